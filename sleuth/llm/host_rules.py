"""Quality rules judged by host (SQL functions only).

Each document gets counts and a base verdict; rule failures are added up per
host (``source``), a host's failure rate is shrunk towards an empirical beta
prior fitted to all hosts, and the host's verdict is joined back to its
documents.

Repeated words: the words of a text that lie in a 5-word window found twice or
more in it. Windows are compared by 64-bit hash. A text whose windows are all
distinct (one hash set) is done; only the others sort their windows.

Defined results: null or blank text has no words and fails; a null host is one
host of its own; repeated rows count each; an empty table gives no rows; other
columns of the input are carried along unless they clash with an output column,
which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, split_words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5  # shrunk share of failed documents above which a host is refused
SYMBOLS = "#*$%&|<>"


def repeat_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that occur twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    grams = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(g: Column) -> Column:
        # (hash, position) in hash order: equal neighbours are repeats
        tagged = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def hits(s: Column) -> Column:
            n = F.size(s)
            same = lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | ((j + 1 < n) & (F.get(s, j + 1)["h"] == e["h"]))
            pos = F.transform(F.filter(s, lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"])
            return _let(F.array_sort(pos), spans)

        def spans(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(tagged, hits)

    found = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of each document and its base verdict; ``text`` is left out."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *[c for c in docs.columns if c not in (text, *names)],
        _let(
            split_words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
                repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("_w"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    kept = [c for c in counted.columns if c not in ("_w", "n_symbols", "n_dup_lines")]
    out = counted.select(*kept, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures, raw and shrunk failure rate.

    The prior is a beta distribution with the hosts' mean rate and the variance
    between hosts (moments, weighted by documents, less the binomial part); hosts
    that differ no more than by chance all shrink to the common rate.
    """
    hosts = measured.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("host_failed")
    )
    totals = hosts.agg(
        F.sum("host_docs").alias("_n"),
        F.sum("host_failed").alias("_f"),
        F.count(F.lit(1)).alias("_hosts"),
        F.sum(F.col("host_docs") * F.col("host_docs")).alias("_n2"),
        F.sum(F.round(F.col("host_failed") * F.col("host_failed") / F.col("host_docs"), 9).cast("decimal(38,9)")).cast("double").alias("_q"),
    )
    n = F.when(F.col("_n") > 0, F.col("_n"))
    p = F.col("_f") / n
    spread = F.col("_q") - n * p * p  # between hosts, weighted by documents
    effective = n - F.col("_n2") / n
    variance = F.when(effective > 0, (spread - (F.col("_hosts") - 1) * p * (1 - p)) / effective).otherwise(F.lit(0.0))
    strength = F.when(variance > 0, F.greatest(F.lit(1.0), F.least(p * (1 - p) / variance - 1, F.lit(1e6)))).otherwise(F.lit(1e6))
    prior = totals.select(p.alias("p"), strength.alias("s")).first()  # two numbers
    rate = (F.col("host_failed") + F.lit(prior["p"]) * F.lit(prior["s"])) / (F.col("host_docs") + F.lit(prior["s"]))
    return hosts.select("_host", "host_docs", "host_failed", F.round(rate, 9).alias("host_rate"))


def judge(docs: DataFrame, scratch: Scratch, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures of every document with its host's rate and the joint verdict."""
    added = ("host_docs", "host_failed", "host_rate", "kept")
    measured = scratch.write(measures(docs, text).drop(*added), "measures")  # read twice; without texts
    hosts = host_rates(measured, host)
    out = measured.join(hosts, measured[host].eqNullSafe(hosts["_host"]), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    out = judge(docs, Scratch(spark))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed", "host_rate"
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT k, i, hash(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS h
      FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, h) AS c FROM g) WHERE c >= 2),
cov AS (SELECT k, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
        FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM rep) GROUP BY k),
lines AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (k) JOIN lines USING (k) LEFT JOIN cov USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::BIGINT AS host_docs, count(*) FILTER (base_failed)::BIGINT AS host_failed FROM b GROUP BY source),
s AS (SELECT sum(host_docs)::DOUBLE AS n, sum(host_failed)::DOUBLE AS f, count(*) AS hosts, sum(host_docs * host_docs)::DOUBLE AS n2,
             sum(round(host_failed * host_failed / host_docs, 9)::DECIMAL(38, 9))::DOUBLE AS q FROM h),
v AS (SELECT f / n AS p, CASE WHEN n - n2 / n > 0 THEN (q - n * (f / n) * (f / n) - (hosts - 1) * (f / n) * (1 - f / n)) / (n - n2 / n) ELSE 0 END AS var FROM s),
pr AS (SELECT p, CASE WHEN var > 0 THEN greatest(1.0::DOUBLE, least(p * (1 - p) / var - 1, 1e6::DOUBLE)) ELSE 1e6::DOUBLE END AS st FROM v),
r AS (SELECT source, host_docs, host_failed, round((host_failed + p * st) / (host_docs + st), 9) AS host_rate FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= 0.5 AS kept, host_docs, host_failed, host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""

QUERIES = {"op8_host_rules": op8_host_rules}
ORACLES = {"op8_host_rules": OP8_SQL}
