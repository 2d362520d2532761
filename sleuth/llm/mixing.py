"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share ``share`` times all words by weight; a target stops at
``max_passes`` times its source's words, and the excess goes to the others by
weight until none is above (water filling, solved in one ordered pass over the
table of sources).

Schedule: point i of the golden-ratio sequence falls into one source's stretch
of the cumulative weights, so every source turns up evenly; the points of a
source are its slots, ranked in order. A source's documents, shuffled by a hash,
form one stream of words that is read ``max_passes`` times and cut into blocks
of equal size; the slot of rank j takes block j, the last one only as far as
the target reaches. Slots that the points left out come after the others.

Running sums over a source are taken in two levels (within buckets of the
shuffle hash, then over bucket totals), so that no task holds a whole source.

Defined results: a null or blank text has size 0 and takes nothing; null is a
source of its own, the last one; documents with the same id count each, and
equal ids in one source are told apart by text; an empty table gives no rows;
other columns are carried along unless an output column has their name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import SPACE, Scratch, documents, lean

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
BLOCK = 256  # words in a block
SEED = "mix-1"
GOLDEN = 0.6180339887498949
BUCKET_DIGITS = 2  # least number of hexadecimal digits that name a bucket: 256 buckets a source
CELLS = 4096  # equal parts of [0, 1) by which points meet the sources' stretches
SLOT_CHUNK = 4096  # least number of consecutive slots whose ranks one group counts
BUCKET_ROWS = 50_000  # documents in a bucket of the shuffle hash, about


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs (null: 0): places where a word ends."""
    t = F.concat(F.coalesce(text, F.lit("")), F.lit(" "))
    flat = F.translate(t, SPACE, " " * len(SPACE))
    squeezed = F.trim(F.regexp_replace(flat, " {2,}", " "))
    gaps = F.octet_length(squeezed) - F.octet_length(F.translate(squeezed, " ", ""))
    return F.when(squeezed == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def _order(docs: DataFrame, text: str, doc_id: str) -> Column:
    """Shuffle key: a hash of the id; equal ids follow by a hash of the text."""
    tie = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.concat(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{SEED}")).cast("binary")), tie)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """``source, source_size`` -> weight, target, its end in the cumulative
    weights and the number of words to take. One row per source throughout."""
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    cap = F.col("source_size") * F.lit(max_passes)
    filled = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").cast("binary").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(every) * F.lit(share)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward)
    levels = ranked.withColumn("_level", level).withColumn("_open", cap > F.col("weight") * F.col("_level"))
    # the first source in that order that stays below its cap sets the level for all after it
    first = F.min(F.when(F.col("_open"), F.struct(F.col("source_size") / F.col("weight"), F.col("_level").alias("l")))).over(every)["l"]
    target = F.least(cap.cast("double"), F.coalesce(F.col("weight") * first, cap.cast("double")))
    out = levels.withColumn("target", target).withColumn("_words", F.floor(F.col("target") + 0.5).cast("long"))
    share_of = F.col("target") / F.sum("target").over(every)
    upto = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("_hi", F.sum(F.coalesce(share_of, F.lit(0.0))).over(upto))
    out = out.withColumn("_lo", F.coalesce(F.lag("_hi").over(by_name), F.lit(0.0)))
    return out.select("source", "source_size", "weight", "target", "_words", "_lo", "_hi")


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots in order: ``slot, source, rank``. Each source has as many as its
    words to take fill blocks."""
    needs = sources.withColumn("_need", F.ceil(F.col("_words") / F.lit(float(block))).cast("long"))
    sums = needs.agg(F.coalesce(F.sum("_need"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    points = int(sums["n"] * 1.01) + 16 * int(sums["k"])  # two numbers; the points then run past the last need
    at = F.pmod((F.col("slot") + 0.5) * F.lit(GOLDEN), F.lit(1.0))
    chunk = max(SLOT_CHUNK, math.isqrt(points))
    slots = spark.range(points).select(F.col("id").alias("slot"), at.alias("_u")).select(
        "*", F.floor(F.col("slot") / chunk).alias("_chunk"), F.floor(F.col("_u") * CELLS).cast("int").alias("_cell")
    )
    # a stretch takes part in each cell of [0, 1) that it touches: CELLS rows and one per source at most
    touched = F.sequence(F.floor(F.col("_lo") * CELLS).cast("int"), F.least(F.floor(F.col("_hi") * CELLS).cast("int"), F.lit(CELLS - 1)))
    stretch = needs.where("_hi > _lo").select(F.col("source").alias("_source"), "_lo", "_hi", "_need", F.explode(touched).alias("_cell"))
    hit = slots.join(stretch, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    per = hit.groupBy("_source", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_source", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_chunk").orderBy("slot")
    ranked = hit.withColumn("_in", F.row_number().over(inside) - 1)
    b = base.select(F.col("_source").alias("_s2"), F.col("_chunk").alias("_c2"), "_base")
    ranked = ranked.join(b, ranked["_source"].eqNullSafe(b["_s2"]) & (ranked["_chunk"] == b["_c2"]))
    ranked = ranked.select(F.col("_source"), (F.col("_base") + F.col("_in")).alias("_rank"), "slot", "_need").where("_rank < _need")
    wanted = _ranks(spark, needs, int(sums["n"]))
    joined = wanted.join(ranked, wanted["source"].eqNullSafe(ranked["_source"]) & (wanted["rank"] == ranked["_rank"]), "left")
    late = F.lit(points).cast("long") + F.col("rank")  # of the same order on every run
    return joined.select("source", "rank", F.coalesce(F.col("slot"), late).alias("slot"), "_words", "source_size")


def _ranks(spark: SparkSession, needs: DataFrame, total: int) -> DataFrame:
    """``source, rank, _words, source_size`` for each rank below a source's need: the
    numbers below ``total`` are dealt to the sources' stretches of them, chunk by chunk
    (a row for each chunk that a source touches, none for each rank)."""
    chunk = max(SLOT_CHUNK, math.isqrt(total))
    upto = Window.orderBy(F.col("source").cast("binary").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    stretch = needs.withColumn("_off", F.coalesce(F.sum("_need").over(upto), F.lit(0))).where("_need > 0")
    touched = F.sequence(F.floor(F.col("_off") / chunk), F.floor((F.col("_off") + F.col("_need") - 1) / chunk))
    stretch = stretch.select("source", "_words", "source_size", "_off", "_need", F.explode(touched).alias("_chunk"))
    numbers = spark.range(total).select("id", F.floor(F.col("id") / chunk).alias("_chunk"))
    rank = F.col("id") - F.col("_off")
    return numbers.join(stretch, "_chunk").where((rank >= 0) & (rank < F.col("_need"))).select("source", "_words", "source_size", rank.alias("rank"))


def stream(sized: DataFrame, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Add ``_at``: words of the same source before the document in shuffled order."""
    x = sized.withColumn("_bucket", F.substring("_key", 1, digits))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = sized.groupBy("source", F.substring("_key", 1, digits).alias("_bucket")).agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        F.col("source").alias("_s2"), F.col("_bucket").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    x = x.join(base, x["source"].eqNullSafe(base["_s2"]) & (x["_bucket"] == base["_b2"]))
    return x.withColumn("_at", F.col("_at") + F.col("_base")).drop("_base", "_s2", "_b2", "_bucket")


def mix_documents(docs: DataFrame, scratch: Scratch, block: int = BLOCK, max_passes: int = MAX_PASSES, text: str = "text", doc_id: str = "doc_id"):
    """``(documents, pieces)``.

    documents: one row per input row with ``size, source_size, target, taken``, its
    place in the schedule (``first_slot``, the earliest of its slots; null if nothing of
    it is taken) and the number of its ``pieces``.
    pieces: the mix, one row per document part of a slot: ``slot, source, rank,
    doc_id, _key, turn, size, begin, words`` (words ``begin..begin + words - 1`` of the
    text, on reading ``turn`` of its source).
    """
    spark = docs.sparkSession
    sized = scratch.write(
        docs.select(F.col(doc_id).alias("doc_id"), "source", n_words(F.col(text)).alias("size"), _order(docs, text, doc_id).alias("_key")), "sizes"
    )
    sized = _numbered(sized, "size")  # rows alike in id, source and text: each keeps its own place
    sources = scratch.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_passes=max_passes).coalesce(1), "sources")
    digits = max(BUCKET_DIGITS, math.ceil(math.log(max(sized.count(), 1) / BUCKET_ROWS, 16)))
    placed = scratch.write(stream(sized, digits), "placed")
    slots = schedule(spark, sources, block)
    per_source = sources.select(F.col("source").alias("_s"), "source_size", "target", "_words")
    full = placed.join(per_source, placed["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    # places of a document in the stream of passes, then the blocks that each place touches
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_passes - 1)), lambda p: F.col("_at") + p * F.col("source_size"))
    spread = full.where("size > 0").select("doc_id", "source", "_key", "size", F.posexplode(passes).alias("turn", "_from"))
    first, last = F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("size") - 1) / block)
    parts = spread.select("*", F.explode(F.sequence(first, last)).alias("_block"))
    s = slots.select(F.col("source").alias("_s"), "rank", "slot", "_words")
    hits = parts.join(s, parts["source"].eqNullSafe(s["_s"]) & (parts["_block"] == s["rank"]))
    lo = F.greatest(F.col("_from"), F.col("_block") * block)
    hi = F.least(F.col("_from") + F.col("size"), (F.col("_block") + 1) * block, F.col("_words"))
    pieces = hits.select("slot", "source", "rank", "doc_id", "_key", "turn", "size", (lo - F.col("_from")).alias("begin"), (hi - lo).alias("words")).where("words > 0")
    taken = pieces.groupBy("source", "_key").agg(F.sum("words").alias("_taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("_pieces"))
    t = taken.select(F.col("source").alias("_s"), F.col("_key").alias("_k"), "_taken", "first_slot", "_pieces")
    out = full.join(t, full["source"].eqNullSafe(t["_s"]) & (full["_key"] == t["_k"]), "left")
    out = out.select("doc_id", "source", "_key", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
                     "first_slot", F.coalesce("_pieces", F.lit(0)).cast("long").alias("pieces"))
    return out, pieces


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows alike in ``_key`` and source get a number, so that each has its own key."""
    x = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_key", "source").orderBy(order)))
    return x.withColumn("_key", F.concat("_key", F.format_string("-%09d", "_copy"))).drop("_copy")


def _head(text: str):
    """New texts of rows (first column): their first ``words`` words (second) where
    they have more (``size``, third); the row follows."""

    def head(batches):
        import numpy as np
        import pyarrow as pa

        from .words import as_strings, text_chunks, words_of

        for batch in batches:
            rows = batch.column(0)
            if not len(batch):
                continue
            texts = as_strings(rows.field(rows.type.get_field_index(text)))
            wanted, size = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            out: list = [None] * len(batch)
            cut = np.flatnonzero(wanted < size)
            some = texts.take(pa.array(cut))
            for i, j in text_chunks(some):
                chunk = some.slice(i, j - i)
                w, base = words_of(chunk), 0
                for d, t in enumerate(chunk.to_pylist()):
                    raw = t.encode("utf-8", "surrogatepass")
                    n = int(min(wanted[cut[i + d]], w.first[d + 1] - w.first[d]))
                    end = int(w.end[w.first[d] + n - 1]) - base if n else 0
                    out[cut[i + d]] = raw[:end].decode("utf-8", "surrogatepass")
                    base += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), rows], ["new", "row"])

    return head


def mixed_texts(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The mix as documents: a row for each reading of a document, with as many of
    its first words as that reading takes; documents of which none is taken go."""
    _, pieces = mix_documents(docs, scratch, text=text, doc_id=doc_id)
    place = lambda key: F.md5(F.concat(key, F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).cast("binary"))
    turns = pieces.groupBy("source", "_key", "turn").agg(F.sum("words").alias("words"), F.max("size").alias("size"))
    turns = scratch.write(turns.select(place(F.substring_index("_key", "-", 1)).alias("place"), "words", "size"), "turns")
    # rows alike in id, source and text have one place, and as many turns as all of them take;
    # the blocks that a source takes are the first of its stream, so a reading takes the first words
    rows = docs.select(F.struct(*docs.columns).alias("row"), place(_order(docs, text, doc_id)).alias("place"))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("place").orderBy("place"))).where("_n = 1").drop("_n")
    schema = StructType([StructField("new", StringType()), StructField("row", docs.schema)])
    out = once.join(turns, "place").select("row", "words", "size").mapInArrow(lean(_head(text)), schema)
    return out.select(*[F.coalesce("new", F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mix_documents(documents(spark, sf_dir), Scratch(spark))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot", "pieces")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(concat(coalesce(doc_id::VARCHAR, ''), ':mix-1')) || md5(coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(source_size * 2) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT level AS lvl FROM l WHERE 2 * source_size > weight * level ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(weight * (SELECT lvl FROM o), 2.0::DOUBLE * source_size)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS want,
             (sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
need AS (SELECT source, ceil(floor(target + 0.5) / 256.0::DOUBLE)::BIGINT AS need,
                coalesce(target / sum(target) OVER (), 0) AS part, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM t),
ends AS (SELECT *, sum(part) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM need),
stretch AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY pos), 0) AS lo FROM ends),
n AS (SELECT floor(sum(need)::DOUBLE * 1.01::DOUBLE)::BIGINT + 16 * count(*) AS points FROM need),
points AS (SELECT i AS slot, ((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM (SELECT unnest(range(points)) AS i FROM n)),
ranked AS (SELECT pos, slot, row_number() OVER (PARTITION BY pos ORDER BY slot) - 1 AS rank FROM points JOIN stretch ON u >= lo AND u < hi),
slots AS (SELECT x.source, x.rank, coalesce(r.slot, points + x.rank) AS slot
          FROM (SELECT source, pos, unnest(range(need)) AS rank FROM need) x CROSS JOIN n LEFT JOIN ranked r ON x.pos = r.pos AND x.rank = r.rank),
turns AS (SELECT row_number() OVER () AS id, * FROM p),
parts AS (SELECT id, source, size, want, a + turn * source_size AS begin, unnest(range((a + turn * source_size) // 256, (a + turn * source_size + size - 1) // 256 + 1)) AS rank
          FROM turns, (SELECT unnest([0, 1]) AS turn) WHERE size > 0),
pieces AS (SELECT id, slot, least(begin + size, (x.rank + 1) * 256, want) - greatest(begin, x.rank * 256) AS words
           FROM parts x JOIN slots s ON x.rank = s.rank AND x.source IS NOT DISTINCT FROM s.source),
taken AS (SELECT id, sum(words)::BIGINT AS taken, min(slot) AS first_slot, count(*)::BIGINT AS pieces FROM pieces WHERE words > 0 GROUP BY id)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0) AS taken, first_slot, coalesce(pieces, 0) AS pieces
FROM turns LEFT JOIN taken USING (id)
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": OP7_SQL}
