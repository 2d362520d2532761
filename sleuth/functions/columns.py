"""Scalar Column helpers.

All helpers return ``pyspark.sql.Column`` expressions that stay inside the
JVM (whole-stage codegen); none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "ISO_PREFIX_RE",
    "SYSLOG_DETECT_RE",
    "SYSLOG_PARSE_RE",
    "SEVERITY_COLOR",
    "SEVERITY_RANK",
    "ZERO_HASH",
    "to_epoch",
    "to_event_ts",
    "normalize_timestamp",
    "safe_json",
    "safe_int",
    "looks_like_json",
    "looks_like_syslog",
    "syslog_fields",
    "sha256_hex",
    "fmt1",
    "clamp10",
    "severity_color",
    "severity_rank",
    "first_non_empty",
    "prefix",
    "icontains",
    "strip_ws",
    "json_quote",
]

# ---------------------------------------------------------------------------
# Fixed values. These must equal the studied tool's behaviour for identical
# results, so they are stated here plainly and in one place.
# ---------------------------------------------------------------------------
# Syslog detection: 3-letter month, day, HH:MM:SS, host, then any non-space.
SYSLOG_DETECT_RE = r"(?U)^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S"
# Syslog parse: time, host, app[pid]: message.
SYSLOG_PARSE_RE = r"(?U)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\[(?:\d+)\]:\s*(.*)$"
# Severity to chart colour; anything else is "gray".
SEVERITY_COLOR = {"critical": "red", "high": "orange", "medium": "gold", "low": "green", "info": "blue"}
# Severity order used for "worst severity" (higher = worse).
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
# First parent hash of a custody chain: 64 zeros.
ZERO_HASH = "0" * 64
# White space removed by Python's str.strip() (the characters for which
# str.isspace() is true).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Only texts that start like an ISO date are parsed as time (Python's
# fromisoformat rejects "12:30" and "2025", Spark's cast accepts them).
ISO_PREFIX_RE = r"^\d{4}-\d{2}-\d{2}"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_event_ts(ts: Column | str) -> Column:
    """ISO text -> TIMESTAMP (UTC session zone), NULL when unparsable."""
    t = _c(ts)
    return F.when(t.rlike(ISO_PREFIX_RE), F.try_to_timestamp(t))


def to_epoch(ts: Column | str) -> Column:
    """ISO text -> epoch seconds (double); 0.0 when it does not parse."""
    parsed = to_event_ts(ts)
    return F.coalesce(F.unix_micros(parsed) / F.lit(1_000_000.0), F.lit(0.0))


def normalize_timestamp(ts: Column | str, as_of: Column) -> Column:
    """Text or numeric time -> TIMESTAMP; offsets are replaced by UTC, not converted.

    Numbers are epoch seconds; unparsable or NULL input yields ``as_of``.
    """
    t = _c(ts)
    number = F.when(F.typeof(t).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$"), t.cast("string").try_cast("double"))
    stripped = F.regexp_replace(t.cast("string"), r"(Z|[+-]\d{2}:?\d{2})$", "")
    as_text = F.when(stripped.rlike(ISO_PREFIX_RE), F.try_to_timestamp(stripped))
    return F.coalesce(F.timestamp_seconds(number), as_text, as_of)


def safe_json(v: Column | str) -> Column:
    """JSON object text -> map<string,string>, empty map on failure."""
    return F.coalesce(
        F.from_json(_c(v), "map<string,string>", {"mode": "PERMISSIVE"}),
        F.create_map().cast("map<string,string>"),
    )


def safe_int(variant: Column, path: str) -> Column:
    """Integer view of a JSON field like Python's ``int(x)`` guarded by a default 0.

    Numbers are truncated toward zero, numeric text must be an integer
    literal ("12.7" -> 0), booleans are 1/0, everything else 0.
    """
    field = F.try_variant_get(variant, path, "variant")
    kind = F.schema_of_variant(field)
    as_text = F.try_variant_get(field, "$", "string")
    as_double = F.try_variant_get(field, "$", "double")
    return (
        F.when(field.isNull(), F.lit(0).cast("bigint"))
        .when(kind == "STRING", F.coalesce(as_text.try_cast("bigint"), F.lit(0).cast("bigint")))
        .when(kind == "BOOLEAN", F.when(as_text == "true", 1).otherwise(0).cast("bigint"))
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), as_double.try_cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
    )


def looks_like_json(v: Column | str) -> Column:
    return F.try_parse_json(_c(v)).isNotNull()


def looks_like_syslog(v: Column | str) -> Column:
    return _c(v).rlike(SYSLOG_DETECT_RE)


def syslog_fields(v: Column | str) -> Column:
    """struct(timestamp, hostname, application, message); unmatched lines keep
    the whole line as message and empty other fields."""
    line = _c(v)
    ok = line.rlike(SYSLOG_PARSE_RE)
    return F.struct(
        F.when(ok, F.regexp_extract(line, SYSLOG_PARSE_RE, 1)).otherwise(F.lit("")).alias("timestamp"),
        F.when(ok, F.regexp_extract(line, SYSLOG_PARSE_RE, 2)).otherwise(F.lit("")).alias("hostname"),
        F.when(ok, F.regexp_extract(line, SYSLOG_PARSE_RE, 3)).otherwise(F.lit("")).alias("application"),
        F.when(ok, strip_ws(F.regexp_extract(line, SYSLOG_PARSE_RE, 4))).otherwise(line).alias("message"),
    )


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_c(c).cast("binary"), 256)


def fmt1(c: Column | str) -> Column:
    """One-decimal text (display only; ties may round differently from Python)."""
    return F.format_string("%.1f", _c(c).cast("double"))


def clamp10(c: Column) -> Column:
    return F.least(F.lit(10.0), c)


def severity_color(sev: Column | str) -> Column:
    m = F.create_map(*[x for k, v in SEVERITY_COLOR.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(sev)), F.lit("gray"))


def severity_rank(sev: Column | str) -> Column:
    m = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(sev)), F.lit(-1))


def first_non_empty(*cols: Column | str, default: str | None = None) -> Column:
    """Python ``a or b or default`` on text columns."""
    parts = [F.nullif(_c(c), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def prefix(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def icontains(haystack: Column | str, needle: Column | str) -> Column:
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(_c(haystack)), F.lower(n))


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: drop leading and trailing white space (no regex)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


# Short escapes of JSON texts.
JSON_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_quote(c: Column | str) -> Column:
    """JSON string literal of a text column, in ASCII: other characters and control
    characters are ``\\uXXXX`` (pairs above U+FFFF); NULL is ``null``."""
    v = _c(c)

    def escaped(run: Column) -> Column:
        units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        return F.when(run.rlike(r"\A[ -~]"), run).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    short = v  # characters that have a short escape
    for ch in ("\\", *(c for c in JSON_ESCAPES if c != "\\")):
        short = F.replace(short, F.lit(ch), F.lit(JSON_ESCAPES[ch]))
    plain = v.rlike(r'\A[ !#-\[\]-~]*\z')
    # else runs of such characters and of the others in turn: work goes by runs, not by characters
    runs = F.regexp_extract_all(short, F.lit(r"([ -~]++|[^ -~]++)"), 1)
    inner = F.when(plain, v).when(v.rlike(r"\A[ -~\x08-\x0A\x0C\x0D]*+\z"), short).otherwise(F.array_join(F.transform(runs, escaped), ""))
    return F.when(v.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))
