"""Global order without a single-task window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
The detectors of the studied tool look at neighbouring events of the whole
log, so they need a *global* order that scales:

``sequence``
    range-partition on the order keys, sort inside partitions, number rows
    inside each partition with ``monotonically_increasing_id`` (the high bits
    are the partition index, the low bits the row position), and add the
    per-partition offsets from a frame that has one row per range partition
    (its size is bounded by the partition count, so broadcasting it is safe).
    The frame is persisted right after the numbering so that the count branch
    and the numbered rows see the same rows. With a unique tie-breaker among
    the order keys the numbering is deterministic, so a recomputation after an
    executor loss yields the same sequence.

``halo`` / ``with_lags``
    equal-size buckets of ``B = max(64, ceil(rows / partitions))`` consecutive
    sequence numbers; the last k rows of each bucket are copied into the next
    bucket so that ``lag(..., j <= k)`` inside a bucket equals the global lag.
    Buckets have the same size whatever the key distribution, so a hot agent
    cannot create a straggler; their number is bounded by the partition count.

``running_max``
    prefix maximum over the whole order (gaps-and-islands): a running max
    inside each bucket plus the maximum of all earlier buckets, taken from a
    per-bucket summary (bounded by the bucket count, broadcast).

Per-key windows (``partition_by``) put the keys first in the order and mask
look-backs that cross a key boundary, so skewed keys are split like any other
range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

SEQ = "seq"
MIN_BUCKET = 64  # largest supported look-back
_LOW_BITS = (1 << 33) - 1
def halo_window() -> Window:
    return Window.partitionBy("_wb").orderBy(SEQ)


LAYOUT_COLS = ["_pid", "_loc", "_off", "_total", "_B", "_bkt", "_bpos"]


_PERSISTED: list[DataFrame] = []


def _keep(df: DataFrame) -> DataFrame:
    """Persist a frame that feeds two branches (spill to disk when needed)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(df)
    return df


def release_cache() -> int:
    """Unpersist every frame the operators persisted; returns how many."""
    n = len(_PERSISTED)
    while _PERSISTED:
        _PERSISTED.pop().unpersist()
    return n


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


TARGET_PARTITION_BYTES = 256 * 1024 * 1024
UNKNOWN_SIZE = 1 << 62


def input_bytes(df: DataFrame) -> int:
    """Bytes of the plan's inputs (sum over its leaf relations). Estimates of
    joins or generators can be far off, the leaves are the real volume."""
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()  # no extra optimisation
        total = 0
        for i in range(leaves.size()):
            size = leaves.apply(i).stats().sizeInBytes()
            size = int(size if isinstance(size, int) else size.toString())
            if size < UNKNOWN_SIZE:  # Long.MaxValue-like sizes mean "unknown"
                total += size
        return total
    except Exception:  # noqa: BLE001 - no estimate available (e.g. streaming)
        return 0


def num_partitions(df: DataFrame, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count for the range shuffle: the session's shuffle partitions,
    raised so that a partition holds about ``target_bytes`` by the optimizer's
    size estimate, so the plan scales with the input. The frames with one row per
    partition hold a few numbers each (100 TB: 400,000 rows, some 10 MB)."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    est = input_bytes(df)
    by_size = -(-est // target_bytes) if est > 0 else 0
    return max(1, conf, by_size)


def sequence(
    df: DataFrame,
    order: Sequence[Column | str],
    partition_by: Sequence[str] = (),
    partitions: int | None = None,
    checkpoint: bool = False,
) -> DataFrame:
    """Add ``seq`` = 1-based position in the order (partition_by..., order...).

    Also adds the layout columns ``_bkt`` (bucket), ``_bpos`` (position in
    bucket) and ``_B`` (bucket size) used by ``halo``.
    ``checkpoint=True`` writes the numbered rows to the reliable checkpoint
    directory instead of persisting them (cuts lineage for very long plans).
    """
    keys = [_col(c) for c in (*partition_by, *order)]
    n = partitions or num_partitions(df)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("_mid", mid).select(
        "*",
        F.shiftright(F.col("_mid"), 33).cast("int").alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)).alias("_loc"),
    ).drop("_mid")
    if checkpoint:
        tagged = tagged.checkpoint(eager=True)
    else:
        tagged = _keep(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(everything).alias("_total"),
    ).withColumn("_B", F.greatest(F.lit(MIN_BUCKET).cast("long"), F.ceil(F.col("_total") / F.lit(n)).cast("long")))
    # one row per range partition: size bounded by `n`, safe to broadcast
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn(SEQ, F.col("_off") + F.col("_loc") + 1)
    return out.withColumn("_bkt", F.floor((F.col(SEQ) - 1) / F.col("_B"))).withColumn(
        "_bpos", F.pmod(F.col(SEQ) - 1, F.col("_B"))
    )


def _key_at_least(names: Sequence[str], df: DataFrame, key: Row) -> Column:
    """Rows whose order keys are ``key`` or later (NULL comes first, as in a sort);
    the first key's bound stands alone too, so that the scan can prune by it."""
    bound = F.struct(*[F.lit(key[c]).cast(df.schema[c].dataType).alias(c) for c in names])
    later = F.struct(*names) >= bound
    return later if key[names[0]] is None else (F.col(names[0]) >= F.lit(key[names[0]])) & later


def seek(df: DataFrame, order: Sequence[str], offset: int) -> DataFrame:
    """The rows after the first ``offset`` ones in the order of the named columns,
    which must be unique together; not sorted.

    Only the order keys are range-partitioned. The partitions' row counts and least
    keys (one row each, read by the driver) tell the partition that holds the row
    at ``offset``; that partition's keys alone are sorted to find its key, and the
    rows from that key on are a filter. Runs these two jobs when called.
    """
    keys = df.select(*order)
    ranged = keys.repartitionByRange(num_partitions(df), *order)
    counted = ranged.groupBy(F.spark_partition_id().alias("_pid")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_least"), F.max(F.struct(*order)).alias("_most")
    )
    before = 0
    for part in sorted(counted.collect()):  # by partition number, which follows the order
        if before + part["_n"] > offset:
            break
        before += part["_n"]
    else:
        return df.limit(0)
    most = F.struct(*[F.lit(part["_most"][c]).cast(df.schema[c].dataType).alias(c) for c in order])
    inside = keys.where(_key_at_least(order, df, part["_least"]) & (F.struct(*order) <= most))
    place = F.row_number().over(Window.orderBy(*order))  # the keys of one range partition
    start = inside.withColumn("_place", place).where(F.col("_place") == offset - before + 1).first()
    return df.where(_key_at_least(order, df, start))


MOST_RANGES = 256  # of ``numbered``; each is a branch of an expression
ROWS_A_TASK = 500_000  # that are sorted; fewer spill less


def numbered(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Add ``seq`` = 1-based position in the order of the named columns, like ``sequence``,
    but no row is kept for a second use: whole rows are shuffled once.

    The order keys alone are range-partitioned first, and the partitions' row counts and
    least keys (one row each) are read by the driver, by a job that runs when this is
    called. A row's range and the rows before that range are then known from its keys, and
    rows are numbered range by range. The rows are read twice, so their keys must be the
    same each time; equal keys are in one range and get numbers in any order. Returns the
    number of rows, too."""
    n = num_partitions(df)
    ranged = df.select(*order).repartitionByRange(min(16 * n, MOST_RANGES), *order)
    counted = ranged.groupBy(F.spark_partition_id().alias("_pid")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_least"))
    parts, starts, before = sorted(counted.collect(), key=lambda part: part["_pid"]), [], 0
    for part in parts:
        starts.append(before)
        before += part["_n"]

    def start(lo: int, hi: int) -> Column:
        """The rows before a row's range, which is one of ``parts[lo:hi]``."""
        if hi - lo <= 1:
            return F.lit(starts[lo] if parts else 0).cast("long")
        mid = (lo + hi) // 2
        return F.when(_key_at_least(order, df, parts[mid]["_least"]), start(mid, hi)).otherwise(start(lo, mid))

    x = df.withColumn("_start", start(0, len(parts))).repartition(max(n, before // ROWS_A_TASK), "_start")
    place = F.row_number().over(Window.partitionBy("_start").orderBy(*order))
    return x.withColumn(SEQ, F.col("_start") + place).drop("_start"), before


def drop_layout(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in LAYOUT_COLS or c in ("_wb", "_halo")])


def halo(sdf: DataFrame, k: int) -> tuple[DataFrame, Window]:
    """Copy the last ``k`` rows of every bucket into the next one.

    Returns the frame (with ``_wb`` = window bucket, ``_halo`` = copied row) and
    the window ordered by ``seq`` inside ``_wb``.
    """
    if k > MIN_BUCKET:
        raise ValueError(f"look-back {k} exceeds {MIN_BUCKET}")
    targets = F.when(F.col("_bpos") >= F.col("_B") - k, F.array(F.col("_bkt"), F.col("_bkt") + 1)).otherwise(
        F.array(F.col("_bkt"))
    )
    x = sdf.withColumn("_wb", F.explode(targets)).withColumn("_halo", F.col("_wb") != F.col("_bkt"))
    # as many partitions as the range layout has: the session's default does not follow the data
    return x.repartition(num_partitions(sdf), "_wb"), halo_window()


def key_struct(partition_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in partition_by]) if partition_by else F.lit(0)


def lag_in_key(c: Column | str, j: int, w: Window, partition_by: Sequence[str]) -> Column:
    """``lag(c, j)`` over the global order, NULL when the row j back has another key."""
    v = F.lag(_col(c), j).over(w)
    if not partition_by:
        return v
    same = F.lag(key_struct(partition_by), j).over(w).eqNullSafe(key_struct(partition_by))
    return F.when(same, v)


def has_lag_in_key(j: int, w: Window, partition_by: Sequence[str]) -> Column:
    """True when a row exists j steps back with the same key."""
    k = key_struct(partition_by)
    prev = F.lag(F.struct(k.alias("k"), F.lit(True).alias("p")), j).over(w)
    if not partition_by:
        return F.coalesce(prev["p"], F.lit(False))
    return F.coalesce(prev["p"] & prev["k"].eqNullSafe(k), F.lit(False))


def with_lags(
    sdf: DataFrame,
    lags: dict[str, tuple[Column | str, int]],
    partition_by: Sequence[str] = (),
    flags: dict[str, int] | None = None,
) -> DataFrame:
    """Add look-back columns over the global order of a ``sequence``d frame.

    ``lags`` maps output name -> (column, j); ``flags`` maps output name -> j
    for "a row j back exists in the same key". Halo rows are removed.
    """
    k = max([j for _, j in lags.values()] + list((flags or {}).values()) + [1])
    x, w = halo(sdf, k)
    cols = [lag_in_key(c, j, w, partition_by).alias(name) for name, (c, j) in lags.items()]
    cols += [has_lag_in_key(j, w, partition_by).alias(name) for name, j in (flags or {}).items()]
    return x.select("*", *cols).where(~F.col("_halo")).drop("_wb", "_halo")


def running_max(
    sdf: DataFrame,
    values: dict[str, Column],
    k: int = 1,
    pre: dict[str, Column] | None = None,
) -> DataFrame:
    """For each ``out -> value``: max of ``value`` over all rows up to and
    including the current one in the global order (NULL = no contribution).
    Struct values give "the latest flagged row" when their first field is
    ``seq``.

    ``pre`` are window-derived columns (lags, flags) computed on the halo
    frame first; ``values`` may refer to them; ``k`` is their look-back.
    """
    x, w = halo(sdf, k)
    if pre:
        x = x.select("*", *[c.alias(n) for n, c in pre.items()])
    names = list(values)
    x = x.select("*", *[F.when(~F.col("_halo"), v).alias(f"_v{i}") for i, v in enumerate(values.values())])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.max(f"_v{i}").over(upto).alias(f"_in{i}") for i in range(len(names))]).where(~F.col("_halo"))
    # the window output feeds both the bucket summary and the result: keep it
    # so the halo shuffle runs once (recomputation after a loss is deterministic)
    x = _keep(x)
    summary = x.groupBy("_wb").agg(*[F.max(f"_v{i}").alias(f"_b{i}") for i in range(len(names))])
    earlier = Window.orderBy("_wb").rowsBetween(Window.unboundedPreceding, -1)
    prefix = summary.select("_wb", *[F.max(f"_b{i}").over(earlier).alias(f"_p{i}") for i in range(len(names))])
    # one row per bucket; the bucket count is bounded by the partition count
    res = x.join(F.broadcast(prefix), "_wb", "left")
    res = res.select("*", *[F.greatest(F.col(f"_in{i}"), F.col(f"_p{i}")).alias(n) for i, n in enumerate(names)])
    tmp = [f"_{p}{i}" for i in range(len(names)) for p in ("v", "in", "p")]
    return res.drop(*tmp, "_wb", "_halo")


def with_position(
    df: DataFrame, order: Sequence[Column | str], partition_by: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """1-based position of each row inside its key (``partition_by``) in
    ``order``; a hot key is split over many tasks like any other range."""
    s = sequence(df, order, partition_by)
    w = halo_window()
    x = running_max(s, {"_start": F.when(~F.col("_h1"), F.col(SEQ))}, k=1, pre={"_h1": has_lag_in_key(1, w, partition_by)})
    return drop_layout(x.withColumn(out, F.col(SEQ) - F.col("_start") + 1).drop("_start", "_h1"))
