"""Ordered computations (running max, rank, prefix sum, quantile) that stay parallel.

A plain window over one session is one task. Here the order is cut into contiguous
chunks: each chunk is finished on its own, and only one row per chunk is ordered globally.
"""
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from floodlens.session import materialise

ARRIVAL_BITS = 17
HASH_DIGITS = 3
MAX_EDGE = 1_000_000


def arrival_chunk(seq: Column, bits: int = ARRIVAL_BITS) -> Column:
    """Contiguous chunk of the arrival order; `seq` is unique, so a chunk has at most 2^bits rows."""
    return F.shiftright(seq, bits)


def running_max(df: DataFrame, keys: list[str], seq: str, value: str, out: str,
                bits: int = ARRIVAL_BITS) -> DataFrame:
    """max(value) over all rows of the same keys up to and including this one in `seq` order."""
    chunked = df.withColumn("_chunk", arrival_chunk(F.col(seq), bits))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (chunked.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
             .select(*keys, "_chunk", F.max("_top").over(before).alias("_carry")))
    inside = W.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return (chunked.withColumn("_run", F.max(value).over(inside))
            .join(carry, [*keys, "_chunk"])
            .withColumn(out, F.greatest("_run", F.coalesce("_carry", "_run")))
            .drop("_chunk", "_run", "_carry"))


def arrival_number(df: DataFrame, keys: list[str], seq: str, out: str,
                   bits: int = ARRIVAL_BITS) -> DataFrame:
    """0-based position of every row within its keys in `seq` order."""
    chunked = df.withColumn("_chunk", arrival_chunk(F.col(seq), bits))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offset = (chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
              .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = W.partitionBy(*keys, "_chunk").orderBy(seq)
    return (chunked.withColumn("_pos", F.row_number().over(inside))
            .join(offset, [*keys, "_chunk"])
            .withColumn(out, F.col("_offset") + F.col("_pos") - 1)
            .drop("_chunk", "_pos", "_offset"))


def global_position(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based position of every row in the global order.

    Rows are dealt to ranges and written, so the ranges stay as they are; one row per range is ordered globally.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialise(ranged.withColumn("_range", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "position")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = numbered.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return numbered.join(starts, "_range").withColumn(out, F.col("_start") + F.col("_row")).drop("_range", "_row", "_start")


def value_buckets(df: DataFrame, value: str, out: str, buckets: int = 256) -> DataFrame:
    """Range bucket of a numeric column; cut points are fixed numbers, so a lost task recomputes
    the same buckets."""
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(value, probabilities, 1 / (4 * buckets))))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    return (Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep")
            .transform(df))


def running_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, str],
                 descending: bool = False) -> DataFrame:
    """Prefix sums in the order of `value` (one row per keys and value).

    `sums` maps an input column to the name of its running total, the row itself included.
    """
    bucketed = value_buckets(df, value, "_bucket")
    step = F.col("_bucket").desc() if descending else F.col("_bucket")
    fine = F.col(value).desc() if descending else F.col(value)
    before = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "_bucket").orderBy(fine).rowsBetween(W.unboundedPreceding, 0)
    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    out = bucketed
    for c in sums:
        out = out.withColumn(f"_r_{c}", F.sum(c).over(inside))
    out = out.join(offsets, [*keys, "_bucket"])
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"_r_{c}") + F.col(f"_o_{c}"))
    return out.drop("_bucket", *[f"_r_{c}" for c in sums], *[f"_o_{c}" for c in sums])


def _swept(queries: DataFrame, events: DataFrame, keys: list[str], at: str, values: list[str], width: int) -> DataFrame:
    """Queries (`_event` 0) and events (1) in one table, with the bucket of `at` that they fall into."""
    both = queries.withColumns({"_event": F.lit(0), **{v: F.lit(None).cast(events.schema[v].dataType) for v in values}}).unionByName(
        events.select(*keys, at, *values, F.lit(1).alias("_event")), allowMissingColumns=True)
    return both.withColumn("_bucket", F.floor(F.col(at) / width))


def sums_before(queries: DataFrame, events: DataFrame, keys: list[str], at: str, values: list[str], width: int) -> DataFrame:
    """`queries` with, for every value, the sum over the events of the same keys whose whole number `at` is smaller.

    Both are swept once in the order of `at`, in buckets of `width`; buckets hand on one row each. So the cost is
    that of queries and events together, however many of them share a key.
    """
    both = _swept(queries, events, keys, at, values, width)
    inside = W.partitionBy(*keys, "_bucket").orderBy(at, "_event").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = both.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values]).select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    local = both.withColumns({f"_r_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).where("_event = 0")
    out = local.join(totals, [*keys, "_bucket"])
    return out.select(*queries.columns, *[(F.col(f"_r_{v}") + F.col(f"_o_{v}")).alias(v) for v in values])


def next_event(queries: DataFrame, events: DataFrame, keys: list[str], at: str, out: str, width: int) -> DataFrame:
    """`queries` with the smallest `at` of an event of the same keys that is greater than their own, or null."""
    both = _swept(queries, events.withColumn(out, F.col(at)), keys, at, [out], width)
    inside = W.partitionBy(*keys, "_bucket").orderBy(F.col(at).desc(), "_event").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    least = both.groupBy(*keys, "_bucket").agg(F.min(out).alias("_least")).select(
        *keys, "_bucket", F.min("_least").over(later).alias("_later"))
    # descending, and at equal places queries come first: what stands before a query is greater
    local = both.withColumn("_next", F.min(out).over(inside)).where("_event = 0")
    return local.join(least, [*keys, "_bucket"]).select(*queries.columns, F.coalesce("_next", "_later").alias(out))


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """Linearly interpolated quantile; only counts per distinct value are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    n = counts.agg(F.sum("_c")).first()[0]
    if not n:
        return None
    rank = (n - 1) * q
    low = int(rank)
    high = min(low + 1, n - 1)
    ranked = running_sums(counts, [], value, {"_c": "_upto"})
    at = ranked.agg(F.min(F.when(F.col("_upto") > low, F.col(value))).alias("low"),
                    F.min(F.when(F.col("_upto") > high, F.col(value))).alias("high")).first()
    return at["low"] + (at["high"] - at["low"]) * (rank - low)


def _edges(counts, quotas):
    """Per group: (prefix holding the last row to keep, rows still wanted in it, rows it holds)."""
    edges = {}
    for g, buckets in counts.items():
        left = quotas[g]
        for prefix in sorted(buckets):
            if left <= buckets[prefix]:
                edges[g] = (prefix, left, buckets[prefix])
                break
            left -= buckets[prefix]
    return edges


def smallest_per_group(df: DataFrame, group: list[str], key: str, quota, max_edge: int = MAX_EDGE) -> DataFrame:
    """Keep, for each group, the rows with the smallest `key` (a unique md5 text).

    `quota(sizes)` maps {group values: size} to {group values: rows wanted}. The fact table is
    never shuffled or ranked as a whole: rows are counted by the first digits of their key, the
    digits where the quota ends are refined until few rows share them, and only those rows are
    ranked to get the last key to keep. The result is a filter against one cut-off per group.
    """
    spark = df.sparkSession

    def count_by(rows, digits):
        found: dict = {}
        per = rows.groupBy(*group, F.substring(key, 1, digits).alias("_p")).agg(F.count("*").alias("_n"))
        for r in per.toLocalIterator():       # at most 16^HASH_DIGITS rows per group
            found.setdefault(tuple(r[c] for c in group), {})[r["_p"]] = r["_n"]
        return found

    counts = count_by(df, HASH_DIGITS)
    sizes = {g: sum(b.values()) for g, b in counts.items()}
    wanted = {g: min(max(q, 0), sizes[g]) for g, q in quota(sizes).items() if g in sizes}
    partial = {g: q for g, q in wanted.items() if 0 < q < sizes[g]}
    edges = _edges({g: counts[g] for g in partial}, partial)
    names = [df.schema[c] for c in group]

    def at_edge(digits):
        table = spark.createDataFrame(
            [(*g, prefix, rest) for g, (prefix, rest, _) in edges.items()],
            T.StructType([*names, T.StructField("_p", T.StringType()), T.StructField("_rest", T.LongType())]))
        return df.withColumn("_p", F.substring(key, 1, digits)).join(F.broadcast(table), [*group, "_p"])

    digits = HASH_DIGITS
    while edges and max(n for _, _, n in edges.values()) > max_edge and digits < 32:
        finer = count_by(at_edge(digits), digits + HASH_DIGITS)
        edges = _edges(finer, {g: rest for g, (_, rest, _) in edges.items()})
        digits += HASH_DIGITS
    last, spare = {}, []
    if edges:
        own = W.partitionBy(*group).orderBy(key)
        edge = at_edge(digits).withColumns({
            "_rank": F.row_number().over(own), "_first": F.rank().over(own),
            "_same": F.count("*").over(W.partitionBy(*group, key))})
        for r in edge.where(F.col("_rank") == F.col("_rest")).collect():
            g = tuple(r[c] for c in group)
            last[g] = r[key]
            if (keep := r["_rest"] - r["_first"] + 1) < r["_same"]:
                spare.append((*g, r[key], keep))
    kept = [(*g, last.get(g)) for g, q in wanted.items() if q > 0]
    cut = spark.createDataFrame(kept, T.StructType([*names, T.StructField("_last", T.StringType())]))
    out = (df.join(F.broadcast(cut), group)
           .where(F.col("_last").isNull() | (F.col(key) <= F.col("_last"))).drop("_last"))
    if not spare:
        return out
    # keys that repeat across the cut: only as many of their rows as the quota leaves, by their other values
    ties = spark.createDataFrame(spare, T.StructType([*names, df.schema[key], T.StructField("_keep", T.LongType())]))
    place = F.row_number().over(W.partitionBy(*group, key).orderBy(F.xxhash64(*[c for c in df.columns if c != key])))
    some = df.join(F.broadcast(ties), [*group, key]).withColumn("_at", place).where(F.col("_at") <= F.col("_keep"))
    return out.join(F.broadcast(ties), [*group, key], "left_anti").unionByName(some.drop("_at", "_keep").select(*out.columns))
