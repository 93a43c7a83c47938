"""Exact nearest neighbours over DataFrames of vectors.

A reference set of checked size is sent to the tasks and searched in blocks, so queries are
not shuffled. A larger one is cut into cells around pivots; bounds from the triangle
inequality (as in the published pivot-partitioned kNN join) tell which cells can hold one of
a query's k nearest. Cells share bins up to a fixed size, so a query meets a bin once however
many of its cells are in reach; large cells and query chunks are split to that size, and every
(bin, block, query chunk) is searched on its own. Copies of one vector are reduced to as many
as can matter, so no group grows with the data. Rows are named by their vectors, and a row's own
reference is left out of the k + 1 nearest.
"""
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from floodlens.operators.sizing import BROADCAST_ROWS
from floodlens.session import materialise

BLOCK_ROWS = 4096
QUERY_ROWS = 512
TILE_ROWS = 32_768     # references in one group of the cells; queries are a quarter of that
BATCH_VALUES = 1 << 20  # of vectors or distances held at once beside a batch
PIVOTS = 128
DIGITS = 9        # squared distances are compared at this precision, so equal ones stay equal
SLACK = 1e-6      # safety margin of the cell bounds against rounding

NEIGHBOURS = T.ArrayType(T.StructType([
    T.StructField("d2", T.DoubleType()), T.StructField("rid", T.StringType()),
    T.StructField("label", T.IntegerType())]))


def squared_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """All squared distances, summed per dimension (no cancellation), rounded."""
    out = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        diff = q[:, j, None] - r[None, :, j]
        out += diff * diff
    return np.round(out, DIGITS)


def nearest_in_block(q, r, k):
    """(query row, reference row, d2) of the k nearest per query; `r` is sorted by id.

    A matrix product gives every distance up to a rounding error; pairs that could be among
    the k nearest within that error are measured exactly.
    """
    found = []
    rr = (r * r).sum(axis=1)
    for lo in range(0, len(q), QUERY_ROWS):
        part = q[lo:lo + QUERY_ROWS]
        qq = (part * part).sum(axis=1)
        near = qq[:, None] + rr[None, :] - 2.0 * (part @ r.T)
        kth = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
        error = 2 * 10.0 ** -DIGITS + 1e-11 * (qq + rr.max())
        rows, cols = np.nonzero((near <= (kth + 2 * error)[:, None]) & np.isfinite(near))
        step = max(1, BATCH_VALUES // max(1, q.shape[1]))      # equal distances can make every pair a candidate
        vals = np.empty(len(rows))
        for at in range(0, len(rows), step):
            diff = part[rows[at:at + step]] - r[cols[at:at + step]]
            vals[at:at + step] = np.round((diff * diff).sum(axis=1), DIGITS)
        order = np.lexsort((cols, vals, rows))
        rows, cols, vals = rows[order], cols[order], vals[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((rows[keep] + lo, cols[keep], vals[keep]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def nearest_in_blocks(q, r, k, block=BLOCK_ROWS):
    """nearest_in_block over any number of references, a block of them at a time."""
    best = (np.empty(0, int), np.empty(0, int), np.empty(0))
    for lo in range(0, len(r), block):
        a, b, v = nearest_in_block(q, r[lo:lo + block], k)
        a, b, v = (np.concatenate(p) for p in zip(best, (a, b + lo, v)))
        order = np.lexsort((b, v, a))
        a, b, v = a[order], b[order], v[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        best = a[keep], b[keep], v[keep]
    return best


def _matrix(column, dims):
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat).reshape(-1, dims)


def _search_broadcast(queries: DataFrame, rows, k: int) -> DataFrame:
    spark = queries.sparkSession
    copies = Counter()
    kept = []
    for r in sorted(rows, key=lambda r: r["rid"]):     # as _first_copies
        copies[same := tuple(r["vec"])] += 1
        if copies[same] <= k:
            kept.append(r)
    rows = kept
    dims = len(rows[0]["vec"]) if rows else 0
    shared = spark.sparkContext.broadcast((
        np.array([r["vec"] for r in rows], dtype=float).reshape(-1, dims),
        np.array([r["rid"] for r in rows], dtype=object), np.array([r["label"] for r in rows], dtype=object)))

    def search(batches):
        ref, ids, labels = shared.value
        for batch in batches:
            n = batch.num_rows
            q = _matrix(batch.column("vec"), dims)
            a, b, v = nearest_in_blocks(q, ref, k)
            offsets = np.searchsorted(a, np.arange(n + 1))
            struct = pa.StructArray.from_arrays(
                [pa.array(v, pa.float64()), pa.array(ids[b], pa.string()), pa.array(labels[b], pa.int32())],
                ["d2", "rid", "label"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "neighbours"])

    schema = T.StructType([*queries.schema.fields, T.StructField("neighbours", NEIGHBOURS)])
    # every query costs a pass over the references, so they are spread over all cores first
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return queries.repartition(tasks).mapInArrow(search, schema)


def _first_copies(vectors: DataFrame, copies: int) -> DataFrame:
    """At most `copies` rows per identical vector, smallest ids first: more can never be chosen."""
    nth = F.row_number().over(W.partitionBy("vec").orderBy("rid"))
    return vectors.withColumn("_nth", nth).where(F.col("_nth") <= copies).drop("_nth")


def _search_cells(queries: DataFrame, refs: DataFrame, k: int, pivots: int, block_rows: int) -> DataFrame:
    spark = queries.sparkSession
    distinct = queries.groupBy("vec").agg(F.min("qid").alias("qid"))
    kept = _first_copies(refs, k)
    centre = np.array([r["vec"] for r in kept.select("vec", F.md5("rid").alias("h")).orderBy("h", "vec")
                      .limit(pivots).collect()], dtype=float)
    dims = centre.shape[1]
    shared = spark.sparkContext.broadcast(centre)

    def place(batches):
        p = shared.value
        for batch in batches:
            d = np.sqrt(squared_distances(_matrix(batch.column("vec"), dims), p))
            cell = d.argmin(axis=1)
            near = d[np.arange(len(d)), cell]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(near, pa.float64())],
                [*batch.schema.names, "cell", "near"])

    schema = T.StructType([*kept.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("near", T.DoubleType())])
    placed = materialise(kept.mapInArrow(place, schema), "knn-cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("far")).collect()
    closest = (placed.withColumn("_r", F.row_number().over(W.partitionBy("cell").orderBy("near")))
               .where(F.col("_r") <= k).select("cell", "near").collect())
    far = np.full(len(centre), -np.inf)
    for s in sizes:
        far[s["cell"]] = s["far"]
    heads = sorted((c["cell"], c["near"]) for c in closest)
    head_cell = np.array([h[0] for h in heads])
    head_near = np.array([h[1] for h in heads])
    # cells that fit share a bin, near ones first; a larger cell has a bin of its own, in blocks
    held = {s["cell"]: s["n"] for s in sizes}
    bin_of, load = np.zeros(len(centre), int), {}
    last = 0
    for c in sorted(held, key=lambda c: (float(((centre[c] - centre[0]) ** 2).sum()), c)):
        if load.get(last, 0) and load[last] + held[c] > block_rows:
            last += 1
        bin_of[c], load[last] = last, load.get(last, 0) + held[c]
    bounds = spark.sparkContext.broadcast((far, head_cell, head_near, bin_of, len(load)))

    def route(batches):
        p = shared.value
        top, cells, nears, own_bin, bins = bounds.value
        step = max(1, BATCH_VALUES // max(1, bins * dims, len(nears)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                d = np.sqrt(squared_distances(_matrix(batch.column("vec"), dims), p))
                # at least `k` references lie within this radius of the query
                upper = d[:, cells] + nears[None, :]
                m = min(k, upper.shape[1])
                radius = np.partition(upper, m - 1, axis=1)[:, m - 1]
                if upper.shape[1] < k:
                    radius[:] = np.inf
                rows, cols = np.nonzero(d - top[None, :] <= radius[:, None] + SLACK)
                rows, cols = np.divmod(np.unique(rows * bins + own_bin[cols]), bins)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cols, pa.int32())],
                                                 [*taken.schema.names, "bin"])

    wanted = materialise(distinct.mapInArrow(
        route, T.StructType([*distinct.schema.fields, T.StructField("bin", T.IntegerType())])), "knn-queries")
    loads = {r["bin"]: r["n"] for r in wanted.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    plan = F.broadcast(spark.createDataFrame(      # one row per bin, at most as many as pivots
        [(b, -(-n // block_rows), max(1, -(-loads.get(b, 0) // max(1, block_rows // 4)))) for b, n in load.items()],
        "bin int, blocks int, chunks int"))
    cells = F.broadcast(spark.createDataFrame([(c, int(bin_of[c])) for c in held], "cell int, bin int"))
    left = (wanted.join(plan, "bin")
            .withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bin", "block", "chunk", "qid", "vec"))
    right = (placed.join(cells, "cell").join(plan, "bin")
             .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("bin", "block", "chunk", "rid", "vec", "label"))

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        names = ["qid", "d2", "rid", "label"]
        r = r.take(pa.array(np.argsort(np.array(r.column("rid").to_pylist(), dtype=object), kind="stable")))
        a, b, v = nearest_in_blocks(_matrix(q.column("vec"), dims), _matrix(r.column("vec"), dims), k)
        near = r.take(pa.array(b))
        return pa.Table.from_arrays([q.column("qid").take(pa.array(a)), pa.array(v, pa.float64()), near.column("rid"),
                                     near.column("label")], names)

    keys = ["bin", "block", "chunk"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        search, "qid string, d2 double, rid string, label int")
    rank = F.row_number().over(W.partitionBy("qid").orderBy("d2", "rid"))
    best = (partial.withColumn("_r", rank).where(F.col("_r") <= k)
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("d2", "rid", "label"))).alias("neighbours")))
    per_vector = distinct.join(best, "qid").select("vec", "neighbours")
    return queries.join(per_vector, "vec")


def nearest(queries: DataFrame, refs: DataFrame, k: int, skip_self: bool = False,
            max_broadcast: int = BROADCAST_ROWS, pivots: int = PIVOTS, block_rows: int = TILE_ROWS) -> DataFrame:
    """Add `neighbours`, the k nearest references in order of (distance, id).

    `queries` holds vec, `refs` holds rid (string), vec and label. With `skip_self` the queries also
    hold qid (string), and a reference is not its own neighbour (rid = qid). Every query is named by
    its vector here, so the result does not depend on the path taken.
    """
    own = [F.col("qid").alias("_own")] if "qid" in queries.columns else []
    named = queries.select(*[c for c in queries.columns if c != "qid"], *own, F.md5(F.to_json("vec")).alias("qid"))
    found = _nearest(named, refs, k + 1 if skip_self else k, max_broadcast, pivots, block_rows)
    if skip_self:
        others = F.filter("neighbours", lambda x: x["rid"] != F.col("_own"))
        found = found.withColumn("neighbours", F.slice(others, 1, k))
    return found.withColumn("qid", F.col("_own")).drop("_own") if own else found


def _nearest(queries, refs, k, max_broadcast, pivots, block_rows):
    refs = refs.select("rid", "vec", F.col("label").cast("int").alias("label"))
    rows = refs.limit(max_broadcast + 1).collect()
    if len(rows) <= max_broadcast:
        return _search_broadcast(queries, rows, k)
    return _search_cells(queries, refs, k, pivots, block_rows)


def mean_distance(neighbours: str = "neighbours"):
    return (F.aggregate(neighbours, F.lit(0.0), lambda s, x: s + F.sqrt(x["d2"]))
            / F.size(neighbours))


def vote(neighbours: str = "neighbours"):
    """Most frequent label among the neighbours; of equally frequent ones the smallest."""
    labels = F.transform(neighbours, lambda x: x["label"])
    tally = F.transform(F.array_distinct(labels), lambda v: F.struct(
        F.size(F.filter(labels, lambda x: x == v)).alias("c"), (-v).alias("minus")))
    return -F.array_max(tally)["minus"]


def knn_classify(test: DataFrame, train: DataFrame, features: list[str], key: list[str], k: int = 5,
                 label: str = "label", **options) -> DataFrame:
    """Add `p`: vote of the k nearest standardised training rows."""
    from floodlens.operators.scaling import fit_scaler
    scaler = fit_scaler(train, features)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    refs = train.select(name.alias("rid"), scaler.vector().alias("vec"), F.col(label).alias("label"))
    queries = test.withColumn("vec", scaler.vector())
    return (nearest(queries, refs, k, **options).withColumn("p", vote().cast("int"))
            .drop("qid", "vec", "neighbours"))
