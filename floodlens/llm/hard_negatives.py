"""Hard negatives: exact integer scores by Strassen's multiplication, positives and windows by mergeable heaps.

Vectors become integers, and rows are dealt by hash into tiles of about TILE_ROWS candidates and ANCHOR_ROWS anchors.
Each pair of an anchor tile and a candidate tile is one product, by Strassen's recursion on int64 matrices that are
padded with zeros to even sizes; additions are exact (modulo 2^64). Anchors are a stated share of the table, so each
is met with each candidate, in blocks, and both sides of a task are bounded.

First the candidates of an anchor's label: every product leaves the `positives` best in a heap for each anchor. Heaps
of an anchor merge by keeping the best again, which Spark does by a rank limit before and after its exchange. Then all
candidates of other labels: for each anchor and positive a heap of the `negatives` best scores inside the positive's
window, merged alike. Nothing but heaps leaves a product.

Nulls, empties, ties: rows with a null label, vec_id or vector, or a null or non-finite component, take no part; equal
scores go by smaller vec_id; rows equal in all three columns count once; rows of one vec_id that differ are rows of
their own, but not each other's positive. Vectors of different lengths are padded with zeros, so empty ones score 0;
an anchor without positives, or a window without rows, gives no row. Components beyond 2^63 take the nearest long. An
empty table gives none. Only vec_id, embedding and label are read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from floodlens.session import materialise

TILE_ROWS, ANCHOR_ROWS = 2048, 1024
#: Matrices with a side of this or less are multiplied directly.
LEAF = 32
_ME = ["vec_id", "tag"]


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices (modulo 2^64) with seven products of halves instead of eight."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    h, i, j = (n + 1) // 2, (k + 1) // 2, (m + 1) // 2

    def quarters(x, rows, columns):
        whole = np.zeros((2 * rows, 2 * columns), np.int64)
        whole[:x.shape[0], :x.shape[1]] = x
        return whole[:rows, :columns], whole[:rows, columns:], whole[rows:, :columns], whole[rows:, columns:]
    a11, a12, a21, a22 = quarters(a, h, i)
    b11, b12, b21, b22 = quarters(b, i, j)
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers padded with zeros to the longest."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def scores(anchors: pa.Table, rows: pa.Table) -> np.ndarray:
    a, b = matrix(anchors.column("v")), matrix(rows.column("v"))
    width = min(a.shape[1], b.shape[1])  # beyond, one side is zero
    return strassen(a[:, :width], b[:, :width].T.copy())


def first_of_each(group: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k entries of every run of equal numbers."""
    new = np.flatnonzero(np.diff(group, prepend=-1))
    return np.flatnonzero(np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group)))) < k)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def positive_heaps(k: int):
    """For a tile of anchors and one of candidates with their label: the k best other rows of every anchor."""
    def heaps(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("vec_id", pa.int64()), ("tag", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("vec_id")
        ids, tags = _columns(anchors, "vec_id", "tag")
        own, = _columns(rows, "vec_id")
        s = scores(anchors, rows)
        other = ids[:, None] != own[None, :]
        worth = np.where(other, ~s, np.iinfo(np.int64).max)  # the complement turns the order of all longs around
        i, j = np.nonzero(other & (worth <= np.partition(worth, min(k, len(own)) - 1, axis=1)[:, [min(k, len(own)) - 1]]))
        order = np.lexsort((j, worth[i, j], i))
        i, j = i[order], j[order]
        keep = first_of_each(i, k)
        i, j = i[keep], j[keep]
        return pa.Table.from_arrays([pa.array(x) for x in (ids[i], tags[i], own[j], s[i, j])], schema=schema)
    return heaps


def window_heaps(k: int):
    """For a tile of anchors with their positives' windows and one of candidates: the k best of other labels in every window."""
    def heaps(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("vec_id", pa.int64()), ("tag", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("score", pa.int64())])
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("vec_id")
        ids, tags, label = _columns(anchors, "vec_id", "tag", "label")
        own, label_of = _columns(rows, "vec_id", "label")
        low, high = matrix(anchors.column("low")), matrix(anchors.column("high"))
        windows = np.diff(anchors.column("low").combine_chunks().offsets.to_numpy())
        s = scores(anchors, rows)
        inside = np.zeros(s.shape, bool)
        for w in range(low.shape[1]):
            inside |= (windows[:, None] > w) & (s >= low[:, [w]]) & (s <= high[:, [w]])
        i, j = np.nonzero(inside & (label[:, None] != label_of[None, :]))
        order = np.lexsort((j, ~s[i, j], i))
        i, j = i[order], j[order]
        value, found = s[i, j], []
        for w in range(low.shape[1]):
            fit = np.flatnonzero((windows[i] > w) & (value >= low[i, w]) & (value <= high[i, w]))
            fit = fit[first_of_each(i[fit], k)]
            found.append((ids[i[fit]], tags[i[fit]], np.full(len(fit), w, np.int32), own[j[fit]], value[fit]))
        if not found:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], schema=schema)
    return heaps


def integer_rows(embeddings: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v, tag): the rows that take part, each once; tag tells apart rows of one vec_id."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where("vec_id is not null and label is not null and x is not null").where(~odd)
    v = F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return whole.select("vec_id", "label", v.alias("v")).distinct().withColumn("tag", F.xxhash64("label", "v"))


def _tiles(rows: DataFrame, n: int, per_tile: int) -> tuple[DataFrame, int]:
    tiles = max(1, -(-n // per_tile))
    return rows.withColumn("tile", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(tiles)).cast("int")), tiles


def _each(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _best(heaps: DataFrame, keys: list[str], other: str, k: int) -> DataFrame:
    """Merged heaps with each entry's rank from 1."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), other))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchors: Column, label: Column | None = None, scale: int = 256, positives: int = 5,
                   negatives: int = 5, floor_percent: int = 80, tile_rows: int = TILE_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` is a condition on vec_id; `label` an expression over the input's columns (its label by default). A
    negative of a positive has a different label and floor_percent to 100 percent of the positive's score.
    """
    rows = materialise(integer_rows(embeddings, F.col("label") if label is None else label, scale), "vectors")
    chosen = materialise(rows.where(anchors), "anchors")
    dealt, tiles = _tiles(rows, rows.count(), tile_rows)
    dealt = dealt.withColumnRenamed("tile", "rows_tile")
    queries, blocks = _tiles(chosen, chosen.count(), anchor_rows)
    queries = queries.withColumnRenamed("tile", "anchor_tile")
    met = ["anchor_tile", "rows_tile"]

    def tiled(left: DataFrame, keys: list[str], heaps, schema: str) -> DataFrame:
        a = _each(left, "rows_tile", tiles).groupBy(*keys)
        return a.cogroup(_each(dealt, "anchor_tile", blocks).groupBy(*keys)).applyInArrow(heaps, schema)
    found = tiled(queries, ["label", *met], positive_heaps(positives), "vec_id long, tag long, positive_id long, score long")
    best = _best(found, _ME, "positive_id", positives).select(*_ME, F.struct("rank", "positive_id", "score").alias("p"))
    best = best.groupBy(*_ME).agg(F.array_sort(F.collect_list("p")).alias("p"))  # at most `positives` of them
    # floor_percent * p <= 100 * n without overflow: n >= p - floor((100 - floor_percent) * p / 100), whole hundreds first;
    # a negative p has an empty window, as floor_percent * p > 100 * p
    low = F.expr(f"transform(p, x -> if(x.score < 0, {(1 << 63) - 1}, x.score - {100 - floor_percent} * (x.score div 100)"
                 f" - {100 - floor_percent} * (x.score % 100) div 100))")
    windows = materialise(queries.join(best, _ME).withColumns({"high": F.transform("p", lambda x: x["score"]), "low": low}), "windows")
    inside = tiled(windows.drop("p"), met, window_heaps(negatives), "vec_id long, tag long, place int, negative_id long, score long")
    kept = _best(inside, [*_ME, "place"], "negative_id", negatives)
    each = windows.select(*_ME, F.posexplode("p").alias("place", "p"))
    return kept.join(each, [*_ME, "place"]).select(
        F.col("vec_id").alias("anchor_id"), "p.positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))



SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a, rows r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
