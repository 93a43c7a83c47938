"""Pieces shared by the corpus operators: words, written tables, distributed ordinals and linked components."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from floodlens.session import materialise

#: A word: a run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def with_ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's position (from 0) in the global order; no task holds more than a range of it.

    Rows are range-partitioned and sorted, each range is counted, and the counts' running sum (one row
    per partition) is added. The ranged rows are written first, so the ranges cannot change in between.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ranged.withColumn("__part", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordinal")
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop(
        "__part", "__at", "__start")


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it) for the nodes of the links a[i]-b[i] that are not themselves the smallest."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        if (root[left] == root[right]).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def linked_components(links: DataFrame) -> DataFrame:
    """(a, b) for every linked node a other than its component's smallest node b.

    `links` holds columns a and b. Rounds of linking each node's larger neighbours, then its smaller ones,
    to its smallest neighbour, until every edge points at the smallest node of its component. Each round is
    written to the shared folder; only a count and a checksum reach the driver. Minima are combined before
    the shuffle, and the joins are plain equi-joins that adaptive execution splits at hub nodes.
    """
    edges = materialise(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(large.where("a <> b").distinct(), "large_star")
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = materialise(small.where("a <> b").distinct(), "small_star")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges
