"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, and its repeated runs.

Every document is a sequence of line IDs (hashes of its lines). Round k ranks every block of 2^k lines: pairs of ranks
are sorted over ranges and named in that order, so the ranks order the suffixes as a suffix array does, one level
deeper in every round; blocks that occur once leave. Suffixes with equal first L lines fill an interval of the array
whose least common prefix is L or more, and two overlapping ranks of 2^k lines name that interval. A run of lines is
deleted if it holds `min_words` words or more and occurs earlier. Every such run is the union of its shortest blocks
of `min_words` words that start at, or end at, one of its lines, so two intervals are looked up for each line.

The first copy of each line stays, in the order of (doc_id, text hash, line). The runs found are maximal: neighbouring
deleted lines are reported as one run. Nulls, empties, ties: a null text has no lines and stays null; blank lines are
lines without words; a null doc_id comes first; rows that repeat both doc_id and text are one sequence and are cut
alike. An empty table gives an empty one. Other columns are kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from floodlens.llm.common import WORD
from floodlens.session import materialise

#: A run of repeated lines is deleted from one word on, so single lines are runs too; only blank ones stay.
MIN_WORDS = 1
_DOC = ["__id", "__text"]


def _key(text: str = "text") -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"), F.xxhash64(text).alias("__text")]


def line_table(docs: DataFrame) -> DataFrame:
    """(__id, __text, pos, line, words): the line IDs of every distinct (doc_id, text)."""
    lines = docs.where("text is not null").select(*_key(), F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    return lines.select(*_DOC, "pos", F.xxhash64("t").alias("line"), F.regexp_count("t", F.lit(WORD)).alias("words"))


def _positions(docs: DataFrame, min_words: int) -> DataFrame:
    """The line table with, for each line, the end of the shortest block from it and the start of the one up to it.

    Words before and up to a line grow along a document, so both are found by frames that only ever grow.
    """
    rows = line_table(docs)
    rows = rows.dropDuplicates([*_DOC, "pos"])
    along = W.partitionBy(*_DOC)
    rows = rows.withColumn("upto", F.sum("words").over(along.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    late = along.orderBy(F.col("before").desc())
    after = F.min("pos").over(late.rangeBetween(W.unboundedPreceding, -min_words))
    last, total = F.max("pos").over(along), F.max("upto").over(along)
    ahead = F.max("pos").over(along.orderBy("upto").rangeBetween(W.unboundedPreceding, -min_words))
    rows = rows.withColumns({"end": F.coalesce(after - 1, F.when(total - F.col("before") >= min_words, last)),
                             "start": F.coalesce(ahead + 1, F.when(F.col("upto") >= min_words, F.lit(0))), "last": last})
    return materialise(rows.select(*_DOC, "pos", "line", "start", "end", "last"), "lines")


def _next_level(level: DataFrame, reach: int) -> DataFrame:
    """Ranks of blocks of 2 * reach lines from ranks of blocks of `reach` lines; blocks that occur once are left out."""
    at = W.partitionBy(*_DOC).orderBy("pos").rangeBetween(reach, reach)
    pairs = materialise(level.withColumn("s", F.max("rank").over(at)).where("s is not null").withColumnRenamed("rank", "r"), "pairs")
    twice = pairs.groupBy("r", "s").agg(F.count("*").alias("n")).where("n > 1").select("r", "s")
    ranks = materialise(twice.repartitionByRange("r", "s").sortWithinPartitions("r", "s").withColumn(
        "rank", F.monotonically_increasing_id()), "ranks")
    return materialise(pairs.join(ranks, ["r", "s"]).select(*_DOC, "pos", "rank"), "level")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __text, start, end, last): maximal runs of lines to delete in every document, `last` being its last line."""
    rows = _positions(docs, min_words)
    blocks = rows.where("end is not null").select(*_DOC, F.col("pos").alias("a"), F.col("end").alias("b"), "last").union(
        rows.where("start is not null").select(*_DOC, F.col("start").alias("a"), F.col("pos").alias("b"), "last")).distinct()
    blocks = blocks.withColumn("n", F.col("b") - F.col("a") + 1).withColumn("k", F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int"))
    blocks = materialise(blocks, "blocks")
    deepest = blocks.agg(F.max("k")).first()[0]
    # written first, so that the join's two sides are plain exchanges and a hot line's can be split
    twice = materialise(rows.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "twice")
    level = materialise(rows.join(twice, "line").select(*_DOC, "pos", F.col("line").alias("rank")), "level")
    found = None
    for k in range(0 if deepest is None else deepest + 1):
        if k:
            level = _next_level(level, 1 << k - 1)
        if level.isEmpty():
            break
        ends = level.select(*_DOC, F.col("pos").alias("q"), F.col("rank").alias("y"))
        own = blocks.where(F.col("k") == k).join(level.select(*_DOC, F.col("pos").alias("a"), F.col("rank").alias("x")), [*_DOC, "a"])
        own = own.withColumn("q", F.col("a") + F.col("n") - (1 << k)).join(ends, [*_DOC, "q"]).select(*_DOC, "a", "b", "last", "n", "x", "y")
        found = own if found is None else found.union(own)
    if found is None:
        return blocks.where("false").select(*_DOC, F.col("a").alias("start"), F.col("b").alias("end"), "last")
    found = materialise(found, "intervals")
    first = materialise(found.groupBy("n", "x", "y").agg(
        F.count("*").alias("copies"), F.min(F.struct(*_DOC, "a")).alias("first")).where("copies > 1"), "first")
    later = found.join(first, ["n", "x", "y"]).where(F.struct(*_DOC, "a") != F.col("first")).select(*_DOC, "a", "b", "last")
    along = W.partitionBy(*_DOC).orderBy("a", "b")
    reach = F.max("b").over(along.rowsBetween(W.unboundedPreceding, -1))
    fresh = later.distinct().withColumn("new", F.when(F.coalesce(reach, F.lit(-2)) + 1 < F.col("a"), 1).otherwise(0))
    return fresh.withColumn("run", F.sum("new").over(along)).groupBy(*_DOC, "run").agg(
        F.min("a").alias("start"), F.max("b").alias("end"), F.max("last").alias("last")).drop("run")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with later copies of repeated line runs cut from text (n_chars, where there is one, follows).

    No row is dropped: a document of which every line occurs earlier keeps an empty text.
    """
    runs = repeated_runs(docs, min_words).groupBy(*_DOC).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__runs"), F.max("last").alias("__last"))
    # what lies between the runs: from the end of one to the start of the next
    froms = F.concat(F.array(F.lit(0)), F.transform("__runs", lambda r: r["end"] + 1))
    tos = F.concat(F.transform("__runs", lambda r: r["start"]), F.array(F.col("__last") + 1))
    kept = F.filter(F.arrays_zip(froms.alias("f"), tos.alias("t")), lambda s: s["f"] < s["t"])
    runs = materialise(runs.select(*[F.col(c).alias(f"{c}_of") for c in _DOC], kept.alias("__kept")), "runs")
    marked = docs.select("*", *_key())
    joined = marked.join(runs, (F.col("__id") == F.col("__id_of")) & (F.col("__text") == F.col("__text_of")), "left")
    rest = F.array_join(F.flatten(F.transform("__kept", lambda s: F.slice(F.split("text", "\n"), s["f"] + 1, s["t"] - s["f"]))), "\n")
    out = joined.withColumn("text", F.when(F.col("__kept").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def repeated_line_counts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lines, kept_lines, runs): of every distinct (doc_id, text) row of `docs`, what is deleted.

    `runs` is the list of maximal deleted runs as structs (start, end) of line numbers from 0.
    """
    runs = repeated_runs(docs, min_words).groupBy(*_DOC).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    runs = runs.select(*[F.col(c).alias(f"{c}_of") for c in _DOC], "runs")
    rows = docs.select("doc_id", *_key(), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("lines"))
    lost = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"] + 1)
    return rows.join(runs, (F.col("__id") == F.col("__id_of")) & (F.col("__text") == F.col("__text_of")), "left").select(
        "doc_id", F.col("lines").cast("long").alias("lines"), (F.col("lines") - F.coalesce(lost, F.lit(0))).cast("long").alias("kept_lines"),
        F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")).alias("runs"))
