"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source's documents stand in a seeded order, repeated as often as the target needs. A copy of a document finishes
at virtual time (words of its source up to its end) / (the source's target), and the mix is all that is served until
virtual time 1, when every source has reached its target and the whole budget is spent; what is being served then is
cut at that point. Sorted by virtual finish time, the mix holds the target weights in each of its prefixes.

Nulls, empties, ties: a null text has no words; a null source is a source of its own, the last; documents without words
are in the mix but take nothing; an empty table gives an empty mix; rows that repeat or lack a doc_id are documents of
their own, ordered by size and text. A text may be very long: it is counted and cut whole, and moves twice. Other
columns of the input are left as they are, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from floodlens.llm.common import SPACE, WORD, with_ordinal, word_count
from floodlens.session import materialise

#: Rows wanted in one range of the shuffled order; a row is a few numbers.
CHUNK_ROWS = 1 << 20


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """(source, source_size, target): the budget of all words shared by weight, no target above `repeats` sizes.

    Sources that their share would overfill are held at that limit and the rest is shared again, until none is
    overfilled. A round needs two sums on the driver, and there are no more rounds than times a source is newly held.
    """
    sources = with_ordinal(sized.groupBy("source").agg(F.sum("size").alias("source_size")),
                           [F.col("source").asc_nulls_last()], "__rank")
    of = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("__w", F.get(of, F.col("__rank") % len(weights))).withColumn(
        "__cap", F.lit(repeats) * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        full = F.col("__cap") < F.lit(level) * F.col("__w")
        capped, weight, n = sources.agg(F.sum(F.when(full, F.col("__cap"))), F.sum(F.when(~full, F.col("__w"))), F.count_if(full)).first()
        if n == held or not weight:
            break
        level, held = float(total - (capped or 0)) / float(weight), n
    target = F.when(full, F.col("__cap").cast("double")).otherwise(F.lit(level) * F.col("__w"))
    return sources.select("source", "source_size", target.alias("target"))


def _queued(sized: DataFrame, weights: tuple[int, ...], repeats: int, seed: int) -> DataFrame:
    """`sized` with source_size, target and `before`: words of the source's shuffled order ahead of each document.

    The order is cut into ranges over all its keys, the row number last, so neither one id nor one text on many rows
    makes a range large. Sums run inside ranges, and over one row for each source and range.
    """
    targets = materialise(source_targets(sized, weights, repeats), "targets")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    order = ["source", "digest", "doc_id", "size", "text_hash", "row"]
    ranges = sized.count() // CHUNK_ROWS + 1
    placed = materialise(sized.withColumn("digest", digest).repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id()).drop("digest").withColumn("at", F.monotonically_increasing_id()), "placed")
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("source", "part").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = W.partitionBy("source", "part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    targets = targets.withColumnRenamed("source", "t")
    return placed.join(targets, F.col("source").eqNullSafe(F.col("t"))).select(
        *sized.columns, "source_size", "target", (F.col("start") + F.col("inside")).alias("before"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """One written row for each of `docs`, with a number of its own."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source",
                                   word_count().alias("size"), F.xxhash64("text").alias("text_hash"), *more), "sized")


def _schedule(queued: DataFrame, repeats: int) -> DataFrame:
    """(row, doc_id, taken, finish): what is served up to virtual time 1, in the order of virtual finish times.

    A document that is being served at virtual time 1 gives the words up to there. As the targets share the budget, the
    cut at virtual time 1 is the cut at the budget.
    """
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("ahead", F.col("copy") * F.col("source_size") + F.col("before"))
    left = F.floor("target") - F.col("ahead")
    copies = copies.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    served = copies.where((F.col("taken") > 0) | ((F.col("size") == 0) & (F.col("copy") == 0))).select("row", "doc_id", "text_hash", "taken", F.coalesce(
        (F.col("ahead") + F.col("size")) / F.nullif("target", F.lit(0.0)), F.lit(0.0)).alias("finish"))
    order = ["finish", "doc_id", "text_hash", "row"]
    return materialise(served.repartitionByRange(*order).sortWithinPartitions(*order).drop("text_hash"), "schedule")


def mix_shares(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 9) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the schedule of the mix takes of each document."""
    queued = materialise(_queued(_sized(docs), weights, repeats, seed), "queued")
    taken = _schedule(queued, repeats).groupBy("row").agg(F.sum("taken").alias("taken"))
    return queued.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 9) -> DataFrame:
    """The mix: copies of the rows of `docs` in the order of their virtual finish times, the last of a source cut.

    The columns are those of `docs`; a cut text keeps its first words, and n_chars, where there is one, follows it.
    """
    rows = _sized(docs, F.struct("*").alias("doc"))
    schedule = _schedule(_queued(rows.drop("doc"), weights, repeats, seed), repeats)
    mixed = rows.select("row", "size", "doc").join(schedule, "row")
    spaced = F.regexp_extract_all("doc.text", F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    whole = F.col("taken") >= F.col("size")
    text = F.when(whole, F.col("doc.text")).otherwise(F.array_join(F.slice(spaced, F.lit(1), F.col("taken").cast("int")), ""))
    columns = {c: F.col(f"doc.`{c}`").alias(c) for c in docs.columns}
    columns["text"] = text.alias("text")
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(whole, F.col("doc.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    order = ["finish", "doc_id", "row"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns.values())


SHARES_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('9:' || doc_id) AS d FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
filling AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
         row_number() OVER fill AS pos,
         coalesce(sum(3 * source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         coalesce(sum(w) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM ranked WINDOW fill AS (ORDER BY 3.0 * source_size / w, source)),
levels AS (
  SELECT *, (total - held)::DOUBLE / (weights - gone)::DOUBLE AS level FROM filling),
chosen AS (SELECT pos, level FROM levels WHERE cap >= level * w ORDER BY pos LIMIT 1),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.pos < c.pos THEN l.cap::DOUBLE ELSE c.level * l.w END AS target
  FROM levels l CROSS JOIN chosen c),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.d, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS rounds
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(size, floor(target)::BIGINT - rounds * source_size - before)))::BIGINT AS taken
FROM queued
"""
