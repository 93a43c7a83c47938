"""Seeded global shuffle into shards in two passes, in DataFrame functions only.

The shard of a document depends on its doc_id and the number of shards alone (law `key`): the shard whose seeded hash
with the doc_id is highest. One more shard therefore takes rows only into itself. Inside a shard, pass one scatters the
rows over buckets that fit in memory, by a seeded hash; pass two draws a Fisher-Yates permutation of every bucket.

Nulls, empties, ties: null doc_ids count as one id; a null text has no bytes and the checksum of an empty text; an
empty table gives an empty result; rows that repeat an id share its shard and have slots of their own. Columns of the
input other than those carried are not read, and result columns replace carried ones of the same name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from floodlens.llm.common import text_of
from floodlens.session import materialise

ROW_BYTES = 16


def _weights(n_shards: int, seed: int) -> list[Column]:
    return [F.struct(F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(n_shards)]


def _first_of(weights: list[Column]) -> Column:
    return (F.greatest(*weights) if len(weights) > 1 else weights[0])["s"]


def _scattered(docs: DataFrame, carry: list[str], n_shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    sized = docs.select(*[c for c in carry if c not in ("size", "text_crc32")], "doc_id" if "doc_id" not in carry else F.lit(0).alias("__0"),
                        (F.octet_length(text_of()) + ROW_BYTES).cast("long").alias("size"),
                        F.crc32(text_of()).alias("text_crc32")).drop("__0")
    total = docs.select((F.octet_length(text_of()) + ROW_BYTES).alias("size")).agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (n_shards * bucket_bytes)))
    now, grown = _weights(n_shards, seed), _weights(n_shards + 1, seed)
    return (sized.withColumn("shard", _first_of(now)).withColumn("grown_shard", _first_of(grown))
            .withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "size"), F.lit(buckets))))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 7, carry: tuple[str, ...] = ("doc_id",),
                    bucket_bytes: int = 64 << 20) -> DataFrame:
    """Carried columns with size, text_crc32, law, shard, slot (gapless from 0 in a shard) and grown_shard.

    `bucket_bytes` bounds the text bytes whose rows one bucket holds; rows travel once, to their bucket. Only the
    buckets' row counts are summed ahead of it, a window over the buckets of one shard.
    """
    narrow = "text" not in carry
    rows = _scattered(docs, list(carry), n_shards, seed, bucket_bytes)
    if narrow:
        rows = materialise(rows, "scattered")
    earlier = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n")).select(
        "shard", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    kept = [c for c in rows.columns if c not in ("shard", "__bucket")]
    piles = rows.groupBy("shard", "__bucket").agg(F.array_sort(F.collect_list(F.struct(
        "doc_id", "text_crc32", *[c for c in kept if c not in ("doc_id", "text_crc32")]))).alias("__rows"))
    dealt = piles.sortWithinPartitions("shard", "__bucket").select(
        "shard", "__bucket", F.posexplode(F.shuffle("__rows", seed)).alias("__at", "__row"))
    return dealt.join(starts, ["shard", "__bucket"]).select(
        *[F.col(f"__row.{c}").alias(c) for c in carry if c not in ("size", "text_crc32", "shard", "slot", "grown_shard", "law")],
        F.col("__row.size").alias("size"), F.col("__row.text_crc32").alias("text_crc32"), F.lit("key").alias("law"),
        "shard", (F.col("__start") + F.col("__at")).alias("slot"), F.col("__row.grown_shard").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, seed: int = 7, bucket_bytes: int = 64 << 20) -> None:
    """Writes the whole records as Parquet, one folder for each shard; rows stand in the order of their slots in each file.

    Buckets stay whole in the tasks that permuted them, so the texts travel once.
    """
    out = shard_documents(docs, n_shards, seed, tuple(docs.columns), bucket_bytes)
    out.drop("law", "text_crc32", "grown_shard").sortWithinPartitions(
        "shard", "slot").write.partitionBy("shard").parquet(path)


def written_shards(docs: DataFrame, path: str, n_shards: int = 40, seed: int = 7, bucket_bytes: int = 64 << 20) -> DataFrame:
    """Writes the whole records to `path` and reads doc_id, size, text_crc32, law, shard, slot and grown_shard from there."""
    write_shards(docs, path, n_shards, seed, bucket_bytes)
    types = docs.select("doc_id", "text").schema.add("shard", "integer").add("slot", "long")
    return docs.sparkSession.read.schema(types).parquet(path).select(
        "doc_id", (F.octet_length(text_of()) + ROW_BYTES).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", _first_of(_weights(n_shards + 1, seed)).alias("grown_shard"))
