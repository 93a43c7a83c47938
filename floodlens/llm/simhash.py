"""SimHash near-duplicates: word-shingle fingerprints, linked by pigeonring chains of segments.

Nulls, empties, ties: a null text counts as empty; a text without words has fingerprint zero and is linked like any
other. Equal fingerprints are one node, so any number of copies costs one node. Rows with a null doc_id take part; a
component whose ids are all null has a null component_id. Repeated rows are kept (`near_duplicates`) or reduced to one,
where a row is its doc_id and text (`drop_near_duplicates`). Very long texts are hashed in blocks. Other columns of the input are never read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from floodlens.llm.common import linked_components, spanning_forest
from floodlens.session import materialise

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_BLOCK = 1 << 16
#: Most own rows under one key that meet in one group; a key with more is split into pairs of blocks.
KEY_ROWS = 4096


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's lower-cased word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[width - 1:] or ends[-1:]
    total, digest = len(ends), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        part = ends[at:at + _BLOCK]
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[at:at + _BLOCK], part)), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = 4, seed: int = 42) -> Column:
    """The fingerprint of each text as a signed long."""
    @F.pandas_udf("long")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.fromiter((fingerprint(x, width, seed) for x in batch), np.uint64, len(batch)).view(np.int64))
    return hashed(text)


class Ring:
    """Segments of 64 bits around a ring and the chains two near fingerprints must share.

    With m = max_bits + 1 segments, two fingerprints at most max_bits apart have a segment from which every run of l
    segments differs in at most l * max_bits / m bits: none in the first, and so on. Candidates share the first segment
    and differ in at most `second` bits of the next one; the longer runs are tested before the whole distance is.
    """

    def __init__(self, max_bits: int = 4):
        self.max_bits, self.m = max_bits, max_bits + 1
        edges = [64 * i // self.m for i in range(self.m + 1)]
        self.offset, self.size = edges[:-1], [b - a for a, b in zip(edges, edges[1:])]
        self.budget = [(n + 1) * max_bits // self.m for n in range(self.m)]
        segments = [((1 << w) - 1) << at for at, w in zip(self.offset, self.size)]
        self.runs = np.array([[sum(segments[(i + j) % self.m] for j in range(n + 1)) for n in range(self.m)]
                              for i in range(self.m)], dtype=np.uint64)

    def segment(self, i: int, fp: Column) -> Column:
        i %= self.m
        return F.shiftrightunsigned(fp, self.offset[i]).bitwiseAND(F.lit((1 << self.size[i]) - 1))

    def keys(self, fp: Column) -> Column:
        """Structs (k, probe): a key for each chain start, and from segments of even parity one for each flipped bit.

        Two second segments one bit apart differ in parity, so one side alone has to probe.
        """
        out = []
        for i in range(self.m):
            first, second = self.segment(i, fp), self.segment(i + 1, fp)
            key = F.lit(i << 56) + first * F.lit(1 << 28) + second
            out.append(F.struct(key.alias("k"), F.lit(False).alias("probe")))
            if self.budget[1]:
                for bit in range(self.size[(i + 1) % self.m]):
                    flipped = F.lit(i << 56) + first * F.lit(1 << 28) + second.bitwiseXOR(F.lit(1 << bit))
                    out.append(F.when(F.bit_count(second) % 2 == 0,
                                      F.struct(flipped.alias("k"), F.lit(True).alias("probe"))))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    def near(self, start: np.ndarray, difference: np.ndarray) -> np.ndarray:
        """Which differences keep to the budgets of every longer chain and of the whole ring."""
        fit = np.ones(len(difference), bool)
        for n in range(2, self.m):
            rest = np.flatnonzero(fit)
            fit[rest] = np.bitwise_count(difference[rest] & self.runs[start[rest], n]) <= self.budget[n]
        return fit


def _links(ring: Ring):
    def group_links(key, fp, probe):
        found = []
        # a key's own rows stand ahead of its probes, so only they need partners
        step, rows = 1, np.flatnonzero((key[1:] == key[:-1]) & ~probe[:-1])
        held = 0
        while len(rows):
            difference = fp[rows] ^ fp[rows + step]
            use = rows[ring.near((key[rows] >> 56).astype(np.int64), difference) & (difference != 0)]
            found.append((fp[use].view(np.int64), fp[use + step].view(np.int64)))
            held += len(use)
            if held > 1 << 20:
                found = [spanning_forest(*map(np.concatenate, zip(*found)))]
                held = len(found[0][0])
            step += 1
            rows = rows[rows + step < len(key)]
            rows = rows[key[rows] == key[rows + step]]
        return spanning_forest(*map(np.concatenate, zip(*found))) if held else None

    def search(batches):
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now[1] = now[1].view(np.uint64)
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[last:] for x in now]
            if last and (pair := group_links(*(x[:last] for x in now))):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])
        if rest is not None and len(rest[0]) and (pair := group_links(*rest)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])
    return search


def fingerprint_links(fingerprints: DataFrame, max_bits: int = 4, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints (column fp) at most max_bits apart into the right components.

    Within a group of equal keys only a spanning forest of its near pairs is returned. Keys with more than
    `key_rows` fingerprints are spread over pairs of blocks, so that no group outgrows a task and no pair is lost.
    """
    if not max_bits:
        return fingerprints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    ring = Ring(max_bits)
    keyed = fingerprints.select("fp", F.explode(ring.keys(F.col("fp"))).alias("x")).select("x.k", "fp", "x.probe")
    crowded = materialise(keyed.where("not probe").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > key_rows), "crowded")
    if crowded.isEmpty():
        dealt = keyed.repartition("k").sortWithinPartitions("k", "probe").select("k", "fp", "probe")
    else:
        blocks = F.coalesce(F.ceil(F.col("n") / key_rows), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        dealt = (keyed.join(crowded, "k", "left").withColumn("g", blocks).withColumn("block", own)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
                 .withColumn("pair", F.least("block", "other").cast("long") * F.col("g") + F.greatest("block", "other"))
                 .repartition("k", "pair").sortWithinPartitions("k", "pair").select("k", "pair", "fp", "probe"))
        return dealt.groupBy("k", "pair").applyInArrow(_block_links(ring), "a long, b long")
    return dealt.mapInArrow(_links(ring), "a long, b long")


def _block_links(ring: Ring):
    search = _links(ring)

    def of_group(group: pa.Table) -> pa.Table:
        found = list(search(iter(group.select(["k", "fp", "probe"]).sort_by("probe").combine_chunks().to_batches())))
        return pa.Table.from_batches(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return of_group


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): the smallest doc_id reachable over links of near fingerprints."""
    hashed = materialise(docs.select("doc_id", fingerprint_column(F.col("text"), width, seed).alias("fp")), "simhash")
    nodes = hashed.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    roots = linked_components(fingerprint_links(nodes.select("fp"), max_bits)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, max_bits: int = 4) -> DataFrame:
    """The rows of `docs`, one for each component: the one with the smallest doc_id (null ids last; of rows of one
    doc_id the one of the smallest text hash). Its columns are unchanged. Rows are told apart by doc_id and text, so
    documents that share an id, or have none, are kept or dropped by their own texts; equal rows become one.
    """
    hashed = materialise(docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"),
                                     fingerprint_column(F.col("text"), width).alias("fp")), "simhash")
    nodes = hashed.groupBy("fp").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__text")).alias("first"))
    roots = linked_components(fingerprint_links(nodes.select("fp"), max_bits)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    stays = rooted.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.__id").alias("__id_stays"), F.col("first.__text").alias("__text_stays"))
    kept = docs.join(materialise(stays, "stays"), docs["doc_id"].eqNullSafe(F.col("__id_stays")) & (F.xxhash64(docs["text"]) == F.col("__text_stays")), "left_semi")
    if hashed.groupBy("__id", "__text").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
