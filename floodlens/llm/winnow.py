"""Document fingerprints by winnowing, and their likeness to an edited text and to the next document.

Rolling hashes of every `k` code points are taken, the smallest of every `window` consecutive ones is selected (the
rightmost at ties) and kept with its position, so that any passage of window + k - 1 code points that two texts share
gives a common selection. A text of fewer than `k` code points selects the hash of its whole.

Nulls, empties, ties: a null text is empty; an empty text selects nothing, has the empty fingerprint and likeness 1 to
another empty one and 0 to any other. A null doc_id comes after all others. Rows that repeat a doc_id follow each
other by their texts. Long texts are hashed in blocks. Other columns of the input are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from floodlens.llm.common import text_of, with_ordinal

K, WINDOW = 12, 32
#: Ranges that documents are dealt to, at most: beyond, the ranges are longer. It bounds the ids sent to the tasks.
RANGES = 20_000
_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Winnower:
    def __init__(self, k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        self.powers = np.multiply.accumulate(np.full(4096, _BASE))
        inverse = pow(int(_BASE), -1, 1 << 64)
        self.inverses = np.multiply.accumulate(np.full(4096, np.uint64(inverse)))

    def _grams(self, codes: np.ndarray) -> np.ndarray:
        """32-bit hashes of every k code points, from one running sum of codes times powers of the base."""
        n = len(codes)
        if n + 1 > len(self.powers):
            inverse = pow(int(_BASE), -1, 1 << 64)
            self.powers = np.multiply.accumulate(np.full(n + 1, _BASE))
            self.inverses = np.multiply.accumulate(np.full(n + 1, np.uint64(inverse)))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        width = min(self.k, n)
        h = (sums[width:] - sums[:-width]) * self.inverses[: n + 1 - width]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h >> np.uint64(32)

    def _select(self, grams: np.ndarray, first: int) -> np.ndarray:
        """Keys hash * 2^32 + (2^32 - 1 - position) of the selected grams: least hash, then rightmost."""
        at = np.arange(first, first + len(grams), dtype=np.uint64)
        low = (grams << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at)
        width, span = min(self.window, len(grams)), 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span:])
        return low[np.flatnonzero(np.diff(low, prepend=~low[:1]))]

    def selections(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the selected grams, by position."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        step, reach = _BLOCK, self.k + self.window - 2
        keys = np.concatenate([self._select(self._grams(codes[at:at + step + reach]), at)
                               for at in range(0, max(1, len(codes) - reach), step)])
        keys = keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]
        return (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64), (keys >> np.uint64(32)).astype(np.uint32)

    def fingerprint(self, text: str) -> np.ndarray:
        return np.unique(self.selections(text)[1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sorted sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def selections_column(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Positions and hashes of each text's selected grams, as an array of structs (position, hash)."""
    @F.udf("array<struct<position:long,hash:long>>", useArrow=True)
    def selected(x):
        at, h = Winnower(k, window).selections(x or "")
        return list(zip(at.tolist(), h.tolist()))
    return selected(text)


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _walk(k: int, window: int):
    """Over a range in order: each row is met by the one after it; a range ends with the next range's first row."""
    def hexed(marks: np.ndarray) -> str:
        return marks.astype(">u4").tobytes().hex()

    def walk(batches):
        w, held = Winnower(k, window), None
        for batch in batches:
            rows = []
            for doc_id, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                now = (doc_id, text, w.fingerprint(text), ahead)
                if held and not held[3]:
                    own, third = held[1], len(held[1]) // 3
                    edited = own[: len(own) - third] + text[:third]
                    marks = w.fingerprint(edited) if third else held[2]
                    rows.append((held[0], len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                 hexed(held[2]), hexed(marks), likeness(held[2], marks), likeness(held[2], now[2])))
                held = now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) if n != "doc_id" else pa.array(x, pa.int64())
                                                  for n, x in zip(_NAMES, zip(*rows))], _NAMES)
    return walk


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW, range_rows: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited form, with the likeness to that form and to the next document.

    The edited form has its last floor(n/3) code points replaced by as many from the front of the next document, in
    descending doc_id; the first follows the last. Documents are dealt once, to ranges of about `range_rows` (or
    more, so that there are no more than RANGES) in that order; every range's first document also goes to the end of the range before it. Only those first ids, one
    for each range, reach the driver.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low))
    ranked = with_ordinal(docs.select(key.alias("k")), [F.col("k").desc()], "at")
    range_rows = max(range_rows, -(-ranked.count() // RANGES))
    cuts = np.array(sorted({r[0] for r in ranked.where(F.col("at") % range_rows == 0).select("k").collect()}), np.int64)
    if not len(cuts):
        return spark.createDataFrame([], _OUT)
    n = len(cuts)

    @F.pandas_udf("array<int>")
    def ranges(keys):
        """The range of a row, and where it opens a range also the one before, as a lookahead (marked by -1 - range)."""
        import pandas as pd
        at = np.searchsorted(cuts, keys.to_numpy(), "left")  # cuts ascend, ranges descend
        own = n - 1 - np.minimum(at, n - 1)
        opens = cuts[np.minimum(at, n - 1)] == keys.to_numpy()
        return pd.Series([[o, -1 - (o - 1) % n] if x else [o] for o, x in zip(own.tolist(), opens)])

    dealt = docs.select("doc_id", key.alias("k"), text_of().alias("text"), F.explode(ranges(key)).alias("r"))
    ahead = F.col("r") < 0
    dealt = dealt.select("doc_id", "k", "text", ahead.alias("ahead"), F.when(ahead, -1 - F.col("r")).otherwise(F.col("r")).alias("r"))
    return (dealt.repartitionById(n, F.col("r")).sortWithinPartitions("ahead", F.col("k").desc(), F.xxhash64("text"))
            .select("doc_id", "text", "ahead").mapInArrow(_walk(k, window), _OUT))
