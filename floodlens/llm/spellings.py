"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Words are rows of padded code-point matrices, one aligned left and one aligned right. Two blocks of rows are compared
as a dense tile: column by column from either side, the pairs that still agree are counted, which gives the common
prefix and the common suffix of every pair. Two different words are one insertion, deletion or replacement apart if
their lengths differ by at most one and prefix + suffix reach the longer length minus one.

Which blocks meet: an edit lies behind the first half of the longer word (of L code points) or before its last half, so
near words share their first or their last floor(L / 2) code points. Every word is keyed by both halves, as the longer
word (its own length) and as the shorter (one more). Rows are dealt by key and sorted, and tiles run along them; a key
with more than KEY_ROWS words is dealt as pairs of blocks, so no task holds an unbounded group and no pair is lost. A
pair counts under its shared first half, and under the last half only where the first differs. Tiles return a count and
the best near word for each word, not pairs; these merge by sum and minimum.

Nulls, empties, ties: null and empty texts have no words; a null doc_id reads as the empty text where an id is hashed;
repeated rows count each time; near words of equal counts: the first in code-point order. Very long texts are split
into words on the JVM; for very long words a tile has fewer rows. An empty table gives no words. Only doc_id and text
of documents, word and n of word tables are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from floodlens.session import materialise

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a block, code points of a block's matrix at most, and words of one key that meet in one group.
TILE, TILE_POINTS, KEY_ROWS = 256, 1 << 22, 4096


def _with_deletion(run: Column, doc: Column, every: int) -> Column:
    """The run without its code point h % length where `every` divides h, the CRC-32 of `doc:run`."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, delete_every: int | None = None) -> DataFrame:
    """(word, n): letter runs of whole texts with A-Z lower-cased, of min_chars code points and min_count occurrences or more.

    `delete_every` spoils a fixed share of the (document, run) pairs by one deleted code point, as a test of the grouping.
    Shorter runs cannot give words, so the pattern itself leaves them out.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    if delete_every:
        runs = runs.select(_with_deletion(F.col("run"), F.col("doc"), delete_every).alias("run"))
    counts = runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= min_count) & (F.length("word") >= min_chars))


def _keyed(words: DataFrame) -> DataFrame:
    """(cls, key, word, n): cls is twice the longer word's length, plus one under the last half."""
    size = F.length("word")
    keys = []
    for extra in (0, 1):
        half = F.floor((size + extra) / 2).cast("int")
        for last in (0, 1):
            part = F.col("word").substr(size - half + 1, half) if last else F.col("word").substr(F.lit(1), half)
            cls = (2 * (size + extra) + last).cast("int")
            keys.append(F.struct(cls.alias("cls"), F.xxhash64(cls, part).alias("key")))
    return words.select(F.explode(F.array(*keys)).alias("k"), "word", "n").select("k.*", "word", "n")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left, aligned right (both padded by 0), and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    width = int(sizes.max(initial=0))
    row = np.repeat(np.arange(len(words)), sizes)
    column = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = (np.zeros((len(words), width), np.uint32) for _ in range(2))
    left[row, column] = points
    right[row, column + np.repeat(width - sizes, sizes)] = points
    return left, right[:, ::-1], sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns every row of `a` and every row of `b` share."""
    alive = np.ones((len(a), len(b)), bool)
    shared = np.zeros(alive.shape, np.int32)
    for j in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, j, None] == b[None, :, j]
        if not alive.any():
            break
        shared += alive
    return shared


def near_tile(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair of different words of a and b is one edit apart, and their common prefixes."""
    left_a, right_a, size_a = _matrices(a)
    left_b, right_b, size_b = _matrices(b)
    prefix, longer = _common(left_a, left_b), np.maximum(size_a[:, None], size_b[None, :])
    near = (np.abs(size_a[:, None] - size_b[None, :]) <= 1) & (prefix < longer)
    return near & (prefix + _common(right_a, right_b) >= longer - 1), prefix


class _Rows:
    """Rows in the order of (cls, key, pair), block and word, as columns."""

    NAMES = ("cls", "key", "pair", "block", "n")

    def __init__(self, columns: dict[str, np.ndarray], words: pa.ChunkedArray | pa.Array):
        self.columns, self.words = columns, words

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        return cls({c: batch.column(c).to_numpy(zero_copy_only=False) for c in cls.NAMES}, batch.column("word"))

    def __len__(self) -> int:
        return len(self.columns["key"])

    def joined(self, after: _Rows) -> _Rows:
        words = pa.concat_arrays([self.words, after.words])
        return _Rows({c: np.concatenate([self.columns[c], after.columns[c]]) for c in self.NAMES}, words)

    def part(self, start: int, end: int) -> _Rows:
        return _Rows({c: v[start:end] for c, v in self.columns.items()}, self.words[start:end])

    def groups(self) -> np.ndarray:
        """A number for every run of equal (cls, key, pair)."""
        new = np.zeros(len(self), bool)
        for c in ("cls", "key", "pair"):
            new[1:] |= self.columns[c][1:] != self.columns[c][:-1]
        return np.cumsum(new)


def _tiled(rows: _Rows) -> pa.RecordBatch | None:
    """Near counts and the best near word of the rows' words, from tiles along whole groups."""
    words, group = rows.words.to_pylist(), rows.groups()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    cls, block, n = (rows.columns[c] for c in ("cls", "block", "n"))
    starts, at = [], 0
    while at < len(words):
        starts.append(at)
        widest = int(cls[at:at + TILE].max()) // 2
        at += max(1, min(TILE, TILE_POINTS // max(1, widest)))
    starts.append(len(words))
    left, right = [], []
    for x in range(len(starts) - 1):
        a, b = starts[x], starts[x + 1]
        for y in range(x, len(starts) - 1):
            c, d = starts[y], starts[y + 1]
            if y > x and group[c] != group[b - 1]:
                break
            near, prefix = near_tile(words[a:b], words[c:d])
            i, j = np.nonzero(near)
            p, i, j = prefix[i, j], i + a, j + c
            same = (i < j) & (group[i] == group[j]) & ((p >= cls[i] // 4) == (cls[i] % 2 == 0))
            # in a group made of two blocks only pairs across them count
            same &= (np.maximum(sizes[i], sizes[j]) == cls[i] // 2) & ((rows.columns["pair"][i] < 0) | (block[i] != block[j]))
            left.append(i[same])
            right.append(j[same])
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return None
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    place = np.empty(len(words), np.int64)
    place[pa.compute.sort_indices(rows.words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((place[j], -n[j], i))
    i, j = i[order], j[order]
    own, first, count = np.unique(i, return_index=True, return_counts=True)
    best = j[first]
    return pa.RecordBatch.from_arrays(
        [rows.words.take(pa.array(own)), pa.array(count), pa.array(n[best]), rows.words.take(pa.array(best))],
        ["word", "n_near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        now = _Rows.of(batch)
        if rest is not None:
            now = rest.joined(now)
        if not len(now):
            continue
        group = now.groups()
        last = int(np.searchsorted(group, group[-1]))
        if last and (found := _tiled(now.part(0, last))) is not None:
            yield found
        rest = now.part(last, len(now))
    if rest is not None and len(rest) and (found := _tiled(rest)) is not None:
        yield found


def near_words(words: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of every word of `words` (word, n; distinct words) that has a near word."""
    keyed = _keyed(words)
    crowded = materialise(keyed.groupBy("cls", "key").agg(F.count("*").alias("m")).where(F.col("m") > key_rows), "crowded")
    dealt = keyed.join(crowded, ["cls", "key"], "left").withColumn("g", F.coalesce(F.ceil(F.col("m") / key_rows), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    low, high = F.least("block", "other").cast("long"), F.greatest("block", "other").cast("long")
    # a negative number for a block with itself
    dealt = dealt.withColumn("pair", F.when(low == high, -1 - low).otherwise(low * F.col("g") + high))
    dealt = dealt.select("cls", "key", "pair", "block", "word", "n").repartition("cls", "key", "pair").sortWithinPartitions(
        "cls", "key", "pair", "block", "word")
    found = dealt.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): from (word, form), the end of each chain of forms, by doubling the steps in every round.

    A form's count is a multiple of its word's, so chains are short and have no circles.
    """
    up = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not up.where("moved").isEmpty():
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        up = materialise(up.drop("moved").join(above, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
    return up.select("word", "root")


def spelling_forms(words: DataFrame, ratio: int = 5, key_rows: int = KEY_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `words` (word, n; distinct words).

    `form` is the near word of the largest n, if that n is `ratio` times the word's n or more.
    """
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its word")
    words = materialise(words.select("word", "n"), "words")
    near = words.join(near_words(words, key_rows), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    near = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"),
                                   F.when(has, F.col("best_n")).alias("form_n")), "near")
    roots = _roots(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
