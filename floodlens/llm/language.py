"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts are lower-cased, every run of non-letters becomes one space. ORDER - 1 spaces stand before
each text and one at its end, so no gram spans two texts. Counts of the
highest order are gathered from all learning documents; the lower orders follow from them as continuation counts.
All languages' probabilities stand in sorted arrays of 64-bit gram hashes, in files of hash ranges that the tasks
read: no gram is left out, and the model passes neither the driver nor a closure. A text is given the language of the lowest
cross-entropy for each character; a text whose cross-entropy exceeds what nearly all learning documents of that
language have is marked as rejected.

Nulls, empties, ties: a null text, or one without letters, is `und` with score 0 and not rejected; documents of a null
language are not learned from, but get a prediction; equal cross-entropies go to the first language by code point.
With nothing to learn from, all is `und`. Long texts are counted and scored in blocks. Only doc_id, text and lang are
read; repeated rows count each time.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F

from floodlens.session import materialise, shared_dir

ORDER = 4
#: Rows of a model file, and bytes of model files a Python worker keeps; files beyond that are read again when needed.
FILE_ROWS, KEPT_BYTES = 2_000_000, 256 << 20
#: Distinct grams looked up at once.
_LOOKUP = 1 << 17
_DENSE = 1 << 24
_BLOCK = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, cleaned, and where each begins (and the last ends)."""
    joined = "\n".join((x or "").lower().replace("\n", " ") for x in texts)
    codes = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), "<u4")
    ends = codes == 10
    clean = np.where(_is_letter()[codes] | ends, codes, 32)
    blank = (clean == 32) | ends
    keep = np.ones(len(clean), bool)
    keep[1:] = ~((clean[1:] == 32) & blank[:-1])
    keep[:-1] &= ~((clean[:-1] == 32) & ends[1:])  # none beside an end: the ends themselves are read as spaces
    clean = clean[keep]
    starts = np.flatnonzero(clean == 10)
    clean[starts] = 32
    return clean, starts


def bounded(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols, each text after order - 1 boundary spaces and with one at its end; each symbol's text, or -1.

    A gram belongs to the text of its last symbol, and none spans two texts: boundary symbols, and the ends of texts
    without letters, belong to none. Also the number of symbols that each text has of its own.
    """
    clean, starts = letters(texts)
    n = np.diff(starts)
    counts = np.ones(len(clean), np.int64)
    counts[starts[:-1]] = order
    counts[starts[0]] = order - 1
    owner = np.full(int(counts.sum()), -1)
    begins = np.cumsum(n + order - 1) - n  # the first own symbol of each text
    own = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    owner[own] = np.repeat(np.where(n > 1, np.arange(len(n)), -1), n)
    return np.repeat(clean, counts), owner, n


def _codes(clean: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Small symbols of the block, the symbols' code points, and a code for every n symbols."""
    seen = np.zeros(0x110000, bool)
    seen[clean] = True
    symbols = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[symbols] = np.arange(len(symbols))
    small, grams = place[clean], None
    for i in range(n):
        part = small[i:len(small) - n + 1 + i]
        grams = part.copy() if grams is None else grams * len(symbols) + part
    return grams, symbols, len(symbols)


def _grams(codes: np.ndarray, symbols: np.ndarray, n: int) -> np.ndarray:
    """The code points of gram codes, a row for each."""
    out = np.empty((len(codes), n), np.uint32)
    for i in range(n - 1, -1, -1):
        codes, rest = np.divmod(codes, len(symbols))
        out[:, i] = symbols[rest]
    return out


def _counted(grams: np.ndarray, base: int, n: int, inverse: bool = False):
    if base ** n <= _DENSE:
        counts = np.bincount(grams, minlength=base ** n)
        return np.flatnonzero(counts), counts[counts > 0], grams if inverse else None
    return np.unique(grams, return_counts=True) + (None,) if not inverse else np.unique(grams, return_counts=True)[:2] + (grams,)


def hashes(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(len(grams), np.uint64(grams.shape[1]))
    for i in range(grams.shape[1]):
        h = (h ^ grams[:, i].astype(np.uint64)) * _SPREAD
        h ^= h >> np.uint64(31)
    return h


def _count_batches(order: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang")["text"]:
                clean, owner, _ = bounded(rows.tolist(), order)
                for at in range(0, len(clean) - order + 1, _BLOCK):
                    part = clean[at:at + _BLOCK + order - 1]
                    grams, symbols, base = _codes(part, order)
                    found, n, _ = _counted(grams[owner[at + order - 1:at + order - 1 + len(grams)] >= 0], base, order)
                    if not len(found):
                        continue
                    texts = np.ascontiguousarray(_grams(found, symbols, order)).view(f"<U{order}").ravel()
                    yield pd.DataFrame({"lang": lang, "gram": list(texts), "n": n})
    return count


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all texts; every task sends each gram of a block once."""
    return docs.where("lang is not null and text is not null").select("lang", "text").mapInPandas(
        _count_batches(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, p, rest): interpolated probabilities, and the weight left to the next lower order after that context.

    `gram` of length l < order carries the continuation probability of its last character; `rest` is the back-off
    weight of the gram as a context. Discounts are n1 / (n1 + 2 n2) for each language and order.
    """
    level = materialise(counts.select("lang", "gram", "n"), "grams")
    levels = {order: level}
    for length in range(order - 1, 0, -1):  # continuation counts: distinct characters seen before
        levels[length] = materialise(levels[length + 1].groupBy("lang", F.substring("gram", 2, length).alias("gram")).agg(
            F.count("*").alias("n")), "continuations")
    out, lower = [], None
    for length in range(1, order + 1):
        rows = levels[length].withColumn("context", F.substring("gram", 1, length - 1))
        seen = rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.sum("n").alias("all"),
                                        F.count("*").alias("kinds"))
        seen = seen.withColumn("d", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0)), F.lit(0.5)))))
        if length == 1:
            p = (F.col("n") - F.col("d")) / F.col("all") + F.col("d") * F.col("kinds") / F.col("all") / F.lit(65536.0)
            now = rows.join(seen, "lang").select("lang", "gram", p.alias("p"))
            contexts = seen.select("lang", F.lit("").alias("gram"), (F.col("d") * F.col("kinds") / F.col("all")).alias("rest"))
        else:
            contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("c"), F.count("*").alias("followers")).join(
                seen.select("lang", "d"), "lang").select("lang", "context", "c", "d", (F.col("d") * F.col("followers") / F.col("c")).alias("rest"))
            now = rows.join(contexts, ["lang", "context"]).withColumn("tail", F.substring("gram", 2, length - 1)).join(
                lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q")), ["lang", "tail"], "left")
            q = F.coalesce("q", F.lit(1 / 65536.0))
            now = now.select("lang", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("c") + F.col("rest") * q).alias("p"))
            contexts = contexts.select("lang", F.col("context").alias("gram"), "rest")
        lower = materialise(now, "probabilities")
        out.append(lower.select("lang", "gram", "p", F.lit(None).cast("double").alias("rest")))
        out.append(contexts.select("lang", "gram", F.lit(None).cast("double").alias("p"), "rest"))
    model = out[0]
    for part in out[1:]:
        model = model.unionByName(part)
    return materialise(model.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.max("rest").alias("rest")), "model")


def _gram_hashes(grams: pd.Series) -> np.ndarray:
    """Signed hashes of gram strings of any lengths."""
    size = grams.str.len().to_numpy()
    out = np.zeros(len(grams), np.int64)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        codes = np.frombuffer("".join(grams.iloc[own]).encode("utf-32-le"), "<u4").reshape(len(own), n)
        out[own] = hashes(codes).view(np.int64)
    return out


def write_model(model: DataFrame, name: str = "language_model") -> tuple[list[str], list[tuple[str, int, int]]]:
    """Writes the model into files of hash ranges, sorted by language and hash: (languages, (path, least, largest hash)).

    Every gram is kept, however many there are; the driver sees one row for each language and each file.
    """
    langs = sorted(r[0] for r in model.select("lang").distinct().collect())
    hashed = F.pandas_udf(lambda grams: pd.Series(_gram_hashes(grams)), "long")
    place = (F.array_position(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), F.col("lang")) - 1).cast("int")
    rows = model.select(place.alias("lang"), hashed("gram").alias("h"), F.log("p").cast("float").alias("p"), F.log("rest").cast("float").alias("rest"))
    path = shared_dir(model.sparkSession, name)
    rows.repartitionByRange(model.count() // FILE_ROWS + 1, "h").sortWithinPartitions("lang", "h").write.parquet(path)
    files = model.sparkSession.read.parquet(path).groupBy(F.input_file_name().alias("path")).agg(F.min("h"), F.max("h")).collect()
    return langs, sorted(tuple(r) for r in files)


_kept: dict[str, tuple] = {}


def _read_file(path: str) -> tuple:
    """A model file's columns; those read last stay in the worker, up to KEPT_BYTES."""
    if path in _kept:
        _kept[path] = _kept.pop(path)
        return _kept[path]
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    read = pq.read_table(inner, filesystem=system, columns=["lang", "h", "p", "rest"])
    columns = tuple(c.to_numpy() for c in read.columns)
    while _kept and sum(c.nbytes for own in (*_kept.values(), columns) for c in own) > KEPT_BYTES:
        del _kept[next(iter(_kept))]
    _kept[path] = columns
    return columns


class Scorer:
    """Sorted hash arrays of every language, in memory or in files, and cross-entropies of texts."""

    def __init__(self, model: pd.DataFrame | tuple, order: int):
        self.order = order
        if isinstance(model, tuple):
            self.langs, self.files = model
            return
        self.langs = sorted(model["lang"].unique())
        lang = np.searchsorted(np.array(self.langs, object), model["lang"].to_numpy(object)) if len(model) else np.zeros(0, np.int64)
        h = _gram_hashes(model["gram"]) if len(model) else np.zeros(0, np.int64)
        by = np.lexsort((h, lang))
        self.own = tuple(x[by] for x in (lang, h, *[np.log(model[c].to_numpy(np.float64)).astype(np.float32) for c in ("p", "rest")]))
        self.files = [(None, np.iinfo(np.int64).min, np.iinfo(np.int64).max)]

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities and back-off weights of sorted hashes, a row for each language; unknown ones are NaN."""
        p = np.full((len(self.langs), len(wanted)), np.nan, np.float32)
        rest = p.copy()
        for path, least, largest in self.files:
            a, b = np.searchsorted(wanted, least), np.searchsorted(wanted, largest, "right")
            if a == b:
                continue
            lang, h, own_p, own_rest = self.own if path is None else _read_file(path)
            cuts = np.searchsorted(lang, np.arange(len(self.langs) + 1))
            for j, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if s < e:
                    at = np.minimum(np.searchsorted(h[s:e], wanted[a:b]), e - s - 1)
                    hit = h[s:e][at] == wanted[a:b]
                    p[j, a:b] = np.where(hit, own_p[s:e][at], p[j, a:b])
                    rest[j, a:b] = np.where(hit, own_rest[s:e][at], rest[j, a:b])
        return p, rest

    def _log_ps(self, grams: np.ndarray) -> np.ndarray:
        """A row for each language: log probability of each gram's last character after the others.

        The longest known gram counts, after the back-off weights of the contexts that were too long.
        """
        k, m = self.order, len(grams)
        tails = [hashes(grams[:, k - n:]).view(np.int64) for n in range(k, 0, -1)]
        heads = [hashes(grams[:, k - n:k - 1]).view(np.int64) for n in range(k, 0, -1)]
        wanted, place = np.unique(np.concatenate(tails + heads), return_inverse=True)
        place = place.reshape(2 * k, m)
        p, rest = self._find(wanted)
        out = np.zeros((len(self.langs), m))
        for j in range(len(self.langs)):
            open_ = np.arange(m)
            for level in range(k):
                found = p[j, place[level, open_]]
                known = ~np.isnan(found)
                out[j, open_[known]] += found[known]
                open_ = open_[~known]
                out[j, open_] += np.nan_to_num(rest[j, place[k + level, open_]], nan=0.0)
            out[j, open_] += np.log(1 / 65536.0)
        return out

    def log_ps(self, grams: np.ndarray) -> np.ndarray:
        parts = [self._log_ps(grams[at:at + _LOOKUP]) for at in range(0, len(grams), _LOOKUP)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(self.langs), 0))

    def log_p(self, lang: str, grams: np.ndarray) -> np.ndarray:
        return self.log_ps(grams)[self.langs.index(lang)]

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text and a column for each language, and the texts' scored characters."""
        clean, owners, n = bounded(texts, self.order)
        sums, k = np.zeros((len(texts), len(self.langs))), self.order
        for at in range(0, max(0, len(clean) - k + 1), _BLOCK):
            part = clean[at:at + _BLOCK + k - 1]
            grams, symbols, base = _codes(part, k)
            owner = owners[at + k - 1:at + k - 1 + len(grams)]  # of the last character
            grams, owner = grams[owner >= 0], owner[owner >= 0]
            if not len(grams):
                continue
            found, _, _ = _counted(grams, base, k, True)
            dense = base ** k <= _DENSE
            place = None if dense else np.searchsorted(found, grams)
            cut = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
            rows = _grams(found, symbols, k)
            for j, p in enumerate(self.log_ps(rows).astype(np.float32)):  # alike for every way below
                if dense:
                    table = np.zeros(base ** k, np.float32)
                    table[found] = p
                    each = table[grams]
                else:
                    each = p[place]
                np.add.at(sums[:, j], owner[cut], np.add.reduceat(each, cut, dtype=np.float64))
        return -sums / np.maximum(n, 1)[:, None], n


_SHARPNESS = 50
_SCORED = "doc_id long, learned boolean, lang_pred string, score double, cross_entropy double"


def _score_batches(model: tuple, order: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model, order)
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.iloc[at:at + 500]
                entropy, n = scorer.cross_entropies(rows["text"].tolist())
                known = n > 1
                if not scorer.langs:
                    known[:] = False
                    entropy = np.zeros((len(rows), 1))
                best = entropy.argmin(axis=1)
                low = entropy.min(axis=1)
                weight = np.exp((low[:, None] - entropy) * np.minimum(n, _SHARPNESS)[:, None]).sum(axis=1)
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"].astype("Int64"), "learned": rows["learned"],
                    "lang_pred": [scorer.langs[b] if k else "und" for b, k in zip(best, known)],
                    "score": np.where(known, 1 / weight, 0.0), "cross_entropy": np.where(known, low, np.nan)})
    return score


def identify_languages(docs: DataFrame, learns: Column, order: int = ORDER, reject_share: float = 0.001) -> DataFrame:
    """(doc_id, learned, lang_pred, score, cross_entropy, rejected) of every document.

    `learns` marks the documents to learn from. `score` is the language's share of the likelihood of 50 characters.
    `rejected`: above the cross-entropy that all but `reject_share` of the learning documents predicted alike keep to.
    """
    model = write_model(kneser_ney(gram_counts(docs.where(learns), order), order))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learns & F.col("lang").isNotNull(), F.lit(False)).alias("learned")).mapInPandas(
        _score_batches(model, order), _SCORED)
    scored = materialise(scored, "languages")
    # one row for each language that was learned
    limits = scored.where("learned").groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 1 - reject_share, 10000).alias("limit"))
    return scored.join(F.broadcast(limits), "lang_pred", "left").select(
        "doc_id", "learned", "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(False)).alias("rejected"))
