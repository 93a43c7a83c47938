"""Toxicity by classifier chains over word and word-stem features.

The categories are predicted in a fixed order by linear models; each sees, besides the features, the probabilities of
the categories before it. Those were predicted out of fold when the later models were trained, so that they are as
uncertain then as they are for new texts. A category's threshold is the least that keeps all but a small share of the
rows outside it, read from the same predictions out of fold.

Nulls, empties, ties: a null or empty text has no features and gets the models' base rates; labelled rows without a
text or with a null in a category are not learned from; a doc_id labelled twice counts twice; a category with one class
only gets that class's constant probability; an empty label table gives probability 0 everywhere. Texts are read whole,
however long. Columns of `docs` are kept; result columns replace those of the same name.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from floodlens.llm.common import with_ordinal
from floodlens.session import materialise

#: category -> condition on the label columns, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
#: Size of the models: features, the most telling ones over all labelled rows; and parts for predictions out of fold.
FEATURES, FOLDS = 1024, 5
#: Features that a task counts, or words that it remembers, before it passes them on or starts anew.
REMEMBERED = 200_000
#: Rows that a task holds in a fit: each pass of a fit moves one gradient for each task, however few rows it has.
ROWS_A_TASK = 20_000
#: Bits for each label, and most bits (8 MB), of the map of hashed ids that keeps unlabelled texts out of the exchange.
BITS_A_LABEL, MOST_BITS = 16, 1 << 26
#: Ridge penalty of the scaled features; recall out of fold on the learning rows decided between settings (README).
RIDGE = 3e-2
#: Share of the labelled rows outside a category that may reach its threshold out of fold, and the least threshold.
CLEAN_SHARE, LEAST = 0.005, 0.1
STEMS = (4, 5, 6)
_WORDS = re.compile(r"\w+")


def word_features(word: str) -> tuple[str, ...]:
    """The word, and as `stem*` its first 4, 5 and 6 characters."""
    return (word, *[f"{word[:n]}*" for n in STEMS if len(word) > n])


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def _distinct_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A text's words once each: its features are the same, and it is much shorter."""
    for texts in batches:
        yield texts.map(lambda text: " ".join(sorted(words_of(text))))


def _counts(categories: list[str], most: int = REMEMBERED):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict[str, int] = {}  # feature -> its row of `seen`
        known: dict[str, tuple[int, ...]] = {}  # word -> rows of its features
        seen = np.zeros((0, 1 + len(categories)), np.int64)

        def table():
            return pd.DataFrame({"feature": pd.Series(list(number), dtype=object), **{c: seen[:, i] for i, c in enumerate(("n", *categories))}})
        for batch in batches:
            marks, at = batch[categories].to_numpy(np.int64), []
            for text in batch["text"]:
                found: set[int] = set()
                for w in words_of(text):
                    own = known.get(w)
                    if own is None:
                        own = known[w] = tuple(number.setdefault(f, len(number)) for f in word_features(w))
                    found.update(own)
                at.append(np.fromiter(found, np.int64, len(found)))
            seen = np.concatenate([seen, np.zeros((len(number) - len(seen), seen.shape[1]), np.int64)])
            flat, row = np.concatenate([*at, np.zeros(0, np.int64)]), np.repeat(np.arange(len(at)), [len(x) for x in at])
            seen[:, 0] += np.bincount(flat, minlength=len(seen))
            for i in range(len(categories)):
                seen[:, i + 1] += np.bincount(flat[marks[row, i] > 0], minlength=len(seen))
            if len(number) > most:
                yield table()
                number.clear()
                known.clear()
                seen = seen[:0]
        yield table()
    return count


def choose_features(labelled: DataFrame, categories: list[str], most: int) -> list[str]:
    """The features most unevenly spread between a category's two classes, as many for each category."""
    total = labelled.agg(F.count("*"), *[F.sum(c) for c in categories]).first()
    counts = labelled.select("text", *categories).mapInPandas(_counts(categories), "feature string, n long, " + ", ".join(f"{c} long" for c in categories))
    counts = materialise(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *categories)]).where("n >= 3"), "features")
    chosen: set[str] = set()
    for i, c in enumerate(categories):
        rows, hits = total[0], total[i + 1] or 0
        if 0 < hits < rows:
            expected = F.col("n") * hits / rows
            strength = F.abs(F.col(c) - expected) / F.sqrt(expected * (1 - hits / rows))
            chosen.update(r[0] for r in counts.orderBy(strength.desc(), "feature").select("feature").limit(most // len(categories)).collect())
    return sorted(chosen)


class Chain:
    """The fitted models: for each category, weights of the features, of the earlier categories, and an intercept."""

    def __init__(self, categories: list[str], features: list[str]):
        self.categories, self.models, self.thresholds = categories, [], {}
        self.place = {f: i for i, f in enumerate(features)}

    def add(self, weights: np.ndarray, intercept: float):
        self.models.append((np.asarray(weights), intercept))

    def places(self, texts) -> Iterator[set[int]]:
        """Of every text, the numbers of the features that are in it."""
        place, remembered = self.place, {}
        for text in texts:
            found: set[int] = set()
            for w in words_of(text):
                own = remembered.get(w)
                if own is None:
                    if len(remembered) > REMEMBERED:
                        remembered.clear()
                    own = remembered[w] = tuple(place[f] for f in word_features(w) if f in place)
                found.update(own)
            yield found

    def predict(self, texts) -> np.ndarray:
        n = len(self.place)
        out = np.zeros((len(texts), len(self.categories)))
        for i, found in enumerate(self.places(texts)):
            at = np.fromiter(found, np.int64, len(found))
            for c, (weights, intercept) in enumerate(self.models):
                z = intercept + weights[at].sum() + weights[n:n + c] @ out[i, :c]
                out[i, c] = _sigmoid(z)
        return out


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _fit(rows: DataFrame, size: int, earlier: list[str], category: str):
    """(weights, intercept, model) of a logistic regression; a constant without a model if there is one class only."""
    n, hits = rows.agg(F.count("*"), F.sum(category)).first()
    if not n or hits in (0, n):
        return np.zeros(size + len(earlier)), -500.0 if not hits else 500.0, None
    if not size + len(earlier):
        return np.zeros(0), math.log(hits / (n - hits)), None
    model = LogisticRegression(maxIter=50, regParam=RIDGE, standardization=True).fit(
        _inputs(rows.coalesce(math.ceil(n / ROWS_A_TASK)), size, earlier).select("features", F.col(category).cast("double").alias("label")))
    return model.coefficients.toArray(), model.intercept, model


def _inputs(rows: DataFrame, size: int, earlier: list[str]) -> DataFrame:
    rows = VectorSizeHint(inputCol="x", size=size, handleInvalid="optimistic").transform(rows)
    return VectorAssembler(inputCols=["x", *[f"p_{c}" for c in earlier]], outputCol="features").transform(rows)


def _out_of_fold(rows: DataFrame, folds: int, size: int, earlier: list[str], category: str) -> DataFrame:
    """`rows` with p_<category>, each row's predicted by a model that has not seen its fold."""
    parts, own = [], f"p_{category}"
    for f in range(folds):
        _, intercept, model = _fit(rows.where(F.col("fold") != f), size, earlier, category)
        held = rows.where(F.col("fold") == f)
        if model is None:
            parts.append(held.withColumn(own, F.lit(_sigmoid(intercept))))
        else:
            scored = model.transform(_inputs(held, size, earlier))
            parts.append(scored.withColumn(own, vector_to_array("probability")[1]).select(*rows.columns, own))
    return materialise(reduce(DataFrame.unionByName, parts), "chained")


def _edge(rows: DataFrame, category: str, clean_share: float) -> float:
    """The smallest threshold, LEAST or more, that at most `clean_share` of the rows outside the category reach out of fold."""
    clean = rows.where(F.col(category) == 0)
    n = clean.count()
    if not n:
        return 0.5
    own = clean.select(F.col(f"p_{category}").alias("p"), F.monotonically_increasing_id().alias("tie"))  # copies have equal p
    last = with_ordinal(own, [F.col("p").desc(), F.col("tie")], "at").where(F.col("at") == int(clean_share * n)).first()["p"]
    return max(LEAST, float(np.nextafter(last, 2.0)))


def _likely_labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """`docs` without most of the rows that `marks` lacks; none that it has is lost, and a join decides on the rest."""
    if docs.schema["doc_id"].dataType != marks.schema["doc_id"].dataType:
        return docs  # equal ids of two types have different hashes
    at = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, min(MOST_BITS, BITS_A_LABEL * marks.count())))) + 1  # positions count from 1
    bucket, bit = F.bitmap_bucket_number(at).alias("__bucket"), F.bitmap_bit_position(at)
    maps = marks.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("__map"))  # 4 KB for each 32,768 bits
    found = docs.withColumns({"__bucket": bucket, "__bit": bit}).join(F.broadcast(maps), "__bucket")
    byte = F.conv(F.hex(F.substring("__map", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).select(*docs.columns)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES,
              features: int = FEATURES, folds: int = FOLDS, clean_share: float = CLEAN_SHARE) -> Chain:
    """Fits the chain on all labelled rows: features are counted, models fitted and thresholds read over every one of them.

    Each category's threshold comes from predictions out of fold, never from a model that saw the row; equal texts
    share a fold.
    """
    names = list(categories)
    marks = labels.select("doc_id", *[F.expr(f"cast({c} as int)").alias(n) for n, c in categories.items()]).dropna()
    fold = F.pmod(F.xxhash64("text"), F.lit(folds)).alias("fold")
    words = _likely_labelled(docs.select("doc_id", "text").where("text is not null"), marks).select("doc_id", fold, F.pandas_udf(_distinct_words, "string")("text").alias("text"))
    # labels grow with the documents, so they don't go through the driver whole; only words move, most of them of labelled texts
    labelled = materialise(words.join(marks.hint("merge"), "doc_id"), "labelled")
    if labelled.isEmpty():
        chain = Chain(names, [])
        for i, name in enumerate(names):
            chain.add(np.zeros(i), -500.0)
            chain.thresholds[name] = 0.5
        return chain
    chain = Chain(names, choose_features(labelled, names, features))
    unfitted = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES names

    @F.pandas_udf("array<int>")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(found) for found in unfitted.value.places(texts.tolist())], dtype=object)

    size = len(chain.place)

    @F.udf(VectorUDT())
    def sparse(at):  # of the numbers alone; all that follows is sparse and in the JVM
        return SparseVector(size, at, [1.0] * len(at))
    rows = materialise(labelled.select(sparse(marked("text")).alias("x"), "fold", *names), "featured")
    for i, name in enumerate(names):
        weights, intercept, _ = _fit(rows, size, names[:i], name)
        chain.add(weights, intercept)
        rows = _out_of_fold(rows, folds, size, names[:i], name)
        chain.thresholds[name] = _edge(rows, name, clean_share)
    return chain


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float | None = None, category: str = "toxic") -> DataFrame:
    """`docs` with p_<category> for every category of the chain and `rejected`: `category` at or over its threshold."""
    names = chain.categories
    threshold = chain.thresholds[category] if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES weights for each category

    @F.pandas_udf(", ".join(f"p_{c} double" for c in names))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(texts.tolist()), columns=[f"p_{c}" for c in names])
    kept = docs.drop(*[f"p_{c}" for c in names], "rejected").withColumn("__p", predict("text"))
    return kept.select(*[c for c in kept.columns if c != "__p"], "__p.*").withColumn("rejected", F.col(f"p_{category}") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the chain does not reject, with their own columns, whatever their names."""
    scored = score_toxicity(docs.select(F.struct("*").alias("__row"), "text"), fit_chain(docs, labels))
    return scored.where(~F.col("rejected")).select("__row.*")
