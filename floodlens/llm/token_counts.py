"""Token counts from a digest cache: only texts that no earlier run has counted are encoded.

The cache is a Parquet folder of (content, n_tokens), partitioned by tokenizer: the SHA-256 of the normalised text, and
the SHA-256 of the tokenizer's file, its library and its version. A run joins the distinct digests of its texts to the
cache, encodes one text for each digest that is missing, and appends the counts as a batch of their own. Then every
document takes its count from the cache. Batches become visible file by file, each row is whole in itself, and a digest
counted twice by runs at the same time has the same count in both: so a lost executor, a run that ends half-way or
another run beside it leave the cache right.

Normalised text: null is empty; for SentencePiece models without normalisation rules U+2581 is a space, as the library
reads it. Nothing else is folded, as it could change a count.

Nulls, empties, ties: null and empty texts have 0 bytes and what the library gives for an empty text; rows with a null
doc_id and repeated rows are kept, one row each. Long texts are encoded whole; a batch for the library ends after
BATCH_CHARS code points. An empty table gives no rows. Only doc_id and text are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from floodlens.llm.common import text_of
from floodlens.operators.sizing import BROADCAST_ROWS, fits
from floodlens.session import materialise

#: Code points given to the library at a time (one text at least).
BATCH_CHARS = 1 << 20
_CACHE = "content binary, n_tokens long, batch string, tokenizer string"
_workers: dict[str, object] = {}


class Tokenizer:
    """A vocabulary file: `.model` for the sentencepiece library, `.json` for tokenizers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.library = {"model": "sentencepiece", "json": "tokenizers"}[path.rpartition(".")[2]]
        self.digest = hashlib.sha256(b"\0".join([self.library.encode(), version(self.library).encode(), self.data])).hexdigest()
        self.folds_space = self.library == "sentencepiece" and self._has_no_rules()

    def _has_no_rules(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.data)
        rules = proto.normalizer_spec
        return not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces

    def content(self, text: Column) -> Column:
        """Texts with equal content have equal tokens."""
        text = F.coalesce(text, F.lit(""))
        return F.replace(text, F.lit("▁"), F.lit(" ")) if self.folds_space else text

    def _loaded(self):
        if self.digest not in _workers:
            if self.library == "sentencepiece":
                from sentencepiece import SentencePieceProcessor
                _workers[self.digest] = SentencePieceProcessor(model_proto=self.data)
            else:
                import os
                os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core
                from tokenizers import Tokenizer as Library
                _workers[self.digest] = own = Library.from_str(self.data.decode())
                own.no_truncation()
                own.no_padding()
        return _workers[self.digest]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text, without begin, end or added special tokens."""
        own = self._loaded()
        if self.library == "sentencepiece":
            return [len(x) for x in own.encode(texts, num_threads=1)]
        return [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > BATCH_CHARS:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


class TokenCountCache:
    """Stored counts in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer):
        self.spark, self.path, self.tokenizer = spark, path, tokenizer

    def stored(self) -> DataFrame:
        """(content, n_tokens) under this tokenizer, each digest once."""
        nothing = self.spark.createDataFrame([], _CACHE)
        nothing.write.mode("append").partitionBy("batch", "tokenizer").parquet(self.path)  # the folder is there from now on
        rows = self.spark.read.schema(_CACHE).parquet(self.path).where(F.col("tokenizer") == self.tokenizer.digest)
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.select("content", "n_tokens").write.parquet(f"{self.path}/batch={uuid4().hex}/tokenizer={self.tokenizer.digest}")


def _encoded(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(content, n_tokens) of (content, text), as the library counts them."""
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary file: its size is fixed

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("text").to_pylist()
            found = [n for a, b in _pieces(list(map(len, given))) for n in shared.value.counts(given[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(found, pa.int64())], ["content", "n_tokens"])
    return texts.select("content", "text").mapInArrow(count, "content binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; the cache at `cache_path` is used and filled."""
    cache = TokenCountCache(docs.sparkSession, cache_path, tokenizer)
    digest = F.unhex(F.sha2(tokenizer.content(F.col("text")), 256))
    keyed = materialise(docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), digest.alias("content")), "digests")
    wanted = keyed.select("content").distinct()
    missing = materialise(wanted.join(cache.stored(), "content", "left_anti"), "missing")
    if not missing.isEmpty():
        texts = docs.select(digest.alias("content"), text_of().alias("text"))
        if fits(missing, BROADCAST_ROWS):  # few: only their texts move
            texts = texts.join(F.broadcast(missing), "content", "left_semi").dropDuplicates(["content"])
        else:  # copies are dropped before and after the exchange, which the join uses again
            texts = texts.dropDuplicates(["content"]).join(missing, "content", "left_semi")
        cache.append(_encoded(texts, tokenizer))
    counts = materialise(cache.stored().join(wanted, "content", "left_semi"), "counts")
    # both sides are plain tables here, so that a digest of very many rows can be split
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
