"""Spelling variants by all pairs, token counts by the libraries, hard negatives by whole sorted score lists."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer as Library

from floodlens.llm import hard_negatives, queries, spellings, token_counts
from floodlens.session import shared_dir

SMALL = "/root/testdata/sf0.001"


# spelling variants -------------------------------------------------------------------------------------------------
def near(a, b):
    """One inserted, deleted or replaced code point, by trying the place of the first difference."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def all_forms(counts, ratio=5):
    found, form = {}, {}
    by_size = defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    for w, n in counts.items():
        close = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        found[w] = (n, len(close))
    out = {}
    for w, (n, k) in found.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, k, counts[form[w]] if form[w] else None)
    return out


def counted(rows, every=199):
    lower = {i: i + 32 for i in range(65, 91)}
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def forms_of(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = all_forms(counted([(r.doc_id, r.text) for r in docs.collect()]))
    assert any(v[0] for v in expected.values())
    assert forms_of(queries.op11_spelling_variants(spark, SMALL)) == expected


def test_forms_of_random_words_in_small_tiles_and_crowded_keys(spark, monkeypatch):
    rng = np.random.default_rng(3)
    counts = {"".join(rng.choice(list("abÿ"), rng.integers(6, 9))): int(rng.choice([5, 6, 30, 31, 200, 5000])) for _ in range(700)}
    counts |= {"x" * 300: 7, "x" * 299: 70, "y" + "x" * 299: 70, "x" * 150 + "z" + "x" * 150: 400}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    expected = all_forms(counts)
    assert max(v[3] for v in expected.values()) > 5
    assert forms_of(spellings.spelling_forms(words)) == expected
    assert forms_of(spellings.spelling_forms(words, key_rows=3)) == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aäb", min_size=1, max_size=6), min_size=2, max_size=12, unique=True))
def test_tile_equals_edits(words):
    found, _ = spellings.near_tile(words, words)
    assert found.tolist() == [[near(a, b) for b in words] for a in words]


def test_tiles_are_cut_by_code_points(spark, monkeypatch):
    monkeypatch.setattr(spellings, "TILE_POINTS", 16)
    words = ["abcdef", "abcdeg", "abcdefg", "bcdefg", "abcxef"]
    import pyarrow as pa
    group = spellings._Rows({"cls": np.full(5, 12), "key": np.ones(5, np.int64), "pair": np.full(5, -1), "block": np.zeros(5, np.int64),
                             "n": np.arange(5)}, pa.array(words))
    found = spellings._tiled(group).to_pylist()
    assert {(r["word"], r["n_near"], r["best"]) for r in found} == {("abcdef", 2, "abcxef"), ("abcdeg", 1, "abcdef"), ("abcxef", 1, "abcdef")}


def test_words_of_odd_rows(spark):
    odd = [(None, "Straße straße STRAßE"), (None, None), (7, ""), (7, "naïvetés " * 6 + "éclairs× abc"), (7, "naïvetés " * 6 + "éclairs× abc"),
           (8, "a" * 100_000), (9, "word6x Tésting-tésting tÉsting " * 9)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").select(F.lit(1).alias("n"), F.lit("w").alias("word"), "doc_id", F.lit(2).alias("key"), "text")
    for every in (None, 2, 199):
        found = {r.word: r.n for r in spellings.word_counts(docs, delete_every=every).collect()}
        assert found == counted(odd, every)
    assert forms_of(spellings.spelling_forms(spellings.word_counts(docs))) == all_forms(counted(odd, None))
    assert spellings.spelling_forms(spellings.word_counts(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spellings.spelling_forms(docs.select("word", "n"), ratio=1)


# token counts ------------------------------------------------------------------------------------------------------
ODD = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, "a▁b"), (3, "a b"), (4, "<s> </s> <unk> <|endoftext|>"), (5, "日本語🙂" * 50), (6, "x" * 30_000),
       (7, "the quick brown fox " * 5000), (8, "\x00\t\n  "), (9, " a b"), (10, "▁"), (11, " ")]


def odd_docs(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.select(F.lit("mine").alias("content"), F.lit(9).alias("n_tokens"), "doc_id", "text", F.lit(0).alias("n_bytes"))


def library_counts(name, rows):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        own = SentencePieceProcessor(model_file=path)
        return sorted(((d if d is not None else -1), len((t or "").encode()), len(own.encode(t or ""))) for d, t in rows)
    own = Library.from_file(path)
    return sorted(((d if d is not None else -1), len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)


def counts_of(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_tokens) for r in df.collect())


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(spark, name):
    docs = odd_docs(spark)
    found = token_counts.count_tokens(docs, token_counts.Tokenizer(public_tokenizers.path(name)), shared_dir(spark, "cache"))
    assert counts_of(found) == library_counts(name, ODD)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found.collect()) and found.where("over_limit").count()


def test_token_query_equals_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert counts_of(queries.op12_token_counts(spark, SMALL)) == library_counts("piece_bpe_32k.model", rows)


@pytest.mark.parametrize("few", [50_000, 1])
def test_only_distinct_misses_are_encoded_and_appended(spark, monkeypatch, few):
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", few)
    encoded = []
    whole = token_counts._encoded
    monkeypatch.setattr(token_counts, "_encoded", lambda texts, own: encoded.append(sorted(r.text for r in texts.collect())) or whole(texts, own))
    own, path = token_counts.Tokenizer(public_tokenizers.path("piece_bpe_32k.model")), shared_dir(spark, "cache")
    first = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, "a▁b"), (5, None)], "doc_id long, text string")
    second = first.union(spark.createDataFrame([(6, "new"), (7, "new"), (8, "c")], "doc_id long, text string"))
    for docs in (first, second, second, second.limit(0)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert counts_of(token_counts.count_tokens(docs, own, path)) == library_counts("piece_bpe_32k.model", rows)
    assert [[t.replace("▁", " ") for t in x] for x in encoded] == [["", "a b", "c"], ["new"]]
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.select("batch").distinct().count() == 2
    assert set(spark.read.schema(token_counts._CACHE).parquet(path).select("tokenizer").distinct().collect()) == {(own.digest,)}
    # another tokenizer shares no counts; a digest that two runs appended counts once
    other = token_counts.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert counts_of(token_counts.count_tokens(first, other, path)) == library_counts("byte_bpe_50k.json", rows)
    cache = token_counts.TokenCountCache(spark, path, own)
    cache.append(cache.stored())
    assert counts_of(token_counts.count_tokens(first, own, path)) == library_counts("piece_bpe_32k.model", rows)


def test_batches_for_the_library_are_bounded():
    sizes = [3, 0, token_counts.BATCH_CHARS, 5, 5]
    assert list(token_counts._pieces(sizes)) == [(0, 2), (2, 3), (3, 5)] and list(token_counts._pieces([])) == []


# hard negatives ----------------------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(1, 8), st.integers(0, 99))
def test_strassen_is_exact(n, k, m, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << 62), 1 << 62, (n, k)), rng.integers(-(1 << 62), 1 << 62, (k, m))
    assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()  # both modulo 2^64


def mined(rows, k=5):
    use = []
    for vid, vec, label in rows:
        if None in (vid, vec, label) or any(x is None or not np.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vid % 7 == 0 else label
        use.append((vid, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in vec)))
    out, use = [], sorted(set(use))
    for a, la, va in [x for x in use if x[0] % 100 == 0]:
        other = sorted((-sum(p * q for p, q in zip(va, v)), i, lab) for i, lab, v in use if i != a)
        for s, p, _ in [x for x in other if x[2] == la][:k]:
            inside = [x for x in other if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, r, i, -s, -x) for r, (x, i, _) in enumerate(inside, 1)]
    return sorted(out)


def negatives_of(spark, rows, **sizes):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select(
        F.lit(1).alias("tag"), "label", F.lit(2).alias("v"), "vec_id", "embedding", F.lit("t").alias("tile"))
    own = F.col("label").cast("long")
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own), **sizes)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_with_ties_in_small_tiles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) / 4 for x in rng.integers(-1, 3, 6)], int(rng.integers(0, 3))) for i in range(0, 500)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0, 0.0, 0.0], i % 2) for i in range(60)]  # one common vector
    expected = mined(rows)
    assert len(expected) > 30
    assert negatives_of(spark, rows) == expected
    assert negatives_of(spark, rows, tile_rows=50, anchor_rows=2) == expected


def test_negatives_of_odd_rows(spark):
    good = [(100, [1.0, 0.5], 1), (101, [1.0, 0.5], 1), (102, [1.0, 0.25], 2), (103, [1.0, 0.5], 2), (203, [0.75, 0.5], 2)]
    odd = [(None, [1.0, 0.5], 1), (104, None, 2), (110, [1.0, 0.5], None), (106, [1.0, None], 2), (107, [1.0, float("nan")], 2), (108, [float("inf"), 0.0], 2),
           (200, [], 2), (300, [1.0], 3), (301, [1.0, 7.0, 9.0], 3), (302, [1.0], 4), (400, [-1.0, 0.0], 5), (401, [1.0, 0.0], 5), (501, [1e30, -1e30], 6)]
    rows = good + odd
    assert negatives_of(spark, rows) == mined([r for r in rows if r[0] != 501])
    assert negatives_of(spark, rows + rows) == negatives_of(spark, rows)  # equal rows count once
    twin = rows + [(100, [0.5, 0.5], 1)]  # another row of that id is an anchor of its own and no positive of the first
    assert negatives_of(spark, twin) == mined([r for r in twin if r[0] != 501])
    assert negatives_of(spark, []) == [] and negatives_of(spark, odd[:3]) == []
