"""Tokens against the library, toxicity and language on held-out documents, shards, mixing and quality by brute force."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from floodlens.llm import language, mixing, pieces, quality, shards, toxicity
from floodlens.llm.queries import PIECES
from floodlens.session import materialise
from test_duplicates import DOCS, ODD, odd

SMALL = "/root/testdata/sf0.001/documents.parquet"
TEXTS = ["", " ", "  a  b   ", "\t\n x", "日本語 テスト 漢字🙂", "a" * 3000, "▁x", "\x00 \x7f é", "<s> </s> <0x0A> <unk>",
         " " * 90 + "z", "ümläut ﷺ", "aaaaabaaaabaa" * 50, "https://a.b/c?d=e&f=%20" * 30]


def test_tokens_equal_the_library(spark):
    data, library = pieces.read_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(SMALL).select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    rows = pieces.encode_texts(docs, data).withColumn("back", pieces.decode_column(F.col("token_ids"), data)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.token_ids == library.encode(r.text) and r.n_tokens == len(r.token_ids) and r.back == library.decode(r.token_ids)


def test_small_cache_and_batches_change_nothing(monkeypatch):
    own = pieces.PieceModel(pieces.read_model(PIECES))
    whole = own.encode(TEXTS)[0].tolist()
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    assert [i for t in TEXTS for i in own.encode([t])[0].tolist()] == whole


def test_unigram_paths_equal_all_paths():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = pieces.UNIGRAM
    proto.normalizer_spec.remove_extra_whitespaces = False
    rng = random.Random(1)
    for text, kind in [("<unk>", 2), ("a", 1), ("b", 1), ("ab", 1), ("ba", 1), ("aab", 1), ("▁", 1), ("▁a", 1), ("bb", 1)]:
        proto.pieces.add(piece=text, score=-rng.random() * 5, type=kind)
    own = pieces.PieceModel(proto.SerializeToString())

    def best(text):
        if not text:
            return 0.0
        return max((own.score[own.ids[text[:n]]] + best(text[n:]) for n in range(1, 4) if text[:n] in own.ids), default=-math.inf)
    for _ in range(60):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 12)))
        ids, _ = own.encode([text])
        assert own.decode(ids.tolist()) == text
        assert sum(own.score[i] for i in ids.tolist()) == pytest.approx(best("▁" + text.replace(" ", "▁")), abs=1e-4)


def test_round_trip_of_odd_rows(spark):
    rows = pieces.encode_and_decode(odd(spark), pieces.read_model(PIECES)).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert pieces.encode_and_decode(odd(spark).limit(0), pieces.read_model(PIECES)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.fit_chain(docs, labels.where("doc_id % 3 <> 0"))
    scored = toxicity.score_toxicity(docs.where("doc_id % 3 = 0"), chain).join(labels, "doc_id").collect()
    hits = Counter((r.toxic, r.rejected) for r in scored)
    assert hits[1, True] >= 0.93 * (hits[1, True] + hits[1, False])
    assert hits[0, True] <= 0.01 * (hits[0, True] + hits[0, False])


def test_toxicity_of_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1), (5, 0, 1), (6, 1, 0), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(odd(spark), toxicity.fit_chain(odd(spark), labels))
    assert out.count() == len(ODD) and out.where("p_toxic is null").count() == 0
    none = toxicity.score_toxicity(odd(spark), toxicity.fit_chain(odd(spark), labels.limit(0)))
    assert none.where("rejected").count() == 0 and toxicity.drop_toxic(odd(spark), labels.limit(0)).columns == odd(spark).columns


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learns = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    rows = language.identify_languages(docs, learns).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if not r.learned]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 20


def test_kneser_ney_is_a_distribution_and_paths_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abab abba, baab!", "x", None, 0), (2, "Abc cab bca", "x", None, 0), (3, "zz zyz", "y", None, 0)], DOCS)
    counts = language.gram_counts(docs).collect()
    plain = Counter()
    for lang, text in (("x", "abab abba, baab!"), ("x", "Abc cab bca"), ("y", "zz zyz")):
        clean = " " + re.sub("[^a-z]+", " ", text.lower()).strip() + " "
        plain.update((lang, clean[i:i + 4]) for i in range(len(clean) - 3))
    kept = {(r.lang, r.gram): r.n for r in counts if not ("  " in r.gram)}
    assert all(kept[k] >= n for k, n in plain.items() if "  " not in k[1])
    scorer = language.Scorer(language.kneser_ney(language.gram_counts(docs)).toPandas(), language.ORDER)
    letters = "abc "
    grams = np.array([[ord(c) for c in "aba" + x] for x in letters], np.uint32)
    total = np.exp(scorer.log_p("x", grams)).sum()
    assert 0.9 < total <= 1.0001
    dense = scorer.cross_entropies(["abab", "zyz", None, "", "a" * 5000])
    monkeypatch.setattr(language, "_DENSE", 1)
    assert np.allclose(dense[0], scorer.cross_entropies(["abab", "zyz", None, "", "a" * 5000])[0], atol=1e-5)


def test_language_of_odd_rows(spark):
    rows = language.identify_languages(odd(spark), F.lit(True)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[3].score == 0
    assert by[4].lang_pred == "en" and by[7].lang_pred == "und"
    assert {r.lang_pred for r in language.identify_languages(odd(spark), F.lit(False)).collect()} == {"und"}
    assert language.identify_languages(odd(spark).limit(0), F.lit(True)).count() == 0


def test_shards_are_gapless_seeded_and_grow_into_the_new_one(spark):
    docs = spark.read.parquet(SMALL)
    rows = shards.shard_documents(docs, bucket_bytes=2000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.doc_id, r.shard): r.slot for r in shards.shard_documents(docs, bucket_bytes=2000).collect()} == {(r.doc_id, r.shard): r.slot for r in rows}
    grown = {r.doc_id: r.shard for r in shards.shard_documents(docs, 41).collect()}
    assert {r.doc_id: r.grown_shard for r in rows} == grown


def test_shards_of_odd_rows_and_files(spark, tmp_path):
    out = shards.shard_documents(odd(spark), 3).collect()
    assert len(out) == len(ODD) and {r.size for r in out if r.doc_id == 1} == {16} and {r.text_crc32 for r in out if r.doc_id == 1} == {0}
    assert shards.shard_documents(odd(spark).limit(0)).count() == 0
    shards.write_shards(odd(spark), str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(ODD) and set(odd(spark).columns) <= set(back.columns)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, held = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in held]
        level = (total - sum(3 * sizes[s] for s in held)) / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in held else level * weight[s] for s in order}
        held |= over


def mixed_documents(spark):
    rng = random.Random(8)
    share = {"a": 60, "b": 3, "c": 1, None: 9, "é": 4}
    return spark.createDataFrame([(i, "w " * rng.randint(0, 40) + "end.", "en", s, 0) for i, s in enumerate(s for s, n in share.items() for _ in range(n))], DOCS)


@pytest.mark.parametrize("chunk", [4096, 4])
def test_shares_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk)
    docs = mixed_documents(spark)
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = {r.doc_id: r for r in mixing.mix_shares(docs).collect()}
    sizes = Counter()
    for i, r in rows.items():
        sizes[source[i]] += r.size
    targets = plain_targets(sizes)
    assert all(r.target == pytest.approx(targets[source[i]]) and r.source_size == sizes[source[i]] for i, r in rows.items())
    for s, target in targets.items():
        left = math.floor(target)
        order = sorted((i for i in rows if source[i] == s), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
        taken = Counter()
        while left and sizes[s]:
            for i in order:
                n = min(left, rows[i].size)
                taken[i] += n
                left -= n
        assert all(rows[i].taken == taken[i] <= 3 * rows[i].size for i in order)
    mix = mixing.mix_documents(docs)
    words = Counter()
    for r in mix.collect():
        words[r.doc_id] += len(r.text.split())
    assert all(words[i] == r.taken for i, r in rows.items()) and mix.columns == docs.columns


def test_mix_of_odd_rows(spark):
    docs = odd(spark)
    assert mixing.mix_shares(docs).count() == len(ODD)
    assert mixing.mix_documents(docs).columns == docs.columns
    total = mixing.mix_documents(docs).select(F.sum(F.size(F.expr(r"regexp_extract_all(text, '\\S+', 0)")))).first()[0]
    assert total == mixing.mix_shares(docs).agg(F.sum("taken")).first()[0]
    assert mixing.mix_shares(docs.limit(0)).count() == mixing.mix_documents(docs.limit(0)).count() == 0


def test_mix_of_rows_that_share_or_lack_ids(spark, monkeypatch):
    """Every row is a document of its own: equal rows, one id on many texts, and many rows without an id."""
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 16)
    rows = [(None, f"text {i % 20} without an id", "en", "a", i) for i in range(60)] + [(7, "w " * (i % 5), "en", "a", i) for i in range(60)]
    rows += [(8, "the same row", "en", "b", 1)] * 30 + [(i, "some more words here", "en", None, i) for i in range(100, 120)]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("row"), F.lit(2).alias("taken"), F.lit(3).alias("finish"))
    shares = mixing.mix_shares(docs).collect()
    assert len(shares) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in shares)
    given = Counter((r.doc_id, r.size, r.taken) for r in shares if r.doc_id != 8)
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    mixed = mix.collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in shares)
    for i in (None, 7, 8):
        assert sum(len(r.text.split()) for r in mixed if r.doc_id == i) == sum(r.taken for r in shares if r.doc_id == i)
    assert given == Counter((r.doc_id, r.size, r.taken) for r in mixing.mix_shares(docs.repartition(5)).collect() if r.doc_id != 8)


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_base_statistics_equal_brute_force(spark):
    docs = spark.read.parquet(SMALL)
    extra = spark.createDataFrame(ODD[:5] + ODD[5:7] + [(9, "a b c a b c a b\n\nx\nx\n \n", "en", "a", 0), (10, "a a a a", "en", "a", 0)], DOCS)
    text = {(r.doc_id, r.text) for r in docs.union(extra).collect()}
    want = Counter((i, *plain_base(t)) for i, t in text)
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base_statistics(docs.union(extra)).collect()}
    assert found == set(want)


def test_outliers_of_each_group_are_rejected(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "no", "it", "river"]) + str(rng.randint(0, 400)) for _ in range(rng.randint(60, 400))]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s", 0))
    for i in range(400, 408):
        rows.append((i, " ".join("#" * 30 + str(j) for j in range(100)), "en", "s", 0))
    out = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(out[i].kept for i in range(400, 408)) and sum(out[i].kept for i in range(400)) >= 396
    assert all(r.kept <= (not r.base_failed) for r in out.values())


def test_quality_filters_on_distances_stay_small(spark):
    """A factor inside the filtered plan is put in place of its name at each use: code beyond 64 KB, compiled on the driver."""
    counts = quality.base_statistics(spark.read.parquet(SMALL))
    rows = materialise(counts.select("*", *[c.alias(n) for n, c in quality._vector().items()]))
    near = quality._with_distance(rows, quality.robust_estimates(rows, steps=1, min_rows=5)).where("d2 is not null and d2 < 9")
    assert near.count() and "sqrt" not in near._jdf.queryExecution().optimizedPlan().toString().lower()


def test_quality_of_odd_rows(spark):
    rows = quality.quality_verdicts(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r.base_failed for r in rows if r.n_words < 50) and quality.quality_verdicts(odd(spark).limit(0)).count() == 0


def test_shard_query_reads_what_it_wrote(spark, monkeypatch):
    from floodlens.llm import queries
    paths, write = [], shards.write_shards
    monkeypatch.setattr(shards, "write_shards", lambda docs, path, *a: (paths.append(path), write(docs, path, *a)))
    docs = spark.read.parquet(SMALL)
    found = {tuple(r) for r in queries.op5_sharding(spark, SMALL.rsplit("/", 1)[0]).collect()}
    assert found == {tuple(r) for r in shards.shard_documents(docs).collect()}
    back = spark.read.parquet(paths[0])
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_language_of_a_text_is_the_same_in_any_batch(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abab abba, baab!", "x", None, 0), (2, "", "x", None, 0), (3, "zz zyz", "y", None, 0), (4, "zb", "x", None, 0)], DOCS)
    counts = Counter()
    for lang, text in (("x", "   abab abba baab "), ("y", "   zz zyz "), ("x", "   zb ")):
        counts.update((lang, text[i:i + 4]) for i in range(len(text) - 3))
    assert {(r.lang, r.gram): r.n for r in language.gram_counts(docs).collect()} == counts
    scorer = language.Scorer(language.kneser_ney(language.gram_counts(docs)).toPandas(), language.ORDER)
    texts = ["z", "abab", "", "b", "zz", None, "z", "b a", "日", "z"]
    for dense in (1 << 24, 1):
        monkeypatch.setattr(language, "_DENSE", dense)
        alone = np.concatenate([scorer.cross_entropies([t])[0] for t in texts])
        assert (alone[0] > 0).all() and alone[0, 0] != alone[0, 1]
        assert np.array_equal(alone, scorer.cross_entropies(texts)[0])
        assert np.array_equal(alone[::-1], scorer.cross_entropies(texts[::-1])[0])


def test_language_model_in_files_equals_one_in_memory(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null")
    model = language.kneser_ney(language.gram_counts(docs))
    texts = [r.text for r in docs.select("text").limit(40).collect()] + [None, "", "x", "日本語の文"]
    whole = language.Scorer(model.toPandas(), language.ORDER).cross_entropies(texts)
    monkeypatch.setattr(language, "FILE_ROWS", model.count() // 5)
    langs, files = language.write_model(model)
    assert len(files) > 3 and sum(spark.read.parquet(p).count() for p, _, _ in files) == model.count()
    monkeypatch.setattr(language, "KEPT_BYTES", 1)
    monkeypatch.setattr(language, "_LOOKUP", 1000)
    parts = language.Scorer((langs, files), language.ORDER).cross_entropies(texts)
    assert np.allclose(whole[0], parts[0], atol=1e-4) and (whole[1] == parts[1]).all()


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """One word marks the toxic rows among the many, another those of the last tenth; a sample by hash would lose rows."""
    seen = {}
    monkeypatch.setattr(toxicity, "_fit", lambda rows, size, earlier, category: seen.setdefault(category, rows.count()) and (np.zeros(size + len(earlier)), -2.0, None))
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('plain words ', if(id % 10 = 0, 'vile ', ''), if(id >= 27000, 'late', 'early')) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 27000 as int) as quality", "cast(doc_id % 10 = 0 as int) as toxic")
    chain = toxicity.fit_chain(docs, labels)
    assert seen == {"low_quality": 30_000, "toxic": 30_000} and {"vile", "late", "early"} <= set(chain.place)


def test_toxicity_moves_few_unlabelled_texts_and_no_gradient_for_each_small_part(spark, monkeypatch):
    docs = spark.range(0, 40_000, 1, 40).selectExpr("if(id % 100 = 0, null, id - 20000) as doc_id", "concat('words of ', id) as text")
    labels = docs.where("doc_id % 5 = 0").selectExpr("doc_id", "1 as quality", "cast(doc_id % 10 = 0 as int) as toxic")
    kept = toxicity._likely_labelled(docs, labels.dropna())
    assert kept.join(labels, "doc_id").count() == labels.where("doc_id is not null").count() and kept.count() < 0.35 * 40_000
    monkeypatch.setattr(toxicity, "MOST_BITS", 1 << 10)  # a full map keeps all
    assert toxicity._likely_labelled(docs, labels.dropna()).join(labels, "doc_id").count() == labels.where("doc_id is not null").count()
    other = labels.selectExpr("cast(doc_id as string) as doc_id").dropna()
    assert toxicity._likely_labelled(docs, other).count() == docs.count()
    fitted = []
    monkeypatch.setattr(toxicity, "_inputs", lambda rows, size, earlier: fitted.append(rows.rdd.getNumPartitions()) or rows.selectExpr("x as features", "toxic"))
    rows = docs.selectExpr("cast(coalesce(doc_id, 0) % 10 = 0 as int) as toxic")
    rows = rows.withColumn("x", F.udf(lambda v: toxicity.SparseVector(1, [0], [float(v)]), toxicity.VectorUDT())("toxic"))
    toxicity._fit(rows, 1, [], "toxic")
    assert fitted == [2]


def test_feature_counts_do_not_depend_on_what_a_task_remembers():
    import pandas as pd
    texts = ["Vile words, vile deeds", None, "", "deeds of old", "vileness"]
    batches = [pd.DataFrame({"text": texts[:2], "toxic": [1, 0]}), pd.DataFrame({"text": texts[2:], "toxic": [0, 0, 1]})]
    found = [pd.concat(toxicity._counts(["toxic"], most)(iter(batches))).groupby("feature").sum().to_dict("index") for most in (1, 1000)]
    want = defaultdict(lambda: {"n": 0, "toxic": 0})
    for text, toxic in zip(texts, (1, 0, 0, 0, 1)):
        words = set(re.findall(r"\w+", (text or "").lower()))
        for f in words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}:
            want[f]["n"] += 1
            want[f]["toxic"] += toxic
    assert found[0] == found[1] == want
