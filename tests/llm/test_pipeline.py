"""The pipeline over odd rows, and near-duplicates among rows that share ids."""
import corpus_pipeline
from pyspark.sql import functions as F

from floodlens.llm import simhash
from test_duplicates import DOCS

LONG = " ".join(f"word{i} lies near word{i * 7 % 50}" for i in range(120))


def test_rows_that_share_or_lack_an_id_are_told_apart(spark):
    rows = [(None, LONG + " one", "en", "a", 1), (None, "quite another text of some length about boats", "en", "a", 2), (7, "a third text on tea and its cups", "en", "b", 3),
            (7, "the fourth text speaks of the weather in spring", "en", "b", 4), (7, "the fourth text speaks of the weather in spring", "en", "b", 4),
            (9, LONG + " one", "en", "a", 5), (8, LONG + " two", "en", "c", 6)]
    docs = spark.createDataFrame(rows, DOCS).select(*[F.col(c.split()[0]) for c in DOCS.split(", ")], F.lit("x").alias("fp"), F.lit("y").alias("root"))
    kept = sorted(((r.doc_id is None, r.doc_id or 0), r.text[:30]) for r in simhash.drop_near_duplicates(docs).collect())
    texts = {t for _, t in kept}
    assert len(kept) == 4 and len(texts) == 4
    assert ((False, 8), LONG[:30]) in kept  # of the three long ones the smallest id
    assert sum(k == (False, 7) for k, _ in kept) == 2 and sum(k[0] for k, _ in kept) == 1
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_over_odd_rows(spark, tmp_path):
    lines = [f"line number {i} of the text says {i * i} things and {i % 7} more" for i in range(40)]
    rows = [(None, "no id at all but some words that matter here", "en", None, 1), (None, "another row without an id speaks of trees", "en", "a", 1),
            (5, None, None, "a", None), (6, "", "en", "b", 0), (7, "seven is the first text with this id", "en", "b", 1),
            (7, "a different text has the same id seven", "de", "b", 1), (8, "\n".join(lines), "en", "c", 1), (8, "\n".join(lines), "en", "c", 1),
            (9, "\n".join(lines[:20] + ["a line of its own that nobody else has"]), "en", "c", 1), (10, "x" * 50_000, "en", "c", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.round_trip for r in out)
    # stage by stage: what came in, and only its columns
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "toxicity":
            assert docs.count() == len(rows)  # nothing to learn from: nothing is rejected
        if name == "line_dedup":
            assert docs.count() == len(rows) and docs.where("doc_id = 9").first().text == "a line of its own that nobody else has"
        if name == "simhash_near_dedup":
            assert docs.where("doc_id = 7").count() == 2 and docs.where("doc_id is null").count() == 2
            assert docs.where("doc_id = 8").count() == 1
    (tmp_path / "none").mkdir()
    for t in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
