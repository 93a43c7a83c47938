"""Models, sampling and evaluation: metric bands on a separable set, invariants, properties."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.operators import evaluation as E
from floodlens.operators import models as M
from floodlens.operators import sampling as R
from floodlens.operators.adaptive import adaptive_replay, in_streak, latest, pool_start, recent_pool
from floodlens.operators.neighbours import knn_classify
from floodlens.operators.novelty import novelty_fit

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three well separated classes over twelve groups, one class rare."""
    rng = np.random.default_rng(1)
    out = []
    for i in range(360):
        y = 0 if i % 6 < 3 else 1 if i % 6 < 5 else 2
        x = rng.normal([0, 4, 8][y], 0.4, 3)
        out.append((f"s{i // 6 % 2}", i // 12 % 6, float(i), f"p{i % 5}", int(y), *map(float, x)))
    return spark.createDataFrame(out, "session string, round int, window_start double, peer_ip string, y int, a double, b double, c double").cache()


def macro(pred):
    return E.macro_f1(pred).first()[0]


def test_learners_separate_the_classes(spark, rows):
    d = R.holdout_session(rows, "s1")
    train, test = d.where("not is_test"), d.where("is_test")
    forest = M.fit_forest(train, COLS, trees=10, depth=5)
    assert macro(M.score(forest, test, COLS)) > 0.95
    assert macro(M.fit_svm(train, COLS, width=64, iterations=20).predict(test)) > 0.95
    assert macro(knn_classify(test, train, COLS, ["session", "window_start"], label="y")) > 0.95
    binary = lambda t: t.withColumn("y", (F.col("y") > 0).cast("int"))
    boosted = M.fit_boosted(binary(train), COLS, rounds=5)
    assert macro(M.score(boosted, binary(test), COLS, threshold=0.5)) > 0.95
    imp = M.feature_importance(spark, forest, COLS).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1) and imp[0]["importance"] >= imp[-1]["importance"]
    eff = M.scoring_efficiency(spark, "forest", forest, test, COLS).first()
    assert eff["nodes"] > 10 and eff["windows_per_s"] > 0


def test_fits_use_all_cores_however_few_partitions_the_rows_have(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()))
    one = rows.coalesce(1).withColumn("y", (F.col("y") > 0).cast("int"))
    M.fit_forest(one, COLS)
    M.fit_boosted(one, COLS)
    assert min(seen) >= spark.sparkContext.defaultParallelism > 1


def test_group_folds_keep_groups_whole_and_mixed(spark, rows):
    d = R.stratified_group_kfold(rows.withColumn("label", F.col("y")), ["session", "round"], 4)
    assert d.groupBy("session", "round").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    shares = {r["fold"]: r["n"] for r in d.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert set(shares) == {0, 1, 2, 3} and max(shares.values()) <= 2 * min(shares.values())
    cv = M.cross_validate(d, lambda t: M.fit_forest(t, COLS, trees=5, depth=4), lambda m, t: M.score(m, t, COLS), 2)
    assert cv > 0.9


def test_padding_cannot_change_a_score(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(40):
        n, y = 1 + i % 4, i % 2
        real = [[float(v) for v in rng.random(14) * 0.3 + 0.7 * y] for _ in range(n)]
        out.append((i, y, n, real + [[0.0] * 14] * (4 - n), real + [[9.0] * 14] * (4 - n)))
    df = spark.createDataFrame(out, "i int, y int, length int, seq array<array<float>>, dirty array<array<float>>")
    clean, dirty = df.select("i", "y", "length", "seq"), df.select("i", "y", "length", F.col("dirty").alias("seq"))
    model, _ = M.fit_network(M.sequence_rows(clean), M.sequence_rows(clean), hidden=4, budgets=[15])
    score = lambda t: [tuple(r["probability"]) for r in model.transform(M.sequence_rows(t)).orderBy("i").collect()]
    assert score(clean) == score(dirty)
    forest = M.fit_sequence_forest(M.sequence_rows(clean), trees=3, depth=3)
    assert forest.transform(M.sequence_rows(dirty)).where("prediction = y").count() > 30


def test_samples_do_not_depend_on_partitions(spark, rows):
    key = ["session", "window_start"]
    for f in (lambda t: R.undersample(t, key, 1, "y"), lambda t: R.stratified_cap(t, 50, key, 1, "y"),
              lambda t: R.stratified_split(t, key, 0.2, 1, "y")):
        a, b = (sorted(map(tuple, f(t).select(*key).collect())) for t in (rows.repartition(3), rows.repartition(11)))
        assert a == b and a
    sizes = {r["y"]: r["n"] for r in R.undersample(rows, key, 1, "y").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert set(sizes.values()) == {60}
    assert R.stratified_cap(rows, 1000, key, 1, "y").count() == 360
    val = R.group_shuffle_split(rows, ["session", "round"], 0.15, 3)
    assert val.where("is_val").select("session", "round").distinct().count() == 2


def test_metrics_of_empty_and_one_sided_tables(spark):
    empty = spark.createDataFrame([], "label int, flagged boolean")
    r = E.detection_fp_rates(empty).first()
    assert r["detection"] is None and r["false_positive"] is None
    one = spark.createDataFrame([(0, 0), (0, 2)], "y int, p int")
    assert macro(one) == pytest.approx((2 / 3 + 0) / 2)
    assert E.confusion_matrix(one, [0, 1, 2]).where("n = 0").count() == 7
    sep = spark.createDataFrame([(1, 0.9, True), (1, 0.1, False), (1, 0.5, True), (1, 0.5, False)], "class int, score double, positive boolean")
    assert E.roc_auc(sep).first()["auc"] == pytest.approx(0.875)


def test_bad_requests_are_errors_by_default(spark):
    req = spark.createDataFrame([("[1,2]",), ("[1,null]",), ("nope",), (None,), ("[1]",)], "body string")
    predict = lambda d: d.withColumn("prediction", F.lit(1))
    strict = M.json_scoring(req, predict, 2, {0: "Normal", 1: "x"}).collect()
    assert sum(r["error"] is None for r in strict) == 1
    assert all(r["prediction"] is None and r["label"] is None for r in strict if r["error"])
    opened = M.json_scoring(req, predict, 2, {0: "Normal", 1: "x"}, "normal").collect()
    assert all(r["label"] == "Normal" and r["prediction"] == 0 for r in opened if r["error"])


def test_adaptive_replay_learns_new_traffic(spark):
    """The base model knows only small counts; novelty and pseudo-labels teach it the new flood."""
    rng = np.random.default_rng(5)
    out = []
    for t in range(240):
        for p in range(3):
            out.append(("s", float(t), f"c{p}", 0, float(rng.normal(10, 1)), float(rng.normal(5, 1))))
        if 130 <= t < 240:
            out.append(("s", float(t), "bad", 4, float(rng.normal(200, 5)), float(rng.normal(90, 5))))
    w = spark.createDataFrame(out, "session string, window_start double, peer_ip string, label int, a double, b double").cache()
    key = ["session", "window_start", "peer_ip"]
    base = spark.createDataFrame([(float(v), float(v / 2), int(v < 3)) for v in (1, 2, 9, 10, 11, 12) * 5], "a double, b double, y int")
    novelty = novelty_fit(w.where("window_start < 60"), ["a", "b"], key)

    def fit(data):
        model = M.fit_boosted(data, ["a", "b"], rounds=3, depth=3)
        return lambda d: M.score(model, d, ["a", "b"]).drop("score")

    res = adaptive_replay(w, base, novelty, fit, ["a", "b"], 60.0, 30.0, 60.0, 60.0)
    assert res.count() == w.where("window_start >= 60").count()
    late = res.where("label = 4 AND version = 2")
    assert late.agg(F.avg(F.col("static_sup").cast("double"))).first()[0] == 0.0
    assert late.agg(F.avg(F.col("adaptive_sup").cast("double"))).first()[0] == 1.0
    assert in_streak(res, "adaptive", "st").where("label = 4 AND st").count() == 109


def test_fits_start_no_task_for_a_shuffle_partition(spark, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert M.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert M.spread(spark.range(9 * M.FIT_ROWS)).rdd.getNumPartitions() == 9


def test_packets_parse_an_event_once_and_base_windows_leave_a_session_out(spark):
    from floodlens.plans.labels import labelled
    from floodlens.plans.packet_view import packets
    sf = "/root/testdata/sf0.001"
    plan = packets(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("get_json_object") == 1
    short = ["n_in", "iat_std_in", "sport_entropy_in"]
    some, every = labelled(spark, sf, 3, short, without="s1"), labelled(spark, sf, 3, short).where("session <> 's1'")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect())) != []


def test_replay_reads_the_versions_of_its_pool_only(spark):
    out = [("s", float(t), f"c{p}", t // 10, "attack" if p == 2 and t % 20 < 6 else None if t % 9 == 0 else "benign")
           for t in range(60) for p in range(3)]
    w = spark.createDataFrame(out, "session string, window_start double, peer_ip string, version int, kind string")
    counts = {(r["version"], r["kind"]): r["n"] for r in w.groupBy("version", "kind").agg(F.count("*").alias("n")).collect()}
    starts = set()
    for v in range(1, 6):
        for kind in ("benign", "attack"):
            starts.add(start := pool_start(counts, kind, v, 8))
            some = latest(w.where(F.col("version").between(start, v - 1)), kind, 8)
            every = recent_pool(w.where(F.col("version") < v), 8).where(F.col("kind") == kind)
            assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))
    assert len(starts) > 2


def test_adaptive_replay_of_a_capture_shorter_than_its_calibration(spark):
    w = spark.createDataFrame([("s", float(t), f"c{p}", 0, float(p), float(t % 7)) for t in range(40) for p in range(3)],
                              "session string, window_start double, peer_ip string, label int, a double, b double")
    base = spark.createDataFrame([(float(v), float(v), v % 2) for v in range(20)], "a double, b double, y int")
    novelty = novelty_fit(w, ["a", "b"], ["session", "window_start", "peer_ip"])
    res = adaptive_replay(w, base, novelty, lambda data: lambda d: d.withColumn("p", F.lit(0)), ["a", "b"], 60.0, 30.0, 60.0, 60.0)
    assert res.count() == 0 and {"version", "adaptive", "static", "block"} <= set(res.columns)
