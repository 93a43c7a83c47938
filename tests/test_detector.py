"""Novelty, streaks, block decisions, mitigation, monitoring, live detection."""
import numpy as np
import pytest
from builders import A, C, V, packet, packet_table
from pyspark.sql import functions as F

from floodlens.operators import adaptive as AD
from floodlens.operators import mitigation as G
from floodlens.operators import monitoring as D
from floodlens.operators.neighbours import knn_classify, nearest
from floodlens.operators.novelty import novelty_fit
from floodlens.schemas import ATTACKS
from floodlens.streaming.detector import LiveDetector


@pytest.fixture(scope="module")
def calm(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(10, 2, 500).clip(0), rng.normal(100, 10, 500)
    return spark.createDataFrame([(f"{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "id string, a double, b double")


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 0, "pivots": 8, "block_rows": 50}])
def test_novelty_flags_far_windows(spark, calm, options):
    model = novelty_fit(calm, ["a", "b"], ["id"], quantile=0.99, **options)
    test = spark.createDataFrame([(1, 10.0, 100.0), (2, 11.0, 95.0), (3, 5000.0, 100.0), (4, 50000.0, 100.0)], "i int, a double, b double")
    rows = model.flag(test).orderBy("i").collect()
    assert [r["novel"] for r in rows] == [False, False, True, True]
    assert rows[3]["novelty"] > rows[2]["novelty"] > model.threshold
    assert model.flag(calm).agg(F.avg(F.col("novel").cast("double"))).first()[0] < 0.02


@pytest.mark.parametrize("skip_self", [False, True])
def test_cells_equal_brute_force_with_many_copies(spark, skip_self):
    """A third of all vectors are one and the same; ties go to the smaller id."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (240, 3)), 1)
    x[::3] = [0.5, 0.5, 0.5]
    rows = [(f"{i:03d}", [float(v) for v in x[i]], i % 4) for i in range(len(x))]
    table = spark.createDataFrame(rows, "qid string, vec array<double>, label int")
    refs = table.select(F.col("qid").alias("rid"), "vec", "label")
    got = {}
    for name, options in (("broadcast", {}), ("cells", {"max_broadcast": 0, "pivots": 6, "block_rows": 16})):
        out = nearest(table, refs, 5, skip_self, **options)
        got[name] = {r["qid"]: [(n["d2"], n["rid"]) for n in r["neighbours"]] for r in out.collect()}
    for i, (qid, vec, _) in enumerate(rows):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), 9)
        order = [(d[j], rows[j][0]) for j in range(len(rows)) if not (skip_self and j == i)]
        want = sorted(order)[:5]
        assert got["broadcast"][qid] == [(pytest.approx(a), b) for a, b in want]
        # copies share their neighbours' distances; ids may be another copy's view of itself
        assert [a for a, _ in got["cells"][qid]] == pytest.approx([a for a, _ in want])
        if not skip_self:
            assert got["cells"][qid] == got["broadcast"][qid]


def test_knn_vote_tie_takes_smallest_label(spark):
    train = spark.createDataFrame([("a", 0.0, 3), ("b", 1.0, 1), ("c", 50.0, 2), ("d", 60.0, 2)], "id string, x double, y int")
    test = spark.createDataFrame([("q", 0.4)], "id string, x double")
    assert knn_classify(test, train, ["x"], ["id"], k=2, label="y").first()["p"] == 1


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_streak_needs_adjacent_flagged_windows(spark, bits):
    rows = list(zip("xxxxyyx", [1.0, 2.0, 3.0, 7.0, 2.0, 3.0, 8.0], [True, True, False, True, True, False, True]))
    df = spark.createDataFrame([("s", p, t, f) for p, t, f in rows], "session string, peer_ip string, window_start double, flag boolean")
    got = {(r["peer_ip"], r["window_start"]): r["out"] for r in AD.streak_at_least(df, "flag", 2, "out", bits=bits).collect()}
    assert [got[(p, t)] for p, t, _ in rows] == [False, True, False, False, False, False, True]
    assert len(got) == len(rows)


def scored(spark, rows):
    return spark.createDataFrame([("s", p, float(t), float(t), f, 0.9, ok) for p, t, f, ok in rows],
                                 "session string, peer_ip string, window_start double, now double, flagged boolean, score double, action_ok boolean")


TRACE = [(A, 0, True, True), (A, 1, False, True), (A, 2, True, True), (A, 3, True, True), (A, 4, True, True), (A, 5, True, True),
         (A, 34, True, True), (A, 35, True, True)] + [(V, t, True, True) for t in range(5)]


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_blocks_after_consecutive_flags_once_per_timeout(spark, bits):
    out = G.block_decisions(scored(spark, TRACE), 2, 30.0, [V], bits=bits).collect()
    assert sorted((r["peer_ip"], r["ts"], r["event"], r["windows"]) for r in out) == [(A, 3.0, "block", 2), (A, 35.0, "block", 2)]


def test_failed_block_is_an_error_and_keeps_state(spark):
    out = G.block_decisions(scored(spark, [(A, 0, True, False), (A, 1, True, False), (A, 2, True, True)]), 1, 30.0).orderBy("ts").collect()
    assert [(r["event"], r["ts"], r["windows"]) for r in out] == [("error", 0.0, 1), ("error", 1.0, 2), ("block", 2.0, 3)]


@pytest.mark.parametrize("consecutive", [1, 2, 3])
def test_block_decisions_match_the_fold(spark, consecutive):
    rng = np.random.default_rng(consecutive)
    rows = [(f"p{p}", int(t), bool(rng.random() < 0.7), bool(rng.random() < 0.8))
            for p in range(3) for t in sorted(rng.choice(200, 120, replace=False))]
    want, state = [], {}
    for p, t, flagged, ok in rows:
        streak, until = state.get(p, (0, -1))
        if not flagged or until > t:
            streak = 0
        else:
            streak += 1
            if streak >= consecutive:
                want.append((p, float(t), "block" if ok else "error", streak))
                if ok:
                    streak, until = 0, t + 12
        state[p] = (streak, until)
    out = G.block_decisions(scored(spark, rows), consecutive, 12.0, bits=4).collect()
    assert sorted((r["peer_ip"], r["ts"], r["event"], r["windows"]) for r in out) == sorted(want)


def test_mitigation_on_a_synthetic_session(spark):
    t0 = 1000.0
    p = packet_table(spark, [packet(t0 + i / 10, A, V, 17) for i in range(20)] + [packet(t0 + 20 + i / 10, "10.0.0.22", V, 17) for i in range(50)], "m0")
    attacks = spark.createDataFrame([("m0", 1, "a1", A, "udp", 2, "low", 10, 0, 53, t0, t0 + 10),
                                     ("m0", 2, "a2", "10.0.0.22", "udp", 2, "low", 10, 0, 53, t0 + 20, t0 + 25)], ATTACKS).withColumn("ev_order", F.col("round"))
    log = spark.createDataFrame([("m0", "block", t0 + 2, A, 30.0, None), ("m0", "block", t0 + 3, C, 30.0, None), ("m0", "stop", t0 + 30, None, None, 0)],
                                "session string, event string, ts double, peer_ip string, seconds double, kernel_drops bigint")
    blocks = log.where("event = 'block'")
    attackers = spark.createDataFrame([("m0", A), ("m0", "10.0.0.22")], "session string, ip string")
    clients = spark.createDataFrame([("m0", C)], "session string, ip string")
    scores = spark.createDataFrame([("m0", C, 0), ("m0", C, 1)], "session string, peer_ip string, flagged int")
    report = G.attack_report(attacks, blocks, G.attack_seconds(p, V, attackers))
    a1, a2 = report.orderBy("round").collect()
    assert (a1["status"], a1["time_to_block_s"], a1["packets_delivered"]) == ("blocked", 2.0, 20)
    assert a1["blocked_share"] == pytest.approx(80.0) and a1["traffic_stopped"] == pytest.approx(80.0)
    assert (a2["status"], a2["packets_delivered"], a2["traffic_stopped"], a2["time_to_block_s"]) == ("missed", 50, 0.0, None)
    s = G.mitigation_summary(report, blocks, attackers, scores, clients, log, "m0").first()
    assert s["blocked_while_attacking"] == 50.0 and s["missed"] == 1 and s["median_time_to_block_s"] == 2.0
    assert (s["benign_clients_blocked"], s["false_blocks"], s["benign_windows_flagged"], s["socket_kernel_drops"]) == (1, 1, 50.0, 0)


def test_dashboard_as_of_a_time(spark):
    t0 = 1000.0
    rows = [(t0 + i, C, 10, 0.01, 0, 0, 0) for i in range(10)] + [(t0 + i, A, 5000, 1.0, 1, 1, 0) for i in (5, 6)]
    scores = spark.createDataFrame(rows, "window_start double, peer_ip string, n_in bigint, score double, novel int, flagged int, model_version int")
    log = spark.createDataFrame(
        [("start", t0 - 1, None, None, None, None, None), ("block", t0 + 7, A, 30.0, 2, None, None), ("error", t0 + 8, None, None, None, '[[1, "a"]]', None)],
        "event string, ts double, peer string, seconds double, n_windows bigint, unscored string, version int")
    now = D.replay_clock(scores, 9.0)
    assert now == t0 + 8
    found = {r["peer_ip"]: r for r in D.sources(scores, log, now).collect()}
    assert set(found) == {A, C} and found[A]["blocked_for"] > 28 and found[A]["blocks"] == 1
    series = {r["peer_ip"]: [x["n"] for x in r["series"]] for r in D.recent_series(scores, now).collect()}
    assert series[A] == [5000, 5000]
    t = D.totals(scores, log, now).first()
    assert (t["active_blocks"], t["blocks"], t["errors"]) == (1, 1, 1)
    feed = D.event_feed(log, now, order="event").collect()
    assert feed[0]["event"] == "error" and "unscored" not in feed[0].asDict() and feed[1]["n_windows"] == 2
    early = D.replay_clock(scores, 3.0)
    assert D.totals(scores, log, early).first()["blocks"] == 0
    assert {r["peer_ip"] for r in D.sources(scores, log, early).collect()} == {C}


LIVE = ["n_in", "bytes_in", "uniq_sport_in"]
WINDOWS = "session string, window_start double, peer_ip string, now double, n_in double, bytes_in double, uniq_sport_in double"


def rule(rows):
    return rows.withColumn("score", (F.col("n_in") > 100).cast("double"))


def test_scores_and_error_rows(spark, tmp_path):
    d = LiveDetector(spark, str(tmp_path), LIVE, rule)
    d.process(spark.createDataFrame([("s", 10.0, A, 11.0, 5000.0, 1.0, 1.0), ("s", 10.0, C, 11.0, 12.0, 1.0, 1.0),
                                     ("s", 10.0, "10.0.0.9", 11.0, float("nan"), 1.0, 1.0), ("s", 10.0, "10.0.0.8", 11.0, 5.0, None, 1.0)], WINDOWS), 0)
    got = {r["peer_ip"]: (r["n_in"], r["score"], r["novel"], r["flagged"], r["model_version"]) for r in d.scores().collect()}
    assert got == {A: (5000, 1.0, 0, 1, 0), C: (12, 0.0, 0, 0, 0)}
    assert {r["peer_ip"] for r in d.table("errors").collect()} == {"10.0.0.9", "10.0.0.8"}


def test_hybrid_calibrates_flags_novel_and_retrains(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = spark.createDataFrame([(*map(float, rng.random(3)), 0) for _ in range(50)], "n_in double, bytes_in double, uniq_sport_in double, y int")
    fitted = []
    def fit(rows):
        fitted.append(rows.groupBy("y").count().collect())
        return rule
    d = LiveDetector(spark, str(tmp_path), LIVE, rule, fit, base, hybrid=True, calibrate_s=5.0, adaptive=True, retrain_s=6.0)
    calm = lambda t, i: ("s", float(t), f"10.0.0.{10 + i}", float(t), 10.0 + i, 500.0 + 10 * i, 1.0)
    odd = lambda t: ("s", float(t), A, float(t), 90.0, 9e6, 90.0)
    d.process(spark.createDataFrame([calm(t, i) for t in range(4) for i in range(6)], WINDOWS), 0)
    assert d.novelty is None
    d.process(spark.createDataFrame([calm(t, i) for t in range(4, 9) for i in range(6)], WINDOWS), 1)
    assert d.novelty is not None and d.version == 0
    d.process(spark.createDataFrame([w for t in range(9, 13) for w in (odd(t), calm(t, 1))], WINDOWS), 2)
    odd_rows = d.scores().where(F.col("peer_ip") == A).collect()
    assert len(odd_rows) == 4 and all(r["novel"] == r["flagged"] == 1 and r["score"] == 0 for r in odd_rows)
    closed = d.scores().withColumn("now", F.col("window_start")).withColumn("action_ok", F.lit(True)).withColumn("flagged", F.col("flagged") == 1)
    assert [r["peer_ip"] for r in G.block_decisions(closed, 2, 60.0).collect()] == [A]
    d.process(spark.createDataFrame([calm(t, 2) for t in range(13, 17)], WINDOWS), 3)
    events = [(r["event"], r["version"], r["pseudo_attack"]) for name in ("calibrated", "retrained") for r in d.table(name).collect()]
    assert events == [("calibrated", None, None), ("retrained", 1, 3)] and d.version == 1 and len(fitted) == 1
    again = LiveDetector(spark, str(tmp_path), LIVE, rule, fit, base, hybrid=True, calibrate_s=5.0, adaptive=True, retrain_s=6.0).resume()
    assert again.version == 1 and again.novelty.threshold == pytest.approx(d.novelty.threshold)
    assert (again.first, again.next_retrain, again.pool_batch) == (d.first, d.next_retrain, d.pool_batch)


def test_swept_sums_and_next_events_equal_all_pairs(spark):
    import random
    from floodlens.operators.ordering import next_event, sums_before
    rng = random.Random(2)
    events = [(rng.choice("ab"), rng.randrange(-30, 60), rng.randrange(1, 9)) for _ in range(150)]
    queries = [(rng.choice("abc"), i, rng.randrange(-40, 70)) for i in range(120)]
    e = spark.createDataFrame(events, "k string, at long, n long")
    q = spark.createDataFrame(queries, "k string, id long, at long")
    for width in (7, 1000):
        sums = {r.id: r.n for r in sums_before(q, e, ["k"], "at", ["n"], width).collect()}
        after = {r.id: r.t for r in next_event(q, e.select("k", "at"), ["k"], "at", "t", width).collect()}
        for k, i, at in queries:
            mine = [(t, n) for key, t, n in events if key == k]
            assert sums[i] == sum(n for t, n in mine if t < at)
            assert after[i] == min((t for t, _ in mine if t > at), default=None)
