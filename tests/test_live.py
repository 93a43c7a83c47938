"""Live windows and the live chain against the batch operators: several sessions, late packets, restarts."""
import random

import pytest
from pyspark.sql import functions as F

from builders import packets_df
from floodlens.operators.packets import late_counts
from floodlens.operators.peer_windows import peer_windows
from floodlens.operators.views import flow_view
from floodlens.streaming.jobs import drain_batches
from floodlens.streaming.windows import LiveWindows, peer_view
from floodlens.streaming.windows import flow_view as live_flows

V, HOSTS = "10.0.0.100", ["10.0.0.11", "10.0.0.12", "10.0.0.21"]


def traffic(spark, seed=0, n=400):
    """Two sessions recorded a day apart in one arrival order, some packets late, some of no protected host."""
    rng, rows, clock = random.Random(seed), [], {"s1": 1_000_000, "s2": 86_400_000_000}
    for seq in range(n):
        s = rng.choice(["s1", "s2"])
        clock[s] += rng.randrange(0, 60_000)
        ts = clock[s] - (rng.randrange(500_000, 2_500_000) if rng.random() < 0.15 else 0)
        peer = rng.choice(HOSTS)
        ends = rng.choice([(peer, V), (peer, V), (V, peer), (peer, "10.0.0.99")])
        proto = rng.choice([1, 6, 17])
        rows.append((s, seq, ts, *ends, proto, rng.randrange(40, 1500), rng.randrange(0, 1000), rng.randrange(1, 5), rng.randrange(1, 5), rng.randrange(32)))
    return packets_df(spark, rows)


def feed(spark, tmp_path, rows, view, cuts, restart=True, bits=4):
    """Each slice is a micro-batch of its own; with `restart` another driver takes each one."""
    source, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    live = LiveWindows(spark, folder, [V], view, bits)
    for low, high in zip([0, *cuts], [*cuts, 1 << 40]):
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(source)
        if restart:
            live = LiveWindows(spark, folder, [V], view, bits)
        drain_batches(spark.readStream.schema(rows.schema).parquet(source), live.process, state)
    live.flush()
    return live


def same(a, b):
    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(a) == rows(b.select(*a.columns))


@pytest.mark.parametrize("seed,cuts,restart", [(0, [150], True), (1, [37, 38, 220], True), (2, [100, 300], False)])
def test_live_windows_of_two_sessions_equal_the_batch(spark, tmp_path, seed, cuts, restart):
    rows = traffic(spark, seed)
    live = feed(spark, tmp_path, rows, peer_view(), cuts, restart)
    batch = peer_windows(rows, [V], drop_late=True, bits=5)
    assert batch.select("session").distinct().count() == 2
    same(batch, live.table("windows"))
    late = late_counts(rows)
    assert late.agg(F.min("late")).first()[0] > 0
    same(late, live.late())


def test_live_flows_of_two_sessions_equal_the_batch(spark, tmp_path):
    rows = traffic(spark, 3)
    from floodlens.operators.packets import drop_late
    same(flow_view(drop_late(rows, 30.0), [V]), feed(spark, tmp_path, rows, live_flows(), [200]).table("windows"))


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = traffic(spark, 4)
    live = feed(spark, tmp_path, rows, peer_view(), [120, 260])
    before = sorted(map(tuple, live.table("windows").where("batch < 3").collect()))
    again = LiveWindows(spark, live.folder, [V], peer_view(), 4)
    again.process(rows.where("seq >= 260"), 2)
    again.process(rows.where("seq >= 120 and seq < 260"), 1)
    assert sorted(map(tuple, again.table("windows").where("batch < 3").collect())) == before
    assert LiveWindows(spark, str(tmp_path / "none"), [V]).flush() is None


@pytest.mark.parametrize("window_s,bits", [(1.0, 2), (10.0, 13), (86_400.0, 3), (400 * 86_400.0, 13)])
def test_windows_of_any_length_equal_a_walk(spark, window_s, bits):
    rng, rows, ts = random.Random(5), [], 0
    for seq in range(300):
        ts += rng.randrange(0, int(window_s * 60_000))
        rows.append(("s", seq, ts, rng.choice(HOSTS[:2]), V, 17, 100, 50, rng.randrange(1, 9), 80, 0))
    got = {(r.window_start, r.peer_ip): r for r in peer_windows(packets_df(spark, rows), [V], window_s, bits).collect()}
    groups = {}
    for _, _, t, src, *rest in rows:
        groups.setdefault((t // int(window_s * 1e6) * window_s, src), []).append((t, rest[4]))
    assert set(got) == set(groups)
    for key, arrivals in groups.items():
        gaps = [b - a for (a, _), (b, _) in zip(arrivals, arrivals[1:])]
        n, total, squares = len(gaps), sum(gaps), sum(g * g for g in gaps)
        std = (max(squares / n - (total / n) ** 2, 0) ** 0.5 / 1e6) if n else 0
        assert got[key].iat_std_in == pytest.approx(std, rel=1e-6, abs=1e-6)
        assert got[key].uniq_sport_in == len({p for _, p in arrivals}) and got[key].n_in == n + 1


def test_windows_take_one_scan_and_late_ones_two(spark, tmp_path):
    path = str(tmp_path / "p")
    traffic(spark).write.parquet(path)
    rows = spark.read.parquet(path)

    def plan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return text.count("FileScan parquet"), text.count("Exchange hashpartitioning")
    assert plan(peer_windows(rows, [V])) == (1, 2)  # packets once, parts once
    assert plan(peer_windows(rows, [V], drop_late=True))[0] == 2


FEATURES = ["n_in", "bytes_in"]


def rule(rows):
    return rows.withColumn("score", (F.col("n_in") / 4.0))


@pytest.mark.parametrize("seed", [6])
def test_chain_equals_block_decisions_on_the_same_packets(spark, tmp_path, seed):
    from floodlens.operators.mitigation import block_decisions
    from floodlens.operators.monitoring import minute_stats, packets_per_minute
    from floodlens.operators.packets import drop_late
    from floodlens.operators.peer_windows import window_ends
    from floodlens.streaming.chain import LiveChain
    rows = traffic(spark, seed, 900)
    works = F.col("bytes_in") % 3 != 0
    source, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for low, high in [(0, 200), (200, 640), (640, 900)]:
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(source)
        chain = LiveChain(spark, folder, [V], FEATURES, rule, works, 2, 3.0, [HOSTS[0]], bits=4)
        drain_batches(spark.readStream.schema(rows.schema).parquet(source), chain.process, state)
        chain.process(rows.where((F.col("seq") >= low) & (F.col("seq") < high)), chain.windows.last)  # a batch that is run again
    chain.flush()
    kept = drop_late(rows)
    w = peer_windows(kept, [V], features=FEATURES).join(window_ends(kept), ["session", "window_start"])
    scored = rule(w).withColumnRenamed("closed_at", "now").withColumn("flagged", F.col("score") >= 0.5).withColumn("action_ok", works)
    expected = block_decisions(scored, 2, 3.0, [V, HOSTS[0]])
    kinds = {r["event"] for r in expected.collect()}
    assert kinds == {"block", "error"}
    same(expected, chain.actions())
    blocks = expected.where("event = 'block'")
    versions = spark.createDataFrame([], "ts double, version int")
    same(minute_stats(scored, packets_per_minute(rows), blocks, versions), chain.minutes())
    # peers whose block is over and that have no run are not kept
    state = chain._table("decided").where("kind = 'state'").orderBy(F.desc("batch"))
    assert state.where("streak = 0 and until < 0").count() == 0


def failing(bad, calls=None):
    @F.udf("double")
    def score(peer, n):
        if peer in bad:
            raise ValueError("bad row")
        return float(n)
    return lambda rows: rows.withColumn("score", score("peer_ip", "n_in"))


def test_one_bad_row_costs_one_error_row(spark, tmp_path):
    from floodlens.streaming.detector import LiveDetector
    rows = spark.createDataFrame([("s", 1.0, f"p{i}", 2.0, float(i % 2), 1.0) for i in range(60)],
                                 "session string, window_start double, peer_ip string, now double, n_in double, bytes_in double")
    live = LiveDetector(spark, str(tmp_path / "a"), FEATURES, failing({"p7", "p31"}))
    live.process(rows, 0)
    assert {r["peer_ip"] for r in live.table("errors").collect()} == {"p7", "p31"}
    assert {r["peer_ip"] for r in live.scores().collect()} == {f"p{i}" for i in range(60)} - {"p7", "p31"}
    live.process(rows.where("peer_ip = 'p3'"), 1)  # and the stream goes on
    assert live.scores().count() == 59


def test_a_scorer_that_always_fails_gives_error_rows(spark, tmp_path, monkeypatch):
    from floodlens.streaming import detector
    monkeypatch.setattr(detector, "MAX_FAILURES", 5)
    rows = spark.createDataFrame([("s", 1.0, f"p{i}", 2.0, 1.0, 1.0) for i in range(40)],
                                 "session string, window_start double, peer_ip string, now double, n_in double, bytes_in double")
    live = detector.LiveDetector(spark, str(tmp_path / "b"), FEATURES, failing({f"p{i}" for i in range(40)}))
    live.process(rows, 0)
    assert live.table("errors").count() == 40 and live.table("errors").select("peer_ip").distinct().count() == 40
    assert live.scores().count() == 0
