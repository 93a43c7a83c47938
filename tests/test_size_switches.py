"""Results must not depend on size limits, repeated keys, header forms or link types."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.operators import neighbours, sampling
from floodlens.operators.labeling import label_windows
from floodlens.operators.neighbours import nearest
from floodlens.operators.novelty import novelty_fit
from floodlens.sources import capture
from floodlens.sources.readers import read_scores
from floodlens.streaming.decisions import _run_positions


def windows(spark, n, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"s{seed}", float(i), "p", rng.gauss(10, 2), rng.gauss(100, 10)) for i in range(n)],
                                 "session string, window_start double, peer_ip string, a double, b double")


def test_novelty_is_the_same_on_both_paths(spark):
    key, normal, new = ["session", "window_start", "peer_ip"], windows(spark, 120, 1), windows(spark, 9, 2)
    scores = [{r.window_start: round(r.novelty, 9) for r in novelty_fit(normal, ["a", "b"], key, **o).score(new).collect()}
              for o in ({}, {"max_broadcast": 50}, {"max_broadcast": 0})]
    assert scores[0] == scores[1] == scores[2] and len(set(scores[0].values())) == 9


@pytest.mark.parametrize("max_broadcast", [0, 50_000])
def test_copies_leave_out_themselves_and_not_each_other(spark, max_broadcast):
    rows = [(f"{i:02d}", [float(i // 8), 0.0], i) for i in range(24)]
    table = spark.createDataFrame(rows, "qid string, vec array<double>, label int")
    out = nearest(table, table.selectExpr("qid as rid", "vec", "label"), 3, True, max_broadcast=max_broadcast, pivots=2, block_rows=8)
    for r in out.collect():
        copies = [q for q, vec, _ in rows if vec == r.vec and q != r.qid]
        assert [n.rid for n in r.neighbours] == copies[:3]


def test_routes_and_exact_pairs_are_made_in_small_batches(spark, monkeypatch):
    """Equal distances all over make most pairs candidates, and every cell is in reach."""
    rng = np.random.default_rng(5)
    x = np.sign(rng.normal(size=(300, 8)))
    want = neighbours.nearest_in_blocks(x, x, 4)
    monkeypatch.setattr(neighbours, "BATCH_VALUES", 64)
    got = neighbours.nearest_in_blocks(x, x, 4, block=37)
    assert all((a == b).all() for a, b in zip(want, got))
    rows = [(f"{i:03d}", [float(v) for v in x[i]], 0) for i in range(len(x))]
    table = spark.createDataFrame(rows, "qid string, vec array<double>, label int")
    refs = table.selectExpr("qid as rid", "vec", "label")
    found = [sorted((r.qid, [n.rid for n in r.neighbours]) for r in nearest(table, refs, 4, True, **o).collect())
             for o in ({}, {"max_broadcast": 0, "pivots": 9, "block_rows": 40}, {"max_broadcast": 0})]
    assert found[0] == found[1] == found[2]


def test_nearest_names_its_own_queries(spark):
    refs = spark.createDataFrame([(str(i), [float(i), 0.0], i) for i in range(30)], "rid string, vec array<double>, label int")
    queries = spark.createDataFrame([("same", [x, 1.0]) for x in (0.1, 7.2, 7.2, 28.0)], "qid string, vec array<double>")
    found = [sorted((r.vec, [n.rid for n in r.neighbours]) for r in nearest(queries, refs, 2, max_broadcast=m).collect()) for m in (0, 29, 50_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 4


def test_labels_do_not_depend_on_the_schedule_limit(spark):
    attacks = spark.createDataFrame([("s", 1, "p", "syn", 3, "fast", 0.0, 5000.0, 1), ("s", 2, "p", "udp", 2, "slow", 100.0, 200.0, 2)],
                                    "session string, round int, ip string, attack string, label int, rate string, start_ts double, end_ts double, ev_order int")
    rows = spark.createDataFrame([("s", float(t), "p") for t in (50, 150, 4900, 9000)], "session string, window_start double, peer_ip string")
    found = [sorted((r.window_start, r.label) for r in label_windows(rows, attacks, max_schedule=m).collect()) for m in (0, 3, 50_000)]
    assert found[0] == found[1] == found[2] == [(50.0, 3), (150.0, 2), (4900.0, 3), (9000.0, 0)]


@pytest.mark.parametrize("n", [2, 4, 9])
def test_quota_holds_when_keys_repeat(spark, n):
    rows = spark.createDataFrame([(i % 2, i // 2 % 3, i) for i in range(15)], "label int, id int, v int")
    kept = sampling.undersample(rows, ["id"], 1)
    assert sorted(r.label for r in kept.collect()) == [0] * 7 + [1] * 7
    capped = sampling.stratified_cap(rows.where("label = 0"), n, ["id"], 1)
    assert capped.count() == min(n, 8) and capped.distinct().count() == min(n, 8)


def test_scores_are_read_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("window_start,peer_ip,n_in,score,novel,flagged\n10.0,x,5,0.5,0,1\n")
    (tmp_path / "b.csv").write_text("window_start,peer_ip,n_in,score,flagged\n11.0,y,6,0.25,1\n")
    (tmp_path / "c.csv").write_text("window_start,peer_ip,n_in,score,novel,flagged,model_version\n12.0,z,7,0.75,1,0,3\n")
    rows = {r.peer_ip: (r.n_in, r.novel, r.flagged, r.model_version) for r in read_scores(spark, str(tmp_path)).collect()}
    assert rows == {"x": (5, 0, 1, 0), "y": (6, 0, 1, 0), "z": (7, 1, 0, 3)}


def test_other_link_types_are_counted_not_decoded(spark):
    ip = bytes([0x45, 0, 0, 40]) + bytes(8) + bytes([10, 0, 0, 1]) + bytes([10, 0, 0, 2]) + bytes(20)
    frame = bytes(12) + b"\x08\x00" + ip
    rows = [("c", 0, 0, 1, 1, 54, bytearray(frame)), ("c", 0, 1, 105, 2, 54, bytearray(b"??")), ("c", 0, 2, 1, 3, 54, bytearray(frame))]
    frames = spark.createDataFrame(rows, capture.FRAMES)
    assert tuple(capture.slice_counts(frames, ["10.0.0.1"]).first()) == (3, 2, 1)


def test_interface_clocks():
    assert capture.clock_units(b"", "<") == 1_000_000
    assert capture.clock_units(bytes([2, 0, 1, 0, 7, 0, 0, 0, 9, 0, 1, 0, 9, 0, 0, 0]), "<") == 10 ** 9
    assert capture.clock_units(bytes([9, 0, 1, 0, 0x8A, 0, 0, 0, 0, 0, 0, 0]), "<") == 1 << 10


def test_run_positions_equal_a_walk():
    rng = random.Random(4)
    for _ in range(200):
        n, run = rng.randint(1, 12), rng.randint(0, 3)
        flag, broken = (np.array([rng.random() < p for _ in range(n)]) for p in (0.7, 0.2))
        want, now = [], run
        for f, b in zip(flag, broken):
            now = ((0 if b else now) + 1) if f else 0
            want.append(now)
        assert _run_positions(flag, broken, run).tolist() == want


def test_settings_of_one_two_and_three_sessions(spark):
    def of(*names):
        return sorted(tuple(r) for r in sampling.training_settings(spark.createDataFrame([(n,) for n in names], "session string")).collect())
    assert of("a") == [("a only", "a"), ("all datasets", "a")]
    assert ("all but a", "b") not in of("a", "b") and ("all but a", "c") in of("a", "b", "c", "c")
    assert F.lit(1) is not None and len(of("a", "b", "c")) == 12
