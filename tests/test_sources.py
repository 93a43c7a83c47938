"""Captures, decoding, slices, schedules, logs."""
import json
import struct
import zipfile

import pytest
from builders import SYN, A, V, block, ethernet, icmp, ipv4, pcap, pcapng, tcp, udp
from pyspark.sql import functions as F

from floodlens.functions.columns import local_epoch
from floodlens.operators import labeling as L
from floodlens.schemas import ATTACKS, FEATURES, FRAMES
from floodlens.sources import capture as C
from floodlens.sources import readers as R
from floodlens.sources import sinks as K


def decode(spark, *frames, linktype=1, ts_us=1_500_000):
    rows = [("t", 0, i, linktype, ts_us, len(f), f) for i, f in enumerate(frames)]
    return C.decode(spark.createDataFrame(rows, FRAMES)).orderBy("seq").collect()


def test_decode_syn(spark):
    (p,) = decode(spark, ethernet(ipv4(A, V, 6, tcp(1234, 80, SYN))))
    assert (p["src"], p["dst"], p["sport"], p["dport"]) == (A, V, 1234, 80)
    assert (p["size"], p["payload"], p["flags"], p["ts_us"]) == (40, 0, SYN, 1_500_000)


def test_decode_vlan_udp_and_double_tags(spark):
    a, b = decode(spark, ethernet(ipv4(A, V, 17, udp(5000, 53, b"x" * 100)), vlans=(5,)),
                  ethernet(ipv4(A, V, 17, udp(5000, 53, b"x" * 100)), vlans=(5, 6)))
    for p in (a, b):
        assert (p["sport"], p["dport"], p["payload"], p["size"]) == (5000, 53, 100, 128)


def test_decode_icmp_with_short_snaplen(spark):
    (p,) = decode(spark, ethernet(ipv4(A, V, 1, icmp(b"x" * 500)))[:60])
    assert (p["size"], p["payload"], p["sport"], p["flags"]) == (528, 500, 0, 0)


def test_other_frames_give_no_row(spark):
    assert decode(spark, ethernet(b"\0" * 28, kind=0x0806), ethernet(b"\x60" + b"\0" * 60, kind=0x86DD),
                  ethernet(ipv4(A, V, 47, b"\0" * 20)), b"\0" * 10, b"",
                  ethernet(ipv4(A, V, 6, tcp(1, 2, 0)))[:40]) == []


def test_later_fragment_has_no_ports(spark):
    (p,) = decode(spark, ethernet(ipv4(A, V, 6, b"\xff" * 30, frag=185)))
    assert (p["sport"], p["dport"], p["flags"], p["payload"]) == (0, 0, 0, 30)


@pytest.mark.parametrize("linktype,prefix", [(113, b"\0" * 14 + b"\x08\0"), (276, b"\x08\0" + b"\0" * 18), (101, b""), (12, b"")])
def test_other_link_types(spark, linktype, prefix):
    (p,) = decode(spark, prefix + ipv4(A, V, 6, tcp(9, 80, 16, b"hello")), linktype=linktype)
    assert (p["src"], p["sport"], p["payload"], p["flags"]) == (A, 9, 5, 16)


def test_unknown_link_type_is_an_error(spark):
    with pytest.raises(Exception, match="unsupported link type 147"):
        decode(spark, b"\0" * 60, linktype=147)


HOST = "192.168.10.50"


def six_frames():
    return [ethernet(ipv4("10.1.1.1", HOST if i % 2 else "10.9.9.9", 6, tcp(1000 + i, 80, 16, b"x" * 300))) for i in range(6)]


def as_pcap(order="<", nano=False):
    magic, part = (0xA1B23C4D, 250_000_789) if nano else (0xA1B2C3D4, 250_000)
    return pcap([(1_500_000_000 + i, part, f) for i, f in enumerate(six_frames())], order, magic)


def as_pcapng(order="<", tsresol=None, units=1_000_000):
    return pcapng([((1_500_000_000 + i) * units + units // 4, f) for i, f in enumerate(six_frames())], order, units, tsresol)


@pytest.mark.parametrize("data", [as_pcap(), as_pcap(">"), as_pcap(nano=True), as_pcap(">", True), as_pcapng(), as_pcapng(">"),
                                  as_pcapng(tsresol=9, units=10**9), as_pcapng(">", 0x80 | 10, 1024)])
def test_both_formats_give_the_same_frames(spark, tmp_path, data):
    path = tmp_path / "in.cap"
    path.write_bytes(data)
    rows = C.read_captures(spark, [str(path)], "t").orderBy("frame_seq").collect()
    assert len(rows) == 6
    r = rows[1]
    assert (r["linktype"], r["ts_us"], r["origlen"]) == (1, 1_500_000_001_250_000, 354)
    assert bytes(r["data"]) == six_frames()[1]


def test_cut_empty_and_foreign_files(spark, tmp_path):
    for name, data in (("cut", as_pcap()[:-20]), ("empty", b""), ("bad", b"GIF89a....")):
        (tmp_path / name).write_bytes(data)
    assert C.read_captures(spark, [str(tmp_path / "cut")], "t").count() == 5
    assert C.read_captures(spark, [str(tmp_path / "empty")], "t").count() == 0
    with pytest.raises(Exception, match="not a pcap"):
        C.read_captures(spark, [str(tmp_path / "bad")], "t").count()


def test_new_section_resets_byte_order_and_interfaces(spark, tmp_path):
    path = tmp_path / "two.pcapng"
    path.write_bytes(as_pcapng("<") + as_pcapng(">", tsresol=9, units=10**9))
    rows = C.read_captures(spark, [str(path)], "t").collect()
    assert len(rows) == 12 and len({r["ts_us"] for r in rows}) == 6
    assert block(3, b"") and struct.calcsize("I") == 4


def test_zip_members_in_natural_order_and_slice(spark, tmp_path):
    archive = tmp_path / "day.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("SAT_10", as_pcap())
        z.writestr("SAT_2", as_pcapng())
    assert [f.member for f in C.plan_files([str(archive)])] == ["SAT_2", "SAT_10"]
    names = spark.createDataFrame([("SAT_10",), ("SAT_2",), ("SAT_0",)], "n string")
    assert [r["n"] for r in names.orderBy(C.natural_order(F.col("n"))).collect()] == ["SAT_0", "SAT_2", "SAT_10"]
    frames = C.read_captures(spark, [str(archive)], "t").where("file_idx = 0")
    assert C.slice_counts(frames, [HOST]).first().asDict() == {"seen": 6, "kept": 3, "other_link": 0}
    out = str(tmp_path / "slice")
    C.write_slice(frames, [HOST], out)
    kept = spark.read.parquet(out)
    assert {len(r["data"]) for r in kept.collect()} == {96} and {r["origlen"] for r in kept.collect()} == {354}
    packets = C.decode(kept.select(*FRAMES.names)).orderBy("seq").collect()
    assert [(p["sport"], p["size"], p["payload"]) for p in packets] == [(1001, 340, 300), (1003, 340, 300), (1005, 340, 300)]
    in_scan = C.read_captures(spark, [str(archive)], "t", hosts=[HOST], snaplen=96).where("file_idx = 0")
    assert sorted(bytes(r["data"]) for r in in_scan.collect()) == sorted(bytes(r["data"]) for r in kept.collect())


def test_frames_of_another_link_type_are_skipped(spark):
    f = six_frames()
    rows = [("t", 0, i, 1 if i < 4 else 113, 0, 354, f[i]) for i in range(6)]
    assert C.slice_counts(spark.createDataFrame(rows, FRAMES), [HOST]).first().asDict() == {"seen": 6, "kept": 2, "other_link": 2}


def test_local_times(spark):
    rows = spark.createDataFrame([("2017-07-07 15:56",), ("2017-07-07 15:56:30",)], "s string")
    a, b = [r[0] for r in rows.orderBy("s").select(local_epoch(F.col("s"), F.lit(-3))).collect()]
    assert a == 1499453760.0 and b == a + 30     # 18:56 UTC


def test_label_by_published_schedule(spark):
    attacks = R.catalog_attacks(spark, "x", "172.16.0.1", 0, [
        ("scan", -1, "2017-07-07 10:00", "2017-07-07 10:05"), ("flood", 4, "2017-07-07 11:00", "2017-07-07 11:10")])
    t = 1499385600.0
    rows = [(t + 36120, "172.16.0.1"), (t + 39900, "172.16.0.1"), (t + 40201, "172.16.0.1"), (t + 40250, "172.16.0.1"), (t + 39900, "192.168.10.3")]
    w = spark.createDataFrame([("x", s, ip) for s, ip in rows], "session string, window_start double, peer_ip string")
    hosts = spark.createDataFrame([("x", "172.16.0.1")], "session string, ip string")
    out, per_attack = L.label_catalog(w, attacks, hosts, "x")
    assert [(r["peer_ip"], r["label"], r["attack_rate"]) for r in out.orderBy("window_start", "peer_ip").collect()] == [
        ("172.16.0.1", 4, ""), ("192.168.10.3", 0, ""), ("172.16.0.1", 4, "")]
    assert {r["attack"]: r["windows"] for r in per_attack.collect()} == {"flood": 2, "scan": 1}
    assert L.unmatched_count(L.label_windows(w, attacks, grace=2.0), hosts).first()[0] == 1


def test_session_and_schedule_files(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"session": "m0", "victim": V, "clients": {"c1": "10.0.0.11"},
                                                    "attackers": {"a1": A, "a2": "10.0.0.22"}}, indent=2))
    (tmp_path / "events.csv").write_text("session,round,attacker,ip,attack,label,rate,pps,size,port,start_ts,end_ts\n"
                                         f"m0,1,a1,{A},udp,2,low,10,0,53,1000.0,1010.0\n")
    (tmp_path / "none.csv").write_text("session,round,attacker,ip,attack,label,rate,pps,size,port,start_ts,end_ts\n")
    s = R.read_sessions(spark, str(tmp_path / "meta.json"))
    assert {r["ip"] for r in R.session_hosts(s, "attackers").collect()} == {A, "10.0.0.22"}
    (e,) = R.read_attacks(spark, str(tmp_path / "events.csv")).collect()
    assert (e["round"], e["label"], e["pps"], e["start_ts"]) == (1, 2, 10, 1000.0)
    assert R.read_attacks(spark, str(tmp_path / "none.csv")).count() == 0


def test_capture_counters(spark):
    lines = spark.createDataFrame([("listening on x",), ("120 packets captured",), ("1 packet received by filter",), ("0 packets dropped by kernel",)], "value string")
    assert R.capture_counters(lines).first().asDict() == {"captured": 120, "received_by_filter": 1, "dropped_by_kernel": 0}


def test_tail_reads_new_files_only(spark, tmp_path):
    from floodlens.streaming.jobs import drain
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a",), ("",)], "value string").coalesce(1).write.text(source)
    drain(R.tail_lines(spark, source), out, state)
    assert [r[0] for r in spark.read.parquet(out).collect()] == ["a"]
    spark.createDataFrame([("bc",), ("d",)], "value string").coalesce(1).write.mode("append").text(source)
    drain(R.tail_lines(spark, source), out, state)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "bc", "d"]


def test_reuse_and_model_store(spark, tmp_path):
    calls = []
    def build():
        calls.append(1)
        return spark.createDataFrame([("s1", 1.0)], "session string, x double")
    for refresh in (False, False, True):
        out = K.materialise_or_reuse(spark, str(tmp_path / "cache"), {"windows": build}, refresh)
        assert out["windows"].count() == 1
    assert len(calls) == 2
    from floodlens.operators.models import fit_forest
    rows = spark.createDataFrame([(float(i), float(i % 3), int(i > 10)) for i in range(20)], "a double, b double, y int")
    K.save_model(fit_forest(rows, ["a", "b"], trees=2, depth=3), str(tmp_path / "m"), ["a", "b"], 1.0, {0: "Normal"}, ["s1"])
    _, info, base = K.load_model(spark, str(tmp_path / "m"), ["a", "b"])
    assert info["labels"] == {"0": "Normal"} and base is None
    with pytest.raises(ValueError):
        K.load_model(spark, str(tmp_path / "m"), FEATURES)


def test_missing_sequence_is_an_error(spark):
    w = spark.createDataFrame([("s", 1.0, "a"), ("s", 2.0, "a")], "session string, window_start double, peer_ip string")
    s = spark.createDataFrame([("s", 1.0, "a", 3)], "session string, window_start double, peer_ip string, length int")
    with pytest.raises(Exception, match="no sequence for window"):
        L.attach_sequences(w, s).collect()


def mixed_capture(n=400, order="<", seed=3):
    """Frames of many lengths; some carry bytes that look like a chain of record headers, one is very long."""
    import random
    rng, frames = random.Random(seed), []
    for i in range(n):
        body = rng.randbytes(rng.choice([20, 60, 200, 900]))
        if i % 17 == 0:
            fake = struct.pack(order + "4I", 1_500_000_000, 5, 40, 40) + b"\7" * 40
            body = fake * 12
        if i == 150:
            body = rng.randbytes(30_000)
        frames.append((1_500_000_000 + i, i, body))
    return pcap(frames, order, 0xA1B2C3D4)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("split_bytes", [700, 5_000, 60_000])
def test_a_file_in_ranges_gives_the_rows_of_one(spark, tmp_path, order, split_bytes):
    (tmp_path / "a_1").write_bytes(mixed_capture(order=order)[:-7])     # its last record is cut off
    (tmp_path / "a_2").write_bytes(mixed_capture(90, order, 4))
    (tmp_path / "a_3").write_bytes(as_pcapng())
    paths = [str(tmp_path / f"a_{i}") for i in (1, 2, 3)]
    key = lambda df: sorted(map(tuple, df.select("file_idx", "frame_seq", "linktype", "ts_us", "origlen", F.md5("data")).collect()))
    whole, cut = C.read_captures(spark, paths, "t"), C.read_captures(spark, paths, "t", split_bytes=split_bytes)
    assert whole.count() == 399 + 90 + 6 and key(cut) == key(whole)
    assert cut.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    assert key(cut.where("file_idx = 1")) == key(whole.where("file_idx = 1"))


def test_misled_ranges_are_walked_again(spark, tmp_path):
    from floodlens.sources import splits
    path = tmp_path / "a"
    path.write_bytes(mixed_capture())
    size, (begins, beyond, frames) = path.stat().st_size, splits.walked(str(path), 24, 4000, 24)
    assert begins == 24 and splits.walked(str(path), beyond, size, beyond)[2] == 400 - frames
    with open(path, "rb") as f:
        form = C.PcapFormat(f.read(24))
        # from inside the made-up headers the search is misled, so `located` has something to mend
        looks = {splits.first_record(f, form, at, size) for at in range(24, size, 701)}
        f.seek(24)
        true = set()
        for data, offsets in form.blocks(f, 24):
            true |= {24 + o for o in offsets}
    assert looks - true - {size}


def test_conditions_are_pushed_into_the_reader(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p_{i}").write_bytes(as_pcap())
    frames = C.read_captures(spark, [str(tmp_path)], "t")
    low = 1_500_000_002_250_000
    late = frames.where((F.col("ts_us") >= low) & (F.col("file_idx").isin(0, 2)) & (F.col("linktype") == 1) & (F.length("data") > 0))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "length(data" in plan and "ts_us#" in plan
    kept = [line for line in plan.splitlines() if " Filter " in line]
    assert len(kept) == 1 and "ts_us" not in kept[0] and "file_idx" not in kept[0] and "linktype" not in kept[0]
    assert late.count() == 8 and late.rdd.getNumPartitions() == 2
    reader = C.CaptureReader({"paths": str(tmp_path), "session": "t"})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual
    left = list(reader.pushFilters([GreaterThanOrEqual(("ts_us",), low), EqualTo(("session",), "t"), EqualTo(("file_idx",), 1)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and left[0].attribute == ("session",)
    parts = reader.partitions()
    assert [p.file_idx for p in parts] == [1]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 4  # frames that leave the reader
    assert frames.where("file_idx = 9").count() == 0


def test_events_keep_the_order_of_their_file(spark, tmp_path):
    from floodlens.operators.labeling import label_windows
    head = ",".join(ATTACKS.names)
    line = lambda ip, label, start: f"s,1,a,{ip},x,{label},low,1,0,80,{start},{start + 9}"
    wide = [line(f"10.0.{i // 200}.{i % 200}", 1, 1000 + i) for i in range(2000)]
    # of two events of one round and start, the later line wins, whatever their addresses
    (tmp_path / "events.csv").write_text("\n".join([head, line("10.9.9.9", 2, 50), line("10.9.9.9", 5, 50), line("10.9.9.9", 3, 50), *wide]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = R.read_attacks(spark, str(tmp_path / "events.csv"))
        assert rows.rdd.getNumPartitions() > 2
        assert [r.label for r in rows.orderBy("ev_order").collect()][:3] == [2, 5, 3]
        assert [r.start_ts for r in rows.orderBy("ev_order").collect()][3:] == [1000.0 + i for i in range(2000)]
        windows = spark.createDataFrame([("s", 52.0, "10.9.9.9")], "session string, window_start double, peer_ip string")
        assert label_windows(windows, rows).first()["label"] == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
