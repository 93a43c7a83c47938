"""Per-peer time-window features (W1-W28) in one pass over the packets.

Packets are dealt once, by window and chunk of the arrival order, so a flood of one peer is many
tasks. A part holds what is known of a stretch of a window: sums, extremes, first and last arrival
with the squared gaps between them, and the count of each port. Parts of neighbouring stretches
merge into one; a single packet is a part, so the same merge makes parts of packets and windows of
parts, whatever the packets were cut into. A stream keeps the parts of its open windows and merges
them with the next ones (streaming/windows.py).
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from floodlens.functions.columns import has_flag, share, slot_start, spread, syn_and_ack, syn_only
from floodlens.operators.ordering import arrival_chunk
from floodlens.operators.packets import direction, mark_late, with_slot
from floodlens.schemas import (ACK, FEATURES, FIN, ICMP, PSH, RST, SYN, TCP, UDP,
                               WINDOW_SECONDS)

# A part holds the packets of one window among at most 2^bits arrivals
PART_BITS = 13
WINDOW_KEYS = ["session", "slot", "peer"]
COUNTS = ["n_in", "n_out", "tcp", "udp", "icmp", "syn", "ack", "rst", "fin", "psh", "synack_out", "rst_out"]
SUMS = ["bytes_in", "bytes_out", "size_sq", "payload_in"]
PORT_LISTS = {"sports": "int", "sports_n": "long", "dports": "int", "dports_n": "long"}
NEVER = (1 << 63) - 1
PORT_FEATURES = {"uniq_sport_in", "uniq_dport_in", "sport_entropy_in", "dport_entropy_in"}
GAP_FEATURES = {"iat_mean_in", "iat_std_in"}


def _sums(inbound, outbound):
    """The algebraic parts of a window, as (name, expression, aggregate)."""
    size = F.col("size").cast("bigint")
    counted = {
        "n_in": inbound,
        "n_out": outbound,
        "tcp": inbound & (F.col("proto") == TCP),
        "udp": inbound & (F.col("proto") == UDP),
        "icmp": inbound & (F.col("proto") == ICMP),
        "syn": inbound & syn_only(),
        "ack": inbound & has_flag(ACK),
        "rst": inbound & has_flag(RST),
        "fin": inbound & has_flag(FIN),
        "psh": inbound & has_flag(PSH),
        "synack_out": outbound & syn_and_ack(),
        "rst_out": outbound & has_flag(RST),
    }
    summed = {
        "bytes_in": F.when(inbound, size),
        "bytes_out": F.when(outbound, size),
        "size_sq": F.when(inbound, size * size),
        "payload_in": F.when(inbound, F.col("payload").cast("bigint")),
    }
    return counted, summed


def plain_level(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per window in one aggregation: sums, counts and extremes."""
    inbound = F.col("inbound")
    counted, summed = _sums(inbound, ~inbound)
    return keyed.groupBy(*keys).agg(
        *[F.count_if(cond).alias(name) for name, cond in counted.items()],
        *[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in summed.items()],
        F.min(F.when(inbound, F.col("size"))).alias("min_size_in"),
        F.max(F.when(inbound, F.col("size"))).alias("max_size_in")).where(F.col("n_in") > 0)


def part_schema(ports: bool = True) -> str:
    """Columns of a part: the window, its first and last arrival, gaps squared in limbs, sums, port counts."""
    whole = ["first_seq", "first_ts", "last_ts", "sq0", "sq1", "sq2", *COUNTS, *SUMS, "min_size_in", "max_size_in"]
    lists = [f"{p} array<{kind}>" for p, kind in PORT_LISTS.items()] if ports else []
    return ", ".join(["session string, slot long, peer string", *[f"{c} long" for c in whole], *lists])


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _limbs(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gap * gap as three numbers to be weighted by 1, 2^24 and 2^48: exact for windows of up to a year."""
    high, low = gap >> 24, gap & 0xFFFFFF
    return low * low, 2 * high * low, high * high


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where the runs of rows with equal columns begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _codes(strings: pa.Array) -> np.ndarray:
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _merge(c: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
    """One part for each run of parts; rows of a run are in the order of their first arrivals, parts without one last."""
    at, out = np.arange(len(c["n_in"])), {}
    for name in (*COUNTS, *SUMS):
        out[name] = np.add.reduceat(c[name], starts)
    out["min_size_in"] = np.minimum.reduceat(c["min_size_in"], starts)
    out["max_size_in"] = np.maximum.reduceat(c["max_size_in"], starts)
    out["first_seq"], out["first_ts"] = c["first_seq"][starts], c["first_ts"][starts]
    arrived = c["n_in"] > 0
    last = np.maximum.reduceat(np.where(arrived, at, -1), starts)
    out["last_ts"] = np.where(last >= 0, c["last_ts"][last], 0)
    gap = np.zeros(len(at), np.int64)
    inner = arrived.copy()
    inner[starts] = False
    inner = np.flatnonzero(inner)
    gap[inner] = c["first_ts"][inner] - c["last_ts"][inner - 1]
    for name, limb in zip(("sq0", "sq1", "sq2"), _limbs(gap)):
        out[name] = np.add.reduceat(c[name] + limb, starts)
    return out


def _merge_ports(run: np.ndarray, port: np.ndarray, n: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, ports, counts) of every run, from entries (run, port, n)."""
    key = run << 16 | port
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    counts = np.add.reduceat(n[order], first) if len(first) else n[:0]
    return np.searchsorted(key[first] >> 16, np.arange(runs + 1)), key[first] & 0xFFFF, counts


def _batch(names: list[str], c: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := c[n], pa.Array) else pa.array(x) for n in names], names)


def _packet_columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Every packet as a part of its own."""
    inbound, seq, ts, size, payload, proto, flags = (
        batch.column(n).to_numpy(zero_copy_only=False) for n in ("inbound", "seq", "ts_us", "size", "payload", "proto", "flags"))
    tcp, size = proto == TCP, size.astype(np.int64)

    def tcp_flag(bits, value=None):
        return tcp & ((flags & bits) == value if value is not None else (flags & bits) != 0)
    marks = {"n_in": inbound, "n_out": ~inbound, "tcp": inbound & tcp, "udp": inbound & (proto == UDP), "icmp": inbound & (proto == ICMP),
             "syn": inbound & tcp_flag(SYN | ACK, SYN), "ack": inbound & tcp_flag(ACK), "rst": inbound & tcp_flag(RST),
             "fin": inbound & tcp_flag(FIN), "psh": inbound & tcp_flag(PSH),
             "synack_out": ~inbound & tcp_flag(SYN | ACK, SYN | ACK), "rst_out": ~inbound & tcp_flag(RST)}
    c = {n: m.astype(np.int64) for n, m in marks.items()}
    c |= {"bytes_in": size * inbound, "bytes_out": size * ~inbound, "size_sq": size * size * inbound,
          "payload_in": payload.astype(np.int64) * inbound}
    c |= {"min_size_in": np.where(inbound, size, NEVER), "max_size_in": np.where(inbound, size, -1)}
    c |= {"first_seq": np.where(inbound, seq, NEVER), "first_ts": ts, "last_ts": ts}
    return c | {n: np.zeros(len(seq), np.int64) for n in ("sq0", "sq1", "sq2")}


def _to_parts(ports: bool):
    """Packets in the order of seq to parts, one for each window and chunk of a batch."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [_codes(batch.column("session")), _codes(batch.column("peer")),
                   *(batch.column(n).to_numpy() for n in ("slot", "chunk"))]
            # stable, so the inbound packets of a run come first and keep the order of seq
            order = np.lexsort((~batch.column("inbound").to_numpy(zero_copy_only=False), *own))
            own, batch = [x[order] for x in own], batch.take(pa.array(order))
            starts, c = _runs(own), _packet_columns(batch)
            out = _merge(c, starts)
            if ports:
                run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
                there = np.flatnonzero(c["n_in"] > c["icmp"])
                for p in ("sport", "dport"):
                    values = batch.column(p).to_numpy(zero_copy_only=False)[there].astype(np.int64)
                    offsets, port, n = _merge_ports(run[there], values, np.ones(len(there), np.int64), len(starts))
                    out[f"{p}s"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(port, pa.int32()))
                    out[f"{p}s_n"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(n))
            for name in ("session", "slot", "peer"):
                out[name] = batch.column(name).take(pa.array(starts))
            yield _batch(_names(part_schema(ports)), out)
    return search


def window_parts(keyed: DataFrame, ports: bool = True) -> DataFrame:
    """Parts of windows. `keyed`: packets with inbound, peer, slot and chunk, dealt so that the rows of a (window,
    chunk) lie in one partition; parts of a window hold disjoint stretches of the arrival order."""
    columns = [*WINDOW_KEYS, "chunk", "inbound", "seq", "ts_us", "size", "payload", "proto", "flags", *(("sport", "dport") if ports else ())]
    rows = keyed.select(*columns).sortWithinPartitions("seq")      # one number: no windows' names are compared
    return rows.mapInArrow(_to_parts(ports), part_schema(ports))


def _to_totals(ports: bool, extra: list[str]):
    """Parts in the order of (window, first arrival) to one row per window; a window cut by batches is carried on."""
    names = [*_names(part_schema(ports)), *extra]
    whole = [n for n in names if n not in PORT_LISTS and n not in extra and n not in WINDOW_KEYS]

    def entries(table: pa.RecordBatch, p: str, run: np.ndarray):
        lists = table.column(p)
        sizes = np.diff(lists.offsets.to_numpy())
        return np.repeat(run, sizes), lists.flatten().to_numpy().astype(np.int64), table.column(f"{p}_n").flatten().to_numpy()

    def merged(table: pa.RecordBatch) -> pa.RecordBatch:
        own = [_codes(table.column("session")), _codes(table.column("peer")), table.column("slot").to_numpy()]
        starts = _runs(own)
        out = _merge({n: table.column(n).to_numpy() for n in whole}, starts)
        if ports:
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            for p in ("sports", "dports"):
                offsets, port, n = _merge_ports(*entries(table, p, run), len(starts))
                out[p] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(port, pa.int32()))
                out[f"{p}_n"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(n))
        for name in (*WINDOW_KEYS, *extra):
            out[name] = table.column(name).take(pa.array(starts))
        return _batch(names, out)

    def finish(table: pa.RecordBatch) -> pa.RecordBatch:
        c = {n: table.column(n) for n in (*WINDOW_KEYS, *extra)} | {n: table.column(n).to_numpy() for n in whole}
        c["gap_sq"] = c["sq0"].astype(np.float64) + c["sq1"] * 2.0 ** 24 + c["sq2"] * 2.0 ** 48
        c["ports_total"] = c["n_in"] - c["icmp"]
        for p in ("sport", "dport") if ports else ():
            sizes = np.diff(table.column(f"{p}s").offsets.to_numpy())
            n = table.column(f"{p}s_n").flatten().to_numpy().astype(np.float64)
            share = n / np.repeat(c["ports_total"], sizes)
            c[f"uniq_{p}_in"] = sizes.astype(np.int64)
            # no term is negative and that of an only port is 0, so nothing cancels; a difference of two logs left rounding errors
            c[f"{p}_entropy_in"] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.abs(share * np.log2(share)), len(sizes)).astype(np.float64)
        keep = pa.array(c["n_in"] > 0)
        return _batch(_names(_totals_schema(ports)) + extra, c).filter(keep)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            found = merged(batch)
            held = found.slice(found.num_rows - 1)
            if found.num_rows > 1:
                yield finish(merged(found.slice(0, found.num_rows - 1)))
        if held is not None:
            yield finish(merged(held))
    return search


def _totals_schema(ports: bool) -> str:
    whole = ["first_ts", "last_ts", *COUNTS, *SUMS, "min_size_in", "max_size_in", "ports_total"]
    found = [f"uniq_{p}_in long, {p}_entropy_in double" for p in ("sport", "dport")] if ports else []
    return ", ".join(["session string, slot long, peer string", *[f"{c} long" for c in whole], "gap_sq double", *found])


def merge_parts(parts: DataFrame, ports: bool = True, extra: dict[str, str] | None = None) -> DataFrame:
    """Totals per window from its parts; windows without inbound packets go. `extra` names columns (and their types)
    that are alike in all parts of a window and stay."""
    extra = extra or {}
    rows = parts.select(*_names(part_schema(ports)), *extra).repartition(*WINDOW_KEYS).sortWithinPartitions(*WINDOW_KEYS, "first_seq")
    return rows.mapInArrow(_to_totals(ports, list(extra)), ", ".join([_totals_schema(ports), *[f"{c} {t}" for c, t in extra.items()]]))


def feature_columns(features: list[str] = FEATURES):
    """Feature expressions over the totals of merge_parts (or plain_level)."""
    n, gaps = F.col("n_in"), F.col("n_in") - 1
    total = (F.col("last_ts") - F.col("first_ts")).cast("double")
    mean_us = share(total, gaps)
    iat_std = F.when(gaps > 0, spread(total, F.col("gap_sq"), gaps) / 1e6).otherwise(F.lit(0.0))
    values = {
        "out_in_ratio": share(F.col("n_out"), n),
        "mean_size_in": share(F.col("bytes_in"), n),
        "std_size_in": spread(F.col("bytes_in"), F.col("size_sq"), n),
        "mean_payload_in": share(F.col("payload_in"), n),
        **{f"{p}_ratio_in": share(F.col(p), n)
           for p in ["tcp", "udp", "icmp", "syn", "ack", "rst", "fin", "psh"]},
        "synack_ratio_out": share(F.col("synack_out"), F.col("n_out")),
        "rst_ratio_out": share(F.col("rst_out"), F.col("n_out")),
        "iat_mean_in": mean_us / 1e6,
        "iat_std_in": iat_std,
    }
    return [values[f].alias(f) if f in values else F.col(f) if f in PORT_FEATURES else F.col(f).cast("bigint").alias(f)
            for f in features]


def keyed_packets(packets: DataFrame, protected: list[str], window_s: float = WINDOW_SECONDS,
                  bits: int = PART_BITS) -> DataFrame:
    """Packets of protected hosts with their peer, slot and arrival chunk."""
    return with_slot(direction(packets, protected), window_s).withColumn("chunk", arrival_chunk(F.col("seq"), bits))


def finished(totals: DataFrame, window_s: float = WINDOW_SECONDS, features: list[str] = FEATURES, extra: list = ()) -> DataFrame:
    return totals.select("session", slot_start(F.col("slot"), window_s).alias("window_start"),
                         F.col("peer").alias("peer_ip"), *feature_columns(features), *extra)


def peer_windows(packets: DataFrame, protected: list[str], window_s: float = WINDOW_SECONDS,
                 bits: int = PART_BITS, features: list[str] = FEATURES, drop_late: bool = False) -> DataFrame:
    """One row per (session, slot, peer) that sent at least one packet to a protected host.

    `drop_late` leaves out packets whose slot had closed when they arrived; their rows are dealt by
    arrival chunk then, and nothing is dealt again for the windows. A caller that needs neither ports
    nor gaps gets plain sums, combined before the shuffle.
    """
    ports = bool(PORT_FEATURES & set(features))
    if drop_late:
        packets = mark_late(packets, window_s, bits).where(~F.col("late")).drop("late")
    keyed = keyed_packets(packets, protected, window_s, bits)
    if not ports and not GAP_FEATURES & set(features):
        return finished(plain_level(keyed, WINDOW_KEYS), window_s, features)
    if not drop_late:
        keyed = keyed.repartition(*WINDOW_KEYS, "chunk")
    return finished(merge_parts(window_parts(keyed, ports), ports), window_s, features)


def window_ends(packets: DataFrame, window_s: float = WINDOW_SECONDS) -> DataFrame:
    """When each slot of a session closed: at its first packet of a later slot, or at the
    session's last packet for the final slot. Columns session, window_start, closed_at."""
    slots = (with_slot(packets, window_s)
             .groupBy("session", "slot")
             .agg(F.min_by("ts_us", "seq").alias("opened"), F.max_by("ts_us", "seq").alias("final")))
    order = W.partitionBy("session").orderBy("slot")
    return slots.select(
        "session", slot_start(F.col("slot"), window_s).alias("window_start"),
        (F.coalesce(F.lead("opened").over(order), F.col("final")) / 1e6).alias("closed_at"))

