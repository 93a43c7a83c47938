"""Other views of the packets: flows, packet sequences, count windows, counters (V1-V9)."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from floodlens.functions.columns import has_flag, share, slot_start
from floodlens.operators.ordering import ARRIVAL_BITS, arrival_number
from floodlens.operators.packets import direction, with_slot
from floodlens.schemas import (ACK, COUNT_WINDOW, FIN, FLOW_FEATURES, FLOW_HEADER_BYTES, FLOW_SECONDS,
                               ICMP, PACKET_FEATURES, PSH, RST, SEQUENCE_LENGTH, SYN, TCP, UDP,
                               WINDOW_SECONDS)


def flow_features(packets: Column, frame_bytes: Column, pairflow: Column, proto: Column,
                  interval_s: float = FLOW_SECONDS) -> list[Column]:
    """The seven flow features from a flow's counters over one interval."""
    values = {
        "pktrate": packets.cast("double") / F.lit(float(interval_s)),
        "byterate": frame_bytes.cast("double") / F.lit(float(interval_s)),
        "mean_size": share(frame_bytes, packets),
        "pairflow": pairflow.cast("int"),
        "proto_tcp": (proto == TCP).cast("int"),
        "proto_udp": (proto == UDP).cast("int"),
        "proto_icmp": (proto == ICMP).cast("int"),
    }
    return [values[f].alias(f) for f in FLOW_FEATURES]


def flow_totals(keyed: DataFrame, keys: list[str], whole: bool = True) -> DataFrame:
    """Counters per flow; both directions share one group, so the reverse flow needs no join.

    `whole`: the rows are all of the flow's, so flows without inbound packets go.
    """
    frame = F.col("size").cast("bigint") + FLOW_HEADER_BYTES
    totals = keyed.groupBy(*keys).agg(
        F.count_if(F.col("inbound")).alias("n"),
        F.sum(F.when(F.col("inbound"), frame)).alias("frame_bytes"),
        F.max((~F.col("inbound")).cast("int")).alias("reverse"))
    return totals.where(F.col("n") > 0) if whole else totals


def flow_view(packets: DataFrame, protected: list[str], interval_s: float = FLOW_SECONDS) -> DataFrame:
    """One row per inbound flow (peer, server, protocol) and interval."""
    keys = ["session", "slot", "peer", "server", "proto"]
    keyed = with_slot(direction(packets, protected), interval_s)
    return flow_totals(keyed, keys).select(
        "session", slot_start(F.col("slot"), interval_s).alias("window_start"),
        F.col("peer").alias("peer_ip"), F.col("server").alias("dst"), "proto",
        *flow_features(F.col("n"), F.col("frame_bytes"), F.col("reverse"), F.col("proto"), interval_s))


# --- Packet sequences ---------------------------------------------------------

# Scales of the packet encoding
FRAME_SCALE = 1500.0
GAP_SCALE_US = 1e6


def first_packets(packets: DataFrame, protected: list[str], window_s: float = WINDOW_SECONDS,
                  length: int = SEQUENCE_LENGTH) -> DataFrame:
    """The first `length` packets of every window in arrival order, both directions, with `pos`.

    The rank limit is applied before the shuffle as well, so a hot peer sends at most
    `length` rows per task.
    """
    keyed = with_slot(direction(packets, protected), window_s)
    order = W.partitionBy("session", "slot", "peer").orderBy("seq")
    return keyed.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= length)


def encoded_packets(packets: DataFrame, protected: list[str], window_s: float = WINDOW_SECONDS,
                    length: int = SEQUENCE_LENGTH) -> DataFrame:
    """The 14 values of each of the first packets, one row per packet.

    Windows of peers that sent nothing inbound (over all their packets) are left out.
    """
    keys = ["session", "slot", "peer"]
    first = first_packets(packets, protected, window_s, length)
    order = W.partitionBy(*keys).orderBy("pos")
    is_icmp = F.col("proto") == ICMP
    peer_port = F.when(F.col("inbound"), F.col("sport")).otherwise(F.col("dport"))
    server_port = F.when(F.col("inbound"), F.col("dport")).otherwise(F.col("sport"))

    def first_sight(port):
        nth = F.row_number().over(W.partitionBy(*keys, "_icmp", port).orderBy("pos"))
        return F.when(F.col("_icmp"), F.lit(0.0)).otherwise((nth == 1).cast("double"))

    gap = F.greatest(F.coalesce(F.col("ts_us") - F.lag("ts_us").over(order), F.lit(0)), F.lit(0))
    flag = F.col("flags")
    values = {
        "inbound": F.col("inbound").cast("double"),
        "size": F.least(F.col("size") / FRAME_SCALE, F.lit(1.0)),
        "payload": F.least(F.col("payload") / FRAME_SCALE, F.lit(1.0)),
        "iat": F.least(F.log1p("_gap") / F.log1p(F.lit(GAP_SCALE_US)), F.lit(1.0)),
        "tcp": (F.col("proto") == TCP).cast("double"),
        "udp": (F.col("proto") == UDP).cast("double"),
        "icmp": is_icmp.cast("double"),
        "syn": (flag.bitwiseAND(SYN) != 0).cast("double"),
        "ack": (flag.bitwiseAND(ACK) != 0).cast("double"),
        "rst": (flag.bitwiseAND(RST) != 0).cast("double"),
        "fin": (flag.bitwiseAND(FIN) != 0).cast("double"),
        "psh": (flag.bitwiseAND(PSH) != 0).cast("double"),
        "peer_port_new": F.col("_peer_new"),
        "server_port_new": F.col("_server_new"),
    }
    rows = (first.withColumn("_gap", gap.cast("double")).withColumn("_icmp", is_icmp)
            .withColumn("_pp", peer_port).withColumn("_sp", server_port)
            .withColumn("_peer_new", first_sight("_pp"))
            .withColumn("_server_new", first_sight("_sp"))
            .select(*keys, "pos", *[values[f].alias(f) for f in PACKET_FEATURES]))
    senders = (with_slot(direction(packets, protected).where("inbound"), window_s)
               .groupBy(*keys).agg(F.lit(True).alias("_sent")).drop("_sent"))
    return rows.join(senders, keys, "left_semi").select(
        "session", slot_start(F.col("slot"), window_s).alias("window_start"),
        F.col("peer").alias("peer_ip"), "pos", *PACKET_FEATURES)


def sequence_view(packets: DataFrame, protected: list[str], window_s: float = WINDOW_SECONDS,
                  length: int = SEQUENCE_LENGTH) -> DataFrame:
    """One row per window: `length` x 14 values, zero-padded, and the number of real packets."""
    vector = F.array(*[F.col(f).cast("float") for f in PACKET_FEATURES])
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), len(PACKET_FEATURES)),
                           F.lit(length) - F.size("real"))
    # at most `length` rows per group by construction
    return (encoded_packets(packets, protected, window_s, length)
            .groupBy("session", "window_start", "peer_ip")
            .agg(F.array_sort(F.collect_list(F.struct("pos", vector.alias("v")))).alias("real"))
            .select("session", "window_start", "peer_ip",
                    F.concat(F.transform("real", lambda r: r["v"]), zeros).alias("seq"),
                    F.size("real").alias("length")))


def sequence_flat(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("flat", F.flatten("seq"))


def masked_flat(sequences: DataFrame, width: int = len(PACKET_FEATURES)) -> DataFrame:
    """Flattened values with every padding position set to zero, whatever it held."""
    real = F.col("length") * width
    return sequences.withColumn("flat", F.transform(
        F.flatten("seq"), lambda v, i: F.when(i < real, v).otherwise(F.lit(0.0).cast("float"))))


def sequence_alignment(windows: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row: matched keys, windows without a sequence, sequences without a window."""
    keys = ["session", "window_start", "peer_ip"]
    both = (windows.select(*keys, F.lit(1).alias("_w"))
            .join(sequences.select(*keys, F.lit(1).alias("_s")), keys, "full"))
    return both.agg(
        F.count_if(F.col("_w").isNotNull() & F.col("_s").isNotNull()).alias("matched"),
        F.count_if(F.col("_s").isNull()).alias("missing_sequence"),
        F.count_if(F.col("_w").isNull()).alias("missing_window"))


# --- Count windows and interface counters ---------------------------------------

def count_windows(packets: DataFrame, size: int = COUNT_WINDOW, frame_extra: int = FLOW_HEADER_BYTES,
                  bits: int = ARRIVAL_BITS) -> DataFrame:
    """Tumbling windows of `size` packets per session in arrival order; a partial last one is dropped.

    Bytes are frame lengths. Values are not rounded here; report sinks round.
    """
    numbered = arrival_number(packets, ["session"], "seq", "_n", bits)
    frame = F.col("size").cast("bigint") + frame_extra
    window_no = ((F.col("_n") - F.pmod(F.col("_n"), F.lit(size))) / size).cast("bigint")
    groups = (numbered.groupBy("session", window_no.alias("window_no"))
              .agg(F.count("*").alias("packets"), F.sum(frame).alias("bytes"),
                   F.count_if(has_flag(SYN)).alias("syn_count"),
                   F.count_if(F.col("proto") == UDP).alias("udp"),
                   F.count_if(F.col("proto") == ICMP).alias("icmp"),
                   F.count_if(F.col("proto") == TCP).alias("tcp"),
                   (F.max_by("ts_us", "seq") - F.min_by("ts_us", "seq")).alias("us"))
              .where(F.col("packets") == size))
    duration = F.when(F.col("us") > 0, F.col("us") / 1e6).otherwise(F.lit(0.001))
    return groups.select(
        "session", "window_no", "packets", "bytes", "syn_count",
        share(F.col("bytes"), F.col("packets")).alias("avg_pkt_size"),
        duration.alias("duration"),
        (F.col("bytes") * 8.0 / (duration * 1000.0)).alias("tx_kbps"),
        (F.col("packets").cast("double") / duration).alias("pkt_rate"),
        share(F.col("udp"), F.col("packets")).alias("udp_ratio"),
        share(F.col("icmp"), F.col("packets")).alias("icmp_ratio"),
        share(F.col("tcp"), F.col("packets")).alias("tcp_ratio"))


def counter_rates(counters: DataFrame) -> DataFrame:
    """Differences between successive polls of cumulative counters (interface, poll, packets, bytes)."""
    order = W.partitionBy("interface").orderBy("poll")
    pkt = F.col("packets") - F.lag("packets").over(order)
    byte = F.col("bytes") - F.lag("bytes").over(order)
    return (counters.withColumn("pkt_rate", pkt).withColumn("byte_rate", byte)
            .where(F.col("pkt_rate").isNotNull())
            .select("interface", "poll", "pkt_rate", "byte_rate",
                    F.floor(F.col("pkt_rate") / 5).cast("bigint").alias("syn_count"),
                    F.when(F.col("pkt_rate") > 0, F.col("byte_rate") / F.col("pkt_rate"))
                    .otherwise(F.lit(0.0)).alias("avg_pkt_size")))
