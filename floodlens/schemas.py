"""Table schemas and the fixed names and ids shared by all operators."""
from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
ICMP, TCP, UDP = 1, 6, 17
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16

LABEL_NAMES = {
    0: "Normal",
    1: "ICMP Flood",
    2: "UDP Flood",
    3: "SYN Flood",
    4: "HTTP Flood",
    5: "Reflection",
    6: "ACK Flood",
}

FEATURES = [
    "n_in", "n_out", "bytes_in", "bytes_out", "out_in_ratio",
    "mean_size_in", "std_size_in", "min_size_in", "max_size_in", "mean_payload_in",
    "tcp_ratio_in", "udp_ratio_in", "icmp_ratio_in",
    "syn_ratio_in", "ack_ratio_in", "rst_ratio_in", "fin_ratio_in", "psh_ratio_in",
    "synack_ratio_out", "rst_ratio_out",
    "uniq_sport_in", "uniq_dport_in", "sport_entropy_in", "dport_entropy_in",
    "iat_mean_in", "iat_std_in",
]
INTEGER_FEATURES = ["n_in", "n_out", "bytes_in", "bytes_out", "min_size_in", "max_size_in",
                    "uniq_sport_in", "uniq_dport_in"]

FLOW_FEATURES = ["pktrate", "byterate", "mean_size", "pairflow",
                 "proto_tcp", "proto_udp", "proto_icmp"]

PACKET_FEATURES = ["inbound", "size", "payload", "iat", "tcp", "udp", "icmp",
                   "syn", "ack", "rst", "fin", "psh", "peer_port_new", "server_port_new"]

COUNT_FEATURES = ["packets", "bytes", "syn_count", "avg_pkt_size", "duration", "tx_kbps",
                  "pkt_rate", "udp_ratio", "icmp_ratio", "tcp_ratio"]

WINDOW_SECONDS = 1.0
FLOW_SECONDS = 30.0
FLOW_HEADER_BYTES = 14
SEQUENCE_LENGTH = 32
COUNT_WINDOW = 100
SNAPLEN = 96
# ----------------------------------------------------------------------------

WINDOW_COLUMNS = ["session", "round", "window_start", "peer_ip", *FEATURES, "attack_rate", "label"]
FLOW_COLUMNS = ["session", "round", "window_start", "peer_ip", "dst", "proto", *FLOW_FEATURES,
                "attack_rate", "label"]

FRAMES = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("file_idx", T.IntegerType()),
    T.StructField("frame_seq", T.LongType()),
    T.StructField("linktype", T.IntegerType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("origlen", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])

PACKETS = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("payload", T.IntegerType()),
    T.StructField("sport", T.IntegerType()),
    T.StructField("dport", T.IntegerType()),
    T.StructField("flags", T.IntegerType()),
])

ATTACKS = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("attacker", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("attack", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("rate", T.StringType()),
    T.StructField("pps", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("start_ts", T.DoubleType()),
    T.StructField("end_ts", T.DoubleType()),
])

SESSIONS = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("victim", T.StringType()),
    T.StructField("clients", T.MapType(T.StringType(), T.StringType())),
    T.StructField("attackers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("start_ts", T.DoubleType()),
    T.StructField("end_ts", T.DoubleType()),
    T.StructField("tcpdump", T.MapType(T.StringType(), T.LongType())),
])

COUNTER_FLOWS = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("Protocol", T.StringType()),
    T.StructField("pktperflow", T.LongType()),
    T.StructField("byteperflow", T.LongType()),
    T.StructField("Pairflow", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
])

# `windows` is a count in some events and a list in others, so it is read as text
DETECTOR_LOG = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("peer", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("windows", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("rows", T.LongType()),
    T.StructField("pseudo_attack", T.LongType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("packets", T.LongType()),
    T.StructField("flagged", T.LongType()),
    T.StructField("blocks_active", T.LongType()),
    T.StructField("model_version", T.IntegerType()),
    T.StructField("calibrated", T.BooleanType()),
    T.StructField("kernel_drops", T.LongType()),
    T.StructField("socket_packets", T.LongType()),
    T.StructField("consecutive", T.IntegerType()),
    T.StructField("block_seconds", T.DoubleType()),
    T.StructField("mode", T.StringType()),
    T.StructField("calibrate", T.DoubleType()),
    T.StructField("adaptive", T.BooleanType()),
    T.StructField("retrain_seconds", T.DoubleType()),
])

SCORES = T.StructType([
    T.StructField("window_start", T.DoubleType()),
    T.StructField("peer_ip", T.StringType()),
    T.StructField("n_in", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("novel", T.IntegerType()),
    T.StructField("flagged", T.IntegerType()),
    T.StructField("model_version", T.IntegerType()),
])
