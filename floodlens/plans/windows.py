"""Queries over the window views: P1-P3, W1-W28, V1-V9."""
from pyspark.sql import functions as F

from floodlens.functions.columns import slot_of
from floodlens.operators import packets as P
from floodlens.operators import views as V
from floodlens.operators.peer_windows import peer_windows, window_ends
from floodlens.plans.packet_view import (DIR_SQL, SERVER, WINDOWS_OUT_SQL, packets, pk_sql, rounded,
                                         rounded_sql, win_sql, windows_out)
from floodlens.plans.registry import query
from floodlens.schemas import COUNT_FEATURES, FLOW_FEATURES, PACKET_FEATURES

WIN = f"WITH {pk_sql()}, {DIR_SQL}, {win_sql()}"
JITTER_SQL = """jit AS (SELECT * EXCLUDE (seq), row_number() OVER (ORDER BY
    ts_us + CASE WHEN k20 = 0 THEN 1500000 ELSE 0 END, seq) AS seq
  FROM (SELECT p.*, CAST(json_extract_string(e.props, '$.k') AS INT) % 20 AS k20
        FROM pk p JOIN events e ON e.event_id = p.seq))"""

# The jittered arrival number is sparse (24 low bits for the original number), so its chunks are wider
ARRIVAL_BITS_JITTERED = 41


def jittered(spark, sf, sessions=1):
    """Packets whose arrival is disturbed: one in twenty is delayed by 1.5 s.

    The arrival number only has to be unique and ordered, so it is built without a sort:
    delayed time in microseconds, then the original number.
    """
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("int") % 20).alias("k20"))
    delayed = F.col("ts_us") + F.when(F.col("k20") == 0, 1_500_000).otherwise(0)
    return (packets(spark, sf, sessions).join(events, "seq")
            .withColumn("arrival", F.shiftleft(delayed, 24) + F.col("seq"))
            .drop("seq", "k20").withColumnRenamed("arrival", "seq"))


@query("direction", f"""WITH {pk_sql()}, {DIR_SQL}
SELECT seq, peer, CAST(inb AS INT) AS inbound FROM dirp""")
def q_direction(spark, sf):
    return P.direction(packets(spark, sf), [SERVER]).select(
        "seq", "peer", F.col("inbound").cast("int").alias("inbound"))


@query("slot", f"""WITH {pk_sql()}
SELECT seq, CAST(ts_us // 1000000 AS BIGINT) AS slot, CAST(ts_us // 30000000 AS BIGINT) AS flow_slot FROM pk""")
def q_slot(spark, sf):
    return packets(spark, sf).select("seq", slot_of(F.col("ts_us"), 1.0).alias("slot"),
                                     slot_of(F.col("ts_us"), 30.0).alias("flow_slot"))


@query("late_flag", f"""WITH {pk_sql()}, {JITTER_SQL}
SELECT src, dst, ts_us, size,
  CAST(ts_us // 1000000 < max(ts_us // 1000000) OVER (ORDER BY seq) AS INT) AS late FROM jit""")
def q_late_flag(spark, sf):
    return P.late_flag(jittered(spark, sf), bits=ARRIVAL_BITS_JITTERED).select(
        "src", "dst", "ts_us", F.col("size").cast("bigint").alias("size"), F.col("late").cast("int").alias("late"))


@query("peer_windows", f"{WIN} SELECT {WINDOWS_OUT_SQL} FROM win")
def q_peer_windows(spark, sf):
    return windows_out(peer_windows(packets(spark, sf), [SERVER]))


@query("peer_windows_late", f"""WITH {pk_sql()}, {JITTER_SQL},
kept AS (SELECT * FROM (SELECT *, max(ts_us // 1000000) OVER (ORDER BY seq) AS open FROM jit)
         WHERE ts_us // 1000000 >= open),
{DIR_SQL.replace('FROM pk', 'FROM kept')}, {win_sql()}
SELECT {WINDOWS_OUT_SQL} FROM win""")
def q_peer_windows_late(spark, sf):
    return windows_out(peer_windows(jittered(spark, sf), [SERVER], bits=ARRIVAL_BITS_JITTERED, drop_late=True))


@query("late_counts", f"""WITH {pk_sql(3)}, {JITTER_SQL}
SELECT session, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (late) AS BIGINT) AS late FROM (
  SELECT session, ts_us // 1000000 < max(ts_us // 1000000) OVER (PARTITION BY session ORDER BY seq) AS late FROM jit) GROUP BY session""")
def q_late_counts(spark, sf):
    return P.late_counts(jittered(spark, sf, 3), bits=ARRIVAL_BITS_JITTERED)


@query("window_close", f"""WITH {pk_sql()},
s AS (SELECT session, ts_us // 1000000 AS slot, arg_min(ts_us, seq) AS a, arg_max(ts_us, seq) AS z
      FROM pk GROUP BY session, ts_us // 1000000)
SELECT session, CAST(slot AS DOUBLE) AS window_start,
  coalesce(lead(a) OVER (PARTITION BY session ORDER BY slot), z) / CAST(1000000 AS DOUBLE) AS closed_at FROM s""")
def q_window_close(spark, sf):
    return window_ends(packets(spark, sf))


FLOW_SQL = f"""flow AS (
  SELECT session, CAST(slot * 30 AS DOUBLE) AS window_start, peer AS peer_ip, '{SERVER}' AS dst, proto,
    n / CAST(30 AS DOUBLE) AS pktrate, b / CAST(30 AS DOUBLE) AS byterate, b / CAST(n AS DOUBLE) AS mean_size,
    CAST(m > 0 AS INT) AS pairflow, CAST(proto = 6 AS INT) AS proto_tcp,
    CAST(proto = 17 AS INT) AS proto_udp, CAST(proto = 1 AS INT) AS proto_icmp
  FROM (SELECT session, ts_us // 30000000 AS slot, peer, proto, count(*) FILTER (inb) AS n,
          count(*) FILTER (NOT inb) AS m, sum(size + 14) FILTER (inb) AS b
        FROM dirp GROUP BY ALL) WHERE n > 0)"""
FLOW_DOUBLES = ["pktrate", "byterate", "mean_size"]
FLOW_INTS = [f for f in FLOW_FEATURES if f not in FLOW_DOUBLES]


def flows_out(df, extra=()):
    return df.select("session", "window_start", "peer_ip", "dst", F.col("proto").cast("int").alias("proto"),
                     *rounded(FLOW_DOUBLES), *FLOW_INTS, *extra)


FLOWS_OUT_SQL = ("session, window_start, peer_ip, dst, CAST(proto AS INT) AS proto, "
                 + rounded_sql(FLOW_DOUBLES) + ", " + ", ".join(FLOW_INTS))


@query("flow_view", f"WITH {pk_sql()}, {DIR_SQL}, {FLOW_SQL} SELECT {FLOWS_OUT_SQL} FROM flow")
def q_flow_view(spark, sf):
    return flows_out(V.flow_view(packets(spark, sf), [SERVER]))


@query("pairflow", f"""WITH {pk_sql()}, {DIR_SQL}, {FLOW_SQL}
SELECT window_start, CAST(proto AS INT) AS proto, CAST(count(*) AS BIGINT) AS flows,
  CAST(sum(pairflow) AS BIGINT) AS paired FROM flow GROUP BY window_start, proto""")
def q_pairflow(spark, sf):
    return (V.flow_view(packets(spark, sf), [SERVER])
            .groupBy("window_start", F.col("proto").cast("int").alias("proto"))
            .agg(F.count("*").alias("flows"), F.sum("pairflow").cast("bigint").alias("paired")))


ENC_SQL = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session, slot, peer ORDER BY seq) AS pos
  FROM (SELECT *, ts_us // 1000000 AS slot, bool_or(inb) OVER (PARTITION BY session, ts_us // 1000000, peer) AS sent
        FROM dirp) WHERE sent QUALIFY pos <= 32),
enc AS (SELECT session, CAST(slot AS DOUBLE) AS window_start, peer AS peer_ip, CAST(pos AS INT) AS pos,
  CAST(inb AS DOUBLE) AS inbound, least(size / CAST(1500 AS DOUBLE), 1) AS size,
  least(payload / CAST(1500 AS DOUBLE), 1) AS payload,
  least(ln(1 + greatest(coalesce(ts_us - lag(ts_us) OVER (PARTITION BY session, slot, peer ORDER BY seq), 0), 0)::DOUBLE)
        / ln(1 + CAST(1000000 AS DOUBLE)), 1) AS iat,
  CAST(proto = 6 AS DOUBLE) AS tcp, CAST(proto = 17 AS DOUBLE) AS udp, CAST(proto = 1 AS DOUBLE) AS icmp,
  CAST((flags & 2) > 0 AS DOUBLE) AS syn, CAST((flags & 16) > 0 AS DOUBLE) AS ack,
  CAST((flags & 4) > 0 AS DOUBLE) AS rst, CAST((flags & 1) > 0 AS DOUBLE) AS fin,
  CAST((flags & 8) > 0 AS DOUBLE) AS psh,
  CAST(proto <> 1 AND row_number() OVER (PARTITION BY session, slot, peer, proto = 1,
       CASE WHEN inb THEN sport ELSE dport END ORDER BY seq) = 1 AS DOUBLE) AS peer_port_new,
  CAST(proto <> 1 AND row_number() OVER (PARTITION BY session, slot, peer, proto = 1,
       CASE WHEN inb THEN dport ELSE sport END ORDER BY seq) = 1 AS DOUBLE) AS server_port_new
  FROM ranked)"""


@query("packet_encoding", f"""WITH {pk_sql()}, {DIR_SQL}, {ENC_SQL}
SELECT session, window_start, peer_ip, pos, {", ".join(f"round({f}, 9) AS {f}" for f in PACKET_FEATURES)} FROM enc""")
def q_packet_encoding(spark, sf):
    return V.encoded_packets(packets(spark, sf), [SERVER]).select(
        "session", "window_start", "peer_ip", "pos", *[F.round(f, 9).alias(f) for f in PACKET_FEATURES])


@query("port_novelty", f"""WITH {pk_sql()}, {DIR_SQL}, {ENC_SQL}
SELECT peer_ip, CAST(sum(peer_port_new) AS BIGINT) AS peer_ports, CAST(sum(server_port_new) AS BIGINT) AS server_ports
FROM enc GROUP BY peer_ip""")
def q_port_novelty(spark, sf):
    return (V.encoded_packets(packets(spark, sf), [SERVER]).groupBy("peer_ip")
            .agg(F.sum("peer_port_new").cast("bigint").alias("peer_ports"),
                 F.sum("server_port_new").cast("bigint").alias("server_ports")))


FLAT_SUM_SQL = " + ".join(f"((pos - 1) * 14 + {j + 1}) * CAST({f} AS FLOAT)::DOUBLE"
                          for j, f in enumerate(PACKET_FEATURES))


def flat_checksum(col):
    """Position-weighted sum of an array: changes with any value, its place or the padding."""
    return F.aggregate(F.transform(col, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query("sequence_view", f"""WITH {pk_sql()}, {DIR_SQL}, {ENC_SQL}
SELECT session, window_start, peer_ip, CAST(count(*) AS INT) AS length, 448 AS width,
  round(sum({FLAT_SUM_SQL}), 6) AS checksum FROM enc GROUP BY session, window_start, peer_ip""")
def q_sequence_view(spark, sf):
    s = V.sequence_flat(V.sequence_view(packets(spark, sf), [SERVER]))
    return s.select("session", "window_start", "peer_ip", "length", F.size("flat").alias("width"),
                    F.round(flat_checksum("flat"), 6).alias("checksum"))


@query("sequence_flat", f"""WITH {pk_sql()}, {DIR_SQL}, {ENC_SQL}
SELECT CAST((pos - 1) * 14 AS INT) AS offset_no, CAST(count(*) AS BIGINT) AS filled,
  round(sum(CAST(size AS FLOAT)::DOUBLE), 5) AS size_sum FROM enc GROUP BY pos""")
def q_sequence_flat(spark, sf):
    s = V.masked_flat(V.sequence_view(packets(spark, sf), [SERVER]))
    pairs = s.select("length", F.posexplode("flat").alias("i", "v")).where(
        (F.col("i") % 14 == 1) & (F.col("i") < F.col("length") * 14))
    return pairs.groupBy((F.col("i") - 1).alias("offset_no")).agg(
        F.count("*").alias("filled"), F.round(F.sum(F.col("v").cast("double")), 5).alias("size_sum"))


@query("sequence_align", f"""{WIN}, {ENC_SQL}
SELECT CAST(count(*) AS BIGINT) AS matched, CAST(0 AS BIGINT) AS missing_sequence, CAST(0 AS BIGINT) AS missing_window
FROM win JOIN (SELECT DISTINCT session, window_start, peer_ip FROM enc) USING (session, window_start, peer_ip)""")
def q_sequence_align(spark, sf):
    p = packets(spark, sf)
    return V.sequence_alignment(peer_windows(p, [SERVER]), V.sequence_view(p, [SERVER]))


COUNT_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS rn FROM pk),
cw AS (SELECT session, rn // 100 AS window_no, count(*) AS n, sum(size + 14) AS b,
    count(*) FILTER (proto = 6 AND (flags & 2) > 0) AS s, count(*) FILTER (proto = 17) AS u,
    count(*) FILTER (proto = 1) AS i, count(*) FILTER (proto = 6) AS t,
    arg_max(ts_us, seq) - arg_min(ts_us, seq) AS us
  FROM numbered GROUP BY session, rn // 100 HAVING count(*) = 100),
count_win AS (SELECT session, CAST(window_no AS BIGINT) AS window_no, CAST(n AS BIGINT) AS packets,
    CAST(b AS BIGINT) AS bytes, CAST(s AS BIGINT) AS syn_count, b / CAST(n AS DOUBLE) AS avg_pkt_size,
    CASE WHEN us > 0 THEN us / CAST(1000000 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END AS duration,
    b * 8 / (CASE WHEN us > 0 THEN us / CAST(1000000 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END * 1000) AS tx_kbps,
    n / (CASE WHEN us > 0 THEN us / CAST(1000000 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END) AS pkt_rate,
    u / CAST(n AS DOUBLE) AS udp_ratio, i / CAST(n AS DOUBLE) AS icmp_ratio, t / CAST(n AS DOUBLE) AS tcp_ratio
  FROM cw)"""
COUNT_DOUBLES = [c for c in COUNT_FEATURES if c not in ("packets", "bytes", "syn_count")]


@query("count_windows", f"""WITH {pk_sql(3)}, {COUNT_SQL}
SELECT session, window_no, packets, bytes, syn_count, {rounded_sql(COUNT_DOUBLES, 6)} FROM count_win""")
def q_count_windows(spark, sf):
    return V.count_windows(packets(spark, sf, 3)).select(
        "session", "window_no", "packets", "bytes", "syn_count", *rounded(COUNT_DOUBLES, 6))


@query("counter_rates", """WITH polls AS (
  SELECT event_type AS interface, (epoch_us(ts) - 1704067200000000) // 86400000000 AS poll,
    count(*) AS p, sum(CAST(floor(value) AS BIGINT)) AS b FROM events GROUP BY ALL),
c AS (SELECT interface, poll, sum(p) OVER w AS packets, sum(b) OVER w AS bytes FROM polls
      WINDOW w AS (PARTITION BY interface ORDER BY poll)),
d AS (SELECT interface, poll, packets - lag(packets) OVER w AS pr, bytes - lag(bytes) OVER w AS br FROM c
      WINDOW w AS (PARTITION BY interface ORDER BY poll))
SELECT interface, CAST(poll AS BIGINT) AS poll, CAST(pr AS BIGINT) AS pkt_rate, CAST(br AS BIGINT) AS byte_rate,
  CAST(pr // 5 AS BIGINT) AS syn_count,
  round(CASE WHEN pr > 0 THEN br / CAST(pr AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 9) AS avg_pkt_size
FROM d WHERE pr IS NOT NULL""")
def q_counter_rates(spark, sf):
    from pyspark.sql import Window as W
    e = spark.read.parquet(f"{sf}/events.parquet")
    day = slot_of(F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000, 86400.0)
    polls = e.groupBy(F.col("event_type").alias("interface"), day.alias("poll")).agg(
        F.count("*").alias("p"), F.sum(F.floor("value").cast("bigint")).alias("b"))
    w = W.partitionBy("interface").orderBy("poll").rowsBetween(W.unboundedPreceding, 0)
    counters = polls.select("interface", "poll", F.sum("p").over(w).alias("packets"), F.sum("b").over(w).alias("bytes"))
    return V.counter_rates(counters).withColumn("avg_pkt_size", F.round("avg_pkt_size", 9))
