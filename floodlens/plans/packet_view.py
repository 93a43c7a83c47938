"""Packets, schedule and hosts derived from the given tables, in Spark and in SQL.

The `events` table becomes a packet table with integer arithmetic only: thirty days shrink
to 360 seconds, users become sixteen peers of one protected host.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.schemas import ATTACKS, FEATURES, INTEGER_FEATURES

# Fixed values of the derived network
SERVER = "10.0.0.100"
EPOCH_US = 1_704_067_200_000_000
SHRINK = 7200
ATTACKERS = ["10.0.0.10", "10.0.0.11", "10.0.0.12"]
CLIENTS = [f"10.0.0.{i}" for i in range(13, 26)]
ROUNDS = [(i, ATTACKERS[(i - 1) % 3], 1 + (i - 1) % 3, 60.0 * (i - 1) + 20.0) for i in range(1, 7)]
ATTACK_KINDS = {1: "icmp", 2: "udp", 3: "syn"}
ATTACK_SECONDS = 25.0
GRACE = 1.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def packets_from(events: DataFrame, sessions: int = 1) -> DataFrame:
    """The packet table of an events table (also of a streamed one)."""
    # a step of its own: three columns use it, and each would parse the text again
    events, k = events.withColumn("_k", F.get_json_object("props", "$.k").cast("int")), F.col("_k")
    inbound = F.col("event_id") % 3 != 0
    peer = F.concat(F.lit("10.0.0."), (10 + F.col("user_id") % 16).cast("string"))
    whole = F.floor("value").cast("int")
    is_error, is_signup = F.col("event_type") == "error", F.col("event_type") == "signup"
    offset = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    # three packets in a row share a session: the direction repeats every three packets
    session = F.concat(F.lit("s"), (1 + F.floor(F.col("event_id") / 3) % sessions).cast("string"))
    return events.select(
        session.alias("session"),
        F.col("event_id").alias("seq"),
        ((offset - F.pmod(offset, F.lit(SHRINK))) / SHRINK).cast("bigint").alias("ts_us"),
        F.when(inbound, peer).otherwise(F.lit(SERVER)).alias("src"),
        F.when(inbound, F.lit(SERVER)).otherwise(peer).alias("dst"),
        F.when(is_error, 1).when(is_signup, 17).otherwise(6).alias("proto"),
        (40 + whole).alias("size"),
        whole.alias("payload"),
        F.when(is_error, 0).when(inbound, 1000 + k).otherwise(80).alias("sport"),
        F.when(is_error, 0).when(inbound, 80).otherwise(1000 + k).alias("dport"),
        F.when(is_error | is_signup, 0).otherwise(k % 32).alias("flags"))


def packets(spark: SparkSession, sf: str, sessions: int = 1) -> DataFrame:
    return packets_from(table(spark, sf, "events"), sessions)


def attacks(spark: SparkSession) -> DataFrame:
    rows = [("s1", i, f"a{label}", ip, ATTACK_KINDS[label], label, "low" if i % 2 else "high",
             10 * label, 0, 80, start, start + ATTACK_SECONDS) for i, ip, label, start in ROUNDS]
    return spark.createDataFrame(rows, ATTACKS).withColumn("ev_order", F.col("round"))


# --- The same in SQL ------------------------------------------------------------

def pk_sql(sessions: int = 1) -> str:
    return f"""pk AS (
  SELECT 's' || (1 + (event_id // 3) % {sessions}) AS session, event_id AS seq,
    (epoch_us(ts) - {EPOCH_US}) // {SHRINK} AS ts_us,
    CASE WHEN event_id % 3 <> 0 THEN '10.0.0.' || (10 + user_id % 16) ELSE '{SERVER}' END AS src,
    CASE WHEN event_id % 3 <> 0 THEN '{SERVER}' ELSE '10.0.0.' || (10 + user_id % 16) END AS dst,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 17 ELSE 6 END AS proto,
    40 + CAST(floor(value) AS BIGINT) AS size, CAST(floor(value) AS BIGINT) AS payload,
    CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 3 <> 0 THEN 1000 + k ELSE 80 END AS sport,
    CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 3 <> 0 THEN 80 ELSE 1000 + k END AS dport,
    CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE k % 32 END AS flags
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


DIR_SQL = f"""dirp AS (
  SELECT *, dst = '{SERVER}' AS inb, CASE WHEN dst = '{SERVER}' THEN src ELSE dst END AS peer
  FROM pk WHERE (dst = '{SERVER}') <> (src = '{SERVER}'))"""


def win_sql(source: str = "dirp") -> str:
    """CTEs ending in `win`: the 26 features per (session, slot, peer)."""
    def of(cond):
        return f"count(*) FILTER (inb AND {cond})"

    ports = lambda p: f"""(SELECT session, slot, peer, count(*) AS u, sum(c) AS tn,
      -sum(c / tot * log2(c / tot)) AS h
      FROM (SELECT *, sum(c) OVER (PARTITION BY session, slot, peer) AS tot
            FROM (SELECT session, slot, peer, {p}, CAST(count(*) AS DOUBLE) AS c FROM keyed
                  WHERE inb AND proto <> 1 GROUP BY session, slot, peer, {p}))
      GROUP BY session, slot, peer)"""
    return f"""keyed AS (SELECT *, ts_us // 1000000 AS slot FROM {source}),
gaps AS (SELECT session, slot, peer, CAST(sum(g) AS DOUBLE) AS g1, CAST(sum(g * g) AS DOUBLE) AS g2
  FROM (SELECT session, slot, peer, ts_us - lag(ts_us) OVER (PARTITION BY session, slot, peer ORDER BY seq) AS g
        FROM keyed WHERE inb) GROUP BY session, slot, peer),
base AS (SELECT session, slot, peer, count(*) FILTER (inb) AS n, count(*) FILTER (NOT inb) AS m,
    coalesce(sum(size) FILTER (inb), 0) AS bi, coalesce(sum(size) FILTER (NOT inb), 0) AS bo,
    CAST(sum(size * size) FILTER (inb) AS DOUBLE) AS sq, min(size) FILTER (inb) AS mn,
    max(size) FILTER (inb) AS mx, sum(payload) FILTER (inb) AS pay,
    {of('proto = 6')} AS tcp, {of('proto = 17')} AS udp, {of('proto = 1')} AS icmp,
    {of('proto = 6 AND (flags & 18) = 2')} AS syn, {of('proto = 6 AND (flags & 16) > 0')} AS ack,
    {of('proto = 6 AND (flags & 4) > 0')} AS rst, {of('proto = 6 AND (flags & 1) > 0')} AS fin,
    {of('proto = 6 AND (flags & 8) > 0')} AS psh,
    count(*) FILTER (NOT inb AND proto = 6 AND (flags & 18) = 18) AS sa,
    count(*) FILTER (NOT inb AND proto = 6 AND (flags & 4) > 0) AS ro
  FROM keyed GROUP BY session, slot, peer HAVING count(*) FILTER (inb) > 0),
win AS (SELECT b.session, CAST(b.slot AS DOUBLE) AS window_start, b.peer AS peer_ip,
    CAST(n AS BIGINT) AS n_in, CAST(m AS BIGINT) AS n_out, CAST(bi AS BIGINT) AS bytes_in,
    CAST(bo AS BIGINT) AS bytes_out, m / CAST(n AS DOUBLE) AS out_in_ratio,
    bi / CAST(n AS DOUBLE) AS mean_size_in,
    sqrt(greatest(sq / n - (bi / CAST(n AS DOUBLE)) * (bi / CAST(n AS DOUBLE)), 0)) AS std_size_in,
    CAST(mn AS BIGINT) AS min_size_in, CAST(mx AS BIGINT) AS max_size_in,
    pay / CAST(n AS DOUBLE) AS mean_payload_in, tcp / CAST(n AS DOUBLE) AS tcp_ratio_in,
    udp / CAST(n AS DOUBLE) AS udp_ratio_in, icmp / CAST(n AS DOUBLE) AS icmp_ratio_in,
    syn / CAST(n AS DOUBLE) AS syn_ratio_in, ack / CAST(n AS DOUBLE) AS ack_ratio_in,
    rst / CAST(n AS DOUBLE) AS rst_ratio_in, fin / CAST(n AS DOUBLE) AS fin_ratio_in,
    psh / CAST(n AS DOUBLE) AS psh_ratio_in,
    coalesce(sa / nullif(CAST(m AS DOUBLE), 0), 0) AS synack_ratio_out,
    coalesce(ro / nullif(CAST(m AS DOUBLE), 0), 0) AS rst_ratio_out,
    CAST(coalesce(s.u, 0) AS BIGINT) AS uniq_sport_in, CAST(coalesce(d.u, 0) AS BIGINT) AS uniq_dport_in,
    abs(coalesce(s.h, 0)) AS sport_entropy_in, abs(coalesce(d.h, 0)) AS dport_entropy_in,
    CASE WHEN n > 1 THEN g1 / (n - 1) / 1e6 ELSE CAST(0 AS DOUBLE) END AS iat_mean_in,
    CASE WHEN n > 1 THEN sqrt(greatest(g2 / (n - 1) - (g1 / (n - 1)) * (g1 / (n - 1)), 0)) / 1e6
      ELSE CAST(0 AS DOUBLE) END AS iat_std_in
  FROM base b LEFT JOIN gaps g USING (session, slot, peer)
  LEFT JOIN {ports('sport')} s USING (session, slot, peer)
  LEFT JOIN {ports('dport')} d USING (session, slot, peer))"""


def rounded(columns, digits: int = 9):
    """Spark columns for the comparison: integers as they are, doubles rounded."""
    return [F.col(c) if c in INTEGER_FEATURES else
            F.round(F.col(c).cast("double"), digits).alias(c) for c in columns]


def rounded_sql(columns, digits: int = 9) -> str:
    return ", ".join(c if c in INTEGER_FEATURES else f"round(CAST({c} AS DOUBLE), {digits}) AS {c}"
                     for c in columns)


WINDOW_OUT = ["session", "window_start", "peer_ip"]


def windows_out(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    return df.select(*WINDOW_OUT, *rounded(FEATURES), *extra)


WINDOWS_OUT_SQL = f"session, window_start, peer_ip, {rounded_sql(FEATURES)}"

ATTACKS_SQL = "attacks AS (SELECT * FROM (VALUES " + ", ".join(
    f"('s1', {i}, '{ip}', '{ATTACK_KINDS[label]}', {label}, '{'low' if i % 2 else 'high'}', {10 * label}, "
    f"CAST({start} AS DOUBLE), CAST({start + ATTACK_SECONDS} AS DOUBLE))" for i, ip, label, start in ROUNDS
) + ") t(session, round, ip, attack, label, rate, pps, start_ts, end_ts))"

ATTACKERS_SQL = "(" + ", ".join(f"'{a}'" for a in ATTACKERS) + ")"


def labelled_sql(window_s: float = 1.0, grace: float = GRACE, source: str = "win") -> str:
    """CTEs `hits` and `lab`: labelled rows of `source`, unmatched attacker rows gone, with rounds."""
    reach = f"w.window_start + {window_s} + {grace}"
    return f"""{ATTACKS_SQL},
hits AS (SELECT w.*, e.label AS hit, coalesce(e.label, 0) AS label, coalesce(e.rate, '') AS attack_rate,
    coalesce((SELECT max(round) FROM (SELECT round, min(start_ts) AS s FROM attacks GROUP BY round) r
              WHERE r.s < {reach}), 0) AS round
  FROM {source} w LEFT JOIN attacks e ON w.peer_ip = e.ip
    AND w.window_start + {window_s} > e.start_ts - {grace} AND w.window_start < e.end_ts + {grace}
  QUALIFY row_number() OVER (PARTITION BY w.session, w.window_start, w.peer_ip{', w.dst, w.proto' if source != 'win' else ''}
    ORDER BY e.round DESC NULLS LAST) = 1),
lab AS (SELECT * EXCLUDE (hit) FROM hits WHERE NOT (peer_ip IN {ATTACKERS_SQL} AND hit IS NULL))"""
