"""Queries over files and sinks: sessions, schedules, counter tables, logs, scores, reports."""
from pyspark.sql import functions as F

from floodlens.operators import views as V
from floodlens.operators.peer_windows import peer_windows
from floodlens.plans.detector import scored_windows
from floodlens.plans.labels import labelled
from floodlens.plans.metrics import lab3_sql
from floodlens.plans.packet_view import DIR_SQL, SERVER, packets, pk_sql, rounded, rounded_sql, table, win_sql
from floodlens.plans.registry import query
from floodlens.plans.windows import FLOW_DOUBLES, FLOW_SQL
from floodlens.schemas import FEATURES
from floodlens.session import shared_dir
from floodlens.sources import readers as R
from floodlens.sources import sinks as K


@query("read_sessions", """SELECT 'r' || n_regionkey AS session, '10.0.' || n_regionkey || '.100' AS victim,
  n_name AS name, '10.0.' || n_regionkey || '.' || n_nationkey AS ip FROM nation""")
def q_read_sessions(spark, sf):
    n = table(spark, sf, "nation")
    ip = F.concat(F.lit("10.0."), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string"))
    meta = (n.withColumn("ip", ip).groupBy("n_regionkey")
            .agg(F.map_from_entries(F.collect_list(F.struct("n_name", "ip"))).alias("attackers"))
            .select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("session"),
                    F.concat(F.lit("10.0."), F.col("n_regionkey").cast("string"), F.lit(".100")).alias("victim"), "attackers"))
    path = shared_dir(spark, "sessions")
    meta.write.json(path)
    s = R.read_sessions(spark, path, multi_line=False)
    return R.session_hosts(s, "attackers").join(s.select("session", "victim"), "session").select("session", "victim", "name", "ip")


@query("read_attacks", """SELECT CAST(c_nationkey AS VARCHAR) AS session, CAST(c_custkey AS INT) AS round, '10.1.0.' || (c_custkey % 250) AS ip,
  CAST(c_custkey % 4 AS INT) AS label, CAST(c_acctbal AS DOUBLE) AS start_ts, CAST(c_acctbal + 25 AS DOUBLE) AS end_ts FROM customer""")
def q_read_attacks(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.select(
        F.col("c_nationkey").cast("string").alias("session"), F.col("c_custkey").cast("int").alias("round"), F.lit("a").alias("attacker"),
        F.concat(F.lit("10.1.0."), (F.col("c_custkey") % 250).cast("string")).alias("ip"), F.lit("syn").alias("attack"),
        (F.col("c_custkey") % 4).cast("int").alias("label"), F.lit("low").alias("rate"), F.lit(10).alias("pps"), F.lit(0).alias("size"),
        F.lit(80).alias("port"), F.col("c_acctbal").cast("double").alias("start_ts"), (F.col("c_acctbal") + 25).cast("double").alias("end_ts"))
    path = shared_dir(spark, "attacks")
    rows.write.option("header", True).csv(path)
    return R.read_attacks(spark, path).select("session", "round", "ip", "label", "start_ts", "end_ts")


SDN_SQL = """raw AS (SELECT CAST(epoch(l_shipdate) AS BIGINT) AS dt, 'h' || l_suppkey AS src, 'h' || l_partkey AS dst,
  CASE l_linenumber % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
  CAST(l_quantity AS BIGINT) - 5 AS pkts, CAST(floor(l_extendedprice) AS BIGINT) AS bytes, CAST(l_linenumber % 2 AS INT) AS pair,
  CAST(l_returnflag = 'R' AS INT) AS lab FROM lineitem)"""


@query("sdn_flows", f"""WITH {SDN_SQL}
SELECT 'sdn' AS session, CAST(dt // 1800 AS INT) AS round, CAST(dt AS DOUBLE) AS window_start, src AS peer_ip, dst,
  CAST(CASE protocol WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 1 END AS INT) AS proto, round(pkts / CAST(30 AS DOUBLE), 9) AS pktrate,
  round(bytes / CAST(30 AS DOUBLE), 9) AS byterate, round(bytes / CAST(pkts AS DOUBLE), 9) AS mean_size, pair AS pairflow,
  CAST(protocol = 'TCP' AS INT) AS proto_tcp, CAST(protocol = 'UDP' AS INT) AS proto_udp, CAST(protocol = 'ICMP' AS INT) AS proto_icmp,
  '' AS attack_rate, CAST(CASE WHEN lab = 0 THEN 0 ELSE CASE protocol WHEN 'ICMP' THEN 1 WHEN 'UDP' THEN 2 ELSE 3 END END AS INT) AS label
FROM raw WHERE pkts > 0""")
def q_sdn_flows(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber") % 3
    raw = li.select(
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("dt"), F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("dst"), F.when(n == 0, "TCP").when(n == 1, "UDP").otherwise("ICMP").alias("Protocol"),
        (F.col("l_quantity").cast("bigint") - 5).alias("pktperflow"), F.floor("l_extendedprice").cast("bigint").alias("byteperflow"),
        (F.col("l_linenumber") % 2).cast("int").alias("Pairflow"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    path = shared_dir(spark, "sdn")
    raw.write.option("header", True).csv(path)
    out = R.counter_flow_view(R.read_counter_flows(spark, path))
    return out.select(*[F.round(c, 9).alias(c) if c in FLOW_DOUBLES else F.col(c) for c in out.columns])


@query("materialise_or_reuse", f"""WITH {pk_sql()}, {DIR_SQL}, {win_sql()}, {FLOW_SQL}
SELECT 'windows' AS name, CAST(count(*) AS BIGINT) AS rows, CAST(sum(n_in) AS DOUBLE) AS total FROM win
UNION ALL SELECT 'flows', CAST(count(*) AS BIGINT), round(sum(pktrate), 6) FROM flow""")
def q_materialise(spark, sf):
    p = packets(spark, sf)
    path = shared_dir(spark, "extract")
    tables = {"windows": lambda: peer_windows(p, [SERVER], features=["n_in"]), "flows": lambda: V.flow_view(p, [SERVER])}
    K.materialise_or_reuse(spark, path, tables)
    again = K.materialise_or_reuse(spark, path, {k: None for k in tables})    # nothing is built this time
    w = again["windows"].agg(F.lit("windows").alias("name"), F.count("*").alias("rows"), F.sum("n_in").cast("double").alias("total"))
    f = again["flows"].agg(F.lit("flows").alias("name"), F.count("*").alias("rows"), F.round(F.sum("pktrate"), 6).alias("total"))
    return w.unionByName(f)


@query("dataset_sink", f"""{lab3_sql()}
SELECT session, CAST(label AS INT) AS label, CAST(count(*) AS BIGINT) AS windows, CAST(sum(n_in) AS BIGINT) AS n_in FROM lab GROUP BY ALL""")
def q_dataset_sink(spark, sf):
    path = shared_dir(spark, "windows")
    K.write_windows(labelled(spark, sf, 3, FEATURES), path)
    back = spark.read.parquet(path)
    return back.groupBy("session", "label").agg(F.count("*").alias("windows"), F.sum("n_in").alias("n_in"))


@query("capture_qc", """WITH c AS (SELECT event_type AS source, count(*) AS captured, count(*) + 7 AS received, count(*) % 5 AS dropped FROM events GROUP BY 1)
SELECT source, CAST(captured AS BIGINT) AS captured, CAST(received AS BIGINT) AS received_by_filter, CAST(dropped AS BIGINT) AS dropped_by_kernel FROM c""")
def q_capture_qc(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"))
    text = F.array(F.concat(F.col("n").cast("string"), F.lit(" packets captured")),
                   F.concat((F.col("n") + 7).cast("string"), F.lit(" packets received by filter")),
                   F.concat((F.col("n") % 5).cast("string"), F.lit(" packets dropped by kernel")), F.lit("listening on eth0"))
    lines = c.select("source", F.explode(text).alias("value"))
    return R.capture_counters(lines, ["source"])


@query("read_scores", f"""WITH {pk_sql()}, {DIR_SQL}, {win_sql()}
SELECT window_start, peer_ip, n_in, round(least(n_in / CAST(5 AS DOUBLE), 1), 4) AS score,
  CAST(CASE WHEN n_in % 2 = 0 THEN uniq_sport_in >= 3 ELSE false END AS INT) AS novel,
  CAST(n_in >= 3 OR uniq_sport_in >= 3 AS INT) AS flagged, CAST(CASE WHEN n_in % 2 = 0 THEN 4 ELSE 0 END AS INT) AS model_version FROM win""")
def q_read_scores(spark, sf):
    s = scored_windows(spark, sf)
    s = s.select(F.format_string("%.0f", "window_start").alias("window_start"), "peer_ip", "n_in", F.format_string("%.4f", "score").alias("score"),
                 F.col("novel").cast("int").alias("novel"), F.col("flagged").cast("int").alias("flagged"), F.lit(4).alias("model_version"))
    old, new = shared_dir(spark, "scores-old"), shared_dir(spark, "scores-new")
    s.where("n_in % 2 <> 0").drop("novel", "model_version").write.option("header", True).csv(old)
    s.where("n_in % 2 = 0").write.option("header", True).csv(new)
    return R.read_scores(spark, [old, new])


@query("read_detector_log", """SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'block' END AS event, CAST(event_id AS DOUBLE) AS ts,
  CASE WHEN event_type <> 'error' THEN CAST(user_id AS BIGINT) END AS n_windows, CASE WHEN event_type = 'error' THEN '[[1,"a"]]' END AS unscored FROM events""")
def q_read_log(spark, sf):
    e = table(spark, sf, "events")
    good = F.when(F.col("event_type") == "error", F.concat(F.lit('{"event":"error","ts":'), F.col("event_id").cast("string"), F.lit(',"windows":[[1,"a"]]}')))
    good = good.otherwise(F.concat(F.lit('{"event":"block","ts":'), F.col("event_id").cast("string"), F.lit(',"windows":'), F.col("user_id").cast("string"), F.lit("}")))
    broken = F.lit('{"event":"blo')
    lines = e.select(F.explode(F.when(F.col("event_id") % 10 == 0, F.array(good, broken)).otherwise(F.array(good))).alias("value"))
    path = shared_dir(spark, "log")
    lines.write.text(path)
    return R.read_detector_log(spark, path).select("event", "ts", "n_windows", "unscored")


@query("report_sink", f"""WITH {pk_sql()}, {DIR_SQL}, {win_sql()}
SELECT peer_ip, CAST(count(*) AS INT) AS windows, round(avg(CAST(n_in AS DOUBLE)), 2) AS mean_n FROM win GROUP BY peer_ip""")
def q_report_sink(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER], features=["n_in"])
    path = shared_dir(spark, "report")
    K.write_report(w.groupBy("peer_ip").agg(F.count("*").cast("int").alias("windows"), F.avg("n_in").alias("mean_n")), path)
    return spark.read.schema("peer_ip string, windows int, mean_n double").option("header", True).csv(path)


@query("column_prune", f"""WITH {pk_sql()}, {DIR_SQL}, {win_sql()} SELECT session, window_start, peer_ip, {rounded_sql(["n_in", "mean_size_in"])} FROM win""")
def q_column_prune(spark, sf):
    return peer_windows(packets(spark, sf), [SERVER], features=["n_in", "mean_size_in"]).select(
        "session", "window_start", "peer_ip", *rounded(["n_in", "mean_size_in"]))
