"""Queries over scoring, novelty, block decisions, mitigation and monitoring (M3, M5, M10, M11, N*, K4-K10, G*, D*)."""
from pyspark.sql import functions as F

from floodlens.functions.decisions import above, hybrid_flag
from floodlens.operators import adaptive as A
from floodlens.operators import mitigation as G
from floodlens.operators import monitoring as D
from floodlens.operators.neighbours import knn_classify, mean_distance, nearest
from floodlens.operators.novelty import calibration_scores, novelty_fit
from floodlens.operators.peer_windows import peer_windows, window_ends
from floodlens.operators.sampling import holdout_session
from floodlens.operators.scaling import fit_scaler, standardise
from floodlens.plans.labels import LAB, attacker_hosts, labelled
from floodlens.plans.packet_view import (ATTACKERS, ATTACKERS_SQL, ATTACKS_SQL, CLIENTS, DIR_SQL, SERVER, attacks,
                                         labelled_sql, packets, pk_sql, rounded_sql, table, win_sql)
from floodlens.plans.registry import query
from floodlens.schemas import FEATURES
from floodlens.session import materialise

WIN = f"WITH RECURSIVE {pk_sql()}, {DIR_SQL}, {win_sql()}"
KEY = ["session", "slot", "peer_ip"]
NAME_SQL = "session || '|' || CAST(window_start AS BIGINT) || '|' || peer_ip"


def windows(spark, sf, sessions=1, features=FEATURES):
    w = peer_windows(packets(spark, sf, sessions), [SERVER], features=features)
    return w.withColumn("slot", F.col("window_start").cast("bigint"))


# --- Scaling and neighbours ---------------------------------------------------------------

def scaled_sql(source, fit, prepare="{}"):
    """`z`-scored features of `source` with means and population deviations of `fit`."""
    out = []
    for f in FEATURES:
        x = prepare.format(f"CAST({f} AS DOUBLE)")
        out.append(f"({x} - (SELECT avg({x}) FROM {fit})) / (SELECT CASE WHEN stddev_pop({x}) = 0 THEN 1 ELSE stddev_pop({x}) END FROM {fit}) AS {f}")
    return ", ".join(out)


def distance_sql(a, b):
    return "round(" + " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in FEATURES) + ", 9)"


@query("standard_scale", f"""{WIN}, z AS (SELECT session, window_start, peer_ip, {scaled_sql("win", "win")} FROM win)
SELECT session, window_start, peer_ip, {", ".join(f"round({f}, 7) + 0.0::DOUBLE AS {f}" for f in FEATURES)} FROM z""")
def q_standard_scale(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER])
    z = standardise(w, fit_scaler(w, FEATURES))
    return z.select("session", "window_start", "peer_ip", *[(F.round(f, 7) + F.lit(0.0)).alias(f) for f in FEATURES])


LAB_S3 = f"WITH RECURSIVE {pk_sql(3)}, {DIR_SQL}, {win_sql()}"
KNN_SQL = f"""{LAB_S3}, lab AS (SELECT *, {NAME_SQL} AS id,
    CASE WHEN udp_ratio_in > 0.5 THEN 2 WHEN icmp_ratio_in > 0.5 THEN 1 ELSE 0 END AS y FROM win),
tr AS (SELECT * FROM lab WHERE session <> 's3'), te AS (SELECT * FROM lab WHERE session = 's3'),
ztr AS (SELECT id, y, {scaled_sql("tr", "tr")} FROM tr),
zte AS (SELECT id, y, {scaled_sql("te", "tr")} FROM te),
nn AS (SELECT e.id, e.y AS truth, r.y FROM zte e, ztr r
  QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY {distance_sql("e", "r")}, r.id) <= 5),
votes AS (SELECT id, truth, y, count(*) AS c FROM nn GROUP BY ALL)
SELECT id, CAST(truth AS INT) AS y, CAST(y AS INT) AS p FROM votes
QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, y) = 1"""


def knn_rows(spark, sf):
    y = F.when(F.col("udp_ratio_in") > 0.5, 2).when(F.col("icmp_ratio_in") > 0.5, 1).otherwise(0)
    d = holdout_session(windows(spark, sf, 3).withColumn("y", y))
    return d.where("is_test"), d.where("not is_test")


def knn_out(df):
    return df.select(F.concat_ws("|", *KEY).alias("id"), "y", "p")


@query("knn_classify", KNN_SQL)
def q_knn(spark, sf):
    test, train = knn_rows(spark, sf)
    return knn_out(knn_classify(test, train, FEATURES, KEY, label="y"))


@query("knn_classify_cells", KNN_SQL)
def q_knn_cells(spark, sf):
    """The way taken by a training table too large to send to every task."""
    test, train = knn_rows(spark, sf)
    return knn_out(knn_classify(test, train, FEATURES, KEY, label="y", max_broadcast=0))


@query("embedding_neighbours", """WITH e AS (SELECT vec_id, label, embedding FROM embeddings),
d AS (SELECT a.vec_id AS q, b.vec_id AS r, b.label,
    round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x:
      (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 9) AS d2
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, CAST(r AS VARCHAR)) AS rn FROM d)
SELECT q AS vec_id, round(avg(sqrt(d2)), 7) AS mean_distance,
  CAST(sum(CASE WHEN label = (SELECT label FROM e WHERE e.vec_id = n.q) THEN 1 ELSE 0 END) AS BIGINT) AS same_label
FROM n WHERE rn <= 5 GROUP BY q""")
def q_embedding_neighbours(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("vec_id").cast("string").alias("qid"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")
    refs = e.select(F.col("qid").alias("rid"), "vec", "label")
    found = nearest(e, refs, 5, skip_self=True)
    same = F.size(F.filter("neighbours", lambda x: x["label"] == F.col("label"))).cast("bigint")
    return found.select("vec_id", F.round(mean_distance(), 7).alias("mean_distance"), same.alias("same_label"))


# --- Novelty ---------------------------------------------------------------------------------

CAL_S = 120.0
LOGGED = "ln(1 + abs({}))"
NOV = f"""{WIN}, all_w AS (SELECT *, {NAME_SQL} AS id FROM win),
t0 AS (SELECT min(window_start) + {CAL_S} AS t FROM win),
cal AS (SELECT * FROM all_w WHERE window_start < (SELECT t FROM t0)),
str AS (SELECT * FROM all_w WHERE window_start >= (SELECT t FROM t0)),
zc AS (SELECT id, {scaled_sql("cal", "cal", LOGGED)} FROM cal),
zs AS (SELECT id, session, window_start, peer_ip, {scaled_sql("str", "cal", LOGGED)} FROM str),
cal_score AS (SELECT id, avg(sqrt(d2)) AS s FROM (
    SELECT a.id, {distance_sql("a", "b")} AS d2 FROM zc a JOIN zc b ON a.id <> b.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {distance_sql("a", "b")}, b.id) <= 5) GROUP BY id),
thr AS (SELECT quantile_cont(s, 0.999) AS t FROM cal_score)"""
STREAM_SCORE = f"""str_score AS (SELECT id, session, window_start, peer_ip, avg(sqrt(d2)) AS s FROM (
    SELECT a.id, a.session, a.window_start, a.peer_ip, {distance_sql("a", "b")} AS d2 FROM zs a, zc b
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {distance_sql("a", "b")}, b.id) <= 5) GROUP BY ALL)"""


@query("novelty_fit", f"""{NOV}
SELECT CAST(count(*) AS BIGINT) AS calibration_windows, round((SELECT t FROM thr), 6) AS threshold FROM cal_score""")
def q_novelty_fit(spark, sf):
    cal, _, _ = A.calibration_split(windows(spark, sf), CAL_S)
    n = novelty_fit(cal, FEATURES, KEY)
    return cal.agg(F.count("*").alias("calibration_windows")).withColumn(
        "threshold", F.round(F.lit(n.threshold), 6))


@query("novelty_calibration_scores", f"{NOV} SELECT id, round(s, 6) AS score FROM cal_score")
def q_novelty_calibration(spark, sf):
    cal, _, _ = A.calibration_split(windows(spark, sf), CAL_S)
    scored = calibration_scores(cal, FEATURES, KEY)[3]
    return scored.select(F.concat_ws("|", *KEY).alias("id"), F.round("novelty", 6).alias("score"))


@query("novelty_score", f"""{NOV}, {STREAM_SCORE}
SELECT session, window_start, peer_ip, round(s, 6) AS novelty, CAST(s > (SELECT t FROM thr) AS INT) AS novel FROM str_score""")
def q_novelty_score(spark, sf):
    cal, stream, _ = A.calibration_split(windows(spark, sf), CAL_S)
    return novelty_fit(cal, FEATURES, KEY).flag(stream).select(
        "session", "window_start", "peer_ip", F.round("novelty", 6).alias("novelty"), F.col("novel").cast("int").alias("novel"))


@query("novelty_flag", f"""{NOV}, {STREAM_SCORE}
SELECT peer_ip, CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (s > (SELECT t FROM thr)) AS BIGINT) AS novel
FROM str_score GROUP BY peer_ip""")
def q_novelty_flag(spark, sf):
    """The way taken by a calibration table too large to send to every task."""
    cal, stream, _ = A.calibration_split(windows(spark, sf), CAL_S)
    flagged = novelty_fit(cal, FEATURES, KEY, max_broadcast=0).flag(stream)
    return flagged.groupBy("peer_ip").agg(F.count("*").alias("windows"), F.count_if("novel").alias("novel"))


# --- Pseudo-labels ---------------------------------------------------------------------------

SMALL = ["n_in", "bytes_in", "mean_size_in", "uniq_sport_in"]
NOVEL_RULE = "bytes_in >= 120"      # a fixed stand-in for the novelty flag: about half of the windows
STREAK_SQL = """rows1 AS (SELECT session, peer_ip, window_start, n_in, bytes_in >= 120 AS novel FROM win),
marks AS (SELECT *, coalesce(lag(window_start) OVER w < window_start - 1, true) AS gap FROM rows1
  WINDOW w AS (PARTITION BY session, peer_ip ORDER BY window_start)),
isl AS (SELECT *, sum(CASE WHEN gap OR NOT novel THEN 1 ELSE 0 END) OVER (
    PARTITION BY session, peer_ip ORDER BY window_start) AS island FROM marks),
streaks AS (SELECT *, CASE WHEN novel THEN count(*) FILTER (novel) OVER (
    PARTITION BY session, peer_ip, island ORDER BY window_start) ELSE 0 END AS streak FROM isl),
kinds AS (SELECT *, CASE WHEN NOT novel THEN 'benign' WHEN streak >= 2 THEN 'attack' END AS kind FROM streaks)"""


def novel_rows(spark, sf):
    return windows(spark, sf, features=SMALL).withColumn("novel", F.expr(NOVEL_RULE))


@query("pseudo_label", f"{WIN}, {STREAK_SQL} SELECT session, peer_ip, window_start, kind FROM kinds")
def q_pseudo_label(spark, sf):
    return A.pseudo_label(novel_rows(spark, sf)).select("session", "peer_ip", "window_start", "kind")


@query("in_streak", f"""{WIN}, rows1 AS (SELECT session, peer_ip, window_start, bytes_in >= 120 AS novel FROM win)
SELECT session, peer_ip, window_start, CAST(novel AND coalesce(lag(novel) OVER w, false)
  AND coalesce(window_start - lag(window_start) OVER w <= 1, false) AS INT) AS in_streak FROM rows1
WINDOW w AS (PARTITION BY session, peer_ip ORDER BY window_start)""")
def q_in_streak(spark, sf):
    return A.in_streak(novel_rows(spark, sf), "novel").select(
        "session", "peer_ip", "window_start", F.col("in_streak").cast("int").alias("in_streak"))


POOL_ROWS = 300
POOL_SQL = f"""pool AS (SELECT * FROM kinds WHERE kind IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY window_start DESC, session DESC, peer_ip DESC) <= {POOL_ROWS})"""


@query("recent_pool", f"{WIN}, {STREAK_SQL}, {POOL_SQL} SELECT session, peer_ip, window_start, kind FROM pool")
def q_recent_pool(spark, sf):
    return A.recent_pool(A.pseudo_label(novel_rows(spark, sf)), POOL_ROWS).select("session", "peer_ip", "window_start", "kind")


@query("retrain_set", f"""{WIN}, {STREAK_SQL}, {POOL_SQL},
u AS (SELECT n_in, CAST(n_in >= 3 AS INT) AS y FROM win UNION ALL SELECT n_in, CASE WHEN kind = 'attack' THEN 1 ELSE 0 END FROM pool)
SELECT CAST(y AS INT) AS y, CAST(count(*) AS BIGINT) AS rows, CAST(sum(n_in) AS DOUBLE) AS n_in FROM u GROUP BY y""")
def q_retrain_set(spark, sf):
    rows = novel_rows(spark, sf)
    base = rows.withColumn("y", (F.col("n_in") >= 3).cast("int"))
    pool = A.recent_pool(A.pseudo_label(rows), POOL_ROWS)
    return A.retrain_set(base, pool, SMALL).groupBy("y").agg(F.count("*").alias("rows"), F.sum("n_in").alias("n_in"))


@query("calibration_split", f"""{WIN}
SELECT CAST(window_start < (SELECT min(window_start) FROM win) + 120 AS INT) AS calibration,
  CAST(count(*) AS BIGINT) AS windows, CAST(sum(n_in) AS BIGINT) AS packets FROM win GROUP BY 1""")
def q_calibration_split(spark, sf):
    cal, stream, _ = A.calibration_split(windows(spark, sf, features=["n_in"]), CAL_S)
    both = cal.withColumn("calibration", F.lit(1)).unionByName(stream.withColumn("calibration", F.lit(0)))
    return both.groupBy("calibration").agg(F.count("*").alias("windows"), F.sum("n_in").alias("packets"))


@query("step_batches", f"""{WIN}, t0 AS (SELECT min(window_start) + 120 AS t FROM win),
s AS (SELECT *, CAST(floor((window_start - (SELECT t FROM t0)) / 30) AS INT) AS step FROM win WHERE window_start >= (SELECT t FROM t0))
SELECT step, CAST(floor(step * 30 / CAST(60 AS DOUBLE)) AS INT) AS version, CAST(count(*) AS BIGINT) AS windows FROM s GROUP BY ALL""")
def q_step_batches(spark, sf):
    _, stream, start = A.calibration_split(windows(spark, sf, features=["n_in"]), CAL_S)
    return A.step_batches(stream, start, 30.0, 60.0).groupBy("step", "version").agg(F.count("*").alias("windows"))


# --- Scores, decisions, blocks -----------------------------------------------------------------

SCORED_SQL = """ends AS (SELECT session, CAST(slot AS DOUBLE) AS window_start,
    coalesce(lead(a) OVER (PARTITION BY session ORDER BY slot), z) / CAST(1000000 AS DOUBLE) AS now
  FROM (SELECT session, ts_us // 1000000 AS slot, arg_min(ts_us, seq) AS a, arg_max(ts_us, seq) AS z FROM pk GROUP BY ALL)),
scored AS (SELECT w.session, w.peer_ip, w.window_start, e.now, w.n_in, least(w.n_in / CAST(5 AS DOUBLE), 1) AS score,
    CAST(uniq_sport_in >= 3 AS INT) AS novel, (w.n_in >= 3 OR uniq_sport_in >= 3) AS flagged,
    w.bytes_in % 7 <> 0 AS action_ok
  FROM win w JOIN ends e USING (session, window_start))"""
BLOCK_S = 30.0


def scored_windows(spark, sf, hybrid=True):
    """Windows scored by a fixed rule, decided at the time they closed."""
    w = windows(spark, sf, features=["n_in", "bytes_in", "uniq_sport_in"])
    s = w.withColumn("score", F.least(F.col("n_in") / F.lit(5.0), F.lit(1.0)))
    s = s.withColumn("novel", (F.col("uniq_sport_in") >= 3).cast("int"))
    s = s.withColumn("flagged", hybrid_flag(above(F.col("score"), 0.5), F.col("novel") == 1, hybrid))
    closed = window_ends(packets(spark, sf)).withColumnRenamed("closed_at", "now")
    return s.join(closed, ["session", "window_start"]).withColumn("action_ok", F.col("bytes_in") % 7 != 0)


@query("predict_threshold", f"""{WIN} SELECT session, window_start, peer_ip,
  CAST(least(n_in / CAST(5 AS DOUBLE), 1) >= 0.5 AS INT) AS p FROM win""")
def q_predict_threshold(spark, sf):
    w = windows(spark, sf, features=["n_in"])
    return w.select("session", "window_start", "peer_ip",
                    above(F.least(F.col("n_in") / F.lit(5.0), F.lit(1.0)), 0.5).cast("int").alias("p"))


@query("hybrid_flag", f"""{WIN}, {SCORED_SQL}
SELECT session, window_start, peer_ip, CAST(flagged AS INT) AS flagged FROM scored""")
def q_hybrid_flag(spark, sf):
    return scored_windows(spark, sf).select("session", "window_start", "peer_ip", F.col("flagged").cast("int").alias("flagged"))


BLOCKS_SQL = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY session, peer_ip ORDER BY window_start) AS rn
  FROM scored WHERE peer_ip <> '10.0.0.25'),
fold AS (
  SELECT session, peer_ip, rn, 0 AS streak, CAST(-1 AS DOUBLE) AS until, CAST(NULL AS VARCHAR) AS event,
    CAST(NULL AS DOUBLE) AS ts, CAST(NULL AS DOUBLE) AS sc, 0 AS w FROM (SELECT DISTINCT session, peer_ip, 0 AS rn FROM numbered)
  UNION ALL
  SELECT n.session, n.peer_ip, n.rn,
    CASE WHEN NOT n.flagged OR f.until > n.now THEN 0 WHEN f.streak + 1 >= 2 AND n.action_ok THEN 0 ELSE f.streak + 1 END,
    CASE WHEN n.flagged AND f.until <= n.now AND f.streak + 1 >= 2 AND n.action_ok THEN n.now + {BLOCK_S} ELSE f.until END,
    CASE WHEN n.flagged AND f.until <= n.now AND f.streak + 1 >= 2 THEN CASE WHEN n.action_ok THEN 'block' ELSE 'error' END END,
    n.now, n.score, f.streak + 1
  FROM fold f JOIN numbered n ON n.session = f.session AND n.peer_ip = f.peer_ip AND n.rn = f.rn + 1),
actions AS (SELECT session, peer_ip, event, ts, sc AS score, CAST(w AS BIGINT) AS windows,
    CASE WHEN event = 'block' THEN CAST({BLOCK_S} AS DOUBLE) END AS seconds FROM fold WHERE event IS NOT NULL)"""
DECIDED = f"{WIN}, {SCORED_SQL}, {BLOCKS_SQL}"


def stored_scores(spark, sf):
    """Scored windows as the table a detector writes; queries that read it more than once start here."""
    return materialise(scored_windows(spark, sf), "scores")


def actions(spark, sf, scored=None):
    return G.block_decisions(scored_windows(spark, sf) if scored is None else scored, 2, BLOCK_S, ["10.0.0.25"])


@query("block_decisions", f"{DECIDED} SELECT * FROM actions WHERE event = 'block'")
def q_block_decisions(spark, sf):
    return actions(spark, sf).where("event = 'block'")


@query("block_failed", f"{DECIDED} SELECT session, peer_ip, ts, windows FROM actions WHERE event = 'error'")
def q_block_failed(spark, sf):
    return actions(spark, sf).where("event = 'error'").select("session", "peer_ip", "ts", "windows")


@query("active_blocks", f"""{DECIDED} SELECT CAST(count(*) AS BIGINT) AS active FROM (
  SELECT peer_ip FROM actions WHERE event = 'block' GROUP BY peer_ip HAVING max(ts + seconds) > 200)""")
def q_active_blocks(spark, sf):
    return G.active_blocks(actions(spark, sf).where("event = 'block'"), 200.0)


LOG_SQL = f"""log AS (
  SELECT event, ts, peer_ip AS peer, score, windows, seconds, CAST(NULL AS INT) AS version FROM actions
  UNION ALL SELECT 'retrained', CAST(m * 60 + 0.5 AS DOUBLE), NULL, NULL, NULL, NULL, CAST(m AS INT)
    FROM (SELECT DISTINCT CAST(window_start // 60 AS BIGINT) AS m FROM win) WHERE m > 0
  UNION ALL SELECT 'calibrated', CAST(59 AS DOUBLE), NULL, NULL, NULL, NULL, NULL FROM (SELECT min(window_start) FROM win)
  UNION ALL SELECT 'start', CAST(min(window_start) - 1 AS DOUBLE), NULL, NULL, NULL, NULL, NULL FROM win)"""


def detector_log(spark, sf, scored):
    w = scored.select("window_start")
    acts = actions(spark, sf, scored).select(
        "event", "ts", F.col("peer_ip").alias("peer"), "score", "windows", "seconds", F.lit(None).cast("int").alias("version"))
    nothing = [F.lit(None).cast("string").alias("peer"), F.lit(None).cast("double").alias("score"),
               F.lit(None).cast("bigint").alias("windows"), F.lit(None).cast("double").alias("seconds")]
    minute = F.floor(F.col("window_start") / 60).cast("int")
    retrained = w.select(minute.alias("version")).distinct().where("version > 0").select(
        F.lit("retrained").alias("event"), (F.col("version") * 60 + 0.5).cast("double").alias("ts"), *nothing, "version")
    first = w.agg(F.min("window_start").alias("a"))
    none = F.lit(None).cast("int").alias("version")
    calibrated = first.select(F.lit("calibrated").alias("event"), F.lit(59.0).alias("ts"), *nothing, none)
    start = first.select(F.lit("start").alias("event"), (F.col("a") - 1).alias("ts"), *nothing, none)
    return materialise(acts.unionByName(retrained).unionByName(calibrated).unionByName(start), "log")


NOW = 200.0


@query("recent_series", f"""{WIN}, {SCORED_SQL}
SELECT peer_ip, CAST(count(*) AS INT) AS points, CAST(min(window_start) AS DOUBLE) AS first_t,
  CAST(sum(rn * n_in) AS BIGINT) AS weighted, CAST(sum(rn * CAST(flagged AS INT)) AS BIGINT) AS flags FROM (
  SELECT *, row_number() OVER (PARTITION BY peer_ip ORDER BY window_start) AS rn FROM scored
  WHERE window_start >= {NOW - 121} AND window_start <= {NOW - 1}) GROUP BY peer_ip""")
def q_recent_series(spark, sf):
    s = D.recent_series(scored_windows(spark, sf), NOW)
    points = s.select("peer_ip", "series", F.posexplode("series").alias("i", "p"))
    return points.groupBy("peer_ip").agg(
        F.count("*").cast("int").alias("points"), F.min("p.t").alias("first_t"),
        F.sum((F.col("i") + 1) * F.col("p.n")).alias("weighted"),
        F.sum((F.col("i") + 1) * F.col("p.flagged").cast("int")).cast("bigint").alias("flags"))


@query("source_state", f"""{WIN}, {SCORED_SQL}
SELECT peer_ip, window_start, n_in, score, novel, CAST(flagged AS INT) AS flagged, CAST(0 AS INT) AS model_version FROM scored
WHERE window_start >= {NOW - 121} AND window_start <= {NOW - 1}
QUALIFY row_number() OVER (PARTITION BY peer_ip ORDER BY window_start DESC) = 1""")
def q_source_state(spark, sf):
    return D.source_state(score_rows(scored_windows(spark, sf)), NOW)


def score_rows(scored):
    return scored.select(
        "window_start", "peer_ip", "n_in", "score", "novel", F.col("flagged").cast("int").alias("flagged"),
        F.lit(0).alias("model_version"))


SOURCES_SQL = f"""st AS (SELECT * FROM scored WHERE window_start >= {NOW - 121} AND window_start <= {NOW - 1}
  QUALIFY row_number() OVER (PARTITION BY peer_ip ORDER BY window_start DESC) = 1),
bl AS (SELECT peer_ip, max(ts + seconds) AS until, count(*) AS c FROM actions WHERE event = 'block' AND ts <= {NOW} GROUP BY peer_ip)"""


@query("block_state", f"""{DECIDED}, {SOURCES_SQL}
SELECT coalesce(s.peer_ip, b.peer_ip) AS peer_ip, s.window_start, CAST(coalesce(s.n_in, 0) AS BIGINT) AS n_in,
  CAST(coalesce(b.c, 0) AS BIGINT) AS blocks, CAST(greatest(coalesce(b.until, 0) - {NOW}, 0) AS DOUBLE) AS blocked_for
FROM st s FULL JOIN bl b ON s.peer_ip = b.peer_ip WHERE s.peer_ip IS NOT NULL OR b.until > {NOW}""")
def q_block_state(spark, sf):
    scored = stored_scores(spark, sf)
    return D.sources(score_rows(scored), detector_log(spark, sf, scored), NOW).select(
        "peer_ip", "window_start", "n_in", "blocks", "blocked_for")


@query("event_feed", f"""{DECIDED}, {LOG_SQL}
SELECT event, ts, peer, windows, version FROM log WHERE ts <= {NOW} ORDER BY ts DESC, peer DESC LIMIT 40""")
def q_event_feed(spark, sf):
    return D.event_feed(detector_log(spark, sf, stored_scores(spark, sf)), NOW, order="peer").select("event", "ts", "peer", "windows", "version")


SCHEDULE_SQL = f"""sched AS (SELECT 's1' AS session, o_orderkey AS round, '10.0.0.' || (10 + o_custkey % 16) AS ip,
    o_orderpriority AS attack, o_orderstatus AS rate, CAST(t AS DOUBLE) AS start_ts, CAST(t + 5 + o_orderkey % 20 AS DOUBLE) AS end_ts
  FROM (SELECT *, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) % 1000003 % 360 AS t FROM orders))"""


def order_schedule(spark, sf):
    """One attack per order: its customer picks the host, its date the time."""
    o = table(spark, sf, "orders")
    t = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) % 1000003 % 360
    return o.select(F.lit("s1").alias("session"), F.col("o_orderkey").alias("round"),
                    F.concat(F.lit("10.0.0."), (10 + F.col("o_custkey") % 16).cast("string")).alias("ip"),
                    F.col("o_orderpriority").alias("attack"), F.col("o_orderstatus").alias("rate"),
                    t.cast("double").alias("start_ts"), (t + 5 + F.col("o_orderkey") % 20).cast("double").alias("end_ts"),
                    F.col("o_orderkey").alias("ev_order"))


@query("attack_overlay", f"""WITH {SCHEDULE_SQL}
SELECT CAST(round AS BIGINT) AS round, ip, attack, rate, start_ts, end_ts FROM sched WHERE end_ts >= {NOW - 120} AND start_ts <= {NOW}""")
def q_attack_overlay(spark, sf):
    return D.attack_overlay(order_schedule(spark, sf), NOW).select(
        F.col("round").cast("bigint").alias("round"), "ip", "attack", "rate", "start_ts", "end_ts")


TOTALS_SQL = f"""{DECIDED}, {LOG_SQL}
SELECT CAST((SELECT count(*) FROM scored WHERE window_start <= {{now}} - 1) AS BIGINT) AS windows,
  CAST((SELECT count(DISTINCT peer_ip) FROM scored WHERE window_start BETWEEN {{now}} - 121 AND {{now}} - 1) AS BIGINT) AS sources,
  CAST((SELECT count(*) FROM log WHERE event = 'block' AND ts <= {{now}}) AS BIGINT) AS blocks,
  CAST(coalesce((SELECT arg_max(version, ts) FROM log WHERE event = 'retrained' AND ts <= {{now}}), 0) AS INT) AS model_version,
  (SELECT count(*) > 0 FROM log WHERE event = 'calibrated' AND ts <= {{now}}) AS calibrated,
  CAST((SELECT count(*) FROM log WHERE event = 'error' AND ts <= {{now}}) AS BIGINT) AS errors,
  CAST((SELECT count(*) FROM (SELECT peer FROM log WHERE event = 'block' AND ts <= {{now}} GROUP BY peer
        HAVING max(ts + seconds) > {{now}})) AS BIGINT) AS active_blocks"""


@query("totals", TOTALS_SQL.format(now=NOW))
def q_totals(spark, sf):
    scored = stored_scores(spark, sf)
    return D.totals(score_rows(scored), detector_log(spark, sf, scored), NOW)


CLOCK_SQL = "least((SELECT min(window_start) FROM scored) - 1 + 25 * 4, (SELECT max(window_start) FROM scored) + 2)"


@query("replay_clock", TOTALS_SQL.format(now=f"({CLOCK_SQL})"))
def q_replay_clock(spark, sf):
    scored = stored_scores(spark, sf)
    scores = score_rows(scored)
    return D.totals(scores, detector_log(spark, sf, scored), D.replay_clock(scores, 25.0, 4.0))


@query("settings", f"""WITH {pk_sql()}, s AS (SELECT session, min(ts_us) / CAST(1000000 AS DOUBLE) AS ts FROM pk GROUP BY session)
SELECT CAST(0.5 AS DOUBLE) AS threshold, CAST(2 AS INT) AS consecutive, CAST(length(session) AS DOUBLE) AS block_seconds,
  'hybrid' AS mode FROM s ORDER BY ts DESC LIMIT 1""")
def q_settings(spark, sf):
    starts = packets(spark, sf).groupBy("session").agg((F.min("ts_us") / 1e6).alias("ts"))
    log = starts.select(
        F.lit("start").alias("event"), "ts", F.lit(0.5).alias("threshold"), F.lit(2).alias("consecutive"),
        F.length("session").cast("double").alias("block_seconds"), F.lit("hybrid").alias("mode"),
        F.lit(300.0).alias("calibrate"), F.lit(False).alias("adaptive"), F.lit(120.0).alias("retrain_seconds"))
    return D.settings(log).select("threshold", "consecutive", "block_seconds", "mode")


@query("minute_stats", f"""{DECIDED}, {LOG_SQL},
m AS (SELECT CAST(floor(now / 60) AS BIGINT) AS minute, count(*) AS windows, count(*) FILTER (flagged) AS flagged FROM scored GROUP BY 1),
p AS (SELECT CAST(floor(ts_us / 60e6) AS BIGINT) AS minute, count(*) AS packets FROM pk GROUP BY 1)
SELECT coalesce(m.minute, p.minute) AS minute, CAST(coalesce(packets, 0) AS BIGINT) AS packets,
  CAST(coalesce(windows, 0) AS BIGINT) AS windows, CAST(coalesce(flagged, 0) AS BIGINT) AS flagged,
  CAST((SELECT count(DISTINCT peer) FROM log WHERE event = 'block' AND ts <= (coalesce(m.minute, p.minute) + 1) * 60
    AND ts + seconds > (coalesce(m.minute, p.minute) + 1) * 60) AS BIGINT) AS blocks_active,
  CAST(coalesce((SELECT max(version) FROM log WHERE event = 'retrained' AND ts <= (coalesce(m.minute, p.minute) + 1) * 60), 0) AS INT) AS model_version,
  (coalesce(m.minute, p.minute) + 1) * 60 >= 59 AS calibrated
FROM m FULL JOIN p ON m.minute = p.minute""")
def q_minute_stats(spark, sf):
    scored = stored_scores(spark, sf)
    log = detector_log(spark, sf, scored)
    blocks = log.where("event = 'block'").select(F.col("peer").alias("peer_ip"), "ts", "seconds")
    return D.minute_stats(scored, D.packets_per_minute(packets(spark, sf)), blocks,
                          log.where("event = 'retrained'").select("ts", "version"), 59.0)


@query("calibration_rows", f"""{WIN}, {SCORED_SQL}
SELECT CAST(count(*) AS BIGINT) AS windows, CAST(max(now) AS DOUBLE) AS last_now FROM scored
WHERE score < 0.5 AND now <= (SELECT min(now) FROM scored WHERE now >= (SELECT min(now) FROM scored) + 60)""")
def q_calibration_rows(spark, sf):
    """Rows the live calibration takes: benign by the model, up to the batch that closes it."""
    return A.calibration_rows(scored_windows(spark, sf), 60.0).agg(
        F.count("*").alias("windows"), F.max("now").alias("last_now"))


# --- Mitigation -----------------------------------------------------------------------------------

def client_hosts(spark):
    return spark.createDataFrame([("s1", ip) for ip in CLIENTS], "session string, ip string")


REPORT_SQL = f"""{DECIDED}, {ATTACKS_SQL},
blocks AS (SELECT *, ts + seconds AS until FROM actions WHERE event = 'block'),
secs AS (SELECT session, src AS ip, ts_us // 1000000 AS sec, count(*) AS n FROM pk
  WHERE dst = '{SERVER}' AND src IN {ATTACKERS_SQL} GROUP BY ALL),
cover AS (SELECT a.round, coalesce(sum(greatest(0, least(b.until, a.end_ts) - greatest(b.ts, a.start_ts))) FILTER (b.ts IS NOT NULL), 0) AS covered,
    coalesce(bool_or(b.ts <= a.start_ts AND b.until > a.start_ts), false) AS active,
    min(b.ts) FILTER (b.ts > a.start_ts AND b.ts <= a.end_ts) AS first
  FROM attacks a LEFT JOIN blocks b ON a.ip = b.peer_ip AND a.session = b.session GROUP BY a.round),
got AS (SELECT a.*, c.covered, c.active, c.first,
    coalesce((SELECT sum(n) FROM secs s WHERE s.ip = a.ip AND sec >= floor(start_ts) AND sec < floor(end_ts) + 1), 0) AS got,
    coalesce((SELECT sum(n) FROM secs s WHERE s.ip = a.ip AND sec >= floor(start_ts) AND sec < floor(c.first)), 0) AS before,
    CASE WHEN c.active THEN 'already blocked' WHEN c.first IS NOT NULL THEN 'blocked' ELSE 'missed' END AS status
  FROM attacks a JOIN cover c USING (round)),
expd AS (SELECT *, CASE WHEN rate1 > 0 THEN rate1 ELSE CAST(pps AS DOUBLE) END * (end_ts - start_ts) AS expected FROM (
  SELECT *, CASE status WHEN 'blocked' THEN before / greatest(first - start_ts, 1) WHEN 'missed' THEN got / greatest(end_ts - start_ts, 1) END AS rate1 FROM got)),
report AS (SELECT session, round, ip AS attacker, attack, rate, end_ts - start_ts AS duration_s, status,
    CASE WHEN status = 'blocked' THEN first - start_ts END AS time_to_block_s,
    100 * covered / (end_ts - start_ts) AS blocked_share, CAST(got AS BIGINT) AS packets_delivered,
    CASE WHEN expected <> 0 THEN 100 * (1 - least(got / expected, 1)) END AS traffic_stopped FROM expd)"""


def report(spark, sf, acts=None):
    acts = materialise(actions(spark, sf), "actions") if acts is None else acts
    secs = G.attack_seconds(packets(spark, sf), SERVER, attacker_hosts(spark))
    return G.attack_report(attacks(spark), acts.where("event = 'block'"), secs)


@query("attack_seconds", f"""WITH {pk_sql()}
SELECT session, src AS ip, CAST(ts_us // 1000000 AS BIGINT) AS sec, CAST(count(*) AS BIGINT) AS n FROM pk
WHERE dst = '{SERVER}' AND src IN {ATTACKERS_SQL} GROUP BY ALL""")
def q_attack_seconds(spark, sf):
    return G.attack_seconds(packets(spark, sf), SERVER, attacker_hosts(spark))


@query("delivered", f"""WITH {pk_sql()}, {ATTACKS_SQL}
SELECT CAST(a.round AS INT) AS round, CAST(count(p.seq) AS BIGINT) AS delivered FROM attacks a LEFT JOIN pk p
  ON p.src = a.ip AND p.dst = '{SERVER}' AND p.ts_us // 1000000 >= floor(start_ts) AND p.ts_us // 1000000 < floor(end_ts) + 1
GROUP BY a.round""")
def q_delivered(spark, sf):
    secs = G.attack_seconds(packets(spark, sf), SERVER, attacker_hosts(spark))
    a = attacks(spark).withColumn("first", F.lit(None).cast("double"))
    return G.delivered(a, secs).select(F.col("ev_order").alias("round"), F.col("got").alias("delivered"))


@query("delivered_orders", f"""WITH {pk_sql()}, {SCHEDULE_SQL},
secs AS (SELECT session, src AS ip, ts_us // 1000000 AS sec, count(*) AS n FROM pk WHERE dst = '{SERVER}' GROUP BY ALL)
SELECT CAST(a.round AS BIGINT) AS round, CAST(coalesce(sum(n), 0) AS BIGINT) AS got,
  CAST(coalesce(sum(CASE WHEN sec < floor(a.start_ts + 3.5) THEN n END), 0) AS BIGINT) AS before
FROM sched a LEFT JOIN secs s ON s.session = a.session AND s.ip = a.ip AND sec >= floor(start_ts) AND sec < floor(end_ts) + 1 GROUP BY a.round""")
def q_delivered_orders(spark, sf):
    """Thousands of overlapping attacks on sixteen hosts, each cut 3.5 s after its start."""
    a = order_schedule(spark, sf).withColumn("first", F.col("start_ts") + 3.5)
    secs = G.attack_seconds(packets(spark, sf), SERVER, a)
    return G.delivered(a, secs).select(F.col("ev_order").cast("bigint").alias("round"), "got", "before")


@query("block_overlap_orders", f"""{DECIDED}, {SCHEDULE_SQL}, b AS (SELECT *, ts + seconds AS until FROM actions WHERE event = 'block')
SELECT CAST(a.round AS BIGINT) AS round,
  round(CAST(coalesce(sum(CASE WHEN ts IS NOT NULL THEN greatest(least(until, end_ts) - greatest(ts, start_ts), 0) END), 0) AS DOUBLE), 6) AS covered,
  coalesce(bool_or(ts <= start_ts AND until > start_ts), false) AS active, min(CASE WHEN ts > start_ts AND ts <= end_ts THEN ts END) AS first
FROM sched a LEFT JOIN b ON b.session = a.session AND b.peer_ip = a.ip GROUP BY a.round""")
def q_block_overlap_orders(spark, sf):
    found = G.block_overlap(order_schedule(spark, sf), materialise(actions(spark, sf).where("event = 'block'"), "blocks"))
    return found.select(F.col("ev_order").cast("bigint").alias("round"), F.round("covered", 6).alias("covered"), "active", "first")


@query("block_overlap", f"""{REPORT_SQL} SELECT CAST(round AS INT) AS round, round(CAST(covered AS DOUBLE), 6) AS covered, active, first FROM cover""")
def q_block_overlap(spark, sf):
    d = G.block_overlap(attacks(spark), materialise(actions(spark, sf).where("event = 'block'"), "blocks"))
    return d.select(F.col("ev_order").alias("round"), F.round("covered", 6).alias("covered"), "active", "first")


@query("block_status", f"{REPORT_SQL} SELECT CAST(round AS INT) AS round, attacker, status FROM report")
def q_block_status(spark, sf):
    return report(spark, sf).select("round", "attacker", "status")


@query("time_to_block", f"{REPORT_SQL} SELECT CAST(round AS INT) AS round, round(time_to_block_s, 6) AS time_to_block_s FROM report")
def q_time_to_block(spark, sf):
    return report(spark, sf).select("round", F.round("time_to_block_s", 6).alias("time_to_block_s"))


@query("traffic_stopped", f"""{REPORT_SQL} SELECT CAST(round AS INT) AS round, packets_delivered,
  round(blocked_share, 6) AS blocked_share, round(traffic_stopped, 6) AS traffic_stopped, duration_s FROM report""")
def q_traffic_stopped(spark, sf):
    return report(spark, sf).select("round", "packets_delivered", F.round("blocked_share", 6).alias("blocked_share"),
                                    F.round("traffic_stopped", 6).alias("traffic_stopped"), "duration_s")


@query("false_blocks", f"""{DECIDED} SELECT session, peer_ip, ts, seconds FROM actions
WHERE event = 'block' AND peer_ip NOT IN {ATTACKERS_SQL}""")
def q_false_blocks(spark, sf):
    return G.false_blocks(actions(spark, sf).where("event = 'block'"), attacker_hosts(spark)).select(
        "session", "peer_ip", "ts", "seconds")


CLIENTS_SQL = "(" + ", ".join(f"'{c}'" for c in CLIENTS) + ")"


@query("benign_flagged", f"""{WIN}, {SCORED_SQL}
SELECT round(avg(CASE WHEN flagged THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS benign_flagged FROM scored WHERE peer_ip IN {CLIENTS_SQL}""")
def q_benign_flagged(spark, sf):
    return G.benign_flagged(scored_windows(spark, sf), client_hosts(spark)).select(
        F.round("benign_flagged", 9).alias("benign_flagged"))


@query("mitigation_summary", f"""{REPORT_SQL}, {LOG_SQL}
SELECT 's1' AS session, CAST(count(*) AS BIGINT) AS attacks,
  round(100 * avg(CASE WHEN status <> 'missed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS blocked_while_attacking,
  CAST(count(*) FILTER (status = 'missed') AS BIGINT) AS missed, round(median(time_to_block_s), 6) AS median_time_to_block_s,
  round(max(time_to_block_s), 6) AS max_time_to_block_s, round(avg(traffic_stopped), 6) AS mean_traffic_stopped,
  CAST((SELECT count(DISTINCT peer_ip) FROM blocks WHERE peer_ip NOT IN {ATTACKERS_SQL}) AS BIGINT) AS benign_clients_blocked,
  CAST((SELECT count(*) FROM blocks WHERE peer_ip NOT IN {ATTACKERS_SQL}) AS BIGINT) AS false_blocks,
  round((SELECT 100 * avg(CASE WHEN flagged THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM scored WHERE peer_ip IN {CLIENTS_SQL}), 6) AS benign_windows_flagged,
  CAST((SELECT count(*) FROM log WHERE event = 'error') AS BIGINT) AS detector_errors, CAST(0 AS BIGINT) AS socket_kernel_drops
FROM report""")
def q_mitigation_summary(spark, sf):
    scored = stored_scores(spark, sf)
    log = detector_log(spark, sf, scored).withColumn("kernel_drops", F.lit(0).cast("bigint"))
    acts = log.where("event = 'block'").withColumn("session", F.lit("s1")).withColumnRenamed("peer", "peer_ip")
    out = G.mitigation_summary(report(spark, sf, acts), acts, attacker_hosts(spark), scored, client_hosts(spark), log, "s1")
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in out.columns])


@query("ttb_pivot", f"""{REPORT_SQL}
SELECT attack, round(median(time_to_block_s) FILTER (rate = 'high'), 6) AS high,
  round(median(time_to_block_s) FILTER (rate = 'low'), 6) AS low FROM report GROUP BY attack""")
def q_ttb_pivot(spark, sf):
    return G.time_to_block_pivot(report(spark, sf), ["high", "low"]).select(
        "attack", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))


__all__ = ["ATTACKERS", "LAB", "labelled", "labelled_sql", "rounded_sql"]
