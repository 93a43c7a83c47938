"""Queries run as streams; each must give what its batch operator gives."""
from pyspark.sql import functions as F

from floodlens.operators.peer_windows import peer_windows
from floodlens.plans.detector import BLOCK_S, BLOCKS_SQL, DECIDED, SCORED_SQL, STREAK_SQL, WIN, novel_rows, scored_windows
from floodlens.plans.packet_view import DIR_SQL, SERVER, WINDOWS_OUT_SQL, packets, pk_sql, win_sql, windows_out
from floodlens.plans.registry import query
from floodlens.plans.windows import ARRIVAL_BITS_JITTERED, FLOW_SQL, FLOWS_OUT_SQL, JITTER_SQL, flows_out, jittered
from floodlens.schemas import PACKETS
from floodlens.session import materialise, shared_dir
from floodlens.sources.readers import stream_detector_log
from floodlens.streaming import decisions as D
from floodlens.streaming import windows as S
from floodlens.streaming.chain import LiveChain
from floodlens.streaming.detector import LiveDetector
from floodlens.streaming.jobs import drain, drain_batches, replay

ALL_SESSIONS = 2
LIVE = ["n_in", "bytes_in"]


def live_windows(spark, sf, rows, view, cuts=2, bits=S.PART_BITS):
    """The packets as a stream in `cuts` + 1 parts, cut inside windows; a restarted detector takes over for each."""
    rows = materialise(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKETS.fields]), "packets")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    folder, source, state = (shared_dir(spark, f"windows-{n}") for n in ("out", "in", "state"))
    edges = [low + (high - low) * i // (cuts + 1) for i in range(1, cuts + 1)]
    live = None
    for i, (start, end) in enumerate(zip([None, *edges], [*edges, None])):
        part = rows if start is None else rows.where(F.col("seq") >= start)
        (part if end is None else part.where(F.col("seq") < end)).write.mode("append").parquet(source)
        live = S.LiveWindows(spark, folder, [SERVER], view, bits)
        drain_batches(spark.readStream.schema(rows.schema).parquet(source), live.process, state)
    live.flush()
    return live


@query("stream_windows", f"WITH {pk_sql(ALL_SESSIONS)}, {DIR_SQL}, {win_sql()} SELECT {WINDOWS_OUT_SQL} FROM win")
def q_stream_windows(spark, sf):
    return windows_out(live_windows(spark, sf, packets(spark, sf, ALL_SESSIONS), S.peer_view(), cuts=1).table("windows"))


JITTERED = f"""WITH {pk_sql(ALL_SESSIONS)}, {JITTER_SQL},
slotted AS (SELECT *, ts_us // 1000000 < max(ts_us // 1000000) OVER (PARTITION BY session ORDER BY seq) AS late FROM jit)"""


@query("stream_windows_late", f"""{JITTERED}, kept AS (SELECT * FROM slotted WHERE NOT late),
{DIR_SQL.replace('FROM pk', 'FROM kept')}, {win_sql()} SELECT {WINDOWS_OUT_SQL} FROM win""")
def q_stream_windows_late(spark, sf):
    """Disordered arrival in two sessions: each is held against its own open slot, over three micro-batches."""
    rows = jittered(spark, sf, ALL_SESSIONS)
    return windows_out(live_windows(spark, sf, rows, S.peer_view(), bits=ARRIVAL_BITS_JITTERED).table("windows"))


@query("stream_late", f"""{JITTERED}
SELECT session, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (late) AS BIGINT) AS late FROM slotted GROUP BY session""")
def q_stream_late(spark, sf):
    rows = jittered(spark, sf, ALL_SESSIONS)
    return live_windows(spark, sf, rows, S.peer_view(features=["n_in"]), bits=ARRIVAL_BITS_JITTERED).late()


@query("stream_flows", f"WITH {pk_sql(ALL_SESSIONS)}, {DIR_SQL}, {FLOW_SQL} SELECT {FLOWS_OUT_SQL} FROM flow")
def q_stream_flows(spark, sf):
    return flows_out(live_windows(spark, sf, packets(spark, sf, ALL_SESSIONS), S.flow_view(), cuts=1).table("windows"))


CHAIN_SCORED = SCORED_SQL.replace("(w.n_in >= 3 OR uniq_sport_in >= 3) AS flagged", "w.n_in >= 3 AS flagged")
CHAIN = f"WITH RECURSIVE {pk_sql(ALL_SESSIONS)}, {DIR_SQL}, {win_sql()}, {CHAIN_SCORED}, {BLOCKS_SQL}"


def live_chain(spark, sf):
    """Packets of two sessions in three micro-batches, each taken up by a new driver from what the last one wrote."""
    rows = materialise(packets(spark, sf, ALL_SESSIONS).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKETS.fields]), "packets")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    folder, source, state = (shared_dir(spark, f"chain-{n}") for n in ("out", "in", "state"))
    rule = lambda r: r.withColumn("score", F.least(F.col("n_in") / F.lit(5.0), F.lit(1.0)))
    cuts = [low + (high - low) * i // 3 for i in (1, 2)]
    for start, end in zip([low, *cuts], [*cuts, high + 1]):
        rows.where((F.col("seq") >= start) & (F.col("seq") < end)).write.mode("append").parquet(source)
        chain = LiveChain(spark, folder, [SERVER], LIVE, rule, F.col("bytes_in") % 7 != 0, 2, BLOCK_S, ["10.0.0.25"])
        drain_batches(spark.readStream.schema(rows.schema).parquet(source), chain.process, state)
    chain.flush()
    return chain


@query("live_chain", f"{CHAIN} SELECT * FROM actions")
def q_live_chain(spark, sf):
    return live_chain(spark, sf).actions()


@query("live_chain_minutes", f"""{CHAIN},
m AS (SELECT CAST(floor(now / 60) AS BIGINT) AS minute, count(*) AS windows, count(*) FILTER (flagged) AS flagged FROM scored GROUP BY 1),
p AS (SELECT CAST(floor(ts_us / 60e6) AS BIGINT) AS minute, count(*) AS packets FROM pk GROUP BY 1)
SELECT coalesce(m.minute, p.minute) AS minute, CAST(coalesce(packets, 0) AS BIGINT) AS packets,
  CAST(coalesce(windows, 0) AS BIGINT) AS windows, CAST(coalesce(flagged, 0) AS BIGINT) AS flagged,
  CAST((SELECT count(DISTINCT peer_ip) FROM actions WHERE event = 'block' AND ts <= (coalesce(m.minute, p.minute) + 1) * 60
    AND ts + seconds > (coalesce(m.minute, p.minute) + 1) * 60) AS BIGINT) AS blocks_active,
  CAST(0 AS INT) AS model_version, false AS calibrated
FROM m FULL JOIN p ON m.minute = p.minute""")
def q_live_chain_minutes(spark, sf):
    return live_chain(spark, sf).minutes()


def scored_stream_rows(spark, sf):
    return scored_windows(spark, sf).select("session", "peer_ip", "window_start", "now", "flagged", "score", "action_ok")


@query("stream_block_decisions", f"{DECIDED} SELECT * FROM actions")
def q_stream_blocks(spark, sf):
    return replay(scored_stream_rows(spark, sf), "window_start", [120.0, 240.0],
                  lambda s: D.stream_block_decisions(s, 2, BLOCK_S, ["10.0.0.25"]))


@query("stream_pseudo_label", f"{WIN}, {STREAK_SQL} SELECT session, peer_ip, window_start, kind FROM kinds")
def q_stream_pseudo(spark, sf):
    rows = novel_rows(spark, sf).select("session", "peer_ip", "window_start", F.col("novel").alias("flag"))
    return replay(rows, "window_start", [120.0, 240.0], D.stream_pseudo_labels)


@query("stream_minute_stats", f"""{WIN}, {SCORED_SQL}
SELECT CAST(floor(now / 60) AS BIGINT) AS minute, CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (flagged) AS BIGINT) AS flagged
FROM scored GROUP BY 1""")
def q_stream_minute(spark, sf):
    rows = scored_stream_rows(spark, sf)
    end = rows.agg((F.max("now") + 86400.0).alias("now")).select(
        F.lit("end").alias("session"), F.lit("0.0.0.0").alias("peer_ip"), F.lit(0.0).alias("window_start"), "now",
        F.lit(False).alias("flagged"), F.lit(0.0).alias("score"), F.lit(True).alias("action_ok"))
    return replay(rows, "now", [200.0], D.stream_minute_stats, end)


@query("stream_score", f"""{WIN}
SELECT session, window_start, peer_ip, n_in, least(n_in / CAST(5 AS DOUBLE), 1) AS score, CAST(0 AS INT) AS novel,
  CAST(n_in / CAST(5 AS DOUBLE) >= 0.5 AS INT) AS flagged, CAST(0 AS INT) AS model_version FROM win WHERE bytes_in % 11 <> 0""")
def q_stream_score(spark, sf):
    """Every closed window scored; windows with a missing feature go to the error table."""
    detector = live_run(spark, sf)
    return detector.scores()


@query("stream_score_errors", f"""{WIN}
SELECT session, window_start, peer_ip, 'error' AS event FROM win WHERE bytes_in % 11 = 0""")
def q_stream_errors(spark, sf):
    return live_run(spark, sf).table("errors").select("session", "window_start", "peer_ip", "event")


def live_run(spark, sf):
    w = peer_windows(packets(spark, sf), [SERVER], features=LIVE).withColumn("now", F.col("window_start") + 1.0)
    w = w.withColumn("bytes_in", F.when(F.col("bytes_in") % 11 != 0, F.col("bytes_in")))
    source, state, out = (shared_dir(spark, f"live-{n}") for n in ("in", "state", "out"))
    rule = lambda rows: rows.withColumn("score", F.least(F.col("n_in") / F.lit(5.0), F.lit(1.0)))
    detector = LiveDetector(spark, out, LIVE, rule)
    for part in (w.where("window_start < 180"), w.where("window_start >= 180")):
        part.write.mode("append").parquet(source)
        drain_batches(spark.readStream.schema(w.schema).parquet(source), detector.process, state)
    return detector


@query("live_retrain")
def q_live_retrain(spark, sf):
    """Hybrid and adaptive: calibration, novelty, pseudo-labels and refits between batches."""
    from floodlens.operators.models import fit_boosted, score
    w = peer_windows(packets(spark, sf), [SERVER], features=LIVE).withColumn("now", F.col("window_start") + 1.0)
    base = w.where("window_start < 60").select(*LIVE, (F.col("n_in") >= 3).cast("int").alias("y"))

    def fit(rows):
        model = fit_boosted(rows, LIVE, rounds=3, depth=3)
        return lambda r: score(model, r, LIVE, threshold=0.5).drop("p")

    source, state, out = (shared_dir(spark, f"live-{n}") for n in ("in", "state", "out"))
    detector = LiveDetector(spark, out, LIVE, fit(base), fit, base, hybrid=True, calibrate_s=60.0, adaptive=True, retrain_s=60.0)
    for low in range(0, 360, 90):
        w.where(f"window_start >= {low} AND window_start < {low + 90}").write.mode("append").parquet(source)
        drain_batches(spark.readStream.schema(w.schema).parquet(source), detector.process, state)
    return detector.scores().groupBy("model_version").agg(
        F.count("*").alias("windows"), F.sum("flagged").alias("flagged"), F.sum("novel").alias("novel"))


@query("log_tail", """SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'block' END AS event, CAST(count(*) AS BIGINT) AS events,
  CAST(sum(event_id) AS DOUBLE) AS ts_sum FROM events GROUP BY 1""")
def q_log_tail(spark, sf):
    """Rolled log files read as a stream, in two parts; lines that do not parse are dropped."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    kind = F.when(F.col("event_type") == "error", "error").otherwise("block")
    line = F.concat(F.lit('{"event":"'), kind, F.lit('","ts":'), F.col("event_id").cast("string"), F.lit("}"))
    lines = e.select("event_id", F.explode(F.when(F.col("event_id") % 9 == 0, F.array(line, F.lit('{"event":"st')))
                                           .otherwise(F.array(line))).alias("value"))
    source, out, state = (shared_dir(spark, f"log-{n}") for n in ("in", "out", "state"))
    half = e.agg(F.max("event_id")).first()[0] // 2
    for part in (lines.where(F.col("event_id") <= half), lines.where(F.col("event_id") > half)):
        part.select("value").write.mode("append").text(source)
        drain(stream_detector_log(spark, source), out, state)
    log = spark.read.parquet(out)
    return log.groupBy("event").agg(F.count("*").alias("events"), F.sum("ts").alias("ts_sum"))
