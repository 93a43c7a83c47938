"""State of the detector as of a moment, from its scores and log."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from floodlens.operators.sizing import broadcast_if_small

# Fixed values of the monitoring view
HISTORY_S = 120.0
EVENT_KINDS = ["start", "calibrated", "retrained", "block", "error"]
FEED_ROWS = 40


def recent(scores: DataFrame, now: float, history_s: float = HISTORY_S) -> DataFrame:
    """Windows that ended within the last `history_s` seconds before `now`."""
    return scores.where((F.col("window_start") >= now - history_s - 1) & (F.col("window_start") <= now - 1))


def recent_series(scores: DataFrame, now: float, history_s: float = HISTORY_S) -> DataFrame:
    """Per source its points in time order. A source has one window per second, so a series is
    bounded by the history."""
    point = F.struct(F.col("window_start").alias("t"), F.col("n_in").alias("n"), "flagged")
    return recent(scores, now, history_s).groupBy("peer_ip").agg(F.array_sort(F.collect_list(point)).alias("series"))


def source_state(scores: DataFrame, now: float, history_s: float = HISTORY_S) -> DataFrame:
    """Latest row per source in the span."""
    row = F.struct("window_start", "n_in", "score", "novel", "flagged", "model_version")
    return (recent(scores, now, history_s).groupBy("peer_ip")
            .agg(F.max_by(row, "window_start").alias("last")).select("peer_ip", "last.*"))


def events_until(log: DataFrame, now: float) -> DataFrame:
    return log.where(F.col("event").isin(EVENT_KINDS) & F.col("ts").isNotNull() & (F.col("ts") <= now))


def block_state(log: DataFrame, now: float) -> DataFrame:
    """Per source its number of blocks and the seconds left of the longest."""
    return (events_until(log, now).where(F.col("event") == "block").groupBy(F.col("peer").alias("peer_ip"))
            .agg(F.max(F.col("ts") + F.coalesce("seconds", F.lit(0.0))).alias("until"), F.count("*").alias("blocks"))
            .withColumn("blocked_for", F.greatest(F.lit(0.0), F.col("until") - now)).drop("until"))


def sources(scores: DataFrame, log: DataFrame, now: float, history_s: float = HISTORY_S) -> DataFrame:
    """Recent sources with their state; blocked ones without traffic are added with n = 0."""
    both = source_state(scores, now, history_s).join(block_state(log, now), "peer_ip", "full")
    seen = F.col("window_start").isNotNull()
    return both.where(seen | (F.col("blocked_for") > 0)).select(
        "peer_ip", "window_start", F.coalesce("n_in", F.lit(0)).alias("n_in"), "score",
        F.coalesce("novel", F.lit(0)).alias("novel"), F.coalesce("flagged", F.lit(0)).alias("flagged"),
        F.coalesce("blocked_for", F.lit(0.0)).alias("blocked_for"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def event_feed(log: DataFrame, now: float, rows: int = FEED_ROWS, order: str = "ts") -> DataFrame:
    """The last events, newest first; a list of unscored windows is not shown."""
    return (events_until(log, now).orderBy(F.col("ts").desc(), F.col(order).desc()).limit(rows).drop("unscored"))


def attack_overlay(attacks: DataFrame, now: float, history_s: float = HISTORY_S) -> DataFrame:
    return attacks.where((F.col("end_ts") >= now - history_s) & (F.col("start_ts") <= now))


def totals(scores: DataFrame, log: DataFrame, now: float, history_s: float = HISTORY_S) -> DataFrame:
    """One row of counters as of `now`."""
    low = now - history_s - 1
    s = scores.where(F.col("window_start") <= now - 1)
    windows = s.agg(F.count("*").alias("windows"))
    recent_sources = s.where(F.col("window_start") >= low).groupBy("peer_ip").agg(F.lit(1).alias("_")).agg(
        F.count("*").alias("sources"))
    e = events_until(log, now)
    events = e.agg(
        F.count_if(F.col("event") == "block").alias("blocks"),
        F.coalesce(F.max_by(F.when(F.col("event") == "retrained", F.col("version")),
                            F.when(F.col("event") == "retrained", F.col("ts"))), F.lit(0)).alias("model_version"),
        F.coalesce(F.max(F.col("event") == "calibrated"), F.lit(False)).alias("calibrated"),
        F.count_if(F.col("event") == "error").alias("errors"))
    active = block_state(log, now).agg(F.count_if(F.col("blocked_for") > 0).alias("active_blocks"))
    out = windows.withColumn("_one", F.lit(1))
    for part in (recent_sources, events, active):   # one row each
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def replay_clock(scores: DataFrame, elapsed: float, speed: float = 1.0) -> float:
    """Replay time: a second before the first window plus what has passed, at most 2 s past the last."""
    row = scores.agg(F.min("window_start").alias("a"), F.max("window_start").alias("z")).first()
    if row["a"] is None:
        return 0.0
    return min(row["a"] - 1 + elapsed * speed, row["z"] + 2)


SETTINGS = ["threshold", "consecutive", "block_seconds", "mode", "calibrate", "adaptive", "retrain_seconds"]


def settings(log: DataFrame) -> DataFrame:
    """The settings of the last start."""
    return (log.where(F.col("event") == "start")
            .agg(F.max_by(F.struct(*SETTINGS), F.coalesce("ts", F.lit(0.0))).alias("s")).select("s.*"))


def packets_per_minute(packets: DataFrame, every_s: float = 60.0) -> DataFrame:
    return packets.groupBy(F.floor(F.col("ts_us") / (every_s * 1e6)).cast("bigint").alias("minute")).agg(
        F.count("*").alias("packets"))


def minute_stats(scored: DataFrame, arrived: DataFrame, blocks: DataFrame, retrained: DataFrame,
                 calibrated_at: float | None = None, every_s: float = 60.0) -> DataFrame:
    """Per minute: packets, windows, flagged; at its end: active blocks, model version, calibrated.

    `scored` holds now and flagged, `arrived` minute and packets, `blocks` peer_ip, ts and seconds,
    `retrained` ts and version.
    """
    minute = F.floor(F.col("now") / every_s).cast("bigint")
    counted = scored.groupBy(minute.alias("minute")).agg(
        F.count("*").alias("windows"), F.count_if(F.col("flagged")).alias("flagged"))
    ends = counted.join(arrived, "minute", "full").withColumn("end", (F.col("minute") + 1) * every_s)
    # a block is active at every minute end it covers: seconds / every_s of them
    first = F.ceil(F.col("ts") / every_s)
    covered = F.explode(F.filter(F.sequence(first, F.ceil((F.col("ts") + F.col("seconds")) / every_s)),
                                 lambda m: (m * every_s >= F.col("ts")) & (m * every_s < F.col("ts") + F.col("seconds"))))
    active = (blocks.where(F.col("seconds") > 0).select("peer_ip", covered.alias("m")).distinct()
              .groupBy((F.col("m") - 1).alias("minute")).agg(F.count("*").alias("blocks_active")))
    versions = retrained.groupBy((F.ceil(F.col("ts") / every_s) - 1).alias("minute")).agg(F.max("version").alias("v"))
    upto = W.orderBy("minute").rowsBetween(W.unboundedPreceding, 0)    # one row per minute
    return (ends.join(broadcast_if_small(active), "minute", "left").join(broadcast_if_small(versions), "minute", "left")
            .select("minute", F.coalesce("packets", F.lit(0)).alias("packets"),
                    F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("flagged", F.lit(0)).alias("flagged"),
                    F.coalesce("blocks_active", F.lit(0)).alias("blocks_active"),
                    F.coalesce(F.max("v").over(upto), F.lit(0)).alias("model_version"),
                    (F.lit(calibrated_at is not None) & (F.col("end") >= (calibrated_at or 0.0))).alias("calibrated")))
