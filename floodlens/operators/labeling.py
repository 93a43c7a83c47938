"""Labelling joins: range, anti, as-of and overlap."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.operators.ordering import running_max
from floodlens.operators.sizing import BROADCAST_ROWS, fits
from floodlens.schemas import WINDOW_SECONDS

KEY = ["session", "window_start", "peer_ip"]
SCHEDULE_SPAN = 600.0     # seconds per bucket of the range join
ROUND_BITS = 26           # about a minute of microseconds per chunk of the as-of join


def _bucketed_schedule(attacks: DataFrame, window_s: float, grace: float, span: float) -> DataFrame:
    """One row per attack and time bucket in which a window could start and still touch it."""
    low, high = F.col("start_ts") - grace - window_s, F.col("end_ts") + grace
    return attacks.select(
        "session", F.col("ip").alias("peer_ip"), low.alias("low"), high.alias("high"), "ev_order", "label",
        F.col("rate").alias("attack_rate"),
        F.explode(F.sequence(F.floor(low / span), F.floor(high / span))).alias("bucket"))


def label_windows(windows: DataFrame, attacks: DataFrame, window_s: float = WINDOW_SECONDS,
                  grace: float = 1.0, span: float = SCHEDULE_SPAN,
                  max_schedule: int = BROADCAST_ROWS) -> DataFrame:
    """Add `label`, `attack_rate` and `matched`: the last attack of the schedule that the window
    touches, or 0 and "".

    A schedule of checked size is sent to every task and looked up in place, so the windows are
    not shuffled. A larger one is joined by (session, peer, bucket), and only the windows that
    hit an attack are grouped to find the last.
    """
    schedule = _bucketed_schedule(attacks, window_s, grace, span)
    bucketed = windows.withColumn("bucket", F.floor(F.col("window_start") / span))
    touches = (F.col("window_start") > F.col("low")) & (F.col("window_start") < F.col("high"))
    winner = F.struct("ev_order", "label", "attack_rate")
    if fits(schedule, max_schedule):      # counted as it is sent: one row per attack and bucket
        lists = schedule.groupBy("session", "peer_ip", "bucket").agg(
            F.collect_list(F.struct("ev_order", "label", "attack_rate", "low", "high")).alias("events"))
        found = F.filter("events", lambda e: (F.col("window_start") > e["low"]) & (F.col("window_start") < e["high"]))
        hit = bucketed.join(F.broadcast(lists), ["session", "peer_ip", "bucket"], "left").withColumn(
            "hit", F.array_max(F.transform(found, lambda e: F.struct(e["ev_order"], e["label"], e["attack_rate"]))))
        hit = hit.drop("events", "bucket")
    else:
        hits = (bucketed.select(*KEY, "bucket").distinct()
                .join(schedule, ["session", "peer_ip", "bucket"]).where(touches)
                .groupBy(*KEY).agg(F.max(winner).alias("hit")))
        hit = windows.join(hits, KEY, "left")
    return (hit.withColumn("label", F.coalesce(F.col("hit.label"), F.lit(0)))
            .withColumn("attack_rate", F.coalesce(F.col("hit.attack_rate"), F.lit("")))
            .withColumn("matched", F.col("hit").isNotNull()).drop("hit"))


def mark_attackers(windows: DataFrame, attackers: DataFrame) -> DataFrame:
    """Add `is_attacker`; `attackers` holds session and ip."""
    hosts = attackers.select("session", F.col("ip").alias("peer_ip")).distinct().withColumn("is_attacker", F.lit(True))
    hosts = F.broadcast(hosts) if fits(hosts) else hosts
    return windows.join(hosts, ["session", "peer_ip"], "left").withColumn(
        "is_attacker", F.coalesce("is_attacker", F.lit(False)))


def drop_unmatched(labelled: DataFrame, attackers: DataFrame) -> DataFrame:
    """Drop windows an attacker sent outside every attack of the schedule."""
    marked = mark_attackers(labelled, attackers)
    return marked.where(~(F.col("is_attacker") & ~F.col("matched"))).drop("is_attacker", "matched")


def unmatched_count(labelled: DataFrame, attackers: DataFrame) -> DataFrame:
    marked = mark_attackers(labelled, attackers)
    return marked.agg(F.count_if(F.col("is_attacker") & ~F.col("matched")).alias("unmatched_attacker_windows"))


def round_starts(attacks: DataFrame) -> DataFrame:
    return attacks.groupBy("session", "round").agg(F.min("start_ts").alias("first_start"))


def assign_round(windows: DataFrame, attacks: DataFrame, window_s: float = WINDOW_SECONDS,
                 grace: float = 1.0, max_rounds: int = BROADCAST_ROWS) -> DataFrame:
    """Add `round`: the last round that started before the window's reach, else 0.

    Round numbers must rise with their start times within a session.
    """
    rounds = round_starts(attacks)
    reach = F.col("window_start") + window_s + grace
    if fits(rounds, max_rounds):
        lists = rounds.groupBy("session").agg(F.collect_list(F.struct("round", "first_start")).alias("_rounds"))
        begun = F.filter("_rounds", lambda r: r["first_start"] < reach)
        return (windows.join(F.broadcast(lists), "session", "left")
                .withColumn("round", F.coalesce(F.array_max(F.transform(begun, lambda r: r["round"])), F.lit(0)))
                .drop("_rounds"))
    # as-of through one ordered union: twice the microsecond, so a round never precedes an equal reach
    points = rounds.select("session", F.col("round").alias("_round"),
                           (F.round(F.col("first_start") * 1e6).cast("bigint") * 2 + 1).alias("_at"))
    placed = windows.withColumn("_at", F.round(reach * 1e6).cast("bigint") * 2)
    both = placed.unionByName(points, allowMissingColumns=True)
    return (running_max(both, ["session"], "_at", "_round", "_asof", ROUND_BITS)
            .where(F.col("window_start").isNotNull())
            .withColumn("round", F.coalesce("_asof", F.lit(0))).drop("_asof", "_at", "_round"))


def label_session(windows: DataFrame, attacks: DataFrame, attackers: DataFrame,
                  window_s: float = WINDOW_SECONDS, grace: float = 1.0) -> DataFrame:
    """Schedule labels, unmatched attacker windows dropped, rounds assigned."""
    kept = drop_unmatched(label_windows(windows, attacks, window_s, grace), attackers)
    return assign_round(kept, attacks, window_s, grace)


def time_blocks(windows: DataFrame, seconds: float, out: str = "round", start: float | None = None) -> DataFrame:
    """Fixed-length blocks from `start`, by default the first row of the table."""
    if start is None:
        start = windows.agg(F.min("window_start")).first()[0] or 0.0
    return windows.withColumn(out, F.floor((F.col("window_start") - start) / seconds).cast("int"))


def label_catalog(windows: DataFrame, attacks: DataFrame, attackers: DataFrame, name: str,
                  window_s: float = WINDOW_SECONDS, grace: float = 2.0, block_s: float = 600.0):
    """Label a published capture by its catalogue: (labelled rows, attacker windows per attack).

    Counts are taken before the rows of other attacks (label -1) go.
    """
    kept = mark_attackers(label_windows(windows, attacks, window_s, grace), attackers)
    kept = kept.where(~(F.col("is_attacker") & ~F.col("matched")))
    per_attack = (kept.where("is_attacker").groupBy(F.col("attack_rate").alias("attack"))
                  .agg(F.count("*").alias("windows")))
    rows = time_blocks(drop_other_attacks(kept), block_s)
    return (rows.withColumn("attack_rate", F.lit("")).withColumn("session", F.lit(name))
            .drop("matched", "is_attacker"), per_attack)


def drop_other_attacks(windows: DataFrame) -> DataFrame:
    """Drop rows labelled -1: attacks of a kind the task does not cover."""
    return windows.where(F.col("label") >= 0)


def attach_sequences(windows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Give every labelled window its sequence; a window without one is an error, not a gap."""
    joined = windows.join(sequences, KEY, "left")
    missing = F.raise_error(F.concat(F.lit("no sequence for window "), F.col("window_start").cast("string"),
                                     F.lit(" of "), F.col("peer_ip")))
    return joined.withColumn("length", F.when(F.col("length").isNull(), missing.cast("int"))
                             .otherwise(F.col("length")))


def verbatim_overlap(test: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Share of test rows whose whole feature vector also occurs in train.

    Both sides are reduced to distinct vectors with counts first, so copies never meet in the join.
    """
    counted = test.groupBy(*features).agg(F.count("*").alias("_c"))
    known = train.select(*features).distinct().withColumn("_known", F.lit(1))
    return (counted.join(known, features, "left")
            .agg(F.coalesce(F.sum(F.when(F.col("_known") == 1, F.col("_c"))), F.lit(0)).alias("seen"),
                 F.sum("_c").alias("rows"))
            .withColumn("share", F.col("seen").cast("double") / F.col("rows")))


def duplicate_share(rows: DataFrame, columns: list[str]) -> DataFrame:
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_c"))
    return counted.agg(F.sum("_c").alias("rows"), F.count("*").alias("distinct_rows")).withColumn(
        "duplicate_share", 1.0 - F.col("distinct_rows").cast("double") / F.col("rows"))
