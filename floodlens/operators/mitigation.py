"""Block decisions and their evaluation."""
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.operators.adaptive import slot_index
from floodlens.operators.ordering import arrival_number, next_event, running_max, sums_before
from floodlens.operators.sizing import broadcast_if_small
from floodlens.schemas import WINDOW_SECONDS
from floodlens.session import materialise

KEYS = ["session", "peer_ip"]
SLOT_BITS = 12
# Stretches of time that one task sweeps
BUCKET_SECONDS = 4096
BUCKET_US = BUCKET_SECONDS * 1_000_000

ACTIONS = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("peer_ip", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("windows", T.LongType()),
    T.StructField("seconds", T.DoubleType()),
])


def block_candidates(scored: DataFrame, consecutive: int, whitelist: list[str] = (),
                     window_s: float = WINDOW_SECONDS, bits: int = SLOT_BITS) -> DataFrame:
    """Windows that end a run of at least `consecutive` flagged ones of the same peer.

    `pos` numbers the peer's windows, `run` is the length of the flagged run and `since` the
    decision time of the window `consecutive` - 1 places earlier. Gaps between windows do not
    break a run. All of it is prefix work over time chunks and one equi-join.
    """
    rows = (scored.where(~F.col("peer_ip").isin(list(whitelist))) if whitelist else scored)
    rows = rows.select(*KEYS, slot_index(window_s).alias("_slot"), "now", "flagged", "score", "action_ok")
    numbered = arrival_number(rows, KEYS, "_slot", "pos", bits)
    broken = numbered.withColumn("_break", F.when(~F.col("flagged"), F.col("pos")))
    runs = (running_max(broken, KEYS, "_slot", "_break", "_last", bits)
            .withColumn("run", F.col("pos") - F.coalesce("_last", F.lit(-1))))
    ending = runs.where(F.col("flagged") & (F.col("run") >= consecutive)).drop("_break", "_last", "flagged", "_slot")
    if consecutive == 1:
        return ending.withColumn("since", F.col("now"))
    starts = numbered.select(*KEYS, (F.col("pos") + (consecutive - 1)).alias("pos"), F.col("now").alias("since"))
    return ending.join(starts, [*KEYS, "pos"])


def block_decisions(scored: DataFrame, consecutive: int = 2, seconds: float = 60.0, whitelist: list[str] = (),
                    window_s: float = WINDOW_SECONDS, bits: int = SLOT_BITS) -> DataFrame:
    """Block and error actions. `scored`: session, peer_ip, window_start, now, flagged, score, action_ok.

    A peer is blocked at the first candidate whose whole run lies after the end of its previous
    block. That choice feeds back into itself, so the few candidates of a peer are walked in
    order; rows stream through sorted partitions and only one small state per peer is held.
    A failed action is an error and leaves the peer's state as it was.
    """
    candidates = (block_candidates(scored, consecutive, whitelist, window_s, bits)
                  .repartition(*KEYS).sortWithinPartitions(*KEYS, "pos"))

    def walk(batches):
        peer, until, streak_pos, run_id = None, float("-inf"), None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.session, r.peer_ip) != peer:
                    peer, until, streak_pos = (r.session, r.peer_ip), float("-inf"), None
                if r.since < until:
                    continue
                if streak_pos is None or run_id != r.pos - r.run:
                    streak_pos, run_id = r.pos, r.pos - r.run
                windows = consecutive + r.pos - streak_pos
                out.append((r.session, r.peer_ip, "block" if r.action_ok else "error",
                            r.now, r.score, windows, seconds if r.action_ok else None))
                if r.action_ok:
                    until, streak_pos = r.now + seconds, None
            yield pd.DataFrame(out, columns=ACTIONS.names)

    return candidates.mapInPandas(walk, ACTIONS)


def active_blocks(blocks: DataFrame, now: float) -> DataFrame:
    """Peers still blocked at `now`."""
    until = blocks.groupBy("peer_ip").agg(F.max(F.col("ts") + F.col("seconds")).alias("until"))
    return until.agg(F.count_if(F.col("until") > now).alias("active"))


# --- Evaluation against the true schedule ---------------------------------------------------

def attack_seconds(packets: DataFrame, victim: str, attackers: DataFrame) -> DataFrame:
    """Packets per (session, attacker, whole second) that reached the victim."""
    hosts = broadcast_if_small(attackers.select("session", F.col("ip").alias("src")).distinct())
    return (packets.where(F.col("dst") == victim).join(hosts, ["session", "src"], "left_semi")
            .groupBy("session", F.col("src").alias("ip"), F.floor(F.col("ts_us") / 1_000_000).alias("sec"))
            .agg(F.count("*").alias("n")))


def block_overlap(attacks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per attack: seconds covered by blocks (overlaps counted twice), whether one was active at
    its start, and the first one that began during it.

    Blocked time up to t is the sum of t - begin over the blocks begun minus that of t - end over the
    ended ones, so counts and sums at an attack's two ends tell what lies between: no attack meets a block.
    """
    whole = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    mine = blocks.select("session", F.col("peer_ip").alias("ip"), whole("ts").alias("at"),
                         F.round((F.col("ts") + F.col("seconds")) * 1e6).cast("bigint").alias("until"))
    key, one = ["session", "ip"], F.lit(1).cast("bigint")
    begun = mine.select(*key, "at", one.alias("n_begun"), F.col("at").cast("decimal(38,0)").alias("sum_begun"))
    ended = mine.select(*key, F.col("until").alias("at"), one.alias("n_ended"), F.col("until").cast("decimal(38,0)").alias("sum_ended"))
    events = begun.unionByName(ended, allowMissingColumns=True)
    values = ["n_begun", "sum_begun", "n_ended", "sum_ended"]
    ends = attacks.select(*key, "ev_order", F.explode(F.array(
        F.struct(F.lit("start").alias("end"), whole("start_ts").alias("at")),
        F.struct(F.lit("stop").alias("end"), whole("end_ts").alias("at")),
        # up to and with the start: whole numbers smaller than the next
        F.struct(F.lit("upto").alias("end"), (whole("start_ts") + 1).alias("at")))).alias("e")).select(*key, "ev_order", "e.*")
    found = sums_before(ends, events, key, "at", values, BUCKET_US)
    blocked = F.col("at") * (F.col("n_begun") - F.col("n_ended")) - F.col("sum_begun") + F.col("sum_ended")
    at = lambda name, value: F.max(F.when(F.col("end") == name, value))
    cover = found.groupBy("session", "ev_order").agg(
        ((at("stop", blocked) - at("start", blocked)).cast("double") / 1e6).alias("covered"),
        (at("upto", F.col("n_begun") - F.col("n_ended")) > 0).alias("active"))
    starts = attacks.select(*key, "ev_order", whole("start_ts").alias("at"), whole("end_ts").alias("stop"))
    first = next_event(starts, mine.select(*key, "at"), key, "at", "first", BUCKET_US).select(
        "session", "ev_order", F.when(F.col("first") <= F.col("stop"), F.col("first") / 1e6).alias("first"))
    return cover.join(first, ["session", "ev_order"])


def delivered(attacks: DataFrame, seconds: DataFrame) -> DataFrame:
    """Per attack (with `first`, the first block): packets while it ran, and those before the block.

    Both are differences of each host's running packet count at the attack's ends and at the block.
    """
    key, floor = ["session", "ip"], lambda c: F.floor(c).cast("bigint")
    stop = floor("end_ts") + 1
    points = attacks.select(*key, "ev_order", F.explode(F.array(
        F.struct(F.lit("start").alias("end"), floor("start_ts").alias("at")),
        F.struct(F.lit("stop").alias("end"), F.greatest(stop, floor("start_ts")).alias("at")),
        F.struct(F.lit("first").alias("end"), F.greatest(F.least(F.coalesce(floor("first"), floor("start_ts")), stop), floor("start_ts"))
                 .alias("at")))).alias("e")).select(*key, "ev_order", "e.*")
    # the sweep reads its table twice, the packets only once
    counts = materialise(seconds.select(*key, F.col("sec").cast("bigint").alias("at"), F.col("n").cast("bigint").alias("n")), "seconds")
    found = sums_before(points, counts, key, "at", ["n"], BUCKET_SECONDS)
    at = lambda name: F.max(F.when(F.col("end") == name, F.col("n")))
    return found.groupBy("session", "ev_order").agg(
        (at("stop") - at("start")).alias("got"), (at("first") - at("start")).alias("before"))


def attack_report(attacks: DataFrame, blocks: DataFrame, seconds: DataFrame) -> DataFrame:
    """One row per attack: status, time to block, share of time blocked, delivered, traffic stopped."""
    attacks = broadcast_if_small(attacks)
    cover = block_overlap(attacks, blocks)
    with_first = attacks.join(cover, ["session", "ev_order"])
    counts = delivered(with_first, seconds)
    rows = with_first.join(counts, ["session", "ev_order"])
    duration = F.col("end_ts") - F.col("start_ts")
    status = (F.when(F.col("active"), F.lit("already blocked"))
              .when(F.col("first").isNotNull(), F.lit("blocked")).otherwise(F.lit("missed")))
    rate = (F.when(F.col("status") == "blocked",
                   F.col("before") / F.greatest(F.col("first") - F.col("start_ts"), F.lit(1.0)))
            .when(F.col("status") == "missed", F.col("got") / F.greatest(duration, F.lit(1.0))))
    expected = F.when(rate > 0, rate).otherwise(F.col("pps").cast("double")) * duration
    stopped = F.when(F.col("expected") != 0,
                     100.0 * (1.0 - F.least(F.col("got") / F.col("expected"), F.lit(1.0))))
    return (rows.withColumn("status", status).withColumn("expected", expected)
            .select("session", "ev_order", "round", F.col("ip").alias("attacker"), "attack", "rate",
                    duration.alias("duration_s"), "status",
                    F.when(F.col("status") == "blocked", F.col("first") - F.col("start_ts")).alias("time_to_block_s"),
                    (100.0 * F.col("covered") / duration).alias("blocked_share"),
                    F.col("got").cast("bigint").alias("packets_delivered"), stopped.alias("traffic_stopped")))


def false_blocks(blocks: DataFrame, attackers: DataFrame) -> DataFrame:
    hosts = attackers.select("session", F.col("ip").alias("peer_ip")).distinct()
    return blocks.join(broadcast_if_small(hosts), ["session", "peer_ip"], "left_anti")


def benign_flagged(scores: DataFrame, clients: DataFrame) -> DataFrame:
    hosts = clients.select("session", F.col("ip").alias("peer_ip")).distinct()
    return (scores.join(broadcast_if_small(hosts), ["session", "peer_ip"], "left_semi")
            .agg(F.avg(F.col("flagged").cast("double")).alias("benign_flagged")))


def mitigation_summary(report: DataFrame, blocks: DataFrame, attackers: DataFrame, scores: DataFrame,
                       clients: DataFrame, log: DataFrame, session: str) -> DataFrame:
    """One row of twelve fields about one session."""
    attacks = report.agg(
        F.count("*").alias("attacks"),
        (100.0 * F.avg(F.col("status").isin("blocked", "already blocked").cast("double"))).alias("blocked_while_attacking"),
        F.count_if(F.col("status") == "missed").alias("missed"),
        F.median("time_to_block_s").alias("median_time_to_block_s"),
        F.max("time_to_block_s").alias("max_time_to_block_s"),
        F.avg("traffic_stopped").alias("mean_traffic_stopped"))
    wrong = false_blocks(blocks, attackers).agg(
        F.countDistinct("peer_ip").alias("benign_clients_blocked"), F.count("*").alias("false_blocks"))
    benign = benign_flagged(scores, clients).select((100.0 * F.col("benign_flagged")).alias("benign_windows_flagged"))
    errors = log.agg(
        F.count_if(F.col("event") == "error").alias("detector_errors"),
        F.coalesce(F.sum(F.when(F.col("event").isin("stats", "stop"), F.col("kernel_drops"))), F.lit(0))
        .alias("socket_kernel_drops"))
    out = attacks.withColumn("session", F.lit(session))
    for part in (wrong, benign, errors):      # each is exactly one row
        out = out.join(part.withColumn("session", F.lit(session)), "session")
    return out


def time_to_block_pivot(report: DataFrame, rates: list[str]) -> DataFrame:
    return report.groupBy("attack").pivot("rate", rates).agg(F.median("time_to_block_s"))
