"""Pseudo-labels, pools and retraining sets (N4-N8, N10) and the adaptive replay."""
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from floodlens.schemas import WINDOW_SECONDS

# Fixed values of the adaptive detector
CONSECUTIVE = 2
POOL = 10_000
CALIBRATION_S = 1800.0
STEP_S = 60.0
RETRAIN_S = 600.0
BLOCK_S = 600.0

ORDER = ("window_start", "session", "peer_ip")
REFITS_AT_ONCE = 4   # a refit is many short jobs that leave cores idle
SLOT_BITS = 12   # a time chunk of 4096 windows per peer


def slot_index(window_s: float) -> Column:
    return F.round(F.col("window_start") / window_s).cast("bigint")


def streak_at_least(windows: DataFrame, flag: str, n: int, out: str, window_s: float = WINDOW_SECONDS,
                    bits: int = SLOT_BITS) -> DataFrame:
    """Add `out`: this window and the n - 1 adjacent ones before it of the same peer are flagged.

    A window can only look back n - 1 slots, so each peer's time is cut into chunks and the
    last slots of a chunk are also given to the next: one shuffle, no group longer than a chunk.
    """
    if n <= 1:
        return windows.withColumn(out, F.col(flag))
    slot, chunk = F.col("_slot"), F.shiftright("_slot", bits)
    near_end = F.shiftright(slot + (n - 1), bits) > chunk
    copies = F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = (windows.withColumn("_slot", slot_index(window_s))
              .withColumn("_chunk", F.explode(copies)))
    order = W.partitionBy("session", "peer_ip", "_chunk").orderBy("_slot")
    run = F.col(flag)
    for j in range(1, n):
        run = run & F.coalesce(F.lag(flag, j).over(order) & (F.lag("_slot", j).over(order) == slot - j), F.lit(False))
    return (spread.withColumn(out, run)
            .where(F.col("_chunk") == F.shiftright("_slot", bits)).drop("_slot", "_chunk"))


def in_streak(windows: DataFrame, flag: str, out: str = "in_streak", window_s: float = WINDOW_SECONDS) -> DataFrame:
    """Flagged, and the peer's previous window is flagged and at most one window earlier."""
    return streak_at_least(windows, flag, 2, out, window_s)


def pseudo_label(windows: DataFrame, flag: str = "novel", consecutive: int = CONSECUTIVE,
                 window_s: float = WINDOW_SECONDS) -> DataFrame:
    """Add `kind`: benign example, attack example, or null (flagged but not yet in a streak)."""
    marked = streak_at_least(windows, flag, consecutive, "_streak", window_s)
    return marked.withColumn("kind", F.when(~F.col(flag), "benign").when(F.col("_streak"), "attack")).drop("_streak")


def latest(labelled: DataFrame, kind: str, pool: int = POOL, order: list[str] = ORDER) -> DataFrame:
    """The latest `pool` examples of a kind."""
    return labelled.where(F.col("kind") == kind).orderBy(*[F.col(c).desc() for c in order]).limit(pool)


def recent_pool(labelled: DataFrame, pool: int = POOL, order: list[str] = ORDER) -> DataFrame:
    """The latest `pool` examples of each kind."""
    return latest(labelled, "benign", pool, order).unionByName(latest(labelled, "attack", pool, order))


def pool_start(counts: dict[tuple[int, str], int], kind: str, before: int, pool: int = POOL) -> int:
    """The version from which on the examples of a kind up to version `before` fill the pool, or 0.

    Versions follow the time, so no older example is in the pool. `counts` holds examples per version and kind.
    """
    found = 0
    for v in range(before - 1, -1, -1):
        found += counts.get((v, kind), 0)
        if found >= pool:
            return v
    return 0


def retrain_set(base: DataFrame, pool: DataFrame, features: list[str]) -> DataFrame:
    """Base rows with pseudo-labelled ones: features and y (0 benign, 1 attack)."""
    pseudo = pool.select(*[F.col(f).cast("double").alias(f) for f in features],
                         (F.col("kind") == "attack").cast("int").alias("y"))
    return base.select(*[F.col(f).cast("double").alias(f) for f in features], F.col("y").cast("int").alias("y")).unionByName(pseudo)


def calibration_split(windows: DataFrame, seconds: float = CALIBRATION_S) -> tuple[DataFrame, DataFrame, float]:
    """(calibration rows, stream rows, stream start): the first `seconds` from the first window."""
    start = (windows.agg(F.min("window_start")).first()[0] or 0.0) + seconds
    return windows.where(F.col("window_start") < start), windows.where(F.col("window_start") >= start), start


def step_batches(stream: DataFrame, start: float, step_s: float = STEP_S, retrain_s: float = RETRAIN_S) -> DataFrame:
    """Add `step` and `version`, the number of retrain times at or before the step's start."""
    if retrain_s < step_s:
        raise ValueError("at most one refit per step: retrain_s must be at least step_s")
    step = F.floor((F.col("window_start") - start) / step_s)
    return stream.withColumn("step", step.cast("int")).withColumn(
        "version", F.floor(F.col("step") * step_s / retrain_s).cast("int"))


def adaptive_replay(windows: DataFrame, base: DataFrame, novelty, fit, features: list[str],
                    calibration_s: float = CALIBRATION_S, step_s: float = STEP_S, retrain_s: float = RETRAIN_S,
                    block_s: float = BLOCK_S, pool: int = POOL, window_s: float = WINDOW_SECONDS) -> DataFrame:
    """Static and adaptive decisions for every streamed window.

    `fit(rows with features and y)` returns a function adding `p` (0/1) to windows. Novelty is
    fitted once, so flags and pseudo-labels of the whole stream are one job; then each model
    version is one refit on what was seen before it and one scoring job over its slice. No version
    needs another's model, so some are refitted at once; the stream is written in the order of time,
    and a version reads only the stretches that hold its pool and its slice.
    """
    from floodlens.session import materialise, shared_dir
    _, stream, start = calibration_split(windows, calibration_s)
    flagged = pseudo_label(novelty.flag(stream), "novel", window_s=window_s)
    stream = materialise(step_batches(flagged, start, step_s, retrain_s).repartitionByRange(*ORDER), "replay")
    counts = {(r["version"], r["kind"]): r["n"]       # at most three rows per version
              for r in stream.groupBy("version", "kind").agg(F.count("*").alias("n")).collect()}
    first_benign = min((v for v, kind in counts if kind == "benign"), default=None)
    static = fit(retrain_set(base, stream.limit(0), features))
    scored = static(stream).withColumnRenamed("p", "static_sup")
    path = shared_dir(stream.sparkSession, "replay-versions")

    def examples(v, kind):
        return latest(stream.where(F.col("version").between(pool_start(counts, kind, v, pool), v - 1)), kind, pool)

    def replay_version(v):
        current = static
        if first_benign is not None and first_benign < v:
            seen = materialise(examples(v, "benign").unionByName(examples(v, "attack")), "pool")
            current = fit(retrain_set(base, seen, features))
        decided = current(scored.where(F.col("version") == v)).withColumnRenamed("p", "adaptive_sup")
        decided.drop("version").write.parquet(f"{path}/version={v}")

    with ThreadPoolExecutor(REFITS_AT_ONCE) as workers:
        list(workers.map(inheritable_thread_target(stream.sparkSession)(replay_version), sorted({v for v, _ in counts})))
    out = stream.sparkSession.read.parquet(path) if counts else scored.withColumn("adaptive_sup", F.col("static_sup"))
    for kind in ("static", "adaptive"):
        out = (out.withColumn(f"{kind}_sup", F.col(f"{kind}_sup") == 1)
               .withColumn(kind, F.col(f"{kind}_sup") | F.col("novel")))
    return out.withColumn("block", F.floor((F.col("window_start") - start) / block_s).cast("int"))


# Fixed value: benign windows needed before the novelty detector is fitted
MIN_CALIBRATION = 30


def calibration_rows(scored: DataFrame, seconds: float, threshold: float = 0.5,
                     least: int = MIN_CALIBRATION) -> DataFrame:
    """Rows the live calibration learns from: benign by the model, up to and with the batch that
    closes it, the first at least `seconds` after the first scored one with enough rows.

    `scored` holds now (the decision time of the batch) and score. Empty when it never closes.
    """
    first = scored.agg(F.min("now")).first()[0]
    benign = scored.where(F.col("score") < threshold)
    enough = benign.select("now").orderBy("now").limit(least).agg(F.max("now").alias("t"), F.count("*").alias("n")).first()
    if first is None or enough["n"] < least:
        return benign.limit(0)
    ready = max(first + seconds, enough["t"])
    closing = scored.where(F.col("now") >= ready).agg(F.min("now")).first()[0]
    return benign.where(F.col("now") <= closing) if closing is not None else benign.limit(0)
