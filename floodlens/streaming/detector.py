"""Live scoring, calibration and retraining per micro-batch.

Everything a batch writes goes to its own folder, so a batch that is run again after a lost
executor or driver overwrites its own rows. What changes between batches (model version,
novelty model, times) is small and is rebuilt from the written tables by `resume`.
"""
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.functions.decisions import above, hybrid_flag, scorable
from floodlens.operators.adaptive import CONSECUTIVE, MIN_CALIBRATION, POOL, pseudo_label, recent_pool, retrain_set
from floodlens.operators.novelty import novelty_fit
from floodlens.schemas import WINDOW_SECONDS
from floodlens.streaming.jobs import batch_path, read_batches

KEY = ["session", "window_start", "peer_ip"]
# Attempts of a micro-batch that may fail before the rest of its failing pieces is given up as error rows
MAX_FAILURES = 64


def split_scorable(windows: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows a model can score, error rows): a window without usable features is never "normal"."""
    ok = scorable(features)
    errors = windows.where(~ok).select(
        *KEY, F.lit("error").alias("event"), F.lit("scoring failed: missing or invalid feature").alias("error"))
    return windows.where(ok), errors


class LiveDetector:
    """`score(rows)` adds `score`; `fit(rows with features and y)` returns such a function.

    Windows need session, window_start, peer_ip, now and the features. In hybrid mode the first
    `calibrate_s` seconds of windows the model calls benign define normal traffic; a novelty
    model fitted on them then also flags windows. With `adaptive` the model is refitted on its
    base rows and pseudo-labelled ones. Calibration and refits take effect at the next batch.
    """

    def __init__(self, spark: SparkSession, folder: str, features: list[str], score, fit=None, base: DataFrame | None = None,
                 threshold: float = 0.5, hybrid: bool = False, calibrate_s: float = 300.0, adaptive: bool = False,
                 retrain_s: float = 120.0, window_s: float = WINDOW_SECONDS, pool: int = POOL):
        if adaptive and (base is None or fit is None):
            raise ValueError("an adaptive detector needs its training rows and a fit function")
        self.spark, self.folder, self.features = spark, folder, list(features)
        self.score_rows, self.fit, self.base = score, fit, base
        self.threshold, self.hybrid, self.adaptive = threshold, hybrid, adaptive and hybrid
        self.calibrate_s, self.retrain_s, self.window_s, self.pool = calibrate_s, retrain_s, window_s, pool
        self.novelty, self.version, self.first, self.next_retrain, self.pool_batch = None, 0, None, None, None

    def table(self, name: str) -> DataFrame:
        return read_batches(self.spark, f"{self.folder}/{name}")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(batch_path(f"{self.folder}/{name}", batch))

    def _log(self, batch: int, name: str, **event) -> None:
        schema = "event string, ts double, windows bigint, threshold double, version int, rows bigint, pseudo_attack bigint"
        row = tuple(event.get(c) for c in ("event", "ts", "windows", "threshold", "version", "rows", "pseudo_attack"))
        self._write(self.spark.createDataFrame([row], schema), name, batch)

    def process(self, windows: DataFrame, batch: int) -> None:
        windows = windows.persist()      # read by the error rows, the scores and the check below
        try:
            if not windows.isEmpty():
                self._process(windows, batch)
        finally:
            windows.unpersist()

    def _process(self, windows: DataFrame, batch: int) -> None:
        good, errors = split_scorable(windows, self.features)
        errors = self._score_all(good, errors, batch)
        self._write(errors, "errors", batch)
        began, now = self.spark.read.parquet(batch_path(f"{self.folder}/scored", batch)).agg(F.min("now"), F.max("now")).first()
        if now is None:
            return
        self.first = began if self.first is None else self.first
        observing = self.novelty is not None
        self._calibrate(batch, now)
        if self.adaptive and observing:
            self._observe(batch)
            self._retrain(batch, now)

    def _scored(self, rows: DataFrame) -> DataFrame:
        scored = self.score_rows(rows).withColumn("sup", above(F.col("score"), self.threshold))
        scored = (self.novelty.flag(scored) if self.novelty is not None
                  else scored.withColumn("novel", F.lit(False)))
        scored = (scored.withColumn("flagged", hybrid_flag(F.col("sup"), F.col("novel"), self.hybrid))
                  .withColumn("model_version", F.lit(self.version)).withColumn("observed", F.lit(self.novelty is not None)))
        return scored.select(*KEY, "now", *self.features, "score", "sup", "novel", "flagged", "model_version", "observed")

    def _score_all(self, good: DataFrame, errors: DataFrame, batch: int) -> DataFrame:
        """Write the scores of `good`; returns `errors` with the rows that the scorer fails on.

        A batch that fails is halved by a hash of its keys until the failing rows stand alone, so one bad row
        costs one error row and a handful of short jobs. A scorer that fails everywhere is not asked about every
        row: after MAX_FAILURES attempts the pieces that are left become error rows as they are.
        """
        try:
            self._write(self._scored(good), "scored", batch)
            return errors
        except Exception:
            place, failures, open_, done, failed = F.xxhash64(*KEY), 1, [(1, 0), (1, 1)], [], {}
        while open_:
            bits, value = open_.pop()
            piece = good.where(F.pmod(place, F.lit(1 << bits)) == value)
            try:
                path = f"{self.folder}/pieces/batch={batch}/{bits}-{value}"
                self._scored(piece).write.mode("overwrite").parquet(path)
                done.append(path)
            except Exception as e:
                failures += 1
                if failures >= MAX_FAILURES or bits >= 40 or piece.limit(2).count() < 2:
                    failed[bits, value] = e
                else:
                    open_ += [(bits + 1, value), (bits + 1, value + (1 << bits))]
        whole = self.spark.read.parquet(*done) if done else self._nothing_scored(good)
        self._write(whole, "scored", batch)
        for (bits, value), e in failed.items():
            errors = errors.unionByName(good.where(F.pmod(place, F.lit(1 << bits)) == value).select(
                *KEY, F.lit("error").alias("event"), F.lit(f"scoring failed: {type(e).__name__}").alias("error")))
        return errors

    def _nothing_scored(self, good: DataFrame) -> DataFrame:
        no = F.lit(False)
        return good.limit(0).select(*KEY, "now", *self.features, F.lit(0.0).alias("score"), no.alias("sup"), no.alias("novel"),
                                    no.alias("flagged"), F.lit(self.version).alias("model_version"), no.alias("observed"))

    def scores(self) -> DataFrame:
        """The table a scores sink holds."""
        return self.table("scored").select(
            "session", "window_start", "peer_ip", F.col("n_in").cast("bigint").alias("n_in"), "score",
            F.col("novel").cast("int").alias("novel"), F.col("flagged").cast("int").alias("flagged"), "model_version")

    def _calibrate(self, batch: int, now: float) -> None:
        if not self.hybrid or self.novelty is not None:
            return
        if now < self.first + self.calibrate_s:
            return
        benign = self.table("scored").where(~F.col("sup"))
        n = benign.count()
        if n >= MIN_CALIBRATION:
            self.novelty = novelty_fit(benign, self.features, KEY)
            self.next_retrain = now + self.retrain_s
            self._log(batch, "calibrated", event="calibrated", ts=now, windows=n, threshold=self.novelty.threshold)

    def _observe(self, batch: int) -> None:
        """Pseudo-label this batch (looking back only as far as a streak can reach) and keep the
        latest examples: the pool of a batch is the previous pool and its own examples, capped."""
        scored = self.table("scored").where("observed")
        low = scored.where(F.col("batch") == batch).agg(F.min("window_start")).first()[0]
        if low is None:
            return
        reach = scored.where((F.col("window_start") >= low - (CONSECUTIVE - 1) * self.window_s) & (F.col("batch") <= batch))
        fresh = pseudo_label(reach, "novel", window_s=self.window_s).where((F.col("batch") == batch) & F.col("kind").isNotNull())
        examples = fresh.select(*KEY, *self.features, "kind")
        if self.pool_batch is not None:
            examples = self.spark.read.parquet(batch_path(f"{self.folder}/pool", self.pool_batch)).unionByName(examples)
        self._write(recent_pool(examples, self.pool), "pool", batch)
        self.pool_batch = batch

    def _retrain(self, batch: int, now: float) -> None:
        if now < self.next_retrain:
            return
        self.next_retrain = now + self.retrain_s
        pool = self.spark.read.parquet(batch_path(f"{self.folder}/pool", batch))
        counts = {r["kind"]: r["n"] for r in pool.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        if not counts.get("benign"):
            return
        rows = retrain_set(self.base, pool, self.features)
        self.score_rows, self.version = self.fit(rows), self.version + 1
        self._log(batch, "retrained", event="retrained", ts=now, version=self.version,
                  rows=rows.count(), pseudo_attack=counts.get("attack", 0))

    def resume(self) -> "LiveDetector":
        """Rebuild what a restarted driver has lost from the written tables: calibration start,
        novelty model, pool and the current model version."""
        scored = self._existing("scored")
        if scored is None:
            return self
        self.first = scored.groupBy("batch").agg(F.min("now").alias("now"), F.min("batch").alias("b")).orderBy("b").first()["now"]
        calibrated, retrained, pool = (self._existing(n) for n in ("calibrated", "retrained", "pool"))
        if calibrated is not None:
            done = calibrated.orderBy("batch").first()
            self.novelty = novelty_fit(scored.where((F.col("batch") <= done["batch"]) & ~F.col("sup")), self.features, KEY)
            self.next_retrain = done["ts"] + self.retrain_s
        if pool is not None:
            self.pool_batch = pool.agg(F.max("batch")).first()[0]
        if retrained is not None:
            last = retrained.orderBy(F.desc("version")).first()
            rows = self.spark.read.parquet(batch_path(f"{self.folder}/pool", last["batch"]))
            self.score_rows, self.version = self.fit(retrain_set(self.base, rows, self.features)), last["version"]
            self.next_retrain = last["ts"] + self.retrain_s
        return self

    def _existing(self, name: str):
        try:
            return self.table(name)
        except AnalysisException:
            return None
