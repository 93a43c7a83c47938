"""The live chain (K1, K3, K7, K10): packets to windows to scores to block actions to minute rows, in one stream.

One micro-batch goes through all steps. Its packets close windows (each session by its own clock), `now` of a
window is the time of the packet that closed it and is carried along to the scores and to the decisions; the peers'
runs and blocks are carried from batch to batch. Every step writes a folder for its batch and starts from the state
of the batch before, so a batch that runs again gives the same rows, and a new driver goes on where one ended.
"""
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.operators.mitigation import ACTIONS
from floodlens.operators.monitoring import minute_stats
from floodlens.streaming.decisions import PEERS, carried_decisions
from floodlens.streaming.detector import LiveDetector
from floodlens.streaming.jobs import batch_path, read_batches
from floodlens.streaming.windows import LiveWindows, View, peer_view


class LiveChain:
    """`score`, `features` and the options of LiveDetector; `works` tells from a scored row whether its block succeeds."""

    def __init__(self, spark: SparkSession, folder: str, protected: list[str], features: list[str], score, works: Column | None = None,
                 consecutive: int = 2, seconds: float = 60.0, whitelist: list[str] = (), view: View | None = None,
                 bits: int | None = None, **detector):
        self.spark, self.folder = spark, folder
        self.windows = LiveWindows(spark, f"{folder}/live", protected, view or peer_view(features=features),
                                   **({} if bits is None else {"bits": bits}))
        self.detector = LiveDetector(spark, f"{folder}/scoring", features, score, **detector).resume()
        self.works = F.lit(True) if works is None else works
        self.rule = (consecutive, seconds, [*protected, *whitelist])

    def _table(self, name: str) -> DataFrame:
        return read_batches(self.spark, f"{self.folder}/{name}")

    def _peers(self, batch: int) -> DataFrame:
        """The peers' states after the newest batch before this one that decided anything."""
        try:
            last = self._table("decided").where(F.col("batch") < batch).agg(F.max("batch")).first()[0]
        except AnalysisException:
            last = None
        if last is None:
            return self.spark.createDataFrame([], PEERS)
        return self.spark.read.parquet(batch_path(f"{self.folder}/decided", last)).where("kind = 'state'").select("session", "peer_ip", "streak", "until")

    def process(self, packets: DataFrame, batch: int) -> None:
        self._decide(self.windows.process(packets, batch), batch)

    def flush(self) -> None:
        """The packets have ended: what is open closes, is scored and decided."""
        closed = self.windows.flush()
        if closed is not None:
            self._decide(closed, self.windows.last + 1)

    def _decide(self, closed: DataFrame, batch: int) -> None:
        if closed.isEmpty():
            return
        self.detector.process(closed, batch)
        scored = self.spark.read.parquet(batch_path(f"{self.detector.folder}/scored", batch)).withColumn("action_ok", self.works)
        found = carried_decisions(scored, self._peers(batch), *self.rule)
        found.write.mode("overwrite").parquet(batch_path(f"{self.folder}/decided", batch))

    def actions(self) -> DataFrame:
        return self._table("decided").where("kind = 'action'").select(*ACTIONS.names)

    def minutes(self) -> DataFrame:
        """Per minute: packets, windows, flagged, active blocks, model version, calibrated."""
        arrived = self.windows.table("late").groupBy("minute").agg(F.sum("packets").alias("packets"))
        retrained, calibrated = (self.detector._existing(n) for n in ("retrained", "calibrated"))
        versions = retrained.select("ts", "version") if retrained is not None else self.spark.createDataFrame([], "ts double, version int")
        at = calibrated.agg(F.min("ts")).first()[0] if calibrated is not None else None
        blocks = self.actions().where("event = 'block'").select("peer_ip", "ts", "seconds")
        return minute_stats(self.detector.table("scored"), arrived, blocks, versions, at)
