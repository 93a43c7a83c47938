"""Live peer windows and flows (K1, K2, W28): each session has its own clock.

A packet is late if a later slot of its session was open when it arrived, and a window closes when a
later slot opens; no watermark over all sessions takes part, so sessions recorded at different times
can share a stream. A micro-batch is worked on by the batch operators: its packets become window
parts, these merge with the parts of the windows left open, and what is still open is kept. The kept
state is one row per session and the parts of its newest slot. A micro-batch writes all it changes to
folders of its own and starts from the state of the one before, so one that runs again after a lost
executor or driver gives the same.
"""
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from floodlens.functions.columns import slot_start
from floodlens.operators.packets import direction, mark_late, with_slot
from floodlens.operators.peer_windows import PART_BITS, PORT_FEATURES, finished, merge_parts, window_parts
from floodlens.operators.views import flow_features, flow_totals
from floodlens.schemas import FEATURES, FLOW_SECONDS, WINDOW_SECONDS
from floodlens.streaming.jobs import batch_path, read_batches


class View(NamedTuple):
    """How packets become parts and parts become rows; `keys` begin with session and slot."""
    window_s: float
    parts: Callable[[DataFrame], DataFrame]
    rows: Callable[[DataFrame], DataFrame]


def peer_view(window_s: float = WINDOW_SECONDS, features: list[str] = FEATURES) -> View:
    ports = bool(PORT_FEATURES & set(features))
    return View(window_s, lambda keyed: window_parts(keyed, ports),
                lambda parts: finished(merge_parts(parts, ports, {"now": "double"}), window_s, features, ["now"]))


def flow_view(interval_s: float = FLOW_SECONDS) -> View:
    keys = ["session", "slot", "peer", "server", "proto"]

    def rows(parts):
        totals = parts.groupBy(*keys, "now").agg(
            F.sum("n").alias("n"), F.sum("frame_bytes").alias("frame_bytes"), F.max("reverse").alias("reverse"))
        return totals.where(F.col("n") > 0).select(
            "session", slot_start(F.col("slot"), interval_s).alias("window_start"), F.col("peer").alias("peer_ip"),
            F.col("server").alias("dst"), "proto",
            *flow_features(F.col("n"), F.col("frame_bytes"), F.col("reverse"), F.col("proto"), interval_s), "now")
    return View(interval_s, lambda keyed: flow_totals(keyed, keys, whole=False), rows)


class LiveWindows:
    """Windows of a packet stream, closed session by session; call `process` for every micro-batch.

    Tables under `folder`, a folder per batch: `windows` (closed rows with `now`, the time of the packet
    that closed them, in seconds), `late` (session, minute, packets, late), `slots` (session, slot, opened_us,
    first_seq, final_us, final_seq, closed_us) and `parts`; those with a null closed_us are the state.
    """

    def __init__(self, spark: SparkSession, folder: str, protected: list[str], view: View | None = None, bits: int = PART_BITS):
        self.spark, self.folder, self.protected, self.bits = spark, folder, list(protected), bits
        self.view = view or peer_view()
        self.last: int | None = None

    def table(self, name: str) -> DataFrame:
        return read_batches(self.spark, f"{self.folder}/{name}")

    def _write(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = batch_path(f"{self.folder}/{name}", batch)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _before(self, batch: int) -> int | None:
        """The newest batch before this one that left its state; found on disk after a restart."""
        if self.last is None or self.last >= batch:
            try:
                self.last = self.table("slots").where(F.col("batch") < batch).agg(F.max("batch")).first()[0]
            except AnalysisException:
                self.last = None
        return self.last

    def _state(self, name: str, batch: int | None) -> DataFrame | None:
        if batch is None:
            return None
        return self.spark.read.parquet(batch_path(f"{self.folder}/{name}", batch)).where("closed_us is null").drop("closed_us")

    def process(self, packets: DataFrame, batch: int) -> DataFrame:
        """The windows that this micro-batch closes; also those of a batch that is run again."""
        before = self._before(batch)
        opened, kept = self._state("slots", before), self._state("parts", before)
        marked = mark_late(packets, self.view.window_s, self.bits, opened).persist()
        try:
            minute = F.floor(F.col("ts_us") / 60_000_000).cast("bigint").alias("minute")
            self._write(marked.groupBy("session", minute).agg(F.count("*").alias("packets"), F.count_if("late").alias("late")), "late", batch)
            fresh = with_slot(marked.where(~F.col("late")), self.view.window_s)
            slots = fresh.groupBy("session", "slot").agg(
                F.min_by("ts_us", "seq").alias("opened_us"), F.min("seq").alias("first_seq"),
                F.max_by("ts_us", "seq").alias("final_us"), F.max("seq").alias("final_seq"))
            parts = self.view.parts(with_slot(direction(marked.where(~F.col("late")), self.protected), self.view.window_s))
            if before is not None:
                slots = slots.unionByName(opened).groupBy("session", "slot").agg(
                    F.min_by("opened_us", "first_seq").alias("opened_us"), F.min("first_seq").alias("first_seq"),
                    F.max_by("final_us", "final_seq").alias("final_us"), F.max("final_seq").alias("final_seq"))
                parts = parts.unionByName(kept)
            newest = W.partitionBy("session").orderBy("slot")
            slots = self._write(slots.withColumn("closed_us", F.lead("opened_us").over(newest)), "slots", batch)
            parts = self._write(parts.join(slots.select("session", "slot", "closed_us"), ["session", "slot"]), "parts", batch)
            closed = parts.where("closed_us is not null").withColumn("now", F.col("closed_us") / 1e6)
            rows = self._write(self.view.rows(closed), "windows", batch)
        finally:
            marked.unpersist()
        self.last = batch
        return rows

    def flush(self) -> DataFrame | None:
        """Close every open window at its slot's last packet, as batch number last + 1; nothing may follow."""
        last = self._before(1 << 62)
        if last is None:
            return None
        slots, parts = self._state("slots", last), self._state("parts", last)
        closed = parts.join(slots.select("session", "slot", (F.col("final_us") / 1e6).alias("now")), ["session", "slot"])
        return self._write(self.view.rows(closed), "windows", last + 1)

    def late(self) -> DataFrame:
        """(session, packets, late) over all micro-batches."""
        return self.table("late").groupBy("session").agg(F.sum("packets").alias("packets"), F.sum("late").alias("late"))

