"""Keying packets: direction, peer, time slot, arrival order."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from floodlens.functions.columns import is_inbound, is_outbound, slot_of
from floodlens.operators.ordering import ARRIVAL_BITS, arrival_chunk
from floodlens.schemas import WINDOW_SECONDS


def direction(packets: DataFrame, protected: list[str]) -> DataFrame:
    """Keep traffic between protected hosts and others; add `inbound`, `peer` and `server`."""
    inbound = is_inbound(protected)
    return packets.where(inbound | is_outbound(protected)).withColumns({
        "inbound": inbound,
        "peer": F.when(inbound, F.col("src")).otherwise(F.col("dst")),
        "server": F.when(inbound, F.col("dst")).otherwise(F.col("src"))})


def with_slot(packets: DataFrame, window_s: float = WINDOW_SECONDS) -> DataFrame:
    return packets.withColumn("slot", slot_of(F.col("ts_us"), window_s))


def mark_late(packets: DataFrame, window_s: float = WINDOW_SECONDS, bits: int = ARRIVAL_BITS,
              opened: DataFrame | None = None) -> DataFrame:
    """Add `late`: a slot after this packet's own was already open when it arrived. Rows stay dealt by
    (session, chunk of the arrival order), with the chunk in `chunk`.

    Every packet of the session advances the slot, also those of no protected host. `opened` (session,
    slot) holds the slots that were open before the first of these packets.
    """
    rows = with_slot(packets, window_s).withColumn("chunk", arrival_chunk(F.col("seq"), bits))
    before = W.partitionBy("session").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy("session", "chunk").agg(F.max("slot").alias("_top"))
    carry = tops.select("session", "chunk", F.max("_top").over(before).alias("_carry"))
    if opened is not None:
        carry = carry.join(opened.select("session", F.col("slot").alias("_opened")), "session", "left").select(
            "session", "chunk", F.greatest("_carry", "_opened").alias("_carry"))
    inside = W.partitionBy("session", "chunk").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.join(carry, ["session", "chunk"]).withColumn("_open", F.max("slot").over(inside))
    return seen.withColumn("late", F.col("slot") < F.greatest("_open", "_carry")).drop("_open", "_carry", "slot")


def late_flag(packets: DataFrame, window_s: float = WINDOW_SECONDS, bits: int = ARRIVAL_BITS) -> DataFrame:
    return mark_late(packets, window_s, bits).drop("chunk")


def drop_late(packets: DataFrame, window_s: float = WINDOW_SECONDS,
              bits: int = ARRIVAL_BITS) -> DataFrame:
    return late_flag(packets, window_s, bits).where(~F.col("late")).drop("late")


def late_counts(packets: DataFrame, window_s: float = WINDOW_SECONDS, bits: int = ARRIVAL_BITS) -> DataFrame:
    """(session, packets, late): how many packets of each session came after their slot had closed."""
    return late_flag(packets, window_s, bits).groupBy("session").agg(
        F.count("*").alias("packets"), F.count_if("late").alias("late"))
