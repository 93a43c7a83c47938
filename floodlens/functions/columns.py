"""Column expressions used by several operators. All stay inside Catalyst."""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodlens.schemas import ACK, SYN, TCP


def micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def slot_of(ts_us: Column, window_s: float) -> Column:
    """Index of the time slot holding `ts_us` (floor, also for negative times)."""
    w = micros(window_s)
    return ((ts_us - F.pmod(ts_us, F.lit(w))) / F.lit(w)).cast("bigint")


def slot_start(slot: Column, window_s: float) -> Column:
    return slot.cast("double") * F.lit(float(window_s))


def is_inbound(protected: list[str]) -> Column:
    return F.col("dst").isin(protected) & ~F.col("src").isin(protected)


def is_outbound(protected: list[str]) -> Column:
    return F.col("src").isin(protected) & ~F.col("dst").isin(protected)


def has_flag(bit: int) -> Column:
    """The TCP flag is set; other protocols carry no flags."""
    return (F.col("proto") == TCP) & (F.col("flags").bitwiseAND(bit) != 0)


def syn_only() -> Column:
    return (F.col("proto") == TCP) & (F.col("flags").bitwiseAND(SYN | ACK) == SYN)


def syn_and_ack() -> Column:
    return (F.col("proto") == TCP) & (F.col("flags").bitwiseAND(SYN | ACK) == (SYN | ACK))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is 0."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def spread(total: Column, squares: Column, n: Column) -> Column:
    """Population standard deviation from a sum and a sum of squares, never below zero."""
    total, squares, n = (c.cast("double") for c in (total, squares, n))
    mean = total / n
    return F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))


def order_key(seed: int, *parts: Column) -> Column:
    """A repeatable pseudo-random order: md5 over the seed and the row key."""
    text = [F.lit(str(seed))]
    for part in parts:
        text += [F.lit("|"), part.cast("string")]
    return F.md5(F.concat(*text))


def local_epoch(local: Column, offset_hours: Column) -> Column:
    """Epoch seconds of a local time given with or without seconds, minus its UTC offset."""
    # The two accepted forms of a published time
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
    parsed = F.coalesce(*[F.try_to_timestamp(local, F.lit(f)) for f in forms])
    return F.unix_timestamp(parsed).cast("double") - offset_hours.cast("double") * 3600.0


def name_of(key: Column, names: dict) -> Column:
    """Look a small fixed dictionary up in place, without a join."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.create_map(*pairs)[key]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
