"""Broadcast only what is proven small."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table of at most this many rows may be sent to every executor
BROADCAST_ROWS = 50_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` holds at most `max_rows` rows; reads no more than max_rows + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the rows; larger tables keep the shuffle join."""
    return F.broadcast(df) if fits(df, max_rows) else df


def held(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluate a small fitted table once and keep it as literal rows; a large one is left alone.

    Used for parameters (means, quotas, counts per label) so that later stages neither
    recompute them nor shuffle the fact table to meet them.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
