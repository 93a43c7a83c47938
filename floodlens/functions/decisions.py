"""Decision columns: thresholds, hybrid flags, validity of a feature row."""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def above(score: Column, threshold: float = 0.5) -> Column:
    """The threshold itself counts as an attack."""
    return score >= F.lit(threshold)


def hybrid_flag(supervised: Column, novel: Column, hybrid: bool = True) -> Column:
    return (supervised | novel) if hybrid else supervised


def scorable(features: list[str]) -> Column:
    """Every feature is there and is a finite number."""
    def usable(f):
        x = F.col(f).cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return reduce(lambda a, b: a & b, [usable(f) for f in features])
