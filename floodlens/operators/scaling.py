"""Standardisation with the population deviation; constant columns are divided by one (M5).

A column whose deviation is no more than the rounding errors of its values counts as constant.
"""
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deviations up to this share of the largest value are rounding: a few units in the last place.
ROUNDING = 8 * sys.float_info.epsilon


@dataclass(frozen=True)
class Scaler:
    features: list[str]
    mean: list[float]
    std: list[float]

    def columns(self, prepare=lambda c: c) -> list[Column]:
        return [((prepare(F.col(f).cast("double")) - F.lit(m)) / F.lit(s)).alias(f)
                for f, m, s in zip(self.features, self.mean, self.std)]

    def vector(self, prepare=lambda c: c) -> Column:
        return F.array(*[((prepare(F.col(f).cast("double")) - F.lit(m)) / F.lit(s))
                         for f, m, s in zip(self.features, self.mean, self.std)])


def fit_scaler(df: DataFrame, features: list[str], prepare=lambda c: c) -> Scaler:
    """Means and deviations in one aggregation; only these numbers reach the driver."""
    parts = []
    for f in features:
        x = prepare(F.col(f).cast("double"))
        parts += [F.avg(x).alias(f"m_{f}"), F.stddev_pop(x).alias(f"s_{f}"), F.max(F.abs(x)).alias(f"t_{f}")]
    row = df.agg(*parts).first()
    mean = [float(row[f"m_{f}"] or 0.0) for f in features]
    std = [float(row[f"s_{f}"] or 0.0) for f in features]
    noise = [ROUNDING * float(row[f"t_{f}"] or 0.0) for f in features]
    return Scaler(list(features), mean, [s if s > least else 1.0 for s, least in zip(std, noise)])


def standardise(df: DataFrame, scaler: Scaler) -> DataFrame:
    kept = [c for c in df.columns if c not in scaler.features]
    return df.select(*kept, *scaler.columns())
