"""Set operations over tables with the same columns."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sessions(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def key_except(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose key does not occur in `right`."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of distinct values; one pass, pre-aggregated per value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
                                for c in columns])).alias("p")
    return (df.select(pairs).groupBy("p.name", "p.value").agg(F.lit(1).alias("one"))
            .groupBy("name").agg(F.count("value").alias("distinct_values")))
