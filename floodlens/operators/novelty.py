"""Nearest-neighbour novelty: how far a window lies from calibrated normal traffic."""
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.operators.neighbours import mean_distance, nearest
from floodlens.operators.ordering import exact_quantile
from floodlens.operators.scaling import Scaler, fit_scaler
from floodlens.session import materialise

# Fixed values of the detector
NEIGHBOUR_COUNT = 5
QUANTILE = 0.999


def log_size(c):
    return F.log1p(F.abs(c))


def row_name(key):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key])


@dataclass
class Novelty:
    scaler: Scaler
    refs: DataFrame
    k: int
    threshold: float
    options: dict

    def score(self, windows: DataFrame) -> DataFrame:
        """Add `novelty`: mean distance to the k nearest calibration rows."""
        queries = windows.withColumn("vec", self.scaler.vector(log_size))
        found = nearest(queries, self.refs, self.k, **self.options)
        return found.withColumn("novelty", mean_distance()).drop("qid", "vec", "neighbours")

    def flag(self, windows: DataFrame) -> DataFrame:
        """Add `novelty` and `novel` (strictly above the threshold)."""
        return self.score(windows).withColumn("novel", F.col("novelty") > self.threshold)


def calibration_scores(benign: DataFrame, features: list[str], key: list[str], k: int = NEIGHBOUR_COUNT,
                       **options):
    """(scaler, references, k used, table of every row's mean distance to its nearest others)."""
    scaler = fit_scaler(benign, features, log_size)
    rows = benign.withColumn("qid", row_name(key)).withColumn("vec", scaler.vector(log_size))
    refs = rows.select(F.col("qid").alias("rid"), "vec", F.lit(0).alias("label"))
    used = min(k, max(refs.limit(k + 1).count() - 1, 1))
    scored = nearest(rows.select(*key, "qid", "vec"), refs, used, skip_self=True, **options)
    return scaler, refs, used, scored.select(*key, mean_distance().alias("novelty"))


def novelty_fit(benign: DataFrame, features: list[str], key: list[str], k: int = NEIGHBOUR_COUNT,
                quantile: float = QUANTILE, **options) -> Novelty:
    """Fit on rows taken as normal: scaler, reference rows and the score threshold."""
    benign = materialise(benign.select(*key, *features), "calibration")
    scaler, refs, used, scored = calibration_scores(benign, features, key, k, **options)
    threshold = exact_quantile(materialise(scored, "calibration-scores"), "novelty", quantile)
    return Novelty(scaler, refs, used, threshold or 0.0, options)
