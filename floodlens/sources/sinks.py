"""Writers: labelled tables, sequences, host slices, reports, models."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.operators.labeling import attach_sequences
from floodlens.schemas import FLOW_COLUMNS, SEQUENCE_LENGTH, WINDOW_COLUMNS


def _exists(spark: SparkSession, path: str) -> bool:
    """A finished table is one whose commit marker was written."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def materialise_or_reuse(spark: SparkSession, path: str, tables: dict, refresh: bool = False) -> dict:
    """Write each table (name -> function giving it) under `path` once; later calls read it back.

    The tables are rebuilt together unless every one of them is finished.
    """
    ready = all(_exists(spark, f"{path}/{name}") for name in tables)
    if refresh or not ready:
        for name, build in tables.items():
            build().write.mode("overwrite").partitionBy("session").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}


def write_windows(windows: DataFrame, path: str) -> None:
    windows.select(*WINDOW_COLUMNS).write.mode("overwrite").partitionBy("session").parquet(path)


def write_flows(flows: DataFrame, path: str) -> None:
    flows.select(*FLOW_COLUMNS).write.mode("overwrite").partitionBy("session").parquet(path)


def sequence_quality(sequences: DataFrame, by: list[str] = ()) -> DataFrame:
    """Windows, median length and share of full sequences."""
    full = (F.col("length") == SEQUENCE_LENGTH).cast("double")
    return sequences.groupBy(*by).agg(
        F.count("*").alias("windows"), F.median("length").alias("median_length"),
        F.round(F.avg(full), 9).alias("full_share"))


def write_sequences(windows: DataFrame, sequences: DataFrame, path: str) -> None:
    """The sequence of every labelled window; a window without one fails the write."""
    rows = attach_sequences(windows, sequences)
    rows.select("session", "round", "window_start", "peer_ip", "seq", "length", "label").write.mode(
        "overwrite").partitionBy("session").parquet(path)


def write_report(table: DataFrame, path: str, digits: int = 2) -> None:
    """A result table as one CSV with a header; doubles are rounded here and nowhere before."""
    rounded = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes]
    table.select(*rounded).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path: str, features: list[str], window_s: float, labels: dict,
               sessions: list[str], base: DataFrame | None = None) -> None:
    """A fitted pipeline with what is needed to use it the same way, and its base training rows."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    info = [(features, float(window_s), {str(k): v for k, v in labels.items()}, sessions)]
    schema = "features array<string>, window double, labels map<string,string>, train_sessions array<string>"
    spark.createDataFrame(info, schema).coalesce(1).write.mode("overwrite").json(f"{path}/info")
    if base is not None:
        base.write.mode("overwrite").parquet(f"{path}/base")


def load_model(spark: SparkSession, path: str, features: list[str]):
    """(pipeline, info row, base rows or None); refuses a model fitted on other features."""
    from pyspark.ml import PipelineModel
    schema = "features array<string>, window double, labels map<string,string>, train_sessions array<string>"
    info = spark.read.schema(schema).json(f"{path}/info").first()
    if list(info["features"]) != list(features):
        raise ValueError("the model was fitted on other features than the windows hold")
    base = spark.read.parquet(f"{path}/base") if _exists(spark, f"{path}/base") else None
    return PipelineModel.load(f"{path}/model"), info, base
