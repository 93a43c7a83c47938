"""Running streams to completion on what has arrived, with restartable state."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.session import shared_dir


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived into Parquet at `path`, then stop. State and progress
    stay in `checkpoint`, so the next call goes on where this one ended."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def drain_batches(stream: DataFrame, each, checkpoint: str) -> None:
    """The same with a function called per micro-batch as each(rows, batch number)."""
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def replay(rows: DataFrame, order: str, cuts: list, job, final: DataFrame | None = None) -> DataFrame:
    """Feed a table to a stream in slices of `order` and return what the stream wrote.

    After each slice the job is started again and drained, as a restarted stream would be.
    `job(stream)` builds the query; `final` holds rows appended to the last slice, such as an
    end marker that lets the last windows close.
    """
    spark = rows.sparkSession
    source, out, state = (shared_dir(spark, f"stream-{n}") for n in ("in", "out", "state"))
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = rows
        if low is not None:
            part = part.where(F.col(order) >= low)
        if high is not None:
            part = part.where(F.col(order) < high)
        elif final is not None:
            part = part.unionByName(final)
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        drain(job(stream), out, state)
    return spark.read.parquet(out)


def batch_path(folder: str, batch: int) -> str:
    """Where a micro-batch writes: a retried batch overwrites its own output and nothing else."""
    return f"{folder}/batch={batch}"


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)
