"""Structured Streaming over the feed: windowed counts with late data, and latest state per key."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.session import is_folder, path_exists


def read_feed(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the parquet files of a folder, or of one file."""
    schema = spark.read.parquet(path).schema
    folder, pattern = (path, "*.parquet") if is_folder(spark, path) else posixpath.split(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Rows of each tumbling window; rows later than `late` behind the newest are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Runs the stream over what is there, batch by batch, and stops."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_folder(stream: DataFrame, folder: str) -> DataFrame:
    """As run_once, of a stream that aggregates: its complete result, written by the executors.

    Each batch writes the result so far to a folder of its own, so that a repeated batch does no
    harm; the last one is read.
    """
    done: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/result/{batch}")
        done.append(batch)

    run_once(stream, write, f"{folder}/progress", "complete")
    spark = stream.sparkSession
    return spark.read.parquet(f"{folder}/result/{max(done)}") if done else spark.createDataFrame([], stream.schema)


def merge_latest(spark: SparkSession, state: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the last row (by order) of each key in a parquet folder.

    State is written to a folder of its own per batch, so a batch that is repeated after a failure
    gives the same result.
    """
    def previous(batch: int) -> DataFrame | None:
        for b in range(batch - 1, -1, -1):
            if path_exists(spark, f"{state}/{b}/_SUCCESS"):
                return spark.read.parquet(f"{state}/{b}")
        return None

    def merge(df: DataFrame, batch: int) -> None:
        old = previous(batch)
        rows = df if old is None else old.unionByName(df)
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{state}/{batch}")

    return merge
