"""Whole jobs: a full or an incremental run over a source's records, with a run log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.operators.snapshots import catalogue_changes
from terroir.sources.tables import read_table

#: Source kinds and their readers; a kind that isn't here is an error.
READERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {"table": read_table}


@dataclass
class Run:
    source_id: int
    started: datetime
    state: str = "executing"
    ended: datetime | None = None
    rows: int = 0


def reader(kind: str) -> Callable[[SparkSession, str, str], DataFrame]:
    if kind not in READERS:
        raise ValueError(f"no reader for sources of kind {kind!r}")
    return READERS[kind]


def run(spark: SparkSession, source_id: int, job: Callable[[], DataFrame], path: str, log: str) -> Run:
    """Runs a job, writes its rows to path and its outcome to the log; a failure is logged and raised."""
    out = Run(source_id, datetime.now(UTC))
    try:
        job().withColumn("run_source_id", F.lit(source_id)).write.mode("overwrite").parquet(path)
        out.rows = spark.read.parquet(path).count()
        out.state = "ready"
    except Exception:
        out.state = "error"
        raise
    finally:
        out.ended = datetime.now(UTC)
        spark.createDataFrame([(out.source_id, out.started, out.ended, out.state, out.rows)], "source_id long, start_time timestamp, end_time timestamp, state string, n_rows long").write.mode("append").parquet(log)
    return out


def incremental(spark: SparkSession, folder: str, source_id: int) -> DataFrame:
    """What changed in a source from run to run."""
    one = F.col("source_id") == source_id
    return catalogue_changes(read_table(spark, folder, "update_products").where(one), read_table(spark, folder, "pipeline_sequence").where(one))


def validate(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """check_type, status: each check is a condition that all rows must meet; none on no rows."""
    aggs = [F.coalesce(F.every(F.coalesce(F.expr(c), F.lit(False))), F.lit(False)).alias(n) for n, c in checks.items()]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_type"), F.col(n).alias("status")) for n in checks])))
