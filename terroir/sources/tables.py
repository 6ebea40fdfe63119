"""Readers and writers: parquet tables, delimited feeds, JSON lines, raw text feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = "array<struct<reviewer_name:string,score_str:string,content:string>>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv_feed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header, comma, RFC quotes, JSON cells, line ends inside cells; every value is a string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; a line that can't be read is kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_nested(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """data: one nested JSON document of the given type for each line of the files, with the folders' columns."""
    return spark.read.text(path).withColumn("data", F.from_json("value", kind)).drop("value")


def parse_csv_line(c: Column, schema: str) -> Column:
    return F.from_csv(c, schema, {"quote": '"', "escape": '"'})


def parse_text_feed(lines: DataFrame, line: str, kinds: Sequence[str]) -> DataFrame:
    """Links of a text feed: lines of the wanted kinds with exactly a price and then a sku."""
    hits = F.regexp_extract_all(F.col(line), F.lit(r"(\$\d+\.\d+|sku=\d+)"), F.lit(1))
    wanted = F.lit(False)
    for k in kinds:
        wanted = wanted | F.col(line).contains(k)
    rows = lines.where(wanted).withColumn("__h", hits)
    rows = rows.where((F.size("__h") == 2) & F.col("__h")[0].startswith("$") & F.col("__h")[1].startswith("sku="))
    return rows.select("*", F.expr("substring(__h[0], 2)").try_cast("double").alias("price"), F.expr("substring(__h[1], 5)").alias("sku")).drop("__h")


def pages(totals: DataFrame, total: str, step: int) -> DataFrame:
    """Adds page (1..n) and offset for each page of a listing of `total` entries; none for 0."""
    n = F.ceil(F.col(total) / step).cast("int")
    return totals.withColumn("page", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))).withColumn("offset", (F.col("page") - 1) * step)


def write_partitions(df: DataFrame, path: str, by: Sequence[str], max_records: int = 5_000_000, mode: str = "overwrite") -> None:
    """Only the partitions that df has are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records).partitionBy(*by).parquet(path)


def append_fixed(df: DataFrame, path: str, columns: Sequence[tuple[str, str]]) -> None:
    """Appends the known columns only; missing ones are null, unknown ones are left out."""
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns]).write.mode("append").parquet(path)
