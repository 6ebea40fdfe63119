"""Session helpers: checkpoints on shared storage, size-checked broadcast."""

from __future__ import annotations

import pickle
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows stay at or under this bound.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as spark.checkpoint.dir names it.

    Where none is named, a folder of this machine is made if Spark runs in one process (tests); on a
    cluster its executors would each write to their own disks, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes df once and cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else unchanged (a shuffled join).

    The count reads at most rows + 1 rows of it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Shared:
    """An object on all executors, pickled by value: they need no install of its class's module.

    keep: whether the driver holds on to it. drop() frees a worker's copy until it is asked for again.
    """

    def __init__(self, spark: SparkSession, thing: object, keep: bool = True) -> None:
        from pyspark import cloudpickle

        self._data = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
        self._thing = thing if keep else None

    def drop(self) -> None:
        self._thing = None

    def __getstate__(self) -> dict:
        return {"_data": self._data, "_thing": None}

    @property
    def value(self):
        if self._thing is None:
            self._thing = pickle.loads(self._data.value)
        return self._thing


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for small rows that take much work each: sizes alone would put them in few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that its scheme names."""
    fs, where = _file_system(spark, path)
    return bool(fs.exists(where))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return bool(fs.exists(where) and fs.getFileStatus(where).isDirectory())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
