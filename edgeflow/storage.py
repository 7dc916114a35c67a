"""Where intermediate tables live.

Iterative programs cut their lineage by writing a table into the folder that all
executors share (``spark.checkpoint.dir``).  Such a table survives the loss of any
executor, unlike a local checkpoint.
"""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="edgeflow-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's handle of a path, and of the file system that it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = file_system(spark, path)
    fs.delete(at, True)


#: By thread, the paths of the tables that ``scope`` removes when it ends, innermost last.
_own = threading.local()


def _scopes() -> list[list[str]]:
    return _own.__dict__.setdefault("scopes", [])


@contextmanager
def scope(spark: SparkSession):
    """Remove, at the end, every table that was saved inside.

    Results are read from such tables when they are computed, so write or collect them inside.
    """
    _scopes().append([])
    try:
        yield _scopes()[-1]
    finally:
        for path in _scopes().pop():
            remove(spark, path)


class Saved:
    """A table in the shared folder, with the means to remove it; its files hold ``file_rows`` rows at most, if given."""

    def __init__(self, df: DataFrame, codec: str = "zstd", file_rows: int = 0):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/edgeflow-{uuid.uuid4().hex}"
        if _scopes():
            _scopes()[-1].append(self.path)
        df.write.option("compression", codec).option("maxRecordsPerFile", file_rows).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes once."""
    return Saved(df).df


def settled(operator):
    """An operator over a table whose result is saved, and whose other tables then go."""

    @wraps(operator)
    def run(rows: DataFrame, *args, **options) -> DataFrame:
        with scope(rows.sparkSession) as inside:
            out = Saved(operator(rows, *args, **options))
            inside.remove(out.path)
        if _scopes():
            _scopes()[-1].append(out.path)
        return out.df

    return run


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    Its cleaner follows the garbage collection of the driver, which may be long in coming.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
