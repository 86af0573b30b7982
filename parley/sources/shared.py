"""Tables in the shared folder: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of this process, by the shared folder that it is in.
_RUNS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where the session names none, a temporary one takes its place on a local
    master; on a cluster, where executors couldn't see it, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="parley-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in this process's part of the shared folder, which is removed when the process ends."""
    top = shared_dir(spark)
    if top not in _RUNS:
        _RUNS[top] = f"{top}/parley-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _RUNS[top])
    return f"{_RUNS[top]}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
