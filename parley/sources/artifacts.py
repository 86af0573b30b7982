"""Versions of tables that outlive a call: entity vectors, community maps, counters, features.

A table is never changed in place.  Each save writes a new version beside the
others, readers take the last one that was written whole, and a job that is
tried again leaves at most a version that nobody reads.

Several tables change together by a commit: all are written first, then one small
manifest that names them.  Until it is there, readers see the state before; a
job that dies in between leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Whether ``source`` now has the name ``target``: not if that is taken."""
    sc = spark.sparkContext
    store, to = _store(spark, target)
    if store.exists(to):
        return False
    jvm = sc._jvm.org.apache.hadoop.fs
    files = jvm.FileContext.getFileContext(to.toUri(), sc._jsc.hadoopConfiguration()) if to.toUri().getScheme() else jvm.FileContext.getFileContext(sc._jsc.hadoopConfiguration())
    try:
        files.rename(jvm.Path(source), to, sc._gateway.new_array(jvm.Options.Rename, 0))
    except Exception as e:  # noqa: BLE001 - an exception of the JVM
        if "exist" in str(e) or "not empty" in str(e):
            return False
        raise
    return True


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the versions that were written whole, in order."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(top):
        return []
    found = [s.getPath() for s in store.listStatus(top) if s.isDirectory()]
    whole = [p.getName() for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(x.removeprefix("v")) for x in whole if x.startswith("v") and x[1:].isdigit())


def save(df: DataFrame, root: str, name: str) -> int:
    """``df`` as the next version of the table; its number.

    It is written under a name of its own and then takes the next number that is
    free, so two that save at once get two versions, and nothing that a reader may hold goes.
    """
    spark, own = df.sparkSession, f"{root}/{name}/.{uuid.uuid4().hex}"
    df.write.parquet(own)
    known = versions(spark, root, name)
    number = known[-1] + 1 if known else 1
    while not _renamed(spark, own, f"{root}/{name}/v{number:09d}"):
        number += 1
    return number


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The last version of the table, or the one named; an error if there is none."""
    known = versions(spark, root, name)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{root}/{name} has no version {version or ''}".rstrip())
    return spark.read.parquet(f"{root}/{name}/v{version or known[-1]:09d}")


def cached(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table, made and saved if there is none yet."""
    if not versions(spark, root, name):
        save(make(), root, name)
    return load(spark, root, name)


def extended(spark: SparkSession, root: str, name: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new version with the rows of ``new`` in place of those with equal keys: the context of calls that go on.

    Of rows of ``new`` with equal keys the largest stays.
    """
    rest = [c for c in new.columns if c not in keys]
    new = (new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()).select(*new.columns)
    if versions(spark, root, name):
        old = load(spark, root, name)
        new = new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
    save(new, root, name)
    return load(spark, root, name)


@dataclass
class State:
    """Tables as one commit left them; ``batch``: the last batch that is in them."""

    number: int
    batch: int | None
    paths: dict[str, str]
    spark: SparkSession

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])


def state(spark: SparkSession, root: str, number: int | None = None) -> State:
    """What the last commit left, or the one named; number 0 without tables if there is none."""
    store, top = _store(spark, f"{root}/_commits")
    names = sorted(s.getPath().getName() for s in store.listStatus(top)) if store.exists(top) else []
    known = [int(x.removesuffix(".json")) for x in names if x.endswith(".json") and not x.startswith(".")]
    if number is None:
        number = known[-1] if known else 0
    if not number:
        return State(0, None, {}, spark)
    if number not in known:
        raise FileNotFoundError(f"{root} has no commit {number}")
    said = json.loads("".join(r.value for r in spark.read.text(f"{root}/_commits/{number:09d}.json").collect()))
    return State(number, said["batch"], said["paths"], spark)


def commit(before: State, root: str, tables: dict[str, DataFrame], batch: int | None = None) -> State:
    """``tables`` in place of those of ``before``, all at once; others stay.

    ``batch``: rises from commit to commit; one that is in the state already
    changes nothing, so a batch that is tried again counts once.  An error if another commit came after ``before``.
    """
    spark = before.spark
    if batch is not None and before.batch is not None and batch <= before.batch:
        return before
    paths = dict(before.paths)
    for name, df in tables.items():
        paths[name] = f"{root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(paths[name])
    own, number = f"{root}/_commits/.{uuid.uuid4().hex}", before.number + 1
    store, at = _store(spark, own)
    out = store.create(at, True)
    out.write(bytearray(json.dumps({"batch": before.batch if batch is None else batch, "paths": paths}).encode()))
    out.close()
    if not _renamed(spark, own, f"{root}/_commits/{number:09d}.json"):
        raise RuntimeError(f"another commit came after {before.number}")
    return state(spark, root, number)


def reset(spark: SparkSession, root: str, name: str) -> None:
    """All versions of the table go."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(top, True)
