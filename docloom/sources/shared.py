"""Tables that cut a lineage: written once into the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Folders that stored() and scratch() have made in this process and nobody has deleted, oldest first.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and all executors are in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clear() deletes it."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back. Computed once, it survives lost executors, and its size is known to the planner."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many folders there are: what clear() takes as since."""
    return len(_MADE)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the folders made since a mark() but those that keep still reads. Results that haven't been written elsewhere are gone then."""
    needed = [f for df in keep for f in df.inputFiles()]
    left = []
    for path in _MADE[since:]:
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in needed):
            left.append(path)
        else:
            _delete(spark, path)
    _MADE[since:] = left


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    gone = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for top in gone:
        _delete(df.sparkSession, top)
    names = {top.rsplit("/", 1)[1] for top in gone}
    _MADE[:] = [p for p in _MADE if p.rsplit("/", 1)[1] not in names]
