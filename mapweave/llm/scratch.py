"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    found = tempfile.mkdtemp(prefix="mapweave-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return "file://" + found


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset and driver and tasks are one process, as in tests, a
    temporary folder that goes with it; on a cluster, ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _own_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


_open: list[Scratch] = []


class Scratch:
    """A folder of named Parquet tables for one run of an operator.

    Every table survives the loss of executors. drop() deletes tables that no
    later step reads; what the lazy result still reads stays.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Deletes all tables."""
        self._delete(self.root)
        if self in _open:
            _open.remove(self)


@contextmanager
def made_since() -> Iterator[None]:
    """Deletes at its end the tables of every Scratch made inside: only results that are written may be used after it."""
    before = len(_open)
    yield
    for scratch in _open[before:]:
        scratch.close()
