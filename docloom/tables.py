"""Tables written between jobs, in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset and the session runs in one process
(tests, notebooks) a local temporary folder is made and set once; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster whose machines have no such path needs the package installed or sent with ``--py-files``.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: Folders of the workspaces made so far.
_ROOTS: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """A point in time for ``clean``."""
    return len(_ROOTS)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables that operators of this process have written (since a ``mark``); call it once their results are stored."""
    while len(_ROOTS) > since:
        _delete(spark, _ROOTS.pop())


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Workspace:
    """Names for tables of one run; ``drop`` removes those that later jobs no longer read, ``clean`` all of them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        _ROOTS.append(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back, which ends its lineage."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            if name in self.paths:
                _delete(self.spark, self.paths.pop(name))
