"""Shared working storage: lineage cuts that outlive any executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_made: list[str] = []  #: folders of this process that nothing has deleted


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is empty and the master is local (tests, a laptop;
    driver and executors share the machine) is a folder of our own made.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing else uses."""
    _made.append(f"{shared_dir(spark)}/weirflow/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> list[str]:
    """Working folders that this process has named and not deleted."""
    return list(_made)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages read the table, so a lost executor costs a re-read of files
    and never a recomputation of what came before.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a finished working folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)


class Scratch:
    """Tables of one run, deleted when no later step reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.made: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """As :func:`materialise`; the table can be dropped."""
        path = new_path(self.spark, tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that have served."""
        gone = [path for made, path in self.made if any(made is t for t in tables)]
        self.made = [x for x in self.made if x[1] not in gone]
        for path in gone:
            delete(self.spark, path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where their path doesn't have it: send it along, once a context."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_weirflow_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="weirflow-")) / "weirflow.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "weirflow").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    context._weirflow_shipped = True
