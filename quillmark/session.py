"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer files than cores and less than this for each core is dealt out anew when it is read.
SMALL_BYTES = 128 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they start: its sources go to every executor once a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_quillmark_shipped", False):
        root = Path(__file__).resolve().parent
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quillmark-")), "quillmark.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        sc._quillmark_shipped = True
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's rows; those of a small table in few files are dealt over all cores, large tables are never shuffled here."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * SMALL_BYTES:
        return df.repartition(cores)
    return df


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillmark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error, as no folder would be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quillmark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: short lineage, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
