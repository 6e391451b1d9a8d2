"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session, whose executors are its driver, gets a folder made
    here, which the context keeps; on a cluster that is an error, as no folder of one machine would do."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/granary-{label}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; a session that has ended leaves it to the cluster's own cleaning."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut and it survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads, so that loops keep one round on disk."""
    for t in tables:
        remove_path(t.sparkSession, t._granary_path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context: their Python workers import the kernels by name."""
    context = spark.sparkContext
    if getattr(context, "_granary_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="granary-")) / "granary.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._granary_shipped = True
