"""Session helpers: shipping the package to executors, the shared folder, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="convograph-"), "convograph.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(out)  # Spark's file server hands it to the executors
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local one is set in local mode (tests); on a cluster that is an error, since a
    machine-local folder would scatter the data over the executors' disks.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            where = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            where = f"file://{tempfile.mkdtemp(prefix='convograph-shared-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables, deleted when the application ends."""
    base = f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{base}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files: later stages never recompute it."""
    at = work_dir(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: most keys that are broadcast (16 bytes each and the hash table's room)
BROADCAST_KEYS = 1_000_000


def only(rows: DataFrame, keys: DataFrame, column: str, n_keys: int | None = None) -> DataFrame:
    """``rows`` whose ``column`` is in ``keys`` (written already, so counting them is cheap, where ``n_keys`` isn't given).

    Up to ``BROADCAST_KEYS`` keys are broadcast and ``rows`` stay where they are; more are joined by a shuffle.
    """
    few = keys.select(column).distinct()
    if (keys.count() if n_keys is None else n_keys) <= BROADCAST_KEYS:
        few = F.broadcast(few)
    return rows.join(few, column, "left_semi")


def parallelism(spark: SparkSession) -> int:
    """Number of partitions for explicit repartitions: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
