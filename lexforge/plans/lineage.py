"""Cutting lineage through the shared checkpoint folder.

A cut is a Parquet table in the folder that ``spark.checkpoint.dir`` names, which all
executors share: a lost executor costs the rerun of its own tasks, never the result of
the cut. Only where the setting is missing (tests, a laptop) is a folder made.

Cuts belong to the session that made them: ``release`` deletes them, and the end of the
driver's process does so too. A result that still reads from a cut must be written or
collected before its session releases.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or one of our own where none is named."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexforge-')}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder, deleted when the session releases its cuts."""
    path = f"{checkpoint_dir(spark)}/lexforge/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table; its schema is kept."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession | None = None) -> int:
    """Deletes the cuts of ``spark``, or of all sessions that still run; how many there were."""
    gone = [x for x in _made if spark is None or x[0] is spark]
    _made[:] = [x for x in _made if x not in gone]
    for owner, path in gone:
        if owner.sparkContext._jsc is not None:
            delete(owner, path)
    return len(gone)


@atexit.register
def _at_end() -> None:
    try:
        release()
    except Exception:  # The JVM may have gone before us; its folder is then the cluster's to clear.
        _made.clear()
