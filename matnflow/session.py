"""Session helpers: table access, worker imports, lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when they see the same file system.

    On a cluster without a shared file system the package is shipped with ``--py-files``.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="matnflow-")
    spark.sparkContext.setCheckpointDir(own)
    return own


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later readers scan columns of a durable table, so nothing is recomputed when an
    executor is lost. The tables are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/matnflow-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; the folder's owner removes what is left
            pass
    _written.clear()


atexit.register(_clean)


def keep_apart(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into a stated number of partitions, which adaptive execution doesn't merge.

    For the stage before an alignment kernel: its rows are small but cost milliseconds
    each. A join on the same keys that follows reuses this shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cores when its scan yields fewer partitions than cores.

    Large tables are many files and stay as they are; only a table of a few files,
    which would keep most cores idle in heavy per-row work, is shuffled once.
    """
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(cores) if len(files) < cores // 2 else df
