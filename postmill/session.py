"""Session helpers: building a local session, checkpoints and spreading Python-heavy stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "postmill", cores: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def _shared_dir(spark: SparkSession, what: str) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset a temporary one on one machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder")
    return tempfile.mkdtemp(prefix=f"postmill-{what}-")


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's JVM ends."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this name in the shared folder, deleted when the driver ends."""
    path = f"{_shared_dir(spark, 'work')}/{name}-{uuid.uuid4().hex}"
    _forget_at_exit(spark, path)
    return path


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder; the files are deleted when the driver ends."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared_dir(df.sparkSession, "ckpt"))
        _forget_at_exit(df.sparkSession, sc._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back: lineage is cut, and later reads prune columns
    and, by the columns named in ``parts``, rows."""
    path = work_dir(df.sparkSession, "stored")
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Repartition a scan only where it has fewer splits than the cluster has cores.

    A large table has many splits and is left alone, so no shuffle is added at scale.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= want else df.repartition(want)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reaches."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).exists(target)


def in_tasks(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Partitioned by the keys into a fixed number of tasks for a Python stage: merging partitions by size would leave few."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism * per_core, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def ship(spark: SparkSession) -> None:
    """Let the executors import this package: once for each context, and only where PYTHONPATH does not already."""
    import shutil
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    on_path = root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    if on_path or getattr(sc, "_postmill_shipped", False):
        return
    target = tempfile.mkdtemp(prefix="postmill-ship-")
    for name in sorted(os.listdir(root)):
        if os.path.isfile(os.path.join(root, name, "session.py")):
            archive = shutil.make_archive(os.path.join(target, name), "zip", root, name)
            sc.addPyFile(archive)
            if archive in sys.path:
                sys.path.remove(archive)  # the driver keeps its own copy
    sc._postmill_shipped = True
