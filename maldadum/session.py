"""Session factory and the folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, driver_memory: str = "12g", shared: str | None = None, **extra: str) -> SparkSession:
    """A ``local[cores]`` session with the settings every operator assumes: UTC, AQE, ANSI, Arrow.

    :param shared: folder for cut lineage, set as ``spark.checkpoint.dir``; without it :func:`scratch_root` chooses one of this machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maldadum")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on ``local[n]``) a temporary folder of this machine is chosen and
    remembered in the session; a cluster without the setting is refused, since its executors share no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.maldadum.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="maldadum-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.maldadum.scratch", root)
    return root.rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/maldadum-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Applications whose folder is to be deleted when they end, and what is written within :func:`scratch`.
_ENDING: set[str] = set()
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet under :func:`scratch_root` and read it back, so that what follows neither
    recomputes it nor depends on an executor that may be lost. What was written stays until the end of the :func:`scratch` around it, :func:`clear_scratch`, or the end of
    the application."""
    spark = df.sparkSession
    folder = _application_folder(spark)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _ENDING:
        _ENDING.add(folder)
        where, files = _file_system(spark, folder)
        files.deleteOnExit(where)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end; frames made inside can then no longer be used."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            where, files = _file_system(spark, path)
            files.delete(where, True)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application has written; frames that still read it can no longer be used."""
    where, files = _file_system(spark, _application_folder(spark))
    return files.delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many partitions as there are cores if its files give fewer, for work that costs far more than moving the rows.
    Large inputs have more splits than cores and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
