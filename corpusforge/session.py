"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder of its own; a
    cluster must name a shared one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: With this setting, which Spark reads when it plans, the shuffle files of an execution go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files when they end; what they have written does not need them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later plans start from files: short lineage, real sizes for join planning, pruned columns,
    and nothing to recompute when an executor is lost. The shuffle files of the write go with it, the table itself by ``discard``.
    """
    path = scratch_path(df.sparkSession, "table")
    with own_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` has written for these very frames; nothing may read them, or frames made from them, any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written_at", None)
        if path is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the key columns come from ``left``."""
    if how in ("left_semi", "left_anti"):
        names = {k: f"_r_{k}" for k in keys}
        right = right.select(*[F.col(k).alias(n) for k, n in names.items()])
    else:
        names = {k: f"_r_{k}" for k in keys}
        right = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, n in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition an input that arrives in fewer splits than the session has cores.

    Large inputs already come in many splits and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


#: Rows of one Arrow batch between the JVM and Python, where the session leaves Spark's setting alone.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Let whole texts go to Python in batches of ``BATCH_ROWS``, unless the session names a number itself.

    The JVM and the worker hold a batch several times over, and Spark's 10,000 whole texts are all rows of a file split.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_ROWS))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="package-")), "corpusforge.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
