"""Session set-up and shared storage for intermediate tables.

Intermediate results that several later jobs read are written once, as Parquet,
under the folder named by ``spark.checkpoint.dir``.  All executors see that
folder, so a lost executor costs nothing but the re-read.  Where the setting is
absent a local session (tests, notebooks) gets a private folder; on a cluster
that is an error, as executors can't see each other's disks.

An application's tables lie in one folder.  :func:`release` removes them once
their results are used; what is left goes when the application ends.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SILTSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_siltstone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="siltstone-code-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    context.addPyFile(archive)
    context._siltstone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's, else one of our own if the session is local."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors of {master} share")
    own = getattr(spark.sparkContext, "_siltstone_dir", None)
    if own is None:
        path = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, path, True)
        own = f"file://{path}"
        spark.sparkContext._siltstone_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def own_tables(spark: SparkSession) -> str:
    """The folder of this application's tables, which is removed when the application ends."""
    path = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_siltstone_tables", None) != path:
        fs, p = _file_system(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        spark.sparkContext._siltstone_tables = path
    return path


def release(spark: SparkSession) -> None:
    """Remove all tables that this application has written so far; results that read them must have been used."""
    path = getattr(spark.sparkContext, "_siltstone_tables", None)
    if path:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Cuts the lineage without relying on any executor's local storage.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{own_tables(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder.

    A folder of few, small files would leave most cores idle.  Where the files,
    by their number and length, make fewer parts than there are cores, the rows
    are spread over the cores, as what follows costs far more than moving them.
    """
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    if len(files) >= cores:
        return rows
    size = 0
    for f in files:
        fs, p = _file_system(spark, f)
        size += fs.getFileStatus(p).getLen()
    if size < 100_000:
        return rows
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
