"""Session helpers shared by every subpackage: table readers and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch between Spark and Python. Spark's own 10,000 long texts are tens of
#: megabytes in every task and worker.
BATCH = 1024


def small_batches(spark: SparkSession) -> SparkSession:
    """`spark`, whose Arrow batches have at most `BATCH` rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))
    return spark


def shipped(spark: SparkSession) -> SparkSession:
    """`spark`, whose Python workers find this package where the driver found it, with small
    batches. On a cluster the package is installed or sent with --py-files, and an absent path does
    no harm."""
    small_batches(spark)
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a dataset folder. Only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that its driver and executors share."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    On a local master without the setting (tests, notebooks) a local folder is made, set as the
    checkpoint folder and removed when Python ends. On a cluster the setting must name shared
    storage, as executors see no folder of the driver's machine; without it this refuses."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="millwright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_folder(spark)}/millwright/{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below this application's folder; nothing is created yet."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, folder: str) -> None:
    """Removes a folder through Spark's file systems; one that is absent does no harm."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleaned(spark: SparkSession) -> None:
    """Removes every table that this application staged. To be called once results are written,
    as a result that is not may still read them."""
    deleted(spark, own_folder(spark))


def staged(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here, and a lost
    executor costs no recomputation. A staged table that it is `instead_of`, which nothing else
    reads, is removed."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if (old := getattr(instead_of, "_staged_at", None)) is not None:
        deleted(spark, old)
    return out


def sliced(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches in parts of at most so many rows, without copying, so that what a Python worker
    makes of a part, and not of a whole batch, is in memory at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
