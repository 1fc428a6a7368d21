"""Session settings and the shared staging folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Stored pages are large, so few of them fill a batch sent to Python.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "33554432",
}

_LOCAL_ROOT = "spark.sitegrain.local.staging"


@cache
def _package() -> str:
    """This package as a zip file for ``addPyFile``, which hands it to the executors."""
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="sitegrain-", suffix=".zip")
    with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, str(source.relative_to(root.parent)))
    return path


_shipped: set[tuple[str, str]] = set()


def configure(spark: SparkSession, *modules: str) -> SparkSession:
    """Apply the settings the operators are written for and hand this package to the executors.

    ``modules`` are further Python files whose functions run in tasks, such as a user's extractor.
    """
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    for path in (_package(), *modules):
        shipment = (spark.sparkContext.applicationId, path)
        if shipment not in _shipped:
            spark.sparkContext.addPyFile(path)
            _shipped.add(shipment)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: the one the cluster names in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_ROOT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="sitegrain-")
        spark.conf.set(_LOCAL_ROOT, root)
    return f"{root.rstrip('/')}/sitegrain/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    This cuts the lineage, computes costly columns once, survives lost executors and
    gives the planner true sizes, by which it chooses or refuses broadcast joins.
    ``codec`` is a Parquet codec other than the session's, such as ``zstd`` for long texts.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """A table the planner knows to be empty, so that joins with it vanish."""
    return spark.createDataFrame([], schema).filter("false")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark would broadcast this side of a join: for a staged table, by its size on disk."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(size)) <= limit


def clear_staging(spark: SparkSession) -> None:
    """Remove what this application has staged; call it once results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utc_now() -> Column:
    """Current time as a zoneless UTC timestamp."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
