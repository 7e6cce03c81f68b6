"""Session settings, and shipping the package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What the audit relies on: keys that differ in case coexist, and the last of repeated JSON keys wins.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Of what it holds Spark sets 2 KB aside for each VARIANT and row of a batch, also where there are few rows.
    "spark.sql.inMemoryColumnarStorage.batchSize": "1000",
    # The driver keeps plans of past queries as text; those of rules are long.
    "spark.sql.maxPlanStringLength": "200000",
    "spark.sql.ui.retainedExecutions": "20",
}
_SHIPPED: set[str] = set()


def new_session(name: str = "corvane", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **settings}).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="corvane-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the session's spark.checkpoint.dir; a temporary one if a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return f"{base.rstrip('/')}/corvane-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor costs the tasks that read it alone."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of stored() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
