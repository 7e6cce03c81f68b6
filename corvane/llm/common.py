"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the ASCII controls tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
SPACES = " \t\n\x0b\x0c\r"

#: Largest amount of text, in bytes, that one vectorised step holds at a time.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return df["`" + name.replace("`", "``") + "`"]


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns but some as one struct, so that their names can't clash with others."""
    fields = [named(df, c).alias(c) for c in df.columns if c not in without]
    return F.struct(*(fields or [F.lit(0).alias("none")]))


def unpacked(row: str, columns: list[str], put: dict[str, Column]) -> list[Column]:
    """The columns of a struct of packed(), and those in put by their names, in order."""
    return [put[c].alias(c) if c in put else F.col(row).getField(c).alias(c) for c in columns]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """A folder for this application below the one that all executors share.

    The folder is the session's spark.checkpoint.dir. Only a local session may
    go without it; it then gets a temporary folder, which executors share there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is needed when executors are separate processes")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return f"{base.rstrip('/')}/corvane-{sc.applicationId}"


_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs at most the tasks that read
    the table. Unlike an executor-local copy it outlives every executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now; it does so when the driver's JVM collects garbage."""
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.table_path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != df.table_path]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those put into the list."""
    start, kept = {path for _, path in _WRITTEN}, []
    yield kept
    stay = start | {df.table_path for df in kept}
    for session, path in [x for x in _WRITTEN if x[0] is spark and x[1] not in stay]:
        remove(session, path)
        _WRITTEN.remove((session, path))
    free_shuffles(spark)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone; the folder is then left to its owner
            return


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one cut holds about `limit` bytes of text, or one row."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


import pyarrow.compute  # noqa: E402,F401  makes pa.compute available to the workers
