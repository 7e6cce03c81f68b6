"""Listing a tree of files in tasks, a level at a time.

Each round lists the folders that the last one found; folders are spread over tasks, and names stay in
tables. The driver learns only whether a folder is left. Any file system that pyarrow reaches by URI will do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = r"^Version_\d{8}_\d{4}$"
ENTRIES = "folder string, name string, path string, is_dir boolean, size long"
#: Folders that one task lists at least, before a round takes more tasks.
FOLDERS_A_TASK = 200
#: Entries that a task hands on at a time.
HELD = 10_000


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system and the path in it."""
    if re.match(r"file:|/", uri):
        return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pyarrow.fs.FileSystem.from_uri(uri)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["folder", "name", "path", "is_dir", "size"]
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            fs, inside = file_system(folder)
            found = fs.get_file_info(pyarrow.fs.FileSelector(inside, allow_not_found=True))
            for start in range(0, len(found), HELD):
                some = found[start : start + HELD]
                is_dir = [x.type == pyarrow.fs.FileType.Directory for x in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder] * len(some)), pa.array([x.base_name for x in some]), pa.array([f"{folder.rstrip('/')}/{x.base_name}" for x in some]), pa.array(is_dir), pa.array([0 if d else x.size for x, d in zip(some, is_dir, strict=True)], pa.int64())], names
                )


def walk(spark: SparkSession, root: str, enter: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(folder, name, path, is_dir, size) of all that lies below root, in no order.

    `enter` tells from rows of that kind which folders are looked into; all are without it. A folder that isn't
    there has no rows. The table is held; unpersist() lets it go.
    """
    frontier = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    levels: list[DataFrame] = []
    while True:
        level = frontier.mapInArrow(_listed, ENTRIES).persist()
        levels.append(level)
        folders = level.where("is_dir")
        if enter is not None:
            folders = folders.where(enter(folders))
        left = folders.count()
        if not left:
            break
        frontier = folders.select("path").repartition(min(spark.sparkContext.defaultParallelism * 4, -(-left // FOLDERS_A_TASK)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    out = out.persist()
    out.count()
    for level in levels:
        level.unpersist()
    return out


def run_folders(spark: SparkSession, root: str, skipped: frozenset[str]) -> DataFrame:
    """(path) of folders named like a run, at or below root. Runs have no runs inside; hidden and skipped folders are not entered."""
    if re.match(RUN, root.rstrip("/").split("/")[-1]):
        return spark.createDataFrame([(root.rstrip("/"),)], "path string")
    into = lambda df: ~df["name"].rlike(RUN) & ~df["name"].isin(*sorted(skipped)) & ~df["name"].startswith(".")
    return walk(spark, root, into).where(F.col("is_dir") & F.col("name").rlike(RUN)).select("path")
