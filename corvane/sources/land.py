"""Landing a run: its files as VARIANT-backed tables, each read once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.sources.archives import register
from corvane.sources.json_splits import JsonFiles, elements, entries
from corvane.sources.json_splits import read as read_splits
from corvane.sources.json_splits import read_parts
from corvane.sources.runs import archive_kind
from corvane.sources.walk import RUN, walk

POLARITIES = ("Positive", "Negative")
# The fields of a context record and its windows.
CONTEXT_FIELDS = """sit_name confidence doc_path value doc_content_length detected_sit_start_index detected_sit_end_index
language ground_truth sit_category domain file_format document_name doc_id""".split()
WINDOWS = ["context_100", "context_500", "context_2000", "context_4000", "context_6000", "context_8000"]
WINDOW_FIELDS = "text left_context_length right_context_length exact_content_length detected_sit_start_index detected_sit_end_index language".split()


@dataclass
class Tables:
    """One run. Rows carry folder_set and, where it applies, polarity."""

    spark: SparkSession
    files: DataFrame  # folder_set, polarity, area, name, size, is_dir
    summary: DataFrame  # folder_set, v, error
    log: DataFrame
    metadata: DataFrame  # folder_set, polarity, name, v, error
    text: DataFrame  # folder_set, polarity, filename, text
    snippets: DataFrame  # folder_set, polarity, name, has_label, label, found
    combined: DataFrame  # folder_set, line, v, bad
    corpus: DataFrame
    context: DataFrame  # folder_set, name, fields as VARIANT, _corrupt_record
    index: DataFrame  # folder_set, entity, value, filename, chunk VARIANT, broken: an entry that isn't JSON
    index_file: DataFrame  # folder_set, name, v (what kind of value it is), error
    evaluations: DataFrame
    grades: DataFrame
    chunk_summary: DataFrame
    listing: DataFrame  # folder_set, polarity, line, v, bad: metadata/index.jsonl
    versions: dict[str, str]  # folder_set: name of the version folder that it lies in
    misc_summary: DataFrame  # the grader's second summary, and its lines for each document
    manifest: DataFrame
    merged: DataFrame  # as index and index_file, of the merged index
    merged_file: DataFrame
    inner: DataFrame  # folder_set, polarity, area, name, error: the JSON files of parsed documents and chunks
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let go of what is held in memory; a run that is landed again is then read again."""
        for f in fields(self):
            if isinstance(own := getattr(self, f.name), DataFrame):
                own.unpersist()
        for df in self.held:
            df.unpersist()

    @property
    def instances(self) -> DataFrame:
        return instances_of(self.metadata)


def instances_of(metadata: DataFrame) -> DataFrame:
    """One row for each object in `instances` of a metadata file."""
    items = F.try_variant_get("v", "$.instances", "array<variant>")
    rows = metadata.select("folder_set", "polarity", "name", "v", F.posexplode(items).alias("pos", "i"))
    return rows.where(X.is_object(F.col("i")))


def clean(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def _folder_set(rel: Column) -> Column:
    return F.when(F.startswith(rel, F.lit("Disagreements/")), "Disagreements").otherwise("Agreements")


def _polarity(rel: Column) -> Column:
    return F.nullif(F.regexp_extract(rel, "^(?:Disagreements/)?(Positive|Negative)/outputs/", 1), F.lit(""))


class FolderSource:
    """A run's files below a folder, on any file system that Spark and pyarrow reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.names = tuple(self.root.split("/")[-2:])
        entries = walk(spark, self.root)
        inside = lambda c: F.substring(F.col(c), F.lit(len(self.root) + 2), F.length(c))
        self.held = [entries]
        self.entries = entries.select(inside("folder").alias("folder"), "name", inside("path").alias("rel"), "is_dir", "size")

    def texts(self, rels: list[str], pattern: str, whole: bool) -> DataFrame:
        if not rels:
            return self.spark.createDataFrame([], TEXTS)
        raw = self.spark.read.text([f"{self._uri}/{r}" for r in rels], wholetext=whole, pathGlobFilter=pattern)
        path = X.decoded(F.col("_metadata.file_path"))
        top = re.sub(r"^\w+:/*", "/", self.root) + "/"
        return raw.select(clean(F.col("value")).alias("value"), F.substring(path, F.instr(path, F.lit(top)) + len(top), F.length(path)).alias("rel"), F.col("_metadata.file_block_start").alias("start"))

    def json(self, rels: list[str], level: int, pattern: str) -> JsonFiles | None:
        if not rels:
            return None
        found = read_splits(self.spark, [f"{self._uri}/{r}" for r in rels], level, pattern)
        path, top = X.decoded(F.col("path")), re.sub(r"^\w+:/*", "/", self.root) + "/"
        return replace(found, files=found.files.withColumn("rel", F.substring(path, F.instr(path, F.lit(top)) + len(top), F.length(path))))

    @property
    def _uri(self) -> str:
        return f"file://{self.root}" if self.root.startswith("/") else self.root


class ArchiveSource:
    """A run's files as they lie in an archive; `inside` is the run's folder in it. A JSON file is read by one task."""

    def __init__(self, spark: SparkSession, members: DataFrame, inside: str) -> None:
        self.spark, self.held = spark, []
        self.names = tuple(["", *inside.split("/")][-2:])
        below = members.where(F.startswith("name", F.lit(f"{inside}/"))).select(F.substring("name", F.lit(len(inside) + 2), F.length("name")).alias("rel"), "size", "content").where("rel <> ''")
        self.members = below.where("rel not like '%/'").withColumn("name", X.base_name(F.col("rel"))).withColumn("folder", _above(F.col("rel")))
        steps = F.split(F.regexp_replace("rel", "/$", ""), "/")
        depth = F.size(steps) - F.when(F.endswith("rel", F.lit("/")), 0).otherwise(1)
        folders = below.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda n: F.when(n <= depth, F.array_join(F.slice(steps, F.lit(1), n), "/")))).alias("rel"))
        folders = folders.where("rel is not null").distinct().select(_above(F.col("rel")).alias("folder"), X.base_name(F.col("rel")).alias("name"), "rel", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))
        self.entries = folders.unionByName(self.members.select("folder", "name", "rel", F.lit(False).alias("is_dir"), "size"))

    def _picked(self, rels: list[str], pattern: str) -> DataFrame:
        glob = "^" + re.escape(pattern).replace(r"\*", ".*") + "$"
        return self.members.where((F.col("folder").isin(rels) | F.col("rel").isin(rels)) & F.col("name").rlike(glob))

    def texts(self, rels: list[str], pattern: str, whole: bool) -> DataFrame:
        rows = self._picked(rels, pattern).select(clean(F.col("content").cast("string")).alias("value"), "rel", F.lit(0).cast("long").alias("start"))
        return rows if whole else rows.select(F.explode(F.split("value", "\r\n|\n|\r")).alias("value"), "rel", "start")

    def json(self, rels: list[str], level: int, pattern: str) -> JsonFiles | None:
        if not rels:
            return None
        rows = self._picked(rels, pattern).where("size > 0").withColumn("file", F.xxhash64("rel"))
        bom = F.substring("content", 1, 3) == F.unhex(F.lit("EFBBBF"))
        text = F.when(bom, F.expr("substring(content, 4)")).otherwise(F.col("content"))
        files = rows.select("file", F.col("rel").alias("path"), "name", "size", "rel")
        return read_parts(self.spark, files, rows.select("file", F.lit(0).cast("long").alias("block"), text.alias("value")), level)


TEXTS = "value string, rel string, start long"


def _above(rel: Column) -> Column:
    return F.regexp_extract(rel, "^(.*)/[^/]*$", 1)


def _parsed(df: DataFrame) -> DataFrame:
    v = F.try_parse_json("value")
    error = F.when(F.length("value") == 0, "empty").when(v.isNull() & (F.trim("value") != "null"), F.when(F.length("value") > 60_000_000, "too large").otherwise("malformed"))
    return df.select("folder_set", "polarity", "name", v.alias("v"), error.alias("error"))


def _lines(df: DataFrame, *more: str) -> DataFrame:
    """Lines in the order of their file: `line` is the block's place in the file, then the place in the task that reads it, however blocks are dealt to tasks."""
    v = F.try_parse_json("value")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.col("start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)") + inside
    rows = df.where(F.trim("value") != "").select("folder_set", *more, line.cast("decimal(38,0)").alias("line"), v.alias("v"))
    return rows.withColumn("bad", F.col("v").isNull())


def _walk_snippets(value: object) -> Iterator[dict]:
    """Objects with `label` and `sit_found` or `snippet`, at any depth; what is inside one is left."""
    work = [value]
    while work:
        x = work.pop()
        if isinstance(x, dict):
            if ("label" in x or "sit_found" in x) and ("sit_found" in x or "snippet" in x):
                yield x
            else:
                work += reversed(x.values())
        elif isinstance(x, list):
            work += reversed(x)


def _snippets(df: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    value = json.loads(r.value)
                except ValueError:
                    continue
                out += [(r.folder_set, r.polarity, r.name, "label" in s, s.get("label") is True, s.get("sit_found") is True) for s in _walk_snippets(value)]
            yield pd.DataFrame(out, columns=["folder_set", "polarity", "name", "has_label", "label", "found"])

    return df.select("folder_set", "polarity", "name", "value").mapInPandas(run, "folder_set string, polarity string, name string, has_label boolean, label boolean, found boolean")


def _context(found: JsonFiles | None, files: DataFrame) -> DataFrame:
    """A row with v for each record of the context files, and one with the reason in _corrupt_record for a file that is no whole array."""
    blank = files.where("not is_dir and polarity is null and size = 0 and name like '%.json' and area in ('context_output_normalized', 'context_output_normalised')")
    out = blank.select(F.lit(None).cast("variant").alias("v"), F.lit("empty").alias("_corrupt_record"), "name", "folder_set", F.lit(0).cast("long").alias("pos"))
    if found is not None:
        told = found.files.withColumn("folder_set", _folder_set(F.col("rel"))).withColumn("why", F.coalesce("error", F.when(F.col("root") != "array", F.col("root"))))
        rows = elements(found).join(F.broadcast(told.where("why is null").select("file", "name", "folder_set")), "file").withColumn("v", F.try_parse_json("text"))
        odd = F.when(~F.coalesce(X.is_object(F.col("v")), F.lit(False)), F.col("text"))
        out = out.unionByName(rows.select("v", odd.alias("_corrupt_record"), "name", "folder_set", "pos"))
        out = out.unionByName(told.where("why is not null").select(F.lit(None).cast("variant").alias("v"), F.col("why").alias("_corrupt_record"), "name", "folder_set", F.lit(0).cast("long").alias("pos")))
    return out


def _indexed(spark: SparkSession, found: JsonFiles | None, files: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(folder_set, entity, value, filename, chunk, broken) of an index, and (folder_set, name, v, error) of its files; v is an empty object if the file is one."""
    blank = files.where((F.col("name") == name) & F.expr("not is_dir and area = '' and polarity is null and size = 0"))
    heads = blank.select("folder_set", "name", F.lit(None).cast("variant").alias("v"), F.lit("empty").alias("error"))
    chunks = "folder_set string, entity string, value string, filename string, chunk variant, broken boolean"
    if found is None:
        return spark.createDataFrame([], chunks.replace("chunk variant", "chunk string")).withColumn("chunk", F.lit(None).cast("variant")), heads
    told = found.files.withColumn("folder_set", _folder_set(F.col("rel"))).withColumn("error", F.coalesce("error", F.when(F.col("root") == "empty", "empty")))
    kind = F.when(F.col("root") == "object", "{}").when(F.col("root") == "array", "[]").otherwise("0")
    heads = heads.unionByName(told.select("folder_set", "name", F.when(F.col("error").isNull(), F.parse_json(kind)).alias("v"), "error"))
    good = told.where("error is null and root = 'object'").select("file", "folder_set")
    rows = entries(found).join(F.broadcast(good), "file").withColumnsRenamed({"first": "entity", "second": "value"})
    entry = F.when((F.col("depth") == 3) & (F.col("container") == "{"), F.try_parse_json(F.concat(F.lit("{"), "text", F.lit("}"))))
    rows = rows.withColumn("entry", entry).withColumn("broken", F.col("text").isNotNull() & F.col("entry").isNull() & (F.col("depth") == 3) & (F.col("container") == "{"))
    rows = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("entry").outer()).select(F.col("key").alias("filename"), F.col("value").alias("held")))
    return rows.select("folder_set", "entity", "value", "filename", F.explode_outer(F.try_variant_get("held", "$", "array<variant>")).alias("chunk"), "broken"), heads


def list_files(entries: DataFrame) -> DataFrame:
    """Every file and folder of the run: folder_set, polarity, area, name, size, is_dir."""
    steps = F.filter(F.split("folder", "/"), lambda x: x != "")
    late = F.coalesce(F.get(steps, F.lit(0)) == "Disagreements", F.lit(False))
    rows = entries.withColumn("late", late).withColumn("steps", F.when(late, F.slice(steps, F.lit(2), F.size(steps))).otherwise(steps))
    first = F.get("steps", F.lit(0))
    rows = rows.withColumn("polarity", F.when(first.isin(*POLARITIES), first))
    area = F.when(F.col("polarity").isNotNull() & (F.get("steps", F.lit(1)) == "outputs"), F.slice("steps", F.lit(3), F.size("steps"))).otherwise(F.col("steps"))
    return rows.select(F.when(F.col("late"), "Disagreements").otherwise("Agreements").alias("folder_set"), "polarity", F.array_join(area, "/").alias("area"), "name", "size", "is_dir")


def land(spark: SparkSession, run_path: str | Path) -> Tables:
    """The tables of the run in a folder: a local path, or a URI."""
    path = str(run_path)
    return land_source(FolderSource(spark, path if re.match(r"\w+:/", path) else str(Path(path).resolve())))


def land_archive(spark: SparkSession, archive: str | Path) -> dict[str, Tables]:
    """The tables of each run in an archive, by the run's folder in it. Nothing is extracted to disk."""
    register(spark)
    uri = str(archive)
    archive_kind(uri)
    members = spark.read.format("members").load(uri if re.match(r"\w+:/", uri) else str(Path(uri).resolve())).persist()
    version = RUN.strip("^$")
    found = members.select(F.regexp_extract("name", f"^((?:[^/]+/)*?{version})/", 1).alias("run")).where("run <> ''").distinct()
    runs = sorted(r["run"] for r in found.collect())  # a few
    out = {run: land_source(ArchiveSource(spark, members, run)) for run in runs}
    for t in out.values():
        t.held.append(members)
    return out


def land_source(source: FolderSource | ArchiveSource) -> Tables:
    spark, tops = source.spark, ["", "Disagreements/"]
    outputs = [f"{t}{p}/outputs/" for t in tops for p in POLARITIES]
    entries = source.entries.persist()
    files = list_files(entries).persist()
    grades = entries.where("is_dir and name like 'chunk_run_%'").where(F.col("folder").isin([f"{t}SITGrader" for t in tops])).groupBy("folder").agg(F.max("name").alias("name"))
    latest = [f"{r['folder']}/{r['name']}/" for r in grades.collect()]  # one for each folder set
    contexts = [f"{t}{n}" for t in tops for n in ("context_output_normalized", "context_output_normalised")]
    wanted = ["export_summary.json", "generation_log.json", "combined_metadata.jsonl", "corpus.jsonl", "sit_inverted_index.json", "sit_merged_index.json", "SITGrader/misc/chunk_evaluations.jsonl", "SITGrader/misc/evaluation_summary.json", "SITGrader/misc/evaluation_manifest.jsonl"]
    single = [f"{t}{w}" for t in tops for w in wanted] + [f"{x}{n}" for x in latest for n in ("chunk_grades.jsonl", "chunk_summary.json")]
    folders = [f"{o}{a}" for o in outputs for a in ("metadata", "parsed_raw_doc", "parsed_raw_doc/chunks", "parsed_raw_doc/plain_text")]
    there = {r["rel"] for r in entries.where(F.col("rel").isin([*single, *folders])).select("rel").distinct().collect()}  # of this short list
    full = {r["rel"] for r in entries.where(F.col("rel").isin(single) & (F.col("size") > 0)).select("rel").distinct().collect()}
    full |= {r["folder"] for r in entries.where(F.col("folder").isin(contexts) & F.expr("name like '%.json' and size > 0")).select("folder").distinct().collect()}

    def read(rels: list[str], pattern: str = "*", whole: bool = True) -> DataFrame:
        rel = F.col("rel")
        return source.texts([r for r in rels if r in there], pattern, whole).select("value", _folder_set(rel).alias("folder_set"), _polarity(rel).alias("polarity"), X.base_name(rel).alias("name"), "start")

    each = lambda name: [f"{t}{name}" for t in tops]
    area = lambda name: [f"{o}{name}" for o in outputs]
    inner = lambda a: _parsed(read(area(a), "*.json")).select("folder_set", "polarity", F.lit(a).alias("area"), "name", "error")
    split = lambda rels, level, pattern="*": source.json([r for r in rels if r in full], level, pattern)
    text = read(area("parsed_raw_doc/plain_text"), "*.txt").select("folder_set", "polarity", F.regexp_replace("name", r"\.txt$", "").alias("filename"), F.col("value").alias("text"))
    records = split(contexts, 1, "*.json")
    indexes = {n: split(each(n), 3) for n in ("sit_inverted_index.json", "sit_merged_index.json")}
    # Held as one value for each record: Spark sets memory aside for each VARIANT column of what it holds.
    whole = _context(records, files).persist()
    context = whole.select(*[F.try_variant_get("v", f"$.{c}", "variant").alias(c) for c in [*CONTEXT_FIELDS, *WINDOWS]], "_corrupt_record", "name", "folder_set", "pos")
    (index, index_file), (merged, merged_file) = (_indexed(spark, found, files, n) for n, found in indexes.items())
    above, version = source.names
    return Tables(
        spark, files, _parsed(read(each("export_summary.json"))).persist(), _parsed(read(["generation_log.json"])).persist(), _parsed(read(area("metadata"), "*.json")).persist(), text.persist(), _snippets(read(area("parsed_raw_doc/chunks"), "*.json")).persist(),
        _lines(read(each("combined_metadata.jsonl"), whole=False)).persist(), _lines(read(each("corpus.jsonl"), whole=False)).persist(), context, index.persist(), index_file, _lines(read(each("SITGrader/misc/chunk_evaluations.jsonl"), whole=False)),
        _lines(read([f"{x}chunk_grades.jsonl" for x in latest], whole=False)), _parsed(read([f"{x}chunk_summary.json" for x in latest])),
        _lines(read(area("metadata"), "index.jsonl", whole=False), "polarity"), {"Agreements": version if version.startswith("Version_") else above, "Disagreements": version},
        _parsed(read(each("SITGrader/misc/evaluation_summary.json"))), _lines(read(each("SITGrader/misc/evaluation_manifest.jsonl"), whole=False)),
        merged, merged_file, inner("parsed_raw_doc").unionByName(inner("parsed_raw_doc/chunks")), [*source.held, entries, whole, *[df for found in (records, *indexes.values()) if found for df in found.held]],
    )
