"""Reference material on entities: packs (folders with CSV files), specifications (documents) and a keyword list (JSON)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.functions import names as N
from corvane.operators import joins as J

# The files of a pack, and the first bytes of an encrypted document.
PACK_FILES = ["contract.yaml", "keywords.csv", "positive_values.csv", "negative_values.csv", "golden_cases.jsonl", "scenarios.yaml", "README.md"]
ENCRYPTED = bytes.fromhex("d0cf11e0")
THRESHOLD = 0.5


def head(path: Path, n: int = 8) -> bytes:
    """The first bytes of a file; none of one that can't be read."""
    try:
        with path.open("rb") as f:
            return f.read(n)
    except OSError:
        return b""


def packs(spark: SparkSession, folder: Path) -> DataFrame:
    """(pack, present, missing, extra): the files of each pack folder. Names alone are listed on the driver."""
    rows = [(p.name, [f.name for f in sorted(p.iterdir()) if f.is_file()]) for p in sorted(folder.iterdir()) if p.is_dir()] if folder.is_dir() else []
    had = spark.createDataFrame(rows, "pack string, files array<string>")
    known = F.lit(PACK_FILES)
    return had.select("pack", F.array_intersect(known, "files").alias("present"), F.array_except(known, "files").alias("missing"), F.array_sort(F.array_except("files", known)).alias("extra"))


def specifications(spark: SparkSession, folder: Path) -> DataFrame:
    """(file, name, size, encrypted) of each .docx file, from its first bytes."""
    rows = [(p.name, p.stem, p.stat().st_size, head(p)[:4] == ENCRYPTED) for p in sorted(folder.iterdir()) if p.is_file() and p.suffix.lower() == ".docx"] if folder.is_dir() else []
    return spark.createDataFrame(rows, "file string, name string, size long, encrypted boolean")


def pack_languages(spark: SparkSession, folder: Path) -> DataFrame:
    """(pack, languages): languages of the column locale of each keywords.csv; packs without the file or the column have no row."""
    # Packs may order their columns differently, so that each file is read with its own header.
    parts = []
    for f in sorted(folder.glob("*/keywords.csv")):
        csv = spark.read.csv(f"file://{f}", header=True, multiLine=True, escape='"')
        if at := [c for c in csv.columns if c.lstrip("﻿") == "locale"]:
            parts.append(csv.select(F.lit(f.parent.name).alias("pack"), F.substring_index(F.lower(X.strip(F.col(f"`{at[0]}`"))), "-", 1).alias("language")))
    none = spark.createDataFrame([], "pack string, language string")
    rows = none
    for p in parts:
        rows = rows.unionByName(p)
    return rows.where("language <> ''").groupBy("pack").agg(F.sort_array(F.collect_set("language")).alias("languages"))


def keyword_entries(spark: SparkSession, file: Path) -> DataFrame:
    """(entry, name, languages) of a JSON array of entries; entries without a name are left out."""
    if not file.is_file():
        return spark.createDataFrame([], "entry string, name string, languages array<string>")
    items = F.try_variant_get(F.try_parse_json(F.regexp_replace("value", "^﻿", "")), "$", "array<variant>")
    rows = spark.read.text(f"file://{file}", wholetext=True).select(F.posexplode(items).alias("pos", "e"))
    said = lambda k: F.nullif(F.try_variant_get("e", f"$.{k}", "string"), F.lit(""))
    spoken = F.transform(F.try_variant_get("e", "$.keywords", "array<variant>"), lambda k: F.lower(X.strip(F.try_variant_get(k, "$.language", "string"))))
    named = rows.select("pos", F.coalesce(said("canonical_sit_name"), said("SIT")).alias("name"), F.array_distinct(F.filter(spoken, lambda x: x != "")).alias("languages")).where("name is not null")
    return named.select(F.concat_ws("#", "name", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("entry"), "name", "languages")


def matched(names: DataFrame, name: str, others: DataFrame, other: str, text: str | None = None) -> DataFrame:
    """(name, other, score): for each name the best match of at least THRESHOLD. `text` is the column of others that is compared."""
    left = names.withColumn("l_tokens", N.tokens(F.col(name)))
    right = others.withColumn("r_tokens", N.tokens(F.col(text or other)))
    return J.best_match(left, right, name, other, N.match_score(F.col("l_tokens"), F.col("r_tokens")), THRESHOLD, N.specific)


def coverage(spark: SparkSession, wanted: DataFrame, pack_folder: Path, spec_folder: Path | None = None, keyword_file: Path | None = None) -> DataFrame:
    """For each (name, language) of wanted, what the reference material has of it and a status.

    confirmed: an entry is found that covers the language; found_unconfirmed_language:
    one is found, but no list of languages has it; not_found. Names of
    specifications tell no language. A language that has no known code can't be
    confirmed by a pack.
    """
    names = wanted.select("name").distinct()
    in_packs = matched(names, "name", packs(spark, pack_folder).select("pack"), "pack").drop("score").join(pack_languages(spark, pack_folder).withColumnRenamed("languages", "pack_languages"), "pack", "left")
    specs = specifications(spark, spec_folder) if spec_folder else spark.createDataFrame([], "file string, name string")
    in_specs = matched(names, "name", specs.select("file", F.col("name").alias("spec_name")), "file", "spec_name").drop("score")
    entries = keyword_entries(spark, keyword_file) if keyword_file else spark.createDataFrame([], "entry string, name string, languages array<string>")
    in_list = matched(names, "name", entries.select("entry", F.col("name").alias("entry_name")), "entry", "entry_name").drop("score").join(entries.select("entry", F.col("languages").alias("entry_languages")), "entry", "left")
    codes = F.create_map(*[F.lit(x) for code in N.LOCALES for x in (N.LANGUAGES[code].lower(), code)])
    language = F.lower(X.strip(F.col("language")))
    rows = wanted.join(in_packs, "name", "left").join(in_specs, "name", "left").join(in_list, "name", "left")
    by_pack = F.array_contains("pack_languages", F.element_at(codes, language))
    by_list = F.array_contains("entry_languages", language)
    found = F.coalesce("pack", "file", "entry").isNotNull()
    sure = F.coalesce(by_pack, F.lit(False)) | F.coalesce(by_list, F.lit(False))
    status = F.when(~found, "not_found").when(sure, "confirmed").otherwise("found_unconfirmed_language")
    return rows.select("name", "language", "pack", by_pack.alias("pack_covers"), F.col("file").alias("specification"), F.regexp_replace("entry", "#[0-9]+$", "").alias("entry"), by_list.alias("entry_covers"), status.alias("status"))


def gaps(spark: SparkSession, pack_folder: Path, spec_folder: Path) -> DataFrame:
    """(kind, name): packs that no specification matches, and specifications without a pack."""
    there, specs = packs(spark, pack_folder).select("pack"), specifications(spark, spec_folder).select("file", "name")
    met = matched(specs, "name", there, "pack")
    lone_packs = there.join(met, "pack", "left_anti").select(F.lit("pack without specification").alias("kind"), F.col("pack").alias("name"))
    return lone_packs.unionByName(specs.join(met, "name", "left_anti").select(F.lit("specification without pack").alias("kind"), F.col("file").alias("name")))
