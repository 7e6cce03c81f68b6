"""The rule catalogue itself as named queries: a run made of the driver's tables, with SQL for what each rule finds.

Labelled documents are the run's documents: quality is their polarity, length
their difficulty. Toxic ones, and some languages, carry faults, so that rules
have something to find. No document is left out but those without a label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans import rules as R
from corvane.plans.fields import REQUIRED
from corvane.sources.land import CONTEXT_FIELDS, WINDOW_FIELDS, WINDOWS, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OUT = ["rule", "category", "scope", "title", "status", "checked", "bad"]
VERSION, OLD = "Version_20250101_1200", "Version_20240101_0000"


def record(spark: SparkSession, d: str) -> DataFrame:
    """One row for each labelled document; RECORD is the same in SQL."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = docs.join(spark.read.parquet(f"{d}/labels.parquet").where("quality is not null"), "doc_id").withColumnRenamed("doc_id", "n")
    made = {
        "tox": "coalesce(toxic = 1, false)", "pol": "if(quality = 1, 'Positive', 'Negative')", "stem": "concat('doc', n)",
        "ext": "case lang when 'de' then 'docx' when 'fr' then 'pdf' else 'txt' end", "filename": "concat(if(tox, 'a/', ''), stem, '.', ext)",
        "file_format": "case lang when 'es' then 'fixed_width' when 'fr' then 'doc' else ext end", "hardness": "if(n_chars < 2000, 'easy', 'hard')",
        "sit_category": "if(tox, 'odd', concat(hardness, ' ', lower(pol)))", "persona": "if(n_chars > 5000, '', 'p')",
        "scenario": "case when n_chars < 200 then null when tox then 'other' else concat(source, '-case') end", "form": "concat_ws(' ', source, lang)",
        "sentence": r"regexp_extract(coalesce(text, ''), '^[^.]+\\.', 0)", "value": "if(tox and sentence <> '', concat(sentence, '§§'), sentence)",
        "norm": "case when sentence = '' then '§ absent §' when lang = 'de' then sentence else value end",
        "place": "locate(sentence, coalesce(text, '')) - 1 + if(lang = 'fr', 1, 0)",
    }
    for name, sql in made.items():
        rows = rows.withColumn(name, F.expr(sql))
    return rows


RECORD = r"""base AS (SELECT doc_id AS n, text, lang, source, n_chars, quality, coalesce(toxic = 1, false) AS tox, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS pol,
    'doc' || doc_id AS stem, CASE lang WHEN 'de' THEN 'docx' WHEN 'fr' THEN 'pdf' ELSE 'txt' END AS ext,
    CASE WHEN n_chars < 2000 THEN 'easy' ELSE 'hard' END AS hardness, regexp_extract(coalesce(text, ''), '^[^.]+\.') AS sentence
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
rec AS (SELECT *, CASE lang WHEN 'es' THEN 'fixed_width' WHEN 'fr' THEN 'doc' ELSE ext END AS file_format, CASE WHEN tox THEN 'odd' ELSE hardness || ' ' || lower(pol) END AS sit_category,
    CASE WHEN n_chars > 5000 THEN '' ELSE 'p' END AS persona, CASE WHEN n_chars < 200 THEN NULL WHEN tox THEN 'other' ELSE source || '-case' END AS scenario, concat_ws(' ', source, lang) AS form,
    CASE WHEN tox AND sentence <> '' THEN sentence || '§§' ELSE sentence END AS value, CASE WHEN sentence = '' THEN '§ absent §' WHEN lang = 'de' THEN sentence WHEN tox THEN sentence || '§§' ELSE sentence END AS norm, instr(coalesce(text, ''), sentence) - 1 + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS place,
    'Agreements / ' || pol AS scope FROM base)"""


def variant(**columns: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()])))


def derived(spark: SparkSession, d: str) -> Tables:
    r, c, text = record(spark, d), F.col, F.lit("Agreements").alias("folder_set")
    who, tox, positive = [text, c("pol").alias("polarity")], c("tox"), c("quality") == 1
    values = lambda there: F.when(there, F.struct(F.array("form").alias("number")))
    own = {
        "doc_id": c("n").cast("string"), "stem": c("stem"), "filename": c("filename"), "file_ext": F.concat(F.lit("."), "ext"), "file_format": c("file_format"), "sit_name": c("source"), "sit_category": c("sit_category"),
        "label": F.lower("pol"), "language": c("lang"), "domain": c("source"), "department": c("lang"), "persona": c("persona"), "scenario_id": c("scenario"), "sit_values": values(positive | tox), "lookalike_values": values(~positive | tox),
        "raw_doc": F.concat(F.lit("/data/"), F.when(tox, OLD).otherwise(VERSION), F.lit("/"), "filename"),
    }
    instance = F.struct(
        own["doc_id"].alias("doc_id"), c("value"), c("norm").alias("normalized_value"), c("place").alias("value_start_offset"), (c("place") + F.length("value")).alias("value_end_offset"), c("hardness").alias("difficulty"),
        F.when(c("lang") == "en", "True").otherwise("False").alias("keyword_present"), F.lit("the").alias("keyword"), F.lit("10").alias("keyword_distance"), F.lit("after").alias("keyword_direction"),
        positive.alias("expected_engine_match"), (positive & ~tox).alias("actual_engine_match"), (positive & ~tox).alias("semantic_ground_truth"), F.when(tox, "x").alias("chunk_label"),
        F.struct(F.when(c("lang").isin("en", "de"), "mandatory").otherwise("optional").alias("keyword_requirement")).alias("sit_extensions"),
    )
    metadata = r.select(*who, F.concat("stem", F.lit(".json")).alias("name"), variant(**own, instances=F.array(instance)).alias("v"), F.lit(None).cast("string").alias("error"))
    line = [text, c("n").alias("line")]
    fine = F.lit(False).alias("bad")
    combined = r.select(*line, variant(**own | {"language": F.when(tox, F.upper("lang")).otherwise(c("lang"))}).alias("v"), fine)
    corpus = r.where("lang is null or lang <> 'fr'").select(*line, variant(**own | {"scenario_id": F.when(c("lang") == "de", "x").otherwise(c("scenario"))}).alias("v"), fine)
    said = {
        "sit_name": c("source"), "confidence": F.when(c("lang") == "es", "85d").otherwise("0.5"), "doc_path": F.concat(F.lit("/x/"), "filename"), "value": c("value"), "doc_content_length": c("n_chars"), "detected_sit_start_index": c("place"),
        "detected_sit_end_index": c("place") + F.length("value") - 1, "language": c("lang"), "ground_truth": positive.cast("string"), "sit_category": F.when(c("lang") == "es", " Undetermined ").otherwise(c("sit_category")), "domain": c("source"), "doc_id": own["doc_id"],
    }
    none = F.lit(None).cast("variant")
    windows = {w: none for w in WINDOWS} | {"context_100": variant(text=F.substring("text", 1, 100), language=c("lang"))}
    context = r.select(text, F.lit("all.json").alias("name"), c("n").alias("pos"), F.lit(None).cast("string").alias("_corrupt_record"), *[said.get(k, none).cast("variant").alias(k) for k in CONTEXT_FIELDS], *[w.alias(k) for k, w in windows.items()])
    total = r.agg(F.count("*").alias("n"), F.count_if(positive).alias("pos"))
    counts = F.struct(c("pos").alias("positive"), (c("n") - c("pos")).alias("negative"), (c("n") + 1).alias("total"))
    one = [F.lit(None).cast("string").alias("error")]
    summary = total.select(text, F.lit("export_summary.json").alias("name"), variant(sit_name=F.lit("all"), version=F.lit(VERSION), output_dir=F.lit(f"/data/{OLD}"), counts=counts).alias("v"), *one)
    snippets = r.select(*who, F.concat("stem", F.lit("."), "ext", F.lit(".json")).alias("name"), F.coalesce(c("lang") != "es", F.lit(True)).alias("has_label"), (positive != tox).alias("label"), (c("n_chars") >= 500).alias("found"))
    own_name = F.concat("stem", F.lit("."), "ext")
    texts = r.select(*who, own_name.alias("filename"), "text").unionByName(r.where("tox").select(*who, "filename", "text"))
    of_area = lambda area, rows, name, size: rows.select(*who, F.lit(area).alias("area"), name.alias("name"), size.alias("size"), F.lit(False).alias("is_dir"))
    one_byte = F.lit(1).cast("long")
    files = R.union([
        of_area("raw_doc", r, own_name, c("n_chars")), of_area("metadata", r, F.concat(F.when(tox, "x").otherwise(""), "stem", F.lit(".json")), one_byte),
        of_area("parsed_raw_doc", r.where("lang is null or lang <> 'fr'"), F.concat("stem", F.lit(".json")), one_byte), of_area("parsed_raw_doc/chunks", r.where("n_chars >= 200"), F.concat(own_name, F.lit(".json")), one_byte),
        of_area("parsed_raw_doc/plain_text", r, F.concat(own_name, F.lit(".txt")), one_byte),
    ])
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.lit("Disagreements").alias("folder_set"), F.monotonically_increasing_id().alias("line"), variant(chunk_label=c("role")).alias("v"), F.coalesce(c("role") == "system", F.lit(False)).alias("bad"), "role")
    tally = turns.agg(F.count("*").alias("n"), F.count_if(c("role") == "user").alias("u"), F.count_if(c("role") == "assistant").alias("a"))
    graded = tally.select(F.lit("Disagreements").alias("folder_set"), F.lit("chunk_summary.json").alias("name"), variant(total_chunk_value_records=c("n"), agreements=c("u"), disagreements=c("a"), agreement_rate=F.lit(0.5)).alias("v"), *one)
    chunks_of = lambda rows: rows.select(text, c("source").alias("entity"), "value", "filename", variant(chunk_id=F.when(~tox, c("n")), chunk_content=F.substring("text", 1, 100), polarity=F.when(c("lang") == "es", "x")).alias("chunk"), F.lit(False).alias("broken"))
    chunks, merged = chunks_of(r), chunks_of(r.where("lang is null or lang <> 'de'"))
    empty = summary.limit(0)
    return Tables(
        spark, files, summary, empty, metadata, texts, snippets, combined, corpus, context, chunks, empty, turns.drop("role"), turns.drop("role"), graded,
        combined.withColumn("polarity", F.lit("")).limit(0), {"Agreements": VERSION, "Disagreements": VERSION}, empty, turns.drop("role").limit(0),
        merged, summary.select(text, F.lit("sit_merged_index.json").alias("name"), F.parse_json(F.lit("[]")).alias("v"), *one), metadata.select("folder_set", "polarity", F.lit("parsed_raw_doc").alias("area"), "name", "error").limit(0),
    )


def tests_sql(source: str, category: str, tests: list[tuple], scope: str = "scope", silent: bool = True) -> str:
    """tests: (rule, title, condition that is bad, condition among which, status if there are bad ones)."""
    parts = []
    for rule, title, bad, among, status in tests:
        quoted = title.replace("'", "''")
        parts.append(
            f"SELECT '{rule}' AS rule, '{category}' AS category, {scope} AS scope, '{quoted}' AS title, CASE WHEN count(*) FILTER (({among}) AND ({bad})) > 0 THEN '{status}' ELSE 'PASS' END AS status, "
            f"count(*) FILTER ({among}) AS checked, count(*) FILTER (({among}) AND ({bad})) AS bad FROM {source} GROUP BY {scope} HAVING count(*) FILTER ({among}) > 0"
        )
    return " UNION ALL ".join(parts)


def family(rules: Callable, *parts: str, more: str = "") -> None:
    name = f"rules_{rules.__name__}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rules(derived(spark, d), R.Options()).select(*OUT)

    QUERIES[name] = run
    ORACLES[name] = f"WITH {RECORD}{more} " + " UNION ALL ".join(parts)


ALL, ONE = "true", "'Agreements'"

family(R.schema, tests_sql("rec", "Metadata Schema Self-Consistency", [
    *[("SC1", f"{x} is stated", "false", ALL, "FAIL") for x in ("doc_id", "stem", "filename")],
    ("SC2", "filename has no folder", "tox", ALL, "FAIL"), ("SC3", "stem is the filename's", "false", ALL, "FAIL"), ("SC4", "file_ext is the filename's", "false", ALL, "FAIL"),
    ("SC5", "file_format is file_ext", "lang = 'fr'", ALL, "FAIL"),
]))

_pairs = "SELECT n, unnest([n::VARCHAR, stem, stem, ext, file_format, source, sit_category, pol, lang, source, lang, persona, scenario_c, stem]) AS value FROM "
_sides = [("K2", "positive rows have values", "false", "quality = 1", "FAIL"), ("K3", "positive rows have no lookalikes", "tox", "quality = 1", "FAIL"), ("K4", "negative rows have no values", "tox", "quality <> 1", "FAIL"), ("K5", "negative rows have lookalikes", "false", "quality <> 1", "FAIL")]
family(R.corpus_fields, *[
    tests_sql(source, "5. corpus.jsonl Field Completeness", tests, f"'Agreements / {name}'")
    for name in ("corpus", "combined_metadata") for source, tests in ((f"{name}_pairs", [("K1", "no field is empty", "value = ''", "value IS NOT NULL", "FAIL")]), (f"{name}_rows", _sides))
], more=f""", corpus_rows AS (SELECT *, CASE WHEN lang = 'de' THEN 'x' ELSE scenario END AS scenario_c FROM rec WHERE lang IS NULL OR lang <> 'fr'), combined_metadata_rows AS (SELECT *, scenario AS scenario_c FROM rec),
corpus_pairs AS ({_pairs} corpus_rows), combined_metadata_pairs AS ({_pairs} combined_metadata_rows)""")  # fmt: skip

_business = [k for k in R.DIMENSIONS if k != "format"]
_of = {"domain": "source", "department": "lang", "persona": "persona"}
_forms = lambda where: f"SELECT regexp_replace(lower(form), '[^a-z0-9]+', '', 'g') AS f, count(*) AS n, min(d) AS low, max(d) AS high FROM (SELECT *, CASE WHEN tox THEN 'unknown' ELSE hardness END AS d FROM rec WHERE {where}) GROUP BY 1"
_shapes = lambda rule, side: [(rule, f"{side} values are used once", "n > 1", ALL, "PASS"), *[(rule, f"no {side} value is reused, {k}", f"n > 1 AND {at}", ALL, "PASS") for k, at in (("easy", "low = 'easy' AND high = 'easy'"), ("hard", "low = 'hard' AND high = 'hard'"), ("mixed", "NOT (low = high AND low IN ('easy', 'hard'))"))]]
family(
    R.composition,
    tests_sql("one", "Label Distribution", [("D1", "labels cover all documents", "n <> total", ALL, "FAIL")], ONE),
    tests_sql("rec", "Label Distribution", [("D2", "every document has a known label", "tox", ALL, "PASS")], ONE),
    tests_sql("one", "Document Format Distribution", [("D3", "formats cover all documents", "n <> total", ALL, "FAIL")], ONE),
    tests_sql("formats", "Document Format Distribution", [("D3", "every document has a format", "file_format = 'unknown'", ALL, "PASS")], ONE),
    tests_sql("shares", "Business Context Balance", [(f"D{4 + i}", f"no {k} holds 80 % of the documents or more", "share >= 0.8", f"k = '{k}'", "PASS") for i, k in enumerate(_business)], ONE),
    tests_sql("positive_forms", "SIT Value Reuse", _shapes("D12", "positive"), ONE), tests_sql("negative_forms", "SIT Value Reuse", _shapes("D13", "negative"), ONE),
    more=", one AS (SELECT count(*) AS n, count(*) + 1 AS total FROM rec), formats AS (SELECT DISTINCT coalesce(nullif(trim(lower(file_format)), ''), 'unknown') AS file_format FROM rec), shares AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS k, max(c) / sum(c) AS share FROM (SELECT coalesce(nullif(trim({_of.get(k, 'NULL::VARCHAR')}), ''), '(missing)') AS v, count(*) AS c FROM rec GROUP BY 1)" for k in _business)
    + f"), positive_forms AS ({_forms('quality = 1 OR tox')}), negative_forms AS ({_forms('quality <> 1 OR tox')})",
)

_given = {"doc_id": "false", "value": "value = ''", "normalized_value": "norm = ''", "value_end_offset": "false", "difficulty": "false"}
family(
    R.instances,
    tests_sql("rec", "Metadata Instance Fields", [*[("N1", f"{f} is never empty", _given.get(f, "true"), ALL, "FAIL") for f in REQUIRED], ("N7", "a keyword goes with keyword_present", "lang IS DISTINCT FROM 'en'", ALL, "FAIL")]),
    tests_sql("(SELECT *, bool_or(tox) OVER (PARTITION BY pol) AS used FROM rec)", "Metadata Instance Fields", [("N2", "chunk_label is never empty where it is used", "NOT tox", "used", "FAIL")]),
    tests_sql("rec", "8. Metadata / Engine / Chunk labels", [("M2", "the engine is expected to match", "false", "quality = 1", "FAIL"), ("M3", "the engine does what is expected", "quality = 1 AND tox", ALL, "WARN")]),
    tests_sql("rec", "10. Keyword / semantic_ground_truth", [("W1", "semantic truth is the polarity", "quality = 1 AND tox", ALL, "FAIL"), ("W2", "mandatory keywords are there", "lang = 'de'", "quality = 1 AND lang IN ('en', 'de')", "FAIL")]),
)

_label, _found = "((quality = 1) <> tox)", "(n_chars >= 500)"
family(
    R.snippets,
    tests_sql("rec", "8. Metadata / Engine / Chunk labels", [
        ("M4", "positive documents have a labelled chunk", f"NOT {_label}", "quality = 1", "FAIL"), ("M5", "positive documents have a chunk with a finding", f"NOT {_found}", "quality = 1", "FAIL"), ("M6", "negative documents have no labelled chunk", _label, "quality <> 1", "FAIL"),
        ("M9", "no document has several findings", "false", ALL, "PASS"), ("M7", "every chunk has a label", "lang = 'es'", ALL, "FAIL"), ("M8", "chunks with a finding have the polarity's label", "tox", f"{_found} AND lang IS DISTINCT FROM 'es'", "FAIL"),
    ]),
    tests_sql("rec", "MCE Detection Coverage", [("MCE", "every document has a finding", f"NOT {_found}", ALL, "FAIL")], "pol"),
)

family(R.combined_join, tests_sql("rec", "combined_metadata.jsonl vs Individual metadata.json Join", [
    ("J1", "sit_name agrees", "false", "source IS NOT NULL", "FAIL"), ("J1", "language agrees", "tox AND upper(lang) <> lang", "lang IS NOT NULL", "FAIL"),
    *[("J1", f"{f} agrees", "false", ALL, "FAIL") for f in ("sit_category", "label", "filename", "stem", "file_ext", "file_format")],
], ONE))

# The value, else what it was normalized to; of toxic documents the first is never in the text, in German the second is.
_near = "contains(lower(substring(text, instr(text, said) + length(said), 250)), 'the')"
family(
    R.content,
    tests_sql("texts", "9b. Content Verification", [
        ("V1", "the value is in the text", "instr(text, said) = 0", "said <> ''", "FAIL"),
        ("V2", "mandatory keywords stand near the value", f"NOT {_near}", "quality = 1 AND lang IN ('en', 'de') AND said <> '' AND instr(text, said) > 0", "FAIL"),
        ("V3", "keyword_present is what the text says", f"{_near} <> coalesce(lang = 'en', false)", "said <> '' AND instr(text, said) > 0", "WARN"),
    ]),
    tests_sql("texts", "Instance Value Offset Accuracy", [
        ("O1", "offsets lead to the value", "substring(text, place + 1, length(value)) <> value AND instr(text, value) = 0", "value <> ''", "FAIL"),
        ("O1", "no offset has drifted", "substring(text, place + 1, length(value)) <> value AND instr(text, value) > 0", "value <> ''", "PASS"),
    ]),
    more=", texts AS (SELECT *, regexp_replace(CASE WHEN value <> '' THEN value ELSE norm END, '^\\s+|\\s+$', '', 'g') AS said FROM rec WHERE text IS NOT NULL)",
)

_scope = "'Agreements / all.json'"
_said = {"sit_name": "source", "doc_path": "'x'", "value": "value", "language": "lang", "domain": "source", "ground_truth": "'x'", "sit_category": "'x'", "doc_id": "'x'", "confidence": "'x'", "doc_content_length": "n_chars::VARCHAR", "detected_sit_start_index": "'0'", "detected_sit_end_index": "'0'"}
_used = lambda k: f"(SELECT count({_said[k]}) > 0 FROM rec)" if k in _said else "false"
family(
    R.context,
    tests_sql("rec", "3. context_output_normalized", [("C0", "the file is a readable array", "false", ALL, "FAIL")], _scope),
    tests_sql("one", "3. context_output_normalized", [("C1", "as many records as documents", "n < total", ALL, "FAIL")], _scope),
    tests_sql("rec", "3. context_output_normalized", [
        ("C2", "category is stated", "lang = 'es'", ALL, "FAIL"), ("C3", "confidence is in the schema", "false", ALL, "FAIL"), ("C6", "confidence is a number", "lang = 'es'", ALL, "FAIL"),
        *[("C5", f"{k} is never empty", f"coalesce({_said[k]}, '') = ''", _used(k), "FAIL") for k in CONTEXT_FIELDS if k in _said],
        *[("C5", f"context_100.{k} is never empty", {"text": "coalesce(text, '') = ''", "language": "coalesce(lang, '') = ''"}.get(k, "true"), ALL, "FAIL") for k in WINDOW_FIELDS],
    ], _scope),
    tests_sql("one", "3. context_output_normalized", [("C4", f"{k} is in the schema", f"NOT {_used(k)}", ALL, "PASS") for k in CONTEXT_FIELDS if k != "confidence"], _scope),
    tests_sql("langs", "3. context_output_normalized", [("C7", "one language is spoken", "lang <> (SELECT arg_max(lang, (n, lang)) FROM langs)", ALL, "PASS")], _scope),
    tests_sql("(SELECT lang FROM rec WHERE coalesce(lang, '') <> '')", "3. context_output_normalized", [("C8", "all records are in one language", "lang <> (SELECT arg_max(lang, (n, lang)) FROM langs)", ALL, "WARN")], _scope),
    more=", one AS (SELECT count(*) AS n, count(*) + 1 AS total FROM rec), langs AS (SELECT lang, count(*) AS n FROM rec WHERE coalesce(lang, '') <> '' GROUP BY lang)",
)

_slug = lambda x: f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_has, _there = "coalesce(scenario <> '', false)", "(lang IS NULL OR lang <> 'fr')"
family(R.scenarios, tests_sql("rec", "Scenario ID Consistency", [
    ("Q1", "documents have a scenario", f"NOT {_has}", ALL, "FAIL"), ("Q2", "the scenario begins with the entity's name", f"NOT starts_with(regexp_replace({_slug('scenario')}, '(-[0-9a-f]{{1,16}})+$', ''), {_slug('source')})", f"{_has} AND {_slug('source')} <> ''", "PASS"),
    ("Q3", "the scenario is the corpus row's", "lang = 'de'", f"{_has} AND {_there}", "FAIL"), ("Q5", "documents have a corpus row", f"NOT {_there}", _has, "WARN"),
    ("Q4", "the scenario is the combined row's", "false", _has, "FAIL"), ("Q6", "documents have a combined row", "false", _has, "WARN"),
], ONE))

family(
    R.version_paths,
    tests_sql("(SELECT 1)", "Version Path Consistency", [("Y1", "output_dir has the version", "true", ALL, "FAIL")], ONE),
    tests_sql("rec", "Version Path Consistency", [("Y2", "raw_doc has the version", "tox", ALL, "FAIL")]),
)

family(R.integrity, tests_sql("sized", "Integrity", [("Z1", "no empty files", "n_chars = 0", ALL, "FAIL")], ONE), tests_sql("rec", "Integrity", [("Z2", "metadata is JSON", "false", ALL, "FAIL")]),
    more=", sized AS (SELECT n_chars FROM rec UNION ALL SELECT 1 FROM rec UNION ALL SELECT 1 FROM rec UNION ALL SELECT 1 FROM rec WHERE lang IS NULL OR lang <> 'fr' UNION ALL SELECT 1 FROM rec WHERE n_chars >= 200)")

family(R.grader, tests_sql("g", "SITGrader Consistency", [
    ("T1", "the summary is readable", "false", ALL, "FAIL"), ("T2", "agreements and disagreements add up", "u + a <> n", ALL, "FAIL"), ("T3", "the rate is a share", "false", ALL, "FAIL"), ("T4", "the rate is what the counts give", "abs(0.5 - u / n) > 0.01", "n > 0", "WARN"),
    ("T5", "no grade is malformed", "s > 0", "n > 0", "FAIL"), ("T6", "there is a grade for each record", "false", "n > 0", "FAIL"), ("T10", "evaluations are readable and complete", "s > 0", "n > 0", "FAIL"),
    ("T7", "the second summary is readable", "true", ALL, "FAIL"), ("T13", "the manifest is there", "true", ALL, "FAIL"),
], "'Disagreements'"), more=", g AS (SELECT count(*) AS n, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'system') AS s FROM conversations)")

family(
    R.index,
    tests_sql("rec", "4. Index files", [("I1", "no chunk has a polarity", "lang = 'es'", ALL, "FAIL"), ("I3", "chunks have an id and content", "tox OR coalesce(text, '') = ''", ALL, "FAIL")], ONE),
    tests_sql("(SELECT count(*) AS n, (SELECT count(*) + 1 FROM rec) AS total FROM (SELECT DISTINCT source, value FROM rec WHERE source IS NOT NULL))", "4. Index files", [("I2", "one value for each document", "n <> total", ALL, "FAIL")], ONE),
)

# The merged index lacks German documents, and its file is an array.
_prefix = "merged index: "
family(
    R.merged_index,
    tests_sql("(SELECT 1)", "4. Index files", [("I0", f"{_prefix}the index is a JSON object", "true", ALL, "FAIL")], ONE),
    tests_sql("held", "4. Index files", [("I1", f"{_prefix}no chunk has a polarity", "lang = 'es'", ALL, "FAIL"), ("I3", f"{_prefix}chunks have an id and content", "tox OR coalesce(text, '') = ''", ALL, "FAIL")], ONE),
    tests_sql("(SELECT count(*) AS n, (SELECT count(*) + 1 FROM rec) AS total FROM (SELECT DISTINCT source, value FROM held WHERE source IS NOT NULL))", "4. Index files", [("I2", f"{_prefix}one value for each document", "n <> total", ALL, "FAIL")], ONE),
    more=", held AS (SELECT * FROM rec WHERE lang IS NULL OR lang <> 'de')",
)

# Metadata of toxic documents has another name, French ones aren't parsed, short ones have no chunks.
_parity = "9. raw_doc Parity & Identity"
family(
    R.parity,
    *[tests_sql(f"(SELECT scope, unnest([{key}, {other}]) AS missing FROM rec)", _parity, [(rule, f"raw_doc and {area} have the same documents", "missing = 1", "missing IS NOT NULL", "FAIL")]) for rule, area, key, other in (
        ("R2", "metadata", "CASE WHEN tox THEN 1 ELSE 0 END", "CASE WHEN tox THEN 1 END"), ("R3", "parsed_raw_doc", "CASE WHEN lang = 'fr' THEN 1 ELSE 0 END", "NULL"),
        ("R4", "parsed_raw_doc/chunks", "CASE WHEN n_chars < 200 THEN 1 ELSE 0 END", "NULL"), ("R5", "parsed_raw_doc/plain_text", "0", "NULL"),
    )],
    *[tests_sql("rec", _parity, [(rule, f"{a} and {b} have no document in common", "false", among, "FAIL")], "'all'") for rule, a, b, among in (
        ("R8", "Agreements/Positive", "Agreements/Negative", ALL), ("R9", "Agreements/Positive", "Disagreements/Positive", "quality = 1"), ("R10", "Agreements/Positive", "Disagreements/Negative", "quality = 1"),
        ("R11", "Agreements/Negative", "Disagreements/Positive", "quality <> 1"), ("R12", "Agreements/Negative", "Disagreements/Negative", "quality <> 1"),
    )],
    tests_sql("(SELECT scope, count(DISTINCT source) AS names FROM early WHERE NOT tox GROUP BY scope)", _parity, [("R7", "one entity in the first 200 documents", "names > 1", ALL, "FAIL")]),
    more=", early AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN tox THEN 'x' ELSE '' END || stem || '.json') <= 200)",
)

_counted = "(SELECT count(*) AS n, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (lang IS NULL OR lang <> 'fr') AS corpus, count(*) FILTER (quality = 1 AND (lang IS NULL OR lang <> 'fr')) AS corpus_pos FROM rec)"
family(
    R.summary,
    tests_sql(_counted, "5. export_summary.json ground truth", [
        ("E0", "the summary is a JSON object", "false", ALL, "FAIL"), *[("E1", f"{k} is stated", "false", ALL, "FAIL") for k in ("sit_name", "version", "output_dir", "counts")], ("E2", "version is the version folder's name", "false", ALL, "FAIL"),
        *[("E3", f"counts.{k} is a whole number", "false", ALL, "FAIL") for k in ("positive", "negative", "total")], ("E4", "positive and negative add up", "true", ALL, "FAIL"),
        ("E10", "positive files are counted", "false", ALL, "FAIL"), ("E11", "negative files are counted", "false", ALL, "FAIL"), ("E12", "all files are counted", "true", ALL, "FAIL"),
    ], ONE),
    tests_sql(_counted, "6-7. corpus.jsonl / combined_metadata.jsonl counts", [
        x for k, n, pos in (("corpus", "corpus", "corpus_pos"), ("combined", "n", "pos")) for x in (
            ("E13", f"{k} has no malformed line", "false", ALL, "FAIL"), ("E14", f"{k} has a line for each document", f"{n} < n + 1", ALL, "FAIL"), ("E15", f"{k} has the labels of the summary", f"{pos} <> pos OR {n} - {pos} <> n - pos", ALL, "FAIL"),
        )
    ], ONE),
)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """What the rules on documents find, and a last row with the verdict."""
    t = derived(spark, d)
    rows = R.union([rules(t, R.Options()).select(*OUT) for rules in (R.schema, R.corpus_fields, R.composition, R.instances, R.snippets, R.combined_join, R.content, R.scenarios)])
    status = F.col("status")
    ready = F.when(F.bool_or(status == "FAIL"), "NOT READY").when(F.bool_or(status == "WARN"), "READY WITH WARNINGS").otherwise("READY")
    total = rows.agg(F.lit("verdict").alias("rule"), F.lit("all").alias("category"), F.lit("run").alias("scope"), F.lit("the verdict").alias("title"), ready.alias("status"), F.count("*").alias("checked"), F.count_if(status != "PASS").alias("bad"))
    return rows.unionByName(total)
