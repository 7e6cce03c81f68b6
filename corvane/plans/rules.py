"""The rule catalogue. Rules on one table are conditional aggregates of one pass over it.

A rule gives rows (rule, category, scope, title, status, checked, bad, examples).
A rule that has nothing to check gives none. Counts are exact; examples are the
least and the greatest offender.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators import joins as J
from corvane.operators import samples as S
from corvane.sources.land import CONTEXT_FIELDS, WINDOW_FIELDS, WINDOWS, Tables

COLUMNS = ["rule", "category", "scope", "title", "status", "checked", "bad", "examples"]


@dataclass(frozen=True)
class Options:
    """sample_size: metadata documents that document rules look at in each polarity; None for all."""

    ratio: float = 1.0
    sample_size: int | None = None


Rules = Callable[[Tables, Options], DataFrame]
CATALOGUE: list[Rules] = []


def rules(f: Rules) -> Rules:
    CATALOGUE.append(f)
    return f


@dataclass(frozen=True)
class Test:
    rule: str
    title: str
    bad: Column
    among: Column | None = None
    status: str = "FAIL"
    silent: bool = True


def judged(df: DataFrame, category: str, tests: list[Test], example: Column, by: tuple[str, ...] = ("folder_set",)) -> DataFrame:
    """All tests in one aggregate by scope; a test with nothing to check is left out, or passes if it isn't silent."""
    aggs = []
    for i, t in enumerate(tests):
        among = F.lit(True) if t.among is None else F.coalesce(t.among, F.lit(False))
        hit = among & F.coalesce(t.bad, F.lit(False))
        shown = F.when(hit, example.cast("string"))
        aggs += [F.count_if(among).alias(f"c{i}"), F.count_if(hit).alias(f"b{i}"), F.min(shown).alias(f"x{i}"), F.max(shown).alias(f"y{i}")]
    one = df.groupBy(*by).agg(*aggs)
    rows = [
        F.struct(F.lit(t.rule).alias("rule"), F.lit(t.title).alias("title"), F.lit(t.status).alias("worst"), F.lit(t.silent).alias("silent"), F.col(f"c{i}").alias("checked"), F.col(f"b{i}").alias("bad"), F.array_distinct(F.array_compact(F.array(f"x{i}", f"y{i}"))).alias("examples"))
        for i, t in enumerate(tests)
    ]
    out = one.select(F.concat_ws(" / ", *by).alias("scope"), F.inline(F.array(*rows))).where("checked > 0 or not silent")
    return out.select("rule", F.lit(category).alias("category"), "scope", "title", F.when(F.col("bad") > 0, F.col("worst")).otherwise("PASS").alias("status"), "checked", "bad", "examples")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


BOTH = ("folder_set", "polarity")


def field(name: str, kind: str = "string", v: str = "i") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def raw(name: str, v: str = "i") -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def sampled(t: Tables, options: Options, df: DataFrame) -> DataFrame:
    """Rows of the metadata files that a seeded draw picks in each polarity."""
    if options.sample_size is None:
        return df
    picked = []
    for keys in t.metadata.select(*BOTH).distinct().collect():  # at most four
        names = t.metadata.where((F.col("folder_set") == keys.folder_set) & (F.col("polarity") == keys.polarity)).select(*BOTH, "name")
        picked.append(S.seeded_sample(names, ["name"], options.sample_size))
    return df.join(union(picked), [*BOTH, "name"], "left_semi") if picked else df


# --- 1-2. folders and files ---

FOLDERS = [("S8", "raw_doc"), ("S9", "metadata"), ("S10", "parsed_raw_doc"), ("S11", "parsed_raw_doc/chunks"), ("S12", "parsed_raw_doc/plain_text")]
FILES = [("S3", "combined_metadata.jsonl"), ("S4", "corpus.jsonl"), ("S5", "export_summary.json"), ("S6", "sit_inverted_index.json")]


def folder_sets(t: Tables) -> DataFrame:
    there = t.files.where("area = '' and is_dir and name in ('Positive', 'Negative') and polarity is null").select("folder_set").distinct()
    return there.union(t.spark.createDataFrame([("Agreements",)], "folder_set string")).distinct()


@rules
def structure(t: Tables, options: Options) -> DataFrame:
    tops = t.files.where("polarity is null").groupBy("folder_set").agg(
        F.collect_set(F.when(F.expr("area = '' and not is_dir"), F.col("name"))).alias("names"),
        F.count_if(F.expr("not is_dir and name like '%.json' and area in ('context_output_normalized', 'context_output_normalised')")).alias("contexts"),
        F.count_if(F.expr("is_dir and name like 'chunk_run_%' and area = 'SITGrader'")).alias("grades"),
        F.max(F.when(F.expr("is_dir and name like 'chunk_run_%' and area = 'SITGrader'"), F.col("name"))).alias("latest"),
        F.count_if(F.expr("is_dir and name = 'misc' and area = 'SITGrader'")).alias("misc"),
        F.count_if(F.expr("is_dir and name like 'run_benchmark_%' and area = 'SITGrader'")).alias("legacy"),
    )
    sets = folder_sets(t).join(tops, "folder_set", "left")
    tests = [Test(r, f"{n} is there", ~F.coalesce(F.array_contains("names", n), F.lit(False))) for r, n in FILES]
    tests.append(Test("S7", "context records are there", F.coalesce("contexts", F.lit(0)) == 0))
    late = F.col("folder_set") == "Disagreements"
    tests.append(Test("S13", "grader output is there", (F.coalesce("grades", F.lit(0)) + F.coalesce("legacy", F.lit(0)) == 0) | (F.coalesce("misc", F.lit(0)) == 0), late))
    areas = t.files.where("is_dir and polarity is not null").select(*BOTH, F.concat_ws("/", F.nullif("area", F.lit("")), "name").alias("area"))
    had = areas.groupBy(*BOTH).agg(F.collect_set("area").alias("areas"))
    every = folder_sets(t).select("folder_set", F.explode(F.array(F.lit("Positive"), F.lit("Negative"))).alias("polarity")).join(had, list(BOTH), "left")
    inner = [Test(r, f"{n}/ is there", ~F.coalesce(F.array_contains("areas", n), F.lit(False))) for r, n in FOLDERS]
    again = [Test("M1", "SITGrader has one chunk_run folder; the latest counts", F.col("grades") > 1, late & (F.col("grades") > 1), status="WARN")]
    version = F.when(late, t.versions["Disagreements"]).otherwise(t.versions["Agreements"])
    tests.append(Test("S2", "the version folder is named by its date", ~version.rlike(f"^{X.VERSION}$")))
    tests.append(Test("S14", "grader output lies in Disagreements alone", F.coalesce("grades", F.lit(0)) + F.coalesce("misc", F.lit(0)) > 0, ~late & (F.coalesce("grades", F.lit(0)) + F.coalesce("misc", F.lit(0)) > 0), "PASS"))
    return judged(sets, "1-2. Folder Structure", tests, F.col("folder_set")).unionByName(judged(sets, "8. Metadata / Engine / Chunk labels", again, F.col("latest"))).unionByName(judged(every, "1-2. Folder Structure", inner, F.col("polarity"), BOTH))


ALLOWED_FOLDERS = ["Positive", "Negative", "Disagreements", "context_output_normalized", "context_output_normalised", "SITGrader"]
ALLOWED_FILES = r"^(generation_log\.json|export_summary\.json|combined_metadata\.jsonl|corpus\.jsonl|sit_inverted_index\.json|mce_.*\.jsonl|mce_.*\.csv|semantic_.*\.jsonl|sit_grader_.*\.csv|.*_sit_values\.csv|.*\.html|.*_report\.json|.*\.log)$"


@rules
def hygiene(t: Tables, options: Options) -> DataFrame:
    top = (F.col("area") == "") & F.col("polarity").isNull() & ~F.col("name").rlike(r"^[_.]")
    tops = [Test("H1", "no unexpected folders", ~F.col("name").isin(ALLOWED_FOLDERS), top & F.col("is_dir")), Test("H2", "no unexpected files", ~F.col("name").rlike(ALLOWED_FILES), top & ~F.col("is_dir"))]
    stray = [Test("H3", "metadata/ holds only .json files", ~F.col("name").endswith(".json") & (F.col("name") != "index.jsonl"), (F.col("area") == "metadata") & ~F.col("is_dir"))]
    category = "Folder/File Hygiene"
    return judged(t.files, category, tops, F.col("name")).unionByName(judged(t.files.where("polarity is not null"), category, stray, F.col("name"), BOTH))


@rules
def integrity(t: Tables, options: Options) -> DataFrame:
    empty = [Test("Z1", "no empty files", F.col("size") == 0, ~F.col("is_dir"))]
    parsed = [Test("Z2", "metadata is JSON", F.col("error") == "malformed", F.coalesce(F.col("error") != "empty", F.lit(True)))]
    return judged(t.files, "Integrity", empty, F.col("name")).unionByName(judged(t.metadata, "Integrity", parsed, F.col("name"), BOTH))


GROUPS = ["raw_doc", "metadata", "parsed_raw_doc", "parsed_raw_doc/chunks", "parsed_raw_doc/plain_text"]


@rules
def file_groups(t: Tables, options: Options) -> DataFrame:
    """Files of each group of each polarity: none empty, and JSON where it should be."""
    by, name = (*BOTH, "area"), F.col("name")
    files = t.files.where(F.col("polarity").isNotNull() & ~F.col("is_dir") & F.col("area").isin(GROUPS) & (F.col("area").isin("raw_doc", "parsed_raw_doc/plain_text") | name.endswith(".json")))
    empty = [Test("Z3", "the group has no empty file", F.col("size") == 0)]
    parsed = [Test("Z4", "the group's files are JSON", F.col("error") == "malformed", F.coalesce(F.col("error") != "empty", F.lit(True)))]
    return judged(files, "Integrity", empty, name, by).unionByName(judged(t.inner, "Integrity", parsed, name, by))


@rules
def listings(t: Tables, options: Options) -> DataFrame:
    """What each polarity folder lists: its metadata, and documents whose names needn't carry a number."""
    had = t.files.where("polarity is not null").groupBy(*BOTH).agg(F.count_if(F.expr("area = 'metadata' and name = 'index.jsonl' and not is_dir")).alias("index"), F.count_if(F.expr("area = 'raw_doc' and not is_dir")).alias("documents"))
    tests = [Test("R1", "metadata/index.jsonl is there", F.col("index") == 0), Test("R6", "names carry no number: documents are identified by their metadata", F.lit(False), F.col("documents") > 0)]
    return judged(had, "9. raw_doc Parity & Identity", tests, F.col("polarity"), BOTH)


def stems(t: Tables, area: str) -> DataFrame:
    """(folder_set, polarity, full name, stem) of the documents that an area has files of."""
    full = {"raw_doc": F.col("name"), "metadata": None, "parsed_raw_doc": None}.get(area, F.regexp_replace("name", r"\.[^.]*$", ""))
    base = F.regexp_replace("name", r"\.[^.]*$", "")
    rows = t.files.where((F.col("area") == area) & ~F.col("is_dir") & (F.col("name") != "index.jsonl"))
    return rows.select(*BOTH, (base if full is None else full).alias("full"), (base if area in ("raw_doc", "metadata", "parsed_raw_doc") else X.stem(F.regexp_replace("name", r"\.[^.]*$", ""))).alias("stem"))


@rules
def parity(t: Tables, options: Options) -> DataFrame:
    out, category = [], "9. raw_doc Parity & Identity"
    documents = stems(t, "raw_doc")
    for rule, area, key in (("R2", "metadata", "stem"), ("R3", "parsed_raw_doc", "stem"), ("R4", "parsed_raw_doc/chunks", "full"), ("R5", "parsed_raw_doc/plain_text", "full")):
        a = documents.select(*BOTH, F.col(key).alias("key")).distinct().withColumn("l", F.lit(1))
        b = stems(t, area).select(*BOTH, F.col(key).alias("key")).distinct().withColumn("r", F.lit(1))
        out.append(judged(a.join(b, [*BOTH, "key"], "full_outer"), category, [Test(rule, f"raw_doc and {area} have the same documents", F.col("l").isNull() | F.col("r").isNull())], F.col("key"), BOTH))
    # Only of an index.jsonl that is there; a missing one is not reported.
    there = t.files.where("area = 'metadata' and name = 'index.jsonl' and not is_dir and polarity is not null").select(*BOTH).distinct()
    out.append(judged(t.listing, category, [Test("R1", "lines of metadata/index.jsonl are JSON", F.col("bad"))], F.col("line"), BOTH))
    listed = t.listing.where(X.is_object(F.col("v")) & X.is_truthy(raw("stem", "v"))).select(*BOTH, X.text_of(raw("stem", "v")).alias("key")).distinct().withColumn("l", F.lit(1))
    known = stems(t, "metadata").join(there, list(BOTH), "left_semi").select(*BOTH, F.col("stem").alias("key")).distinct().withColumn("r", F.lit(1))
    out.append(judged(listed.join(known, [*BOTH, "key"], "full_outer"), category, [Test("R1", "metadata/index.jsonl and metadata have the same documents", F.col("l").isNull() | F.col("r").isNull())], F.col("key"), BOTH))
    sides = documents.groupBy("stem").agg(F.collect_set(F.concat_ws("/", *BOTH)).alias("places"))
    # A name in two places; each pair of places is a rule of its own.
    names = [(f, p) for f in ("Agreements", "Disagreements") for p in ("Positive", "Negative")]
    pairs = [("R8", f"{f}/Positive", f"{f}/Negative") for f in ("Agreements", "Disagreements")]
    pairs += [(f"R{9 + i}", f"Agreements/{p}", f"Disagreements/{q}") for i, (p, q) in enumerate((p, q) for p in ("Positive", "Negative") for q in ("Positive", "Negative"))]
    has = {f"{f}/{p}": F.array_contains("places", f"{f}/{p}") for f, p in names}
    tests = [Test(r, f"{a} and {b} have no document in common", has[a] & has[b], has[a] | has[b]) for r, a, b in pairs]
    out.append(judged(sides.withColumn("folder_set", F.lit("all")), category, tests, F.col("stem")))
    first = t.files.where("area = 'metadata' and name like '%.json' and not is_dir")
    early = first.withColumn("turn", F.row_number().over(Window.partitionBy(*BOTH).orderBy("name"))).where("turn <= 200").select(*BOTH, "name")
    names_in = t.metadata.join(early, [*BOTH, "name"], "left_semi").groupBy(*BOTH).agg(F.count_distinct(field("sit_name", v="v")).alias("names"), F.count_distinct(field("entity_guid", v="v")).alias("guids"))
    out.append(judged(names_in, category, [Test("R7", "one entity in the first 200 documents", (F.col("names") > 1) | (F.col("guids") > 1))], F.col("names"), BOTH))
    return union(out)


# --- 3-4. context records and index ---


def _sources(t: Tables, odd: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(scope, examples): where the documents of context records lie: by the index's files of their value, else by name, else by path.

    Only values of these records are looked up; of several files the first and the last are named.
    """
    text = lambda c: F.nullif(X.text_of(F.col(c)), F.lit(""))
    rows = odd.select(*by, text("value").alias("value"), X.to_bool(F.col("ground_truth")).alias("true"), text("document_name").alias("named"), text("doc_path").alias("path"))
    wanted = rows.select("folder_set", "value").distinct()
    files = t.index.where("value is not null and filename is not null").join(wanted, ["folder_set", "value"], "left_semi").groupBy("folder_set", "value").agg(F.min("filename").alias("low"), F.max("filename").alias("high"))
    full = lambda n: F.concat(F.when(F.col("true"), "Positive").otherwise("Negative"), F.lit("/outputs/raw_doc/"), n)
    indexed = F.when(F.col("low").isNotNull(), F.concat_ws("; ", full(F.col("low")), F.when(F.col("low") != F.col("high"), full(F.col("high")))))
    place = F.coalesce(indexed, full(F.col("named")), F.concat(F.lit("(unverified) "), X.base_name(F.col("path"))), F.lit("(no document is named)"))
    found = rows.join(files, ["folder_set", "value"], "left").withColumn("place", place).groupBy(*by).agg(F.min("place").alias("a"), F.max("place").alias("b"))
    return found.select(F.concat_ws(" / ", *by).alias("scope"), F.array_distinct(F.array("a", "b")).alias("examples"))


@rules
def context(t: Tables, options: Options) -> DataFrame:
    category, by = "3. context_output_normalized", ("folder_set", "name")
    fine = F.col("_corrupt_record").isNull()
    there = t.context.where(fine).groupBy(*by).agg(*[F.bool_or(F.col(c).isNotNull()).alias(f"{c}_used") for c in CONTEXT_FIELDS])
    plain = t.context.where(fine)
    rows = plain.join(there, list(by))
    where = F.col("pos")
    category_text = F.lower(X.strip(X.text_of(F.col("sit_category"))))
    tests = [
        Test("C2", "category is stated", F.coalesce(category_text, F.lit("")).isin("", "undetermined")),
        Test("C3", "confidence is in the schema", ~F.col("confidence_used")),
        Test("C6", "confidence is a number", ~X.is_numeric(F.col("confidence")), F.col("confidence_used") & ~X.is_empty(F.col("confidence"))),
        *[Test("C5", f"{c} is never empty", X.is_empty(F.col(c)), F.col(f"{c}_used")) for c in CONTEXT_FIELDS],
        *[Test("C5", f"{w}.{s} is never empty", X.is_empty(raw(s, w)), F.col(w).isNotNull()) for w in WINDOWS for s in WINDOW_FIELDS],
    ]
    whole = judged(t.context, category, [Test("C0", "the file is a readable array", ~fine)], F.col("name"), by)
    language = F.coalesce(X.text_of(F.col("language")), *[F.try_variant_get(w, "$.language", "string") for w in WINDOWS])
    counted = plain.select(*by, language.alias("lang"), X.text_of(F.col("value")).alias("value")).where("lang is not null and lang <> ''")
    tally = counted.groupBy(*by, "lang").agg(F.count("*").alias("n"))
    main = tally.groupBy(*by).agg(F.max_by("lang", F.struct("n", "lang")).alias("main"))
    soft = judged(there, category, [Test("C4", f"{c} is in the schema", ~F.col(f"{c}_used"), None, "PASS") for c in CONTEXT_FIELDS if c != "confidence"], F.col("name"), by)
    spoken = judged(tally.join(main, list(by)), category, [Test("C7", "one language is spoken", F.col("lang") != F.col("main"), None, "PASS")], F.col("lang"), by)
    mixed = judged(counted.join(main, list(by)), category, [Test("C8", "all records are in one language", F.col("lang") != F.col("main"), status="WARN")], F.col("value"), by)
    mixed = mixed.drop("examples").join(_sources(t, plain.withColumn("lang", language).join(main, list(by)).where("lang <> '' and lang <> main"), by), "scope", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    total = t.summary.select("folder_set", X.first_present(F.col("v"), ["$.counts.total", "$.counts.Total"]).alias("total"))
    sized = t.context.where(fine).groupBy(*by).agg(F.count("*").alias("n")).join(total, "folder_set", "left")
    counts = judged(sized, category, [Test("C1", "as many records as documents", F.col("n") < F.col("total") * options.ratio, silent=False)], F.col("n"), by)
    return union([whole, counts, judged(rows, category, tests, where, by), soft, spoken, mixed])


def _index(t: Tables, chunks: DataFrame, file: DataFrame) -> DataFrame:
    category, c = "4. Index files", F.col("chunk")
    tests = [
        Test("I1", "no chunk has a polarity", raw("polarity", "chunk").isNotNull(), X.is_object(c)),
        Test("I3", "chunks have an id and content", X.is_empty(raw("chunk_id", "chunk")) | ~X.is_truthy(raw("chunk_content", "chunk")), X.is_object(c)),
    ]
    read = [Test("I0", "the index is a JSON object", F.col("error").isNotNull() | ~X.is_object(F.col("v")))]
    parts = [Test("I0", "the entries of the index are JSON", F.col("broken"), F.col("broken"))]
    values = chunks.where("value is not null").groupBy("folder_set").agg(F.count_distinct("entity", "value").alias("n"))
    total = t.summary.select("folder_set", X.first_present(F.col("v"), ["$.counts.total", "$.counts.Total"]).alias("total"))
    sized = judged(values.join(total, "folder_set", "left"), category, [Test("I2", "one value for each document", F.col("n") != F.col("total"), F.col("total").isNotNull()), Test("I2", "the number of documents is known", F.col("total").isNull(), F.col("total").isNull(), "WARN")], F.col("n"))
    return union([judged(file, category, read, F.col("name")), judged(chunks, category, [*tests, *parts], F.col("value")), sized])


@rules
def index(t: Tables, options: Options) -> DataFrame:
    return _index(t, t.index, t.index_file)


@rules
def merged_index(t: Tables, options: Options) -> DataFrame:
    """The same of the merged index, which may be absent."""
    return _index(t, t.merged, t.merged_file).withColumn("title", F.concat(F.lit("merged index: "), "title"))


# --- 5-7. summaries and counts ---


def label_of(v: str = "v") -> Column:
    """positive or negative from label, polarity or ground_truth."""
    out = F.lit(None).cast("string")
    for name in ("ground_truth", "polarity", "label"):
        word = F.lower(X.strip(X.text_of(raw(name, v))))
        said = F.when(word.isin("positive", "true"), "positive").when(word.isin("negative", "false"), "negative")
        out = F.coalesce(said, out)
    return out


@rules
def summary(t: Tables, options: Options) -> DataFrame:
    category, v = "5. export_summary.json ground truth", F.col("v")
    count = lambda n: X.first_present(v, [f"$.counts.{n}", f"$.counts.{n.title()}"])
    whole = lambda n: X.is_integer(F.coalesce(F.try_variant_get(v, f"$.counts.{n}", "variant"), F.try_variant_get(v, f"$.counts.{n.title()}", "variant"))) & (count(n) >= 0)
    truth = lambda n: F.try_variant_get(v, f"$.normalized_context.ground_truth.{n}", "long")
    records = F.try_variant_get(v, "$.normalized_context.records", "long")
    files = t.files.where("area = 'raw_doc' and not is_dir").groupBy("folder_set").agg(F.count_if(F.col("polarity") == "Positive").alias("raw_pos"), F.count_if(F.col("polarity") == "Negative").alias("raw_neg"))
    stated = F.lower(X.text_of(F.col("ground_truth")))
    held = t.context.where("_corrupt_record is null").groupBy("folder_set", F.col("name").alias("file")).agg(F.count("*").alias("rows"), F.count_if(stated.isin("true", "positive")).alias("rows_true"), F.count_if(stated.isin("false", "negative")).alias("rows_false"))
    each = held.join(t.summary, "folder_set")
    said = {n: t_.groupBy("folder_set").agg(F.count_if(~F.col("bad") & X.is_object(v)).alias(f"{n}_n"), F.count_if(F.col("bad")).alias(f"{n}_bad"), F.count_if(label_of() == "positive").alias(f"{n}_pos"), F.count_if(label_of() == "negative").alias(f"{n}_neg")) for n, t_ in (("corpus", t.corpus), ("combined", t.combined))}
    one = t.summary.join(files, "folder_set", "left").join(said["corpus"], "folder_set", "left").join(said["combined"], "folder_set", "left")
    pos, neg, total = count("positive"), count("negative"), count("total")
    version = X.text_of(raw("version", "v"))
    inside = F.when(F.col("folder_set") == "Disagreements", t.versions["Disagreements"]).otherwise(t.versions["Agreements"])
    tests = [
        Test("E0", "the summary is a JSON object", F.col("error").isNotNull() | ~X.is_object(v)),
        *[Test("E1", f"{k} is stated", raw(k, "v").isNull(), X.is_object(v)) for k in ("sit_name", "version", "output_dir", "counts")],
        Test("E2", "version is the version folder's name", version != inside, X.is_object(v) & version.isNotNull()),
        *[Test("E3", f"counts.{n} is a whole number", ~whole(n), X.is_object(raw("counts", "v"))) for n in ("positive", "negative", "total")],
        Test("E4", "positive and negative add up", pos + neg != total, (pos + neg + total).isNotNull()),
        Test("E5", "true records are the positive documents", truth("true") != pos, (truth("true") + pos).isNotNull()),
        Test("E6", "false records are the negative documents", truth("false") != neg, (truth("false") + neg).isNotNull()),
        Test("E7", "records are true and false ones", records != truth("true") + truth("false"), (records + truth("true") + truth("false")).isNotNull()),
        Test("E10", "positive files are counted", pos != F.col("raw_pos"), (pos + F.col("raw_pos")).isNotNull()),
        Test("E11", "negative files are counted", neg != F.col("raw_neg"), (neg + F.col("raw_neg")).isNotNull()),
        Test("E12", "all files are counted", total != F.col("raw_pos") + F.col("raw_neg"), (total + F.col("raw_pos")).isNotNull()),
    ]
    by_file = [
        Test("E8", "records are those in the context file", records != F.col("rows"), records.isNotNull()),
        Test("E9", "true and false records are those in the context file", (truth("true") != F.col("rows_true")) | (truth("false") != F.col("rows_false")), (truth("true") + truth("false")).isNotNull()),
    ]
    counts = [
        x for n in ("corpus", "combined") for x in (
            Test("E13", f"{n} has no malformed line", F.col(f"{n}_bad") > 0, F.col(f"{n}_n").isNotNull()),
            Test("E14", f"{n} has a line for each document", F.col(f"{n}_n") < total * options.ratio, (total + F.col(f"{n}_n")).isNotNull()),
            Test("E15", f"{n} has the labels of the summary", (F.col(f"{n}_pos") != pos) | (F.col(f"{n}_neg") != neg), (F.col(f"{n}_n") + pos + neg).isNotNull()),
            Test("E16", f"{n} has the labels of the context records", (F.col(f"{n}_pos") != truth("true")) | (F.col(f"{n}_neg") != truth("false")), (F.col(f"{n}_n") + truth("true") + truth("false")).isNotNull()),
        )
    ]
    return judged(one, category, tests, F.col("name")).unionByName(judged(each, category, by_file, F.col("file"))).unionByName(judged(one, "6-7. corpus.jsonl / combined_metadata.jsonl counts", counts, F.col("name")))


LOG_STRINGS = ["schema_version", "dataset_version", "generated_at", "sit_name"]
LOG_NESTED = {"generator": ["model", "model_version"], "sit_grader": ["model"], "mce": ["version"], "docparser": ["version"]}


@rules
def generation_log(t: Tables, options: Options) -> DataFrame:
    v, category = F.col("v"), "Generation Log Consistency"
    stated = t.summary.where("folder_set = 'Agreements'").select(field("version", v="v").alias("version"), field("sit_name", v="v").alias("entity"))
    one = t.spark.range(1).join(t.log.select("v", "error", F.lit(True).alias("there")), F.lit(True), "left").join(stated, F.lit(True), "left").withColumn("folder_set", F.lit("run"))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    known = F.lit([*LOG_STRINGS, *LOG_NESTED])
    ok = X.is_object(v)
    tests = [
        Test("G1", "the log is there", F.col("there").isNull()),
        Test("G2", "the log is readable", F.col("error").isNotNull(), F.col("there")),
        Test("G3", "the log is an object", ~ok, F.col("there") & F.col("error").isNull()),
        Test("G4", "no unknown keys", F.size(F.array_except(keys, known)) > 0, ok),
        Test("G5", "no missing keys", F.size(F.array_except(known, keys)) > 0, ok),
        *[Test(f"G{6 + i}", f"{k} has its keys alone", ~F.coalesce(F.array_sort(F.map_keys(F.try_variant_get(v, f"$.{k}", "map<string,variant>"))) == F.lit(sorted(names)), F.lit(False)), ok) for i, (k, names) in enumerate(LOG_NESTED.items())],
        Test("G10", "the version is the summary's", ~field("dataset_version", v="v").eqNullSafe(F.col("version")), ok & F.col("version").isNotNull()),
        Test("G11", "the entity is the summary's", ~field("sit_name", v="v").eqNullSafe(F.col("entity")), ok & F.col("entity").isNotNull()),
        *[Test(f"G{12 + i}", f"{k} is not empty", ~X.is_string(F.try_variant_get(v, f"$.{k}", "variant")) | (F.coalesce(X.strip(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) == ""), ok) for i, k in enumerate(["generator.model", "generator.model_version", "sit_grader.model", "mce.version", "docparser.version"])],
    ]
    return judged(one, category, tests, F.col("folder_set"))


# --- corpus and combined rows ---

UNSWEPT = ["sit_values", "lookalike_values", "temperature_used", "has_table"]
DIMENSIONS = {"format": "file_format", **{x: x for x in "domain department function workflow process persona role document_type".split()}}
BUCKETS = ["easy positive", "easy negative", "hard positive", "hard negative"]


def bucket(v: str = "v") -> Column:
    """sit_category if it is one of the buckets, else the first one found in the nested details."""
    own = F.lower(X.strip(field("sit_category", v=v)))
    none = F.try_variant_get(F.parse_json(F.lit("[]")), "$", "array<variant>")
    inside = lambda x: F.coalesce(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), none)
    entities = F.flatten(F.transform(inside(raw("sit_details", v)), inside))
    entries = F.flatten(F.transform(entities, lambda e: F.coalesce(F.try_variant_get(e, "$.values", "array<variant>"), none)))
    nested = F.filter(F.transform(entries, lambda e: F.lower(X.strip(F.try_variant_get(e, "$.sit_category", "string")))), lambda c: c != "")
    return F.when(own.isin(BUCKETS), own).otherwise(F.coalesce(F.get(nested, F.lit(0)), F.lit("unknown")))


@rules
def corpus_fields(t: Tables, options: Options) -> DataFrame:
    out, category = [], "5. corpus.jsonl Field Completeness"
    for name, df in (("corpus", t.corpus), ("combined_metadata", t.combined)):
        rows = df.where(~F.col("bad") & X.is_object(F.col("v"))).withColumn("file", F.lit(name))
        fields = rows.select("folder_set", "file", "line", F.explode(F.try_variant_get("v", "$", "map<string,variant>"))).where(~F.col("key").isin(UNSWEPT))
        out.append(judged(fields, category, [Test("K1", "no field is empty", X.is_empty(F.col("value")))], F.concat_ws(":", "line", "key"), ("folder_set", "file")))
        label = F.lower(X.strip(F.coalesce(X.text_of(raw("label", "v")), X.text_of(raw("ground_truth", "v")))))
        pos, neg = label.isin("positive", "true"), label.isin("negative", "false")
        sit, like = X.is_empty(raw("sit_values", "v")), X.is_empty(raw("lookalike_values", "v"))
        tests = [Test("K2", "positive rows have values", sit, pos), Test("K3", "positive rows have no lookalikes", ~like, pos), Test("K4", "negative rows have no values", ~sit, neg), Test("K5", "negative rows have lookalikes", like, neg)]
        out.append(judged(rows, category, tests, F.col("line"), ("folder_set", "file")))
    return union(out)


@rules
def composition(t: Tables, options: Options) -> DataFrame:
    rows = t.combined.where(~F.col("bad") & X.is_object(F.col("v")))
    total = t.summary.select("folder_set", X.first_present(F.col("v"), ["$.counts.total", "$.counts.Total"]).alias("total"))
    one = rows.withColumn("bucket", bucket()).groupBy("folder_set").agg(F.count("*").alias("n"), F.count_if(~F.col("bucket").isin(BUCKETS)).alias("other")).join(total, "folder_set", "left")
    out = [judged(one, "Label Distribution", [Test("D1", "labels cover all documents", F.col("n") != F.col("total"), F.col("total").isNotNull())], F.col("other"))]
    out.append(judged(rows.withColumn("bucket", bucket()), "Label Distribution", [Test("D2", "every document has a known label", ~F.col("bucket").isin(BUCKETS), None, "PASS")], F.col("line")))
    out.append(judged(one, "Document Format Distribution", [Test("D3", "formats cover all documents", F.col("n") != F.col("total"), silent=False)], F.col("n")))
    forms = rows.groupBy("folder_set", F.lower(F.coalesce(F.nullif(X.strip(field("file_format", v="v")), F.lit("")), F.lit("unknown"))).alias("form")).agg(F.count("*").alias("n"))
    out.append(judged(forms, "Document Format Distribution", [Test("D3", "every document has a format", F.col("form") == "unknown", None, "PASS")], F.concat_ws(": ", "form", "n")))
    business = [k for k in DIMENSIONS if k != "format"]
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(F.nullif(X.strip(field(DIMENSIONS[k], v="v")), F.lit("")), F.lit("(missing)")).alias("value")) for k in business])
    counted = rows.select("folder_set", F.explode(pairs).alias("p")).select("folder_set", "p.*").groupBy("folder_set", "dimension", "value").agg(F.count("*").alias("n"))
    top = counted.groupBy("folder_set", "dimension").agg((F.max("n") / F.sum("n")).alias("share"), F.max_by("value", F.struct("n", "value")).alias("top"))
    # Notes: what they count doesn't change the status.
    out.append(judged(top, "Business Context Balance", [Test(f"D{4 + i}", f"no {k} holds 80 % of the documents or more", F.col("share") >= 0.8, F.col("dimension") == k, "PASS") for i, k in enumerate(business)], F.col("top")))
    first = F.substring_index(F.col("bucket"), " ", 1)
    difficulty = F.when(first.isin("easy", "hard"), first).otherwise("unknown")
    for rule, side, name in (("D12", "positive", "sit_values"), ("D13", "negative", "lookalike_values")):
        values = F.flatten(F.map_values(F.try_variant_get("v", f"$.{name}", "map<string,array<string>>")))
        used = rows.withColumn("bucket", bucket()).select("folder_set", difficulty.alias("difficulty"), X.text_of(raw("doc_id", "v")).alias("doc_id"), F.explode(values).alias("value"))
        forms = used.groupBy("folder_set", X.normal_name(F.col("value")).alias("form")).agg(F.count("*").alias("n"), F.min("difficulty").alias("low"), F.max("difficulty").alias("high"), F.min("doc_id").alias("doc_id"))
        again, alike = F.col("n") > 1, F.col("low") == F.col("high")
        shapes = [(k, alike & (F.col("low") == k)) for k in ("easy", "hard")] + [("mixed", ~(alike & F.col("low").isin("easy", "hard")))]
        tests = [Test(rule, f"{side} values are used once", again, None, "PASS"), *[Test(rule, f"no {side} value is reused, {k}", again & at, None, "PASS") for k, at in shapes]]
        out.append(judged(forms, "SIT Value Reuse", tests, F.col("doc_id")))
    return union(out)


# --- metadata documents and their instances ---


def instance_parts(rows: DataFrame) -> list[DataFrame]:
    """What can be told of each instance by itself."""
    from corvane.plans.fields import REQUIRED

    who = F.concat_ws("#", "name", "pos")
    present, semantic = X.to_bool(raw("keyword_present")), X.to_bool(raw("semantic_ground_truth"))
    expected, actual = X.to_bool(raw("expected_engine_match")), X.to_bool(raw("actual_engine_match"))
    mandatory = F.lower(X.strip(field("sit_extensions.keyword_requirement"))) == "mandatory"
    positive = F.col("polarity") == "Positive"
    return [
        judged(rows, "Metadata Instance Fields", [Test("N1", f"{f} is never empty", X.is_empty(raw(f))) for f in REQUIRED] + [Test("N7", "a keyword goes with keyword_present", present != ~X.is_empty(raw("keyword")), present.isNotNull())], who, BOTH),
        judged(rows, "8. Metadata / Engine / Chunk labels", [Test("M2", "the engine is expected to match", ~F.coalesce(expected, F.lit(False)), positive), Test("M3", "the engine does what is expected", expected != actual, (expected.isNotNull() & actual.isNotNull()), "WARN")], who, BOTH),
        judged(rows, "10. Keyword / semantic_ground_truth", [Test("W1", "semantic truth is the polarity", semantic != positive, semantic.isNotNull()), Test("W2", "mandatory keywords are there", ~present, positive & mandatory & present.isNotNull())], who, BOTH),
    ]


def used_fields(rows: DataFrame, among: Callable[[str], Column | None]) -> DataFrame:
    """Fields that no instance has to have, but all if one has them; `among` tells whether one has."""
    from corvane.plans.fields import SCHEMA_AWARE

    return judged(rows, "Metadata Instance Fields", [Test(f"N{2 + i}", f"{f} is never empty where it is used", X.is_empty(raw(f)), among(f)) for i, f in enumerate(SCHEMA_AWARE)], F.concat_ws("#", "name", "pos"), BOTH)


@rules
def instances(t: Tables, options: Options) -> DataFrame:
    from corvane.plans.fields import SCHEMA_AWARE

    rows = sampled(t, options, t.instances)
    there = rows.groupBy(*BOTH).agg(*[F.bool_or(~X.is_empty(raw(f))).alias(f"used_{f}") for f in SCHEMA_AWARE])
    wide = rows.join(F.broadcast(there), list(BOTH))  # at most four rows
    return union([*instance_parts(rows), used_fields(wide, lambda f: F.col(f"used_{f}"))])


@rules
def snippets(t: Tables, options: Options) -> DataFrame:
    category, s = "8. Metadata / Engine / Chunk labels", sampled(t, options, t.snippets.withColumn("name", F.regexp_replace("name", r"\.[^.]+\.json$", ".json")))
    positive = F.col("polarity") == "Positive"
    docs = s.groupBy(*BOTH, "name").agg(F.bool_or("label").alias("label"), F.bool_or("found").alias("found"), F.count_if("found").alias("n"))
    tests = [
        Test("M4", "positive documents have a labelled chunk", ~F.col("label"), positive), Test("M5", "positive documents have a chunk with a finding", ~F.col("found"), positive),
        Test("M6", "negative documents have no labelled chunk", F.col("label"), ~positive), Test("M9", "no document has several findings", F.col("n") > 1, None, "PASS"),
    ]
    each = [Test("M7", "every chunk has a label", ~F.col("has_label")), Test("M8", "chunks with a finding have the polarity's label", F.col("label") != positive, F.col("found") & F.col("has_label"))]
    covered = t.snippets.groupBy(*BOTH, "name").agg(F.bool_or("found").alias("found"))
    return union([judged(docs, category, tests, F.col("name"), BOTH), judged(s, category, each, F.col("name"), BOTH), judged(covered, "MCE Detection Coverage", [Test("MCE", "every document has a finding", ~F.col("found"))], F.col("name"), ("polarity",)).withColumn("scope", F.col("scope"))])


@rules
def schema(t: Tables, options: Options) -> DataFrame:
    """Each document's names agree with each other."""
    return document_names(sampled(t, options, t.metadata.where(X.is_object(F.col("v")))))


def document_names(rows: DataFrame) -> DataFrame:
    f = lambda n: F.coalesce(X.strip(X.text_of(raw(n, "v"))), F.lit(""))
    end, form = F.regexp_replace(F.lower(f("file_ext")), r"^\.", ""), F.lower(f("file_format"))
    tests = [
        *[Test("SC1", f"{n} is stated", f(n) == "") for n in ("doc_id", "stem", "filename")],
        Test("SC2", "filename has no folder", X.base_name(f("filename")) != f("filename"), f("filename") != ""),
        Test("SC3", "stem is the filename's", X.stem(f("filename")) != f("stem"), (f("filename") != "") & (f("stem") != "")),
        Test("SC4", "file_ext is the filename's", F.regexp_replace(F.lower(X.suffix(f("filename"))), r"^\.", "") != end, (f("filename") != "") & (end != "")),
        Test("SC5", "file_format is file_ext", F.when(form == "fixed_width", "txt").otherwise(form) != end, (form != "") & (end != "")),
    ]
    return judged(rows, "Metadata Schema Self-Consistency", tests, F.col("name"), BOTH)


JOINED = ["sit_name", "sit_category", "label", "language", "filename", "stem", "file_ext", "file_format", "entity_guid"]


@rules
def combined_join(t: Tables, options: Options) -> DataFrame:
    """Rows of the combined file against the document's own metadata, by polarity and stem."""
    label = field("label", v="v")
    polarity = F.when(label == "positive", "Positive").when(label == "negative", "Negative")
    left = t.combined.where(~F.col("bad")).select("folder_set", polarity.alias("polarity"), field("stem", v="v").alias("stem"), F.col("v").alias("a"))
    right = t.metadata.select(*BOTH, F.regexp_replace("name", r"\.json$", "").alias("stem"), F.col("v").alias("b"))
    both = left.join(right, [*BOTH, "stem"])
    text = lambda side, f: F.to_json(F.try_variant_get(side, f"$.{f}", "variant"))
    tests = [Test("J1", f"{f} agrees", ~text("a", f).eqNullSafe(text("b", f)), text("a", f).isNotNull() | text("b", f).isNotNull()) for f in JOINED]
    return judged(both, "combined_metadata.jsonl vs Individual metadata.json Join", tests, F.col("stem"))


def raw_kinds(t: Tables) -> DataFrame:
    """(folder_set, polarity, stem, ext) of the raw documents; of names with one stem the last counts."""
    raws = t.files.where("area = 'raw_doc' and not is_dir and polarity is not null")
    return raws.groupBy(*BOTH, X.stem(F.col("name")).alias("stem")).agg(F.max_by(F.lower(X.suffix(F.col("name"))), "name").alias("ext"))


def own_text(t: Tables, options: Options) -> DataFrame:
    """Rows of t.instances with the text that has the metadata file's stem and the raw document's extension.

    A sample takes its documents from the extensions in turn.
    """
    stem = F.substring("name", F.lit(1), F.length("name") - 5)
    docs = t.metadata.select(*BOTH, "name", stem.alias("stem")).join(raw_kinds(t), [*BOTH, "stem"], "left")
    if options.sample_size is not None:
        drawn = docs.withColumn("_ext", F.coalesce("ext", F.lit(""))).withColumn("_draw", F.xxhash64("name", F.lit(42)))
        keys = t.metadata.select(*BOTH).distinct().collect()  # at most four
        parts = [S.stratified_sample(drawn.where((F.col("folder_set") == k.folder_set) & (F.col("polarity") == k.polarity)), "_ext", ["_draw", "name"], options.sample_size) for k in keys]
        docs = union(parts).drop("_ext", "_draw") if parts else docs
    texts = t.text.withColumnRenamed("filename", "text_name")
    there = docs.where("ext <> ''").withColumn("text_name", F.concat("stem", "ext")).join(texts, [*BOTH, "text_name"])
    return t.instances.join(there.select(*BOTH, "name", "text_name", "text"), [*BOTH, "name"])


def first_said(*names: str) -> Column:
    """The first of these fields that is neither empty, 0 nor false, without spaces around it; null if there is none or it is blank."""
    return F.nullif(X.strip(F.coalesce(*[F.when(X.is_truthy(raw(n)), X.text_of(raw(n))) for n in names])), F.lit(""))


@rules
def content(t: Tables, options: Options) -> DataFrame:
    """Values and keywords of instances against the document's text, by stem and raw extension; offsets against the text that `filename` names."""
    who = F.concat_ws("#", "name", "pos")
    said = own_text(t, options).withColumn("said", first_said("value", "normalized_value"))
    said = said.withColumn("span", X.find_span(F.col("text"), F.col("said")))
    window = X.proximity_window(F.col("text"), F.col("span.start"), F.col("span.length"), X.to_int(raw("keyword_distance")), field("keyword_direction"))
    keyword = F.coalesce(first_said("keyword"), F.lit(""))
    near = (keyword != "") & F.contains(F.lower(window), F.lower(keyword))
    mandatory = F.lower(field("sit_extensions.keyword_requirement")) == "mandatory"
    found, present = F.col("span").isNotNull(), X.to_bool(raw("keyword_present"))
    tests = [
        Test("V1", "the value is in the text", ~found, F.col("said").isNotNull()),
        Test("V2", "mandatory keywords stand near the value", ~near, (F.col("polarity") == "Positive") & mandatory & found),
        Test("V3", "keyword_present is what the text says", near != present, (keyword != "") & found & present.isNotNull(), "WARN"),
    ]
    docs = sampled(t, options, t.instances).select(*BOTH, "name", "pos", "i", field("filename", v="v").alias("filename"), field("doc_id", v="v").alias("doc_id"))
    rows = docs.join(t.text, [*BOTH, "filename"])
    value, low, high = field("value"), X.to_int(raw("value_start_offset")), X.to_int(raw("value_end_offset"))
    own = field("doc_id").eqNullSafe(F.col("doc_id")) & low.isNotNull() & high.isNotNull() & (F.length(value) > 0)
    exact = F.substring("text", low + 1, high - low) == value
    offsets = [Test("O1", "offsets lead to the value", ~exact & (F.instr("text", value) == 0), own), Test("O1", "no offset has drifted", ~exact & (F.instr("text", value) > 0), own, "PASS")]
    return judged(said, "9b. Content Verification", tests, who, BOTH).unionByName(judged(rows, "Instance Value Offset Accuracy", offsets, who, BOTH))


@rules
def value_contexts(t: Tables, options: Options) -> DataFrame:
    """The sentences around the first and the last value that is found, to read; it never fails. Only these are cut out."""
    rows = own_text(t, options).select(*BOTH, "name", "pos", "text", first_said("value", "normalized_value").alias("value"))
    rows = rows.withColumn("span", X.find_span(F.col("text"), F.col("value"))).where("span is not null")
    one, who = F.struct("name", "text", "span"), F.struct("name", "pos")
    ends = rows.groupBy(*BOTH).agg(F.count("*").alias("checked"), F.min_by(one, who).alias("a"), F.max_by(one, who).alias("b"))

    def shown(c: str) -> Column:
        s = X.sentence_context(F.col(f"{c}.text"), F.col(f"{c}.span.start"), F.col(f"{c}.span.length"))
        return F.transform(F.array(s), lambda x: F.concat(F.col(f"{c}.name"), F.lit(": "), F.concat_ws(" | ", x["before"], x["current"], x["after"])))[0]

    out = ends.select(F.concat_ws(" / ", *BOTH).alias("scope"), "checked", F.array_distinct(F.array(shown("a"), shown("b"))).alias("examples"))
    fixed = {"rule": "V4", "category": "9b. Content Verification", "title": "values in their sentences", "status": "PASS"}
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("bad", F.lit(0).cast("long")).select(*COLUMNS)


@rules
def context_join(t: Tables, options: Options) -> DataFrame:
    """Context records against the document's text: by id and file name, else by the path's name, else their own window."""
    known = J.last_wins(t.combined.where(~F.col("bad")).select("folder_set", field("doc_id", v="v").alias("doc_id"), "line", field("filename", v="v").alias("filename")), ["folder_set", "doc_id"], ["line"])
    rows = t.context.where("_corrupt_record is null").select("folder_set", "pos", X.text_of(F.col("value")).alias("value"), X.text_of(F.col("doc_id")).alias("doc_id"), X.base_name(X.text_of(F.col("doc_path"))).alias("base"), X.to_int(F.col("detected_sit_start_index")).alias("low"), X.to_int(F.col("detected_sit_end_index")).alias("high"), F.coalesce(*[F.try_variant_get(w, "$.text", "string") for w in reversed(WINDOWS)]).alias("window")).where("value <> ''")
    texts = t.text.groupBy("folder_set", "filename").agg(F.max_by("text", "polarity").alias("text"))  # Positive before Negative
    by_id = texts.select("folder_set", "filename", F.col("text").alias("t1"))
    by_base = texts.select("folder_set", F.col("filename").alias("base"), F.col("text").alias("t2"))
    found = rows.join(known.select("folder_set", "doc_id", "filename"), ["folder_set", "doc_id"], "left").join(by_id, ["folder_set", "filename"], "left").join(by_base, ["folder_set", "base"], "left")
    found = found.withColumn("text", F.coalesce("t1", "t2", "window"))
    size = F.col("high") - F.col("low")
    exact = (F.substring("text", F.col("low") + 1, size + 1) == F.col("value")) | (F.substring("text", F.col("low") + 1, size) == F.col("value"))
    lost = F.col("text").isNull() | (~F.coalesce(exact, F.lit(False)) & (F.instr("text", F.col("value")) == 0))
    return judged(found, "Context Detection Row Join", [Test("X1", "values are found in their document", lost)], F.col("pos"))


@rules
def scenarios(t: Tables, options: Options) -> DataFrame:
    """Scenario ids of documents against the corpus and combined rows."""
    last = lambda df, n: J.last_wins(df.where(~F.col("bad")).select("folder_set", field("doc_id", v="v").alias("doc_id"), "line", field("scenario_id", v="v").alias(n)), ["folder_set", "doc_id"], ["line"]).withColumn(f"in_{n}", F.lit(True)).drop("line")
    rows = sampled(t, options, t.metadata.where(X.is_object(F.col("v")))).select("folder_set", "name", field("doc_id", v="v").alias("doc_id"), field("scenario_id", v="v").alias("own"), X.slug(field("sit_name", v="v")).alias("entity"))
    both = rows.join(last(t.corpus, "corpus"), ["folder_set", "doc_id"], "left").join(last(t.combined, "combined"), ["folder_set", "doc_id"], "left")
    has = F.coalesce(F.col("own") != "", F.lit(False))
    tests = [Test("Q1", "documents have a scenario", ~has), Test("Q2", "the scenario begins with the entity's name", ~F.startswith(X.without_hashes(X.slug(F.col("own"))), F.col("entity")), has & (F.col("entity") != ""), "PASS")]
    for i, n in enumerate(("corpus", "combined")):
        there = F.coalesce(F.col(f"in_{n}"), F.lit(False))
        tests += [Test(f"Q{3 + i}", f"the scenario is the {n} row's", ~F.col("own").eqNullSafe(F.col(n)), has & there), Test(f"Q{5 + i}", f"documents have a {n} row", ~there, has, "WARN")]
    return judged(both, "Scenario ID Consistency", tests, F.col("name"))


@rules
def version_paths(t: Tables, options: Options) -> DataFrame:
    category, expected = "Version Path Consistency", t.summary.select("folder_set", field("version", v="v").alias("version"), field("output_dir", v="v").alias("output"))
    top = judged(expected, category, [Test("Y1", "output_dir has the version", X.version_stamp(F.col("output")) != F.col("version"), X.version_stamp(F.col("output")).isNotNull() & F.col("version").isNotNull())], F.col("output"))
    run = expected.where("folder_set = 'Agreements'").select("version")
    rows = sampled(t, options, t.metadata).join(F.broadcast(run))  # one row
    stamp = lambda p: X.version_stamp(field(p, v="v"))
    paths = ["raw_doc", "docparser.raw_output", "docparser.parsed", "docparser.chunks"]
    return top.unionByName(judged(rows, category, [Test(f"Y{2 + i}", f"{p} has the version", stamp(p) != F.col("version"), stamp(p).isNotNull()) for i, p in enumerate(paths)], F.col("name"), BOTH))


@rules
def grader(t: Tables, options: Options) -> DataFrame:
    n = lambda k, kind="long": field(k, kind, "v")
    grades = t.grades.groupBy("folder_set").agg(F.count("*").alias("grades"), F.count_if("bad").alias("bad_grades"))
    evaluations = t.evaluations.groupBy("folder_set").agg(F.count("*").alias("evaluations"), F.count_if("bad").alias("bad_evaluations"))
    one = t.chunk_summary.join(grades, "folder_set", "left").join(evaluations, "folder_set", "left")
    total, agreed, other, rate = n("total_chunk_value_records"), n("agreements"), n("disagreements"), n("agreement_rate", "double")
    tests = [
        Test("T1", "the summary is readable", F.col("error").isNotNull()),
        Test("T2", "agreements and disagreements add up", agreed + other != total, (agreed + other + total).isNotNull()),
        Test("T3", "the rate is a share", (rate < 0) | (rate > 1), rate.isNotNull()),
        Test("T4", "the rate is what the counts give", F.abs(rate - agreed / total) > 0.01, (total > 0) & rate.isNotNull() & agreed.isNotNull(), "WARN"),
        Test("T5", "no grade is malformed", F.col("bad_grades") > 0, F.col("grades").isNotNull()),
        Test("T6", "there is a grade for each record", F.col("grades") != total, (F.col("grades") + total).isNotNull()),
        Test("T10", "evaluations are readable and complete", (F.col("bad_evaluations") > 0) | (F.col("evaluations") != total), F.col("evaluations").isNotNull()),
    ]
    # The second summary, the labels that evaluations give, and the manifest.
    keys = ["total_chunk_value_records", "agreements", "disagreements", "agreement_rate"]
    counted = lambda df, k: df.where(~F.col("bad") & X.is_object(F.col("v"))).groupBy("folder_set", X.text_of(raw(k, "v")).alias("label")).agg(F.count("*").alias("n")).where("label is not null").groupBy("folder_set").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias(f"{k}s"))
    listed = t.manifest.groupBy("folder_set").agg(F.count("*").alias("listed"), F.count_if(F.try_variant_get("v", "$.agreement", "boolean")).alias("agreed"), F.count_if(~F.try_variant_get("v", "$.agreement", "boolean")).alias("differ"))
    second = t.chunk_summary.select("folder_set", "name", F.col("v").alias("first"), F.col("error").alias("first_error")).join(t.misc_summary.select("folder_set", "v", "error", F.lit(True).alias("there")), "folder_set", "left")
    second = second.join(listed, "folder_set", "left").join(counted(t.evaluations, "chunk_label"), "folder_set", "left").join(counted(t.evaluations, "grader_label"), "folder_set", "left")
    fine = F.col("there").isNotNull() & F.col("error").isNull() & X.is_object(F.col("v"))
    labels = lambda k: F.transform_keys(F.try_variant_get("v", f"$.{k}", "map<string,long>"), lambda x, _: F.lower(x))
    seen = lambda k: F.transform_keys(F.col(k), lambda x, _: F.lower(x))
    same = lambda a, b: F.sort_array(F.map_entries(a)) == F.sort_array(F.map_entries(b))
    has = lambda k: F.coalesce(F.size(labels(k)) > 0, F.lit(False))
    done, undone, odd = n("evaluated_documents"), n("unevaluated_documents"), n("disagreement_documents")
    more = [
        Test("T7", "the second summary is readable", ~fine),
        Test("T8", "its agreements and disagreements add up", agreed + other != total, fine & (agreed + other + total).isNotNull()),
        Test("T8", "its rate is a share", (rate < 0) | (rate > 1), fine & rate.isNotNull()),
        Test("T8", "its rate is what the counts give", F.abs(rate - agreed / total) > 0.01, fine & (total > 0) & rate.isNotNull() & agreed.isNotNull(), "WARN"),
        *[Test("T9", f"{k} is the same in both summaries", ~F.try_variant_get("first", f"$.{k}", "double").eqNullSafe(n(k, "double")), fine & F.col("first_error").isNull(), "WARN") for k in keys],
        Test("T11", "chunk labels are those of the summary", ~F.coalesce(same(seen("chunk_labels"), labels("source_labels")), F.lit(False)), fine & has("source_labels"), "WARN"),
        Test("T12", "grader labels are those of the summary", ~F.coalesce(same(seen("grader_labels"), labels("grader_labels")), F.lit(False)), fine & has("grader_labels"), "WARN"),
        Test("T13", "the manifest is there", F.col("listed").isNull()),
        Test("T13", "the manifest lists every document", F.col("listed") != done + undone, fine & (F.col("listed") + done + undone).isNotNull()),
        Test("T14", "the manifest has the agreeing documents", F.col("agreed") != done - odd, fine & (F.col("agreed") + done + odd).isNotNull()),
        Test("T14", "the manifest has the disagreeing documents", F.col("differ") != odd, fine & (F.col("differ") + odd).isNotNull()),
    ]
    category = "SITGrader Consistency"
    return judged(one, category, tests, F.col("name")).unionByName(judged(second, category, more, F.col("name")))
