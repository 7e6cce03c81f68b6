"""Running the catalogue over a run: results, statistics, quality metrics, verdict."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.functions import names as N
from corvane.operators import aggregates as A
from corvane.operators import languages as L
from corvane.operators import similarity as M
from corvane.plans.report import doc_counts, gated, generation, graded, to_html, to_json
from corvane.plans.rules import BOTH, BUCKETS, CATALOGUE, DIMENSIONS, Options, Rules, bucket, field, raw
from corvane.sources.land import Tables, land
from corvane.sources.runs import find_runs

__all__ = ["audit", "audit_all", "metrics", "results", "statistics", "to_html", "to_json", "verdict"]
ORDER = {"FAIL": 0, "WARN": 1, "INFO": 2, "PASS": 3}
#: Rules that are planned and run side by side: their jobs are small, and planning them takes most of the time.
THREADS = 8
#: Seconds after which a rule counts as slow.
SLOW = 5
Progress = Callable[[str], None]


def quiet(message: str) -> None:
    pass



def results(t: Tables, options: Options = Options(), progress: Progress = quiet) -> list[dict]:
    """Rows of all rules. A rule that fails to run becomes a FAIL row; the others go on. Progress is told of each."""

    def run(rules: Rules) -> list[dict]:
        start = time.monotonic()
        try:
            rows = [r.asDict() for r in rules(t, options).collect()]  # a few rows for each rule
        except Exception as e:
            progress(f"{rules.__name__}: crashed, {e}")
            return [{"rule": rules.__name__, "category": "(any)", "scope": "run", "title": f"Check crashed: {rules.__name__}", "status": "FAIL", "checked": 0, "bad": 1, "examples": [str(e)[:300]]}]
        took = time.monotonic() - start
        progress(f"{rules.__name__}: {len(rows)} results in {took:.2f} s{' [SLOW]' if took > SLOW else ''}")
        return rows

    with ThreadPoolExecutor(THREADS) as pool:
        out = [row for rows in pool.map(run, CATALOGUE) for row in rows]
    return sorted(out, key=lambda r: (_leading(r["category"]), r["category"], ORDER[r["status"]], r["rule"], r["scope"]))


def _leading(category: str) -> int:
    digits = "".join(c for c in category.split(".")[0].split("-")[0] if c.isdigit())
    return int(digits) if digits else 999


def records(t: Tables) -> DataFrame:
    return t.combined.where(~F.col("bad") & X.is_object(F.col("v")))


def statistics(t: Tables) -> dict[str, DataFrame]:
    """Exhaustive figures of the run, both folder sets together."""
    rows = records(t).withColumn("bucket", bucket())
    value = lambda k, f: F.lower(F.coalesce(X.strip(field(f, v="v")), F.lit("unknown"))) if k == "format" else F.coalesce(F.nullif(X.strip(field(f, v="v")), F.lit("")), F.lit("(missing)"))
    length = F.when(X.is_integer(F.col("doc_content_length")), F.try_variant_get("doc_content_length", "$", "long"))
    language = X.strip(F.coalesce(field("language", v="v"), field("locale", v="v")))
    return {
        "labels": A.label_distribution(rows, F.col("bucket"), BUCKETS),
        "breakdown": A.breakdown(rows, F.col("bucket"), F.col("folder_set") == "Agreements", BUCKETS),
        "composition": A.composition(rows, {k: value(k, f) for k, f in DIMENSIONS.items()}, 8, F.col("line")),
        "spread": A.spread(rows, {k: value(k, f) for k, f in DIMENSIONS.items() if k != "format"}),
        "lengths": A.length_summary(t.context, length),
        "histogram": A.length_histogram(t.context, length),
        "language": A.dominant(rows, language, F.col("line")),
        "coverage": A.coverage(t.snippets.withColumn("item", F.concat_ws("/", *BOTH, "name")), "item", F.col("found"), "polarity"),
    }


def planted_values(name: str) -> Column:
    """Values that a document states to hold: a map of lists, or one list."""
    lists = F.flatten(F.map_values(F.try_variant_get("v", f"$.{name}", "map<string,array<string>>")))
    return F.coalesce(lists, F.try_variant_get("v", f"$.{name}", "array<string>"), F.array().cast("array<string>"))


def documents(t: Tables) -> DataFrame:
    """Metadata with text: (folder_set, polarity, name, v, text, side), side from the category, else the folder."""
    rows = t.metadata.where(X.is_object(F.col("v"))).withColumn("filename", field("filename", v="v")).join(t.text, [*BOTH, "filename"])
    category = bucket()
    return rows.withColumn("side", F.when(F.contains(category, F.lit("positive")), "positive").when(F.contains(category, F.lit("negative")), "negative").otherwise(F.lower("polarity")))


def metrics(t: Tables) -> dict[str, dict]:
    """The graded metrics; one without input is left out."""
    docs = documents(t).persist()
    inside = docs.select("*", F.posexplode(F.try_variant_get("v", "$.instances", "array<variant>")).alias("pos", "i")).where(X.is_object(F.col("i")))
    scores: dict[str, float] = {}
    position = X.position_band(X.to_number(raw("value_start_offset")), F.length("text"))
    scores["sit_position_diversity"] = A.band_entropy(inside, ["side"], position).agg(F.min("entropy")).first()[0]
    difficulty, distance = F.lower(X.strip(field("difficulty"))), X.to_number(raw("keyword_distance"))
    near = F.when(X.is_truthy(raw("keyword_present")), X.keyword_band(difficulty, distance))
    scores["keyword_proximity_diversity"] = A.band_entropy(inside.withColumn("difficulty", difficulty), ["side", "difficulty"], near).agg(F.avg("entropy")).first()[0]
    value = X.strip(X.text_of(raw("value")))
    span = X.find_span(F.col("text"), value)
    labels = inside.where((F.col("side") == "negative") & (value != "")).withColumn("span", span).where("span is not null").select(X.observed_label(F.col("text"), F.col("span.start")).alias("label")).where("label is not null")
    scores["negative_label_uniqueness"] = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*") / F.sum("n")).first()[0]
    language = F.lower(F.substring(X.strip(field("language", v="v")), 1, 2))
    target = A.dominant(docs, language, F.pmod(F.xxhash64("name"), F.lit(1 << 40))).first()
    if target and target["value"]:
        # The run's own texts teach the languages that it states. A run in one language has nothing to compare with: frequent short words tell then.
        model = L.fit(docs.select("text", F.nullif(language, F.lit("")).alias("language")))
        planted = F.concat(planted_values("sit_values"), planted_values("lookalike_values"))
        words = docs.select(X.assessable_words(F.col("text"), planted).alias("words")).where(F.size("words") >= L.LEAST_WORDS)
        if model.more_than_one():
            words = L.detected(words.withColumn("plain", F.array_join("words", " ")), model, "plain", "guess")
        elif target["value"] in X.STOP_WORDS:
            words = words.withColumn("guess", X.guessed_language(F.col("words")))
        else:
            words = words.withColumn("guess", F.lit(None).cast("string"))
        size = F.size("words")
        scores["target_language_purity"] = words.where("guess is not null").agg(1 - F.sum(F.when(F.col("guess") != target["value"], size).otherwise(0)) / F.sum(size)).first()[0]
    out = {name: graded(name, score) for name, score in scores.items() if score is not None}
    named = docs.withColumn("id", F.concat_ws(":", "folder_set", "polarity", "name"))
    rates = {r.threshold: r.rate for r in M.cluster_rates(docs, M.banded_pairs(M.shingled(named, "id", "text")), "jaccard").collect()}
    if rates.get(0.75) is not None:
        out["template_cluster_rate"] = {"score": rates[0.75], "grade": "report_only", "gate": False, "rate_85": rates[0.85], "rate_90": rates[0.9]}
    docs.unpersist()
    return out


def verdict(rows: list[dict], graded: dict[str, dict]) -> str:
    stopped = any(r["status"] == "FAIL" for r in rows) or gated({"metrics": graded})
    return "NOT READY" if stopped else "READY WITH WARNINGS" if any(r["status"] == "WARN" for r in rows) else "READY"


def audit(spark: SparkSession, path: str | Path, options: Options = Options(), progress: Progress = quiet) -> dict:
    """The whole report of one run."""
    progress(f"landing {path}")
    t = land(spark, path)
    try:
        rows = results(t, options, progress)
        progress("metrics and statistics")
        scores = metrics(t)
        stats = {k: [r.asDict() for r in df.collect()] for k, df in statistics(t).items()}  # each a few dozen rows
        made, sizes = (df.first().asDict() for df in (generation(t), doc_counts(t)))
        spoken = stats["language"][0]["value"] if stats["language"] else None
        if spoken:
            shown = spark.range(1).select(N.language_name(F.lit(spoken)), N.shown_language(F.lit(spoken))).first()
            made |= {"language_code": spoken, "language_name": shown[0], "language": shown[1]}
    finally:
        t.release()
    return {"label": next((run.label for run in find_runs(path)), str(path)), "verdict": verdict(rows, scores), "doc_counts": sizes, "generation": made, "results": rows, "metrics": scores, "statistics": stats}


def audit_all(spark: SparkSession, root: str | Path, options: Options = Options(), progress: Progress = quiet) -> dict[str, dict]:
    return {run.label: audit(spark, run.path, options, progress) for run in find_runs(root)}
