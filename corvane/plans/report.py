"""What a report says beside its rules: counts, versions, what to mend, several runs at a glance, and the page."""

from __future__ import annotations

import html
import json
import re
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.sources.land import Tables

#: Metric: strong, acceptable and weak minima, and whether a critical grade stops the delivery.
METRICS = {
    "target_language_purity": (0.995, 0.99, 0.97, False), "sit_position_diversity": (0.85, 0.75, 0.6, True),
    "keyword_proximity_diversity": (0.7, 0.55, 0.3, True), "negative_label_uniqueness": (0.7, 0.55, 0.35, True),
}
# Categories that stand apart from the core ones.
ADDITIONAL = ["Folder/File Hygiene", "Metadata Schema Self-Consistency", "combined_metadata.jsonl vs Individual metadata.json Join", "Instance Value Offset Accuracy", "Context Detection Row Join"]
LONG, SHORT = 320, 150


def doc_counts(t: Tables) -> DataFrame:
    """One row: the summaries' counts. A total that isn't stated is the sum of its parts; combined_total is null unless both sides are known."""
    count = lambda n: X.first_present(F.col("v"), [f"$.counts.{n}", f"$.counts.{n.title()}"])
    rows = t.summary.select("folder_set", count("positive").alias("positive"), count("negative").alias("negative"), count("total").alias("total"))
    rows = rows.withColumn("known", F.coalesce(F.col("total"), F.col("positive") + F.col("negative")))
    of = lambda side, c: F.max(F.when(F.col("folder_set") == side, F.col(c)))
    sides = {"agreements": "Agreements", "disagreements": "Disagreements"}
    parts = [of(side, c).alias(f"{name}_{c}") for name, side in sides.items() for c in ("positive", "negative", "total")]
    return rows.agg(of("Agreements", "known").alias("total"), (of("Agreements", "known") + of("Disagreements", "known")).alias("combined_total"), *parts)


def generation(t: Tables) -> DataFrame:
    """One row: the versions that the log states; what it lacks is from the first combined row that has any of them."""
    v = F.col("v")
    said = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    logged = {
        "generator_model": "$.generator.model", "generator_model_version": "$.generator.model_version", "sit_grader_model": "$.sit_grader.model",
        "mce_version": "$.mce.version", "docparser_version": "$.docparser.version", "generated_at": "$.generated_at",
    }
    log = t.log.agg(*[F.max(said(path)).alias(name) for name, path in logged.items()])  # one log
    engines = F.transform(F.try_variant_get(v, "$.instances", "array<variant>"), lambda i: F.try_variant_get(i, "$.sit_extensions.detector_engine_version", "string"))
    told = F.struct(said("$.generation_model").alias("generator_model"), F.get(F.filter(engines, lambda x: x != ""), 0).alias("mce_version"), said("$.docparser.parser").alias("docparser_version"))
    rows = t.combined.where(~F.col("bad") & X.is_object(v)).select("folder_set", "line", told.alias("told"))
    first = rows.where(F.coalesce("told.generator_model", "told.mce_version", "told.docparser_version").isNotNull()).agg(F.min_by("told", F.struct("folder_set", "line")).alias("told"))
    fill = ("generator_model", "mce_version", "docparser_version")
    return log.join(first).select(*[F.coalesce(F.col(n), F.col(f"told.{n}")).alias(n) if n in fill else F.col(n) for n in logged])


def graded(name: str, score: float) -> dict:
    strong, acceptable, weak, gate = METRICS[name]
    grade = "strong" if score >= strong else "acceptable" if score >= acceptable else "weak" if score >= weak else "critical"
    return {"score": score, "grade": grade, "gate": gate}


def counts(report: dict) -> dict[str, int]:
    out = {"FAIL": 0, "WARN": 0, "INFO": 0, "PASS": 0}
    for r in report["results"]:
        out[r["status"]] += 1
    return out


def gated(report: dict) -> list[str]:
    return [name for name, m in report["metrics"].items() if m["gate"] and m["grade"] == "critical"]


def headline(report: dict) -> tuple[str, str]:
    """What to do with the run, and why: one part for each kind of fault that there is."""
    faults = {"rules broken": counts(report)["FAIL"], "gate metrics that are critical": len(gated(report))}
    why = "; ".join(f"{what}: {n}" for what, n in faults.items() if n)
    return ("Hold back", why) if why else ("Release", "no rule is broken, no gate metric is critical")


def by_category(report: dict) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in report["results"]:  # in the order of categories
        out.setdefault(r["category"], []).append(r)
    return out


def core_and_additional(report: dict) -> tuple[dict, dict]:
    groups = by_category(report)
    return {k: v for k, v in groups.items() if k not in ADDITIONAL}, {k: v for k, v in groups.items() if k in ADDITIONAL}


def shown_category(category: str) -> str:
    """Without the number of the check list before it."""
    return re.sub(r"^\d+[a-z]?(-\d+)?\.\s*", "", category)


def split_label(label: str) -> tuple[str, str]:
    """What a run is called, and its version folder if the label ends with one."""
    m = re.fullmatch(r"(?s)(.*?)(?: / (Version_\d{8}_\d{4}))?", label)
    return m[1], m[2] or ""


def anchor(*parts: str) -> str:
    return "qc-" + re.sub(r"[^a-z0-9]+", "-", "-".join(parts).lower()).strip("-")


def shorten(text: str, limit: int = SHORT) -> str:
    """As many whole words as fit into limit characters, then a mark if any is left out; a first word that is too long is cut."""
    first, *_ = textwrap.wrap((text or "").strip(), limit, max_lines=1, placeholder=" …") or [""]
    return first if first != "…" else text.split()[0][: limit - 1] + "…"


def fixes(report: dict) -> list[dict]:
    """What to mend: one entry for each failed rule, whatever its scopes, then the weak and critical metrics."""
    failed: dict[tuple[str, str], list[dict]] = {}
    for r in report["results"]:
        if r["status"] == "FAIL":
            failed.setdefault((r["category"], r["title"]), []).append(r)
    out = []
    for (category, title), rows in failed.items():
        scopes = sorted({r["scope"] for r in rows if r["scope"]})
        bad, checked = sum(r["bad"] for r in rows), sum(r["checked"] for r in rows)
        example = next((x for r in rows for x in r["examples"] or []), None)
        out.append({"tag": "QC", "where": scopes[0] if len(scopes) == 1 else f"{len(scopes)} scopes" if scopes else "", "what": f"{title}: {bad} of {checked} not", "category": category, "example": example})
    for name, m in report["metrics"].items():
        above = [x for x in METRICS.get(name, ())[1:3] if m["score"] < x]  # the minima of acceptable and weak that it misses
        if above:
            out.append({"tag": m["grade"].upper(), "where": "", "what": f"{name} is {m['score']:.3f}; {min(above):g} is the next grade", "category": "Quality Metrics", "example": None})
    return out


def overview(reports: dict[str, dict]) -> list[dict]:
    """One row for each run."""
    out = []
    for label, report in reports.items():
        n = counts(report)
        said = "Needs fixes" if n["FAIL"] else "Review warnings" if n["WARN"] else "Clean"
        out.append({"run": label, "verdict": said, "fail": n["FAIL"], "warn": n["WARN"], "pass": n["PASS"] + n["INFO"]})
    return out


def without_root(value, root: str):
    """The report without the folder that it was made in: in its strings, root goes, with slashes of either kind, escaped or not."""
    root = str(root).rstrip("/\\")
    if not root:
        return value
    step = r"(?:/|\\{1,2})"
    pattern = re.compile(step.join(re.escape(p) for p in re.split(r"[/\\]+", root)) + step)

    def of(x):
        if isinstance(x, str):
            return pattern.sub("", x)
        if isinstance(x, dict):
            return {k: of(v) for k, v in x.items()}
        return [of(v) for v in x] if isinstance(x, list) else x

    return of(value)


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)


def _table(rows: list[dict], columns: list[str] | None = None) -> str:
    if not rows:
        return ""
    columns = columns or list(rows[0])
    cell = lambda x: html.escape(shorten(", ".join(map(str, x)) if isinstance(x, list) else "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x), LONG))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"


def to_html(report: dict) -> str:
    """A self-contained page: verdict, counts, versions, what to mend, metrics, statistics and the rules by category."""
    said, why = headline(report)
    title, version = split_label(report.get("label", ""))
    part = lambda name, body: f"<h2>{html.escape(name)}</h2>{body}" if body else ""
    known = lambda key: [{k: v for k, v in report.get(key, {}).items() if v is not None}]
    out = [f"<!doctype html><meta charset=utf-8><title>Corpus audit</title><p>{html.escape(title)} <code>{html.escape(version)}</code></p><h1>{html.escape(report['verdict'])}</h1><p>{said}. {html.escape(why)}</p>"]
    out += [part(name, _table(known(key)) if known(key)[0] else "") for name, key in (("Documents", "doc_counts"), ("Generated with", "generation"))]
    todo = fixes(report)
    out.append(part(f"Fix these {len(todo)}", _table(todo, ["tag", "where", "what", "example"])))
    out.append(part("Quality metrics", _table([{"metric": k, "score": m["score"], "grade": m["grade"]} for k, m in report["metrics"].items()])))
    out += [part(f"Statistics: {name}", _table(rows)) for name, rows in report.get("statistics", {}).items()]
    for section, groups in zip(("Checks", "Default Checklist"), core_and_additional(report)):
        out += [f"<h2>{section}</h2>"] if groups else []
        for category, rows in groups.items():
            failed = sum(r["status"] == "FAIL" for r in rows)
            out.append(f"<details id={anchor(category)}{' open' if failed else ''}><summary>{html.escape(shown_category(category))}: {failed} failed of {len(rows)}</summary>{_table(rows, ['status', 'scope', 'rule', 'title', 'bad', 'checked', 'examples'])}</details>")
    return "".join(out)


def overview_html(reports: dict[str, dict]) -> str:
    """All runs at a glance, then the page of each."""
    rows = "".join(f"<tr><td>{r['verdict']}</td><td><a href=#{anchor('run', r['run'])}>{html.escape(r['run'])}</a></td><td>{r['fail']}</td><td>{r['warn']}</td><td>{r['pass']}</td></tr>" for r in overview(reports))
    pages = "".join(f"<section id={anchor('run', label)}>{to_html(report)}</section>" for label, report in reports.items())
    return f"<!doctype html><meta charset=utf-8><title>Corpus audits</title><h1>Summary across all runs</h1><table><tr><th>Verdict</th><th>Run</th><th>FAIL</th><th>WARN</th><th>PASS</th></tr>{rows}</table>{pages}"
