"""Quality rules: a decision list learned by sequential covering.

Statistics come from whole texts (words lie between space, tab, LF, VT, FF and
CR). Learning takes labelled rows that pass the base rule, splits them by a hash
of the id into two thirds to grow and one third to prune, and repeats: grow a
conjunction of thresholds by FOIL gain, cut conditions off its end while that
doesn't worsen it on the pruning rows, accept it if it is precise enough, and go
on with the rows it doesn't cover. The list becomes one Spark conditional
expression in the order of learning; a document that no rule rejects is kept.

Defined cases: null and empty texts have no words and fail the base rule. Without
labels of both kinds the list is empty and only the base rule decides. Labels
that are null teach nothing; of repeated labels of an id the smallest counts.
Of conditions with equal gain the first by statistic and threshold is taken.
Very long texts are counted whole. Only the named columns are read, so that other
names can't clash. Repeated rows get equal results; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_chunks
from .shingles import odd_numbers

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Labelled rows that come to the driver, about: of more, a share drawn by hash of their id.
SAMPLE_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
MAX_THRESHOLDS = 200
MIN_PRECISION = 0.95
MIN_COVER = 5

#: What conditions test: name, Spark expression and the same for a pandas frame.
FEATURES: dict[str, tuple[Callable[[], Column], Callable[[pd.DataFrame], np.ndarray]]] = {
    "symbols per word": (lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)), lambda t: t["n_symbols"] / np.maximum(t["n_words"], 1)),
    "repeated share": (lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)), lambda t: t["n_repeat_words"] / np.maximum(t["n_words"], 1)),
    "chars per word": (lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)), lambda t: t["word_chars"] / np.maximum(t["n_words"], 1)),
    "duplicate lines": (lambda: F.col("n_dup_lines").cast("double"), lambda t: t["n_dup_lines"].astype(float)),
    "words": (lambda: F.col("n_words").cast("double"), lambda t: t["n_words"].astype(float)),
}


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Of each text, the words that lie in a window of WINDOW words found twice or more in it."""
    sizes = np.array([len(x) for x in words], np.int64)
    out = np.zeros(len(words), np.int64)
    number = _Numbers()
    flat = np.fromiter((number[w] for x in words for w in x), np.int64, int(sizes.sum()))
    if len(flat) < WINDOW + 1:
        return out
    text_of = np.repeat(np.arange(len(words)), sizes)
    n = len(flat) - WINDOW + 1
    factors = odd_numbers(WINDOW + 1, 3)
    mixed = text_of[:n].astype(np.uint64) * factors[WINDOW]
    for i in range(WINDOW):
        mixed += (flat[i : i + n].astype(np.uint64) + np.uint64(1)) * factors[i]
    mixed ^= mixed >> np.uint64(31)
    valid = np.flatnonzero(text_of[:n] == text_of[WINDOW - 1 :])
    order = valid[np.argsort(mixed[valid], kind="stable")]
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = np.append(same, False) | np.append(False, same)
    at = order[twice]
    if not len(at):
        return out
    # Equal hashes are confirmed on the words themselves.
    rows = np.stack([text_of[at], *(flat[at + i] for i in range(WINDOW))], axis=1)
    _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[back.ravel()] > 1]
    marked = np.zeros(len(flat) + 1, np.int64)
    np.add.at(marked, at, 1)
    np.add.at(marked, at + WINDOW, -1)
    return np.bincount(text_of[np.cumsum(marked[:-1]) > 0], minlength=len(words))


def text_stats(texts: list[str | None]) -> dict[str, np.ndarray]:
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(words),
    }


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, STATS..., base_failed) of each row."""
    source = docs.select(docs[id_col], docs[text_col].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_text"):
            found = text_stats(part.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[s]) for s in STATS]], names=[id_col, *STATS])

    counted = source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in STATS))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = FEATURES[self.feature][0]()
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for c in rule:
        out &= c.holds(values)
    return out


def _candidates(values: dict[str, np.ndarray]) -> Iterator[Condition]:
    for name, x in values.items():
        points = np.unique(x)
        middles = (points[1:] + points[:-1]) / 2
        if len(middles) > MAX_THRESHOLDS:
            middles = middles[np.linspace(0, len(middles) - 1, MAX_THRESHOLDS).astype(int)]
        for t in middles.tolist():
            yield Condition(name, True, t)
            yield Condition(name, False, t)


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the largest FOIL gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[inside]).any():
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p:
            break
        best, gain = None, 1e-9
        here = {k: v[inside] for k, v in values.items()}
        for c in _candidates(here):
            held = c.holds(here)
            q, m = int((held & bad[inside]).sum()), int((held & ~bad[inside]).sum())
            if q and (new := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain + 1e-9:
                best, gain = c, new
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(values)
    return rule


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        held = covers(r, values)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(table: pd.DataFrame, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list for a frame with STATS, `bad` and `part` (0 and 1 grow, 2 prunes)."""
    values = {k: np.asarray(f(table), float) for k, (_, f) in FEATURES.items()}
    bad, growing = table["bad"].to_numpy(bool), table["part"].to_numpy() < 2
    left, rules = np.ones(len(table), bool), []
    pick = lambda m: ({k: v[m] for k, v in values.items()}, bad[m])
    while len(rules) < MAX_RULES and (bad & left & growing).any():
        rule = prune(grow(*pick(left & growing)), *pick(left & ~growing)) if (left & ~growing).any() else ()
        if not rule:
            break
        held = covers(rule, values) & left
        precise = all((m := held & side).sum() and (bad & m).sum() >= min_precision * m.sum() for side in (growing, ~growing))
        if not precise or (held & bad).sum() < MIN_COVER:
            break
        rules.append(rule)
        left &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for what the list keeps."""
    if not rules:
        return F.lit(True)
    out = F
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_sample(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """About `rows` labelled rows, drawn by hash, that pass the base rule, one for each id; label 0 is bad."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"))
    share = rows / max(known.count(), 1)
    drawn = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < share * (1 << 40))
    joined = stats.where(~F.col("base_failed")).join(drawn, id_col).groupBy(id_col).agg(F.min(F.struct(*STATS, (F.col("label") == 0).alias("bad"))).alias("row"))
    return joined.select(id_col, "row.*", F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.lit(3)).alias("part")).toPandas().sort_values(id_col, kind="stable")
