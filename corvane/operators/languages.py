"""Which language a text is in, by naive Bayes over letter pairs and triples that a corpus's own labels teach.

The model is fitted in one pass: tasks count hashed n-grams of all labelled texts by language, Spark sums them up. It has BINS
numbers for each of MAX_LANGUAGES languages at most, whatever the corpus. A text gets the language with the largest
likelihood; equals go to the first by name.

Defined cases: words are runs of letters, in lower case, with a space at either end; texts are read whole, in blocks. A text without
a letter, or with fewer than LEAST_WORDS words, has no language. Null labels teach nothing. With one language all texts are in it,
so that it can't be doubted; more_than_one() tells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1 << 14
MAX_LANGUAGES = 200
LEAST_WORDS = 6
#: Added to each count, so that what no text of a language has isn't impossible in it.
SMOOTHING = 0.2
BLOCK = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def profile(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of a text's n-grams by bin, and its words."""
    counts, words = np.zeros(BINS, np.int64), 0
    for start in range(0, len(text or ""), BLOCK):
        found = _LETTERS.findall(text[start : start + BLOCK].lower())
        if not found:
            continue
        words += len(found)
        codes = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        triples = pairs[:-1] * np.uint64(0x165667B19E3779F9) + codes[2:] * np.uint64(0x27D4EB2F165667C5)
        for keys in (pairs, triples):
            counts += np.bincount((keys >> np.uint64(50)).astype(np.int64), minlength=BINS)
    return counts, words


@dataclass
class Languages:
    names: list[str]
    weights: np.ndarray  # logarithms of the share of each bin in each language

    def more_than_one(self) -> bool:
        return len(self.names) > 1

    def of(self, text: str | None) -> str | None:
        counts, words = profile(text)
        if words < LEAST_WORDS or not self.names:
            return None
        return self.names[int((self.weights @ counts).argmax())]


def fit(texts: DataFrame) -> Languages:
    """Learn from texts(text, language)."""
    known = texts.where("language IS NOT NULL AND text IS NOT NULL").select("language", "text")
    if known.select("language").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column("language").to_pylist(), batch.column("text"), strict=True):
                counts, _ = profile(text.as_py())
                sums[language] = sums[language] + counts if language in sums else counts
        for language, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(used)), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["language", "bin", "n"])

    # A task gives a row for each bin of each language at most.
    summed = known.mapInArrow(run, "language string, bin int, n long").groupBy("language", "bin").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()  # MAX_LANGUAGES * BINS rows at most
    names = sorted(set(rows.column("language").to_pylist()))
    counts = np.full((len(names), BINS), SMOOTHING)
    place = {name: i for i, name in enumerate(names)}
    counts[[place[x] for x in rows.column("language").to_pylist()], rows.column("bin").to_numpy()] += rows.column("n").to_numpy()
    return Languages(names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts)


def detected(texts: DataFrame, model: Languages, text: str = "text", name: str = "detected") -> DataFrame:
    """texts with the language that each is in, or null. The model has a fixed largest size."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def guess(column: pd.Series) -> pd.Series:
        return column.map(sent.value.of)

    return texts.withColumn(name, guess(F.col(text)))
