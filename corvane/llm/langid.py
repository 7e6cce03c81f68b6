"""Language identification by the nearest of several centroids per language.

A text's vector has the letter trigrams of its words (lower case, a space at
either end of a word), hashed to BINS bins, as (1 + log count) * idf, scaled to
length 1. Fitting draws a bounded sample of labelled rows by hash of their id,
at most per_language of each language and MAX_LANGUAGES languages, takes idf
from it and clusters each language's vectors into `clusters` centroids by
spherical k-means. A text gets the language of the centroid with the largest
cosine; it is rejected if that cosine is below the floor for its length. Cosines
grow with the number of bins that a text fills, so floors are learned from the
sample by powers of two of it: a share of a low quantile, which a few odd sample
texts don't move.

Defined cases: texts that are null or have no letter are `und`, score 0,
rejected. Texts are read whole, in blocks, so that memory doesn't grow with their
length. Rows are independent, so that repeated rows and ids have results of their
own (of rows that repeat an id and a label one teaches, that with the least text); of equal cosines the
centroid that comes first by label counts. Labels that are null teach nothing;
without any label all is `und`. A carried column with the name of a result is left
out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_chunks

BINS = 4096
PER_LANGUAGE = 400
MAX_LANGUAGES = 64
CLUSTERS = 4
#: The floor of a length is this share of this quantile of the cosines that sample texts of that length have with their own language.
FLOOR_SHARE, FLOOR_QUANTILE = 0.5, 0.02
#: Lengths with fewer sample texts take their floor from another.
FLOOR_TEXTS = 20
BLOCK = 1 << 19
UNKNOWN = "und"


@cache
def _folded() -> np.ndarray:
    """Of each code point: its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed letter trigrams, one row per text."""
    table = _folded()
    counts = np.zeros((len(texts), BINS), np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        last = np.full(2, 32, np.uint32)
        for start in range(0, len(text) + 1, BLOCK):
            codes = table[np.frombuffer(text[start : start + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
            if start + BLOCK > len(text):
                codes = np.append(codes, np.uint32(32))
            codes = np.concatenate([last, codes])
            keep = (codes != 32) | np.append(True, codes[:-1] != 32)
            keep[:2] = True
            codes = codes[keep]
            inner = codes[1:-1] != 32
            mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            bins = (mixed >> np.uint32(20))[inner]
            counts[row] += np.bincount(bins, minlength=BINS)
            last = codes[-2:] if len(codes) >= 2 else np.concatenate([last, codes])[-2:]
    return counts


def _length(counts: np.ndarray) -> np.ndarray:
    """The power of two of the number of bins that each row fills."""
    return np.frexp((counts > 0).sum(axis=1))[1]


def _floors(lengths: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The floor of each length. One with few texts has that of the next shorter one with enough; the shortest fall with the root of the length."""
    sizes = np.bincount(lengths, minlength=BINS.bit_length() + 1)
    floors, enough = np.zeros(len(sizes)), np.flatnonzero(sizes >= min(FLOOR_TEXTS, sizes.max()))
    for k in range(len(sizes)):
        if k in enough:
            floors[k] = FLOOR_SHARE * np.quantile(cosines[lengths == k], FLOOR_QUANTILE)
        else:
            floors[k] = floors[k - 1] if k > enough[0] else 0
    for k in range(enough[0] - 1, -1, -1):
        floors[k] = floors[k + 1] / np.sqrt(2)
    return floors


class Sample:
    """Counts of trigrams of some texts, of which only those of a few are held densely at a time."""

    def __init__(self, labels: list[str], bins: list[np.ndarray], counts: list[np.ndarray]) -> None:
        seen = [i for i, b in enumerate(bins) if len(b)]
        self.labels, self.bins, self.counts = [labels[i] for i in seen], [bins[i] for i in seen], [counts[i] for i in seen]

    @classmethod
    def of(cls, labels: list[str], dense: np.ndarray) -> Sample:
        bins = [np.flatnonzero(x) for x in dense]
        return cls(labels, bins, [x[b] for x, b in zip(dense, bins, strict=True)])

    def dense(self, rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), BINS), np.float32)
        for at, i in enumerate(rows):
            out[at, self.bins[i]] = self.counts[i]
        return out

    def texts_with(self) -> np.ndarray:
        """Number of texts in which each bin is filled."""
        out = np.zeros(BINS, np.int64)
        for b in self.bins:
            out[b] += 1
        return out


@dataclass
class Centroids:
    """A fitted classifier."""

    languages: list[str]
    language_of: np.ndarray
    centres: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        out = np.zeros_like(counts)
        np.log(counts, out=out, where=counts > 0)
        out += counts > 0
        out *= self.idf
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each row of counts."""
        blank = ~counts.any(axis=1)
        if not self.languages:
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosines = self.vectors(counts) @ self.centres.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best].astype(float), 0, 1)
        score[blank] = 0
        named = [UNKNOWN if b else self.languages[self.language_of[k]] for b, k in zip(blank.tolist(), best.tolist(), strict=True)]
        return named, score, blank | (score < self.floors[_length(counts)])


def _clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are the mean's nearest vector and then the farthest ones."""
    picked = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(picked) < k:
        picked.append(int((vectors @ vectors[picked].T).max(axis=1).argmin()))
    centres = vectors[picked]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        for j in range(k):
            if (nearest == j).any():
                total = vectors[nearest == j].sum(axis=0)
                centres[j] = total / max(float(np.linalg.norm(total)), 1e-9)
    return centres


def fit_counts(labels: list[str], counts: np.ndarray, clusters: int = CLUSTERS) -> Centroids:
    return fit_sample(Sample.of(labels, counts), clusters)


def fit_sample(sample: Sample, clusters: int = CLUSTERS) -> Centroids:
    languages = sorted(set(sample.labels))
    idf = (np.log((1 + len(sample.labels)) / (1 + sample.texts_with())) + 1).astype(np.float32)
    model = Centroids(languages, np.zeros(0, int), np.zeros((0, BINS), np.float32), idf, np.zeros(BINS.bit_length() + 1))
    if not languages:
        return model
    centres, owner, lengths, cosines = [], [], [], []
    for i, language in enumerate(languages):
        counts = sample.dense([k for k, x in enumerate(sample.labels) if x == language])
        own = model.vectors(counts)
        found = _clustered(own, max(1, min(clusters, len(own) // 20)))
        centres.append(found)
        owner += [i] * len(found)
        lengths.append(_length(counts))
        cosines.append((own @ found.T).max(axis=1))
    model.centres, model.language_of = np.concatenate(centres), np.array(owner)
    model.floors = _floors(np.concatenate(lengths), np.concatenate(cosines))
    return model


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Centroids:
    """Learn from rows for which usable holds and the label isn't null.

    At most per_language rows of each of at most MAX_LANGUAGES labels come to
    the driver, as counts of trigram bins.
    """
    named = docs.where(usable & docs[label_col].isNotNull() & docs[id_col].isNotNull()).select(docs[id_col].alias("id"), docs[label_col].alias("label"))
    if named.select("label").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    # A draw by hash at about twice the rate that is needed comes first, so that no task ranks all ids of a label. The count may be a few percent off.
    counted = named.groupBy("label").agg(F.approx_count_distinct("id", 0.02).alias("n"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    early = F.col("place") * (F.col("n") / (1 << 40)) < 2 * per_language + 200
    turn = F.row_number().over(Window.partitionBy("label").orderBy("place", "id"))
    few = named.withColumn("place", place).join(F.broadcast(counted), "label").where(early).select("id", "label", "place").distinct()
    drawn = few.withColumn("turn", turn).where(F.col("turn") <= per_language).select("id", "label")
    taught = docs.where(usable).select(docs[id_col].alias("id"), docs[label_col].alias("label"), docs[text_col].alias("text")).join(F.broadcast(drawn), ["id", "label"], "left_semi")
    rows = taught.groupBy("id", "label").agg(F.min("text").alias("text"))
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("id", T.StringType()), T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            for start in range(0, part.num_rows, 64):
                cut = part.slice(start, 64)
                counts = trigram_counts(cut.column("text").to_pylist())
                bins = [np.flatnonzero(x).astype(np.int32) for x in counts]
                yield pa.RecordBatch.from_arrays([cut.column("label").cast(pa.string()), cut.column("id").cast(pa.string()), pa.array(bins, pa.list_(pa.int32())), pa.array([x[b] for x, b in zip(counts, bins, strict=True)], pa.list_(pa.float32()))], names=schema.names)

    sample = rows.select("label", "id", "text").mapInArrow(run, schema).toArrow().sort_by([("label", "ascending"), ("id", "ascending")])
    lists = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in sample.column(c).combine_chunks()] if sample.num_rows else []
    return fit_sample(Sample(sample.column("label").to_pylist(), lists("bins"), lists("counts")), clusters)


def predict(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, columns in carry, lang_pred, score, rejected) of each row. The model has a fixed largest size."""
    carried = dict.fromkeys(c for c in [id_col, *carry] if c not in ("lang_pred", "score", "rejected"))
    source = docs.select(*[docs[c].alias(f"in_{c}") for c in carried], *([] if text_col in carried else [docs[text_col].alias(f"in_{text_col}")]))
    kept = [T.StructField(c, docs.schema[c].dataType) for c in carried]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for part in text_chunks(batches, f"in_{text_col}"):
            texts = part.column(f"in_{text_col}").to_pylist()
            found = [fitted.predict(trigram_counts(texts[i : i + 128])) for i in range(0, len(texts), 128)]
            named = pa.array([x for names, _, _ in found for x in names], pa.string())
            score = pa.array(np.concatenate([s for _, s, _ in found]), pa.float64())
            gone = pa.array(np.concatenate([r for _, _, r in found]), pa.bool_())
            yield pa.RecordBatch.from_arrays([*[part.column(f"in_{f.name}") for f in kept], named, score, gone], names=schema.names)

    return source.mapInArrow(run, schema)
