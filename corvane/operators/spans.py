"""Where values stand in texts: all values of a batch are looked for in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a value that the automaton has; what follows is compared in place.
HEAD = 64
#: Bytes of values that tasks get a copy of at a time; more values take more passes over the texts.
BATCH_BYTES = 8 << 20
#: Bytes of text that a task takes at a time, one text at least.
CHUNK_BYTES = 4 << 20


class Finder:
    """First places of values in a text, by an Aho-Corasick automaton over their first characters."""

    def __init__(self, values: list[tuple[int, str]]) -> None:
        import ahocorasick

        heads: dict[str, list[tuple[int, str]]] = {}
        for i, value in values:
            heads.setdefault(value[:HEAD], []).append((i, value))
        self.automaton = ahocorasick.Automaton()
        for head, of in heads.items():
            self.automaton.add_word(head, (len(head), of))
        if heads:
            self.automaton.make_automaton()

    def first(self, text: str) -> dict[int, int]:
        """The first place of each value that is there, by its number."""
        found: dict[int, int] = {}
        if not len(self.automaton):
            return found
        for end, (size, of) in self.automaton.iter(text):
            start = end - size + 1
            for i, value in of:
                if i not in found and (len(value) == size or text.startswith(value, start)):
                    found[i] = start
        return found


@lru_cache(maxsize=1)
def _finder(sent) -> Finder:
    return Finder([(i, value) for i, (_, value) in enumerate(sent.value)])


def first_spans(texts: DataFrame, values: DataFrame) -> DataFrame:
    """(id, text, value_id, value, start, size) of each value in each text that has it; start is counted from 0, in characters.

    texts(id, text) and values(value_id, value); an empty or null value or text has no place. Values that repeat have rows of
    their own. The driver holds BATCH_BYTES of values at a time; texts are never shuffled.
    """
    wanted = values.where("value IS NOT NULL AND value <> ''")
    total = wanted.agg(F.sum(F.octet_length("value") + 16)).first()[0] or 0
    batches = max(1, -(-total // BATCH_BYTES) * 2 if total > BATCH_BYTES else 1)
    spark = texts.sparkSession
    kinds = {f.name: f.dataType for f in (*texts.select("id").schema, *values.select("value_id").schema)}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("text", T.StringType()), T.StructField("value_id", kinds["value_id"]), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())])
    out = spark.createDataFrame([], schema)
    for k in range(batches):
        batch = wanted if batches == 1 else wanted.where(F.pmod(F.xxhash64("value"), F.lit(batches)) == k)
        sent = spark.sparkContext.broadcast([(r["value_id"], r["value"]) for r in batch.select("value_id", "value").collect()])
        out = out.unionByName(texts.select("id", "text").where("text <> ''").mapInArrow(_search(sent, kinds["value_id"]), schema))
    return out


def _search(sent, kind: T.DataType):
    arrow = T.StructType([T.StructField("v", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        finder, values, value_type = _finder(sent), sent.value, to_arrow_schema(arrow).field(0).type
        for batch in batches:
            ids, rows, texts, held = batch.column("id"), [], [], 0
            for n, text in enumerate(batch.column("text")):
                text = text.as_py()
                for i, start in finder.first(text).items():
                    rows.append((n, *values[i], start))
                    texts.append(text)
                    held += len(text)
                if rows and (held > CHUNK_BYTES or n == batch.num_rows - 1):
                    yield _batch(ids, rows, texts, value_type)
                    rows, texts, held = [], [], 0
            if rows:
                yield _batch(ids, rows, texts, value_type)

    return run


def _batch(ids: pa.Array, rows: list, texts: list[str], value_type: pa.DataType) -> pa.RecordBatch:
    n, value_ids, values, starts = zip(*rows, strict=True)
    columns = [ids.take(pa.array(n, pa.int64())), pa.array(texts, pa.string()), pa.array(value_ids, value_type), pa.array(values, pa.string()), pa.array(starts, pa.int32()), pa.array([len(v) for v in values], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["id", "text", "value_id", "value", "start", "size"])
