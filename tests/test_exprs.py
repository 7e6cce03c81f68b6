"""Expressions against short plain versions, on odd values."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import exprs as X

VALUES = ["85", "85d", "1_000", " 7 ", "12.5", ".5", "1e3", "inf", "NaN", "", "abc", 3, 2.5, True, False, None, [], {}, [1], {"a": 1}, "[]", "True", "false ", "0", 0, " ", "-4"]


def column(spark, expression):
    df = spark.createDataFrame([(i, json.dumps({"x": v})) for i, v in enumerate(VALUES)] + [(len(VALUES), "{}")], "i int, j string")
    v = F.try_variant_get(F.try_parse_json("j"), "$.x", "variant")
    return [r[0] for r in df.select("i", v.alias("v")).orderBy("i").select(expression(F.col("v"))).collect()]


def test_emptiness_and_truth(spark):
    empty = column(spark, X.is_empty)
    assert empty == [v in ("", None) or v in ([], {}) and not isinstance(v, (bool, int)) for v in VALUES] + [True]
    assert column(spark, X.is_truthy)[:-1] == [bool(v) for v in VALUES]


def test_numbers(spark):
    def number(v):
        if isinstance(v, bool) or not isinstance(v, (int, float, str)):
            return None
        try:
            return float(v.strip() if isinstance(v, str) else v)
        except ValueError:
            return None

    assert [None if x is None else str(float(x)) for x in column(spark, X.to_number)[:-1]] == [None if number(v) is None else str(number(v)) for v in VALUES]
    whole = column(spark, X.to_int)
    assert [whole[VALUES.index(v)] for v in ("85", "85d", "1_000", " 7 ", "12.5", "-4")] == [85, None, 1000, 7, None, -4]


def test_booleans(spark):
    got = column(spark, X.to_bool)
    assert [got[VALUES.index(v)] for v in ("True", "false ", "abc", None)] == [True, False, None, None]
    assert got[13] is True and got[14] is False and got[VALUES.index("85")] is None


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize("name, suffix, stem", [("a.b.docx", ".docx", "a.b"), (".hidden", "", ".hidden"), ("x.", "", "x."), ("d/e\\f.txt", ".txt", "f"), ("plain", "", "plain")])
def test_names(spark, name, suffix, stem):
    assert (one(spark, X.suffix(F.lit(name))), one(spark, X.stem(F.lit(name)))) == (suffix, stem)


def test_slugs_and_hashes(spark):
    assert one(spark, X.slug(F.lit(" A  b/C! "))) == "a-b-c"
    assert one(spark, X.without_hashes(F.lit("case-one-3f-ABCDEF12"))) == "case-one"
    assert one(spark, X.normal_name(F.lit("AB-12 c"))) == "ab12c"


@pytest.mark.parametrize("text, value, span", [("id 1-2 3.45 end", "12345", (3, 8)), ("abc", "bc", (1, 2)), ("abc", "x", None), ("a.b", "a.b", (0, 3)), ("aXb", "a.b", None), ("x", "", None), ("q" * 50, "z" * 41, None)])
def test_spans(spark, text, value, span):
    got = one(spark, X.find_span(F.lit(text), F.lit(value)))
    assert (None if got is None else (got.start, got.length)) == span


def test_observed_labels_and_windows(spark):
    text = "One. Two three four five six: 123"
    assert one(spark, X.observed_label(F.lit(text), F.lit(text.index("123")))) == "three four five six"
    assert one(spark, X.observed_label(F.lit("123"), F.lit(0))) is None
    window = one(spark, X.proximity_window(F.lit("a" * 400 + "V" + "b" * 400), F.lit(400), F.lit(1), F.lit(300).cast("long"), F.lit("Before")))
    assert window == "a" * 360
    got = one(spark, X.sentence_context(F.lit("First one. The value here! Last?"), F.lit(15), F.lit(5)))
    assert (got.before, got.current, got.after) == ("First one.", "The value here!", "Last?")


def test_shingles_and_even_steps(spark):
    words = [f"w{i}" for i in range(400)]
    listed = [" ".join(words[i : i + 5]) for i in range(396)]
    assert one(spark, X.shingles(F.lit(" ".join(words).upper()))) == [listed[int(i * 396 / 150)] for i in range(150)]
    assert one(spark, X.shingles(F.lit("One two"))) == ["one two"] and one(spark, X.shingles(F.lit("--"))) == []
    assert re.fullmatch(X.VERSION, one(spark, X.version_stamp(F.lit("/x/Version_20250101_1200/y"))))
