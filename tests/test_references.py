"""Names that match, and what reference material has of an entity and a language."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import names as N
from corvane.sources import references as R


def test_tokens_and_scores(spark):
    def one(a, b=""):
        row = spark.range(1).select(N.tokens(F.lit(a)).alias("t"), N.match_score(N.tokens(F.lit(a)), N.tokens(F.lit(b))).alias("s")).first()
        return set(row.t), row.s

    assert one("U.S. Social Security Number (SSN)")[0] == {"us", "social", "security", "number", "ssn", "ssns"}
    assert one("SIT definition and test data")[0] == set()
    assert one("US Social Security Number", "us_ssn")[1] == 1.0
    assert one("US Social Security Number", "EU Social Security Number")[1] == 0.0  # two regions
    assert one("EU Passport Number", "EU Account Number")[1] == 0.0  # nothing specific in common
    assert one("made up passport card", "norway_passport")[1] == 0.0
    assert one("Tax File Code of Adults", "tax file thing")[1] == pytest.approx(2 / 4)
    assert one("", "us_ssn")[1] == 0.0


def test_language_names(spark):
    codes = spark.createDataFrame([("en",), (" ZH-Hans ",), ("xx",), (None,)], "c string")
    assert [tuple(r) for r in codes.select(N.language_name(F.col("c")), N.shown_language(F.col("c"))).collect()] == [("English", "EN - English"), ("Chinese (Simplified)", "ZH-HANS - Chinese (Simplified)"), ("xx", "XX"), (None, None)]


@pytest.fixture
def material(tmp_path):
    packs, specs = tmp_path / "packs", tmp_path / "specs"
    for name, locales in (("us_ssn", ["en-US", "es-MX"]), ("sweden_tax_number", None), ("alpha_beta_code", [])):
        (packs / name).mkdir(parents=True)
        (packs / name / "README.md").write_text("x")
        if locales is not None:
            (packs / name / "keywords.csv").write_text("﻿locale,word\n" + "".join(f'{x},"a, b"\n' for x in locales))
    (packs / "us_ssn" / "more.txt").write_text("")
    specs.mkdir()
    (specs / "Sweden Tax Number spec.docx").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1") + b"x")
    (specs / "Gamma Delta Rule.DOCX").write_bytes(b"PK\x03\x04")
    (specs / "note.txt").write_text("x")
    (tmp_path / "list.json").write_text(json.dumps([{"SIT": "Gamma Delta Rule", "keywords": [{"language": "German "}, {"word": 1}]}, {"canonical_sit_name": ""}, 3]))
    return tmp_path


def test_material(spark, material):
    packs = {r.pack: (r.present, r.extra, len(r.missing)) for r in R.packs(spark, material / "packs").collect()}
    assert packs["us_ssn"] == (["keywords.csv", "README.md"], ["more.txt"], 5)
    assert {r.file: r.encrypted for r in R.specifications(spark, material / "specs").collect()} == {"Gamma Delta Rule.DOCX": False, "Sweden Tax Number spec.docx": True}
    assert {r.pack: r.languages for r in R.pack_languages(spark, material / "packs").collect()} == {"us_ssn": ["en", "es"]}
    assert {tuple(r) for r in R.gaps(spark, material / "packs", material / "specs").collect()} == {
        ("pack without specification", "us_ssn"), ("pack without specification", "alpha_beta_code"), ("specification without pack", "Gamma Delta Rule.DOCX"),
    }


def test_coverage(spark, material):
    wanted = [("US Social Security Number", "Spanish"), ("US Social Security Number", "French"), ("EU Social Security Number", "English"), ("Gamma Delta Rule", "German"), ("Sweden Tax Number", "Swedish")]
    rows = R.coverage(spark, spark.createDataFrame(wanted, "name string, language string"), material / "packs", material / "specs", material / "list.json").collect()
    got = {(r.name, r.language): (r.pack, r.specification, r.entry, r.status) for r in rows}
    assert got == {
        wanted[0]: ("us_ssn", None, None, "confirmed"), wanted[1]: ("us_ssn", None, None, "found_unconfirmed_language"), wanted[2]: (None, None, None, "not_found"),
        wanted[3]: (None, "Gamma Delta Rule.DOCX", "Gamma Delta Rule", "confirmed"), wanted[4]: ("sweden_tax_number", "Sweden Tax Number spec.docx", None, "found_unconfirmed_language"),
    }
    none = R.coverage(spark, spark.createDataFrame(wanted[:1], "name string, language string"), material / "absent").collect()
    assert [r.status for r in none] == ["not_found"]
