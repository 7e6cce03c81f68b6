import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rows = []
    for i in range(60):
        own = " ".join(f"word{i}x{j} lorem ipsum dolor" for j in range(6 + i % 5))
        rows.append((i, own + "\nA line that all documents share\nshort", "aa" if i % 2 else "bb", f"s{i % 3}"))
    rows += [(100, None, None, None), (101, "", "aa", "s0"), (102, "漢字", "aa", "s0"), (103, rows[5][1].replace("short", "brief"), "aa", "s1"), (104, "12 34", "bb", "s1")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    seen = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    # Texts without a letter, and one unlike all that was learned, go; all else stays.
    assert {r.doc_id for r in seen["language_id"].collect()} == {*range(60), 103}
    lines = {r.doc_id: r for r in seen["line_dedup"].collect()}
    assert "A line that all documents share" in lines[0].text
    assert all("A line" not in lines[i].text and lines[i].text.endswith("short") for i in range(1, 60))
    assert lines[103].text == "brief" and all(r.n_chars == len(r.text) for r in lines.values())
    kept = {r.doc_id for r in seen["near_dedup"].collect()}
    assert kept == {*range(60), 103}
    assert all(df.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") for n, df in seen.items() if n != "encode")
    words = lambda df: df.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(words(seen["mix_sources"]) - 1.5 * words(seen["near_dedup"])) <= 3
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, library.encode(r.text)) for r in seen["mix_sources"].collect())
    assert sorted((r.doc_id, r.ids) for r in seen["encode"].collect()) == want
