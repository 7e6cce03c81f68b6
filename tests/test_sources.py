import io
import tarfile
import zipfile

import pytest

from corvane.sources.runs import archive_kind, extract
from corvane.streaming.landing import append_metadata
from tests.tree import build


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", "hello")
    assert (extract(tmp_path / "a.zip", tmp_path / "out") / "x/y.txt").read_text() == "hello"
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("f.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    assert (extract(tmp_path / "b.tar.gz", tmp_path / "out2") / "f.txt").read_text() == "ok"
    assert archive_kind("A.TGZ") == "tar"
    for name in ("x.rar", "x.gz"):
        with pytest.raises(ValueError):
            archive_kind(name)


def test_members_outside_the_target_are_refused(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../../evil.txt", "x")
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.addfile(tarfile.TarInfo("../evil.txt"), io.BytesIO(b""))
    for name in ("a.zip", "a.tar"):
        with pytest.raises(ValueError):
            extract(tmp_path / name, tmp_path / "deep" / "out")
    assert not list(tmp_path.rglob("evil.txt"))


def test_streamed_landing_takes_each_file_once(spark, tmp_path):
    root = build(tmp_path / "run")
    folder = root / "Positive/outputs/metadata"
    args = (f"file://{folder}", str(tmp_path / "table"), str(tmp_path / "state"))
    append_metadata(spark, *args).awaitTermination()
    (folder / "late.json").write_text("{broken")
    append_metadata(spark, *args).awaitTermination()
    rows = {r.name: r.error for r in spark.read.parquet(args[1]).collect()}
    assert rows == {"doc0.json": None, "doc2.json": None, "doc4.json": None, "late.json": "malformed"}
