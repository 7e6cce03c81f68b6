import io
import os
import tarfile
import zipfile
from dataclasses import fields

import pytest
from pyspark.sql import DataFrame

from corvane.sources import archives as A
from corvane.sources.land import land, land_archive
from corvane.sources.runs import SKIPPED
from corvane.sources.walk import run_folders, walk
from tests.tree import build


def tree(top):
    for name, text in {"a b/c%20d.txt": "x", "a b/.hidden": "yy", "_under/ü/日本.json": "", "plus+/x": "1", "top.txt": "z" * 1000}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    (top / "empty/inner").mkdir(parents=True)
    for i in range(30):
        (top / f"many/{i}").mkdir(parents=True)
        (top / f"many/{i}/f").write_text("1" * i)


def test_walk_lists_what_the_system_lists(spark, tmp_path):
    tree(tmp_path)
    wanted = set()
    for top, folders, files in os.walk(tmp_path):
        wanted |= {(top, n, f"{top}/{n}", True, 0) for n in folders} | {(top, n, f"{top}/{n}", False, os.path.getsize(f"{top}/{n}")) for n in files}
    assert {tuple(r) for r in walk(spark, str(tmp_path)).collect()} == wanted
    uri = {r["path"] for r in walk(spark, f"file://{tmp_path}").collect()}
    assert uri == {f"file://{w[2]}" for w in wanted}
    pruned = {r["name"] for r in walk(spark, str(tmp_path), lambda df: df["name"] != "many").collect()}
    assert "many" in pruned and "f" not in pruned
    assert walk(spark, str(tmp_path / "nowhere")).count() == 0


def test_runs_are_found_in_tasks(spark, tmp_path):
    for name in ("One/Version_20250101_1200/Version_20250101_1300", "Two/French/Version_20250102_0000", ".git/Version_20250101_1200", "node_modules/x/Version_20250101_1200", "Three/version_1"):
        (tmp_path / name).mkdir(parents=True)
    found = {r["path"] for r in run_folders(spark, str(tmp_path), SKIPPED).collect()}
    assert found == {f"{tmp_path}/One/Version_20250101_1200", f"{tmp_path}/Two/French/Version_20250102_0000"}
    inner = f"{tmp_path}/One/Version_20250101_1200"
    assert [r["path"] for r in run_folders(spark, inner, SKIPPED).collect()] == [inner]


def packed(folder, to):
    if to.suffix == ".zip":
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
            for i, p in enumerate(sorted(folder.rglob("*"))):
                info = zipfile.ZipInfo.from_file(p, str(p.relative_to(folder)))
                info.compress_type = zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED
                if p.is_dir():
                    z.writestr(info, b"")
                else:
                    with z.open(info, "w", force_zip64=i % 3 == 0) as out:
                        out.write(p.read_bytes())
    else:
        with tarfile.open(to, "w:" + {".tar": "", ".gz": "gz", ".tgz": "gz", ".bz2": "bz2"}[to.suffix], format=tarfile.PAX_FORMAT) as t:
            t.add(folder, ".")


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz", "tgz", "tar.bz2"])
def test_members_are_the_files(spark, tmp_path, kind):
    tree(tmp_path / "in")
    long = tmp_path / "in" / ("deep/" * 30 + "x" * 120)
    long.parent.mkdir(parents=True)
    long.write_bytes(os.urandom(5000))
    packed(tmp_path / "in", tmp_path / f"a.{kind}")
    A.register(spark)
    got = spark.read.format("members").option("slice_bytes", "3000").load(str(tmp_path / f"a.{kind}"))
    name = lambda n: n.removeprefix("./")
    files = {name(r["name"]): bytes(r["content"]) for r in got.collect() if not r["name"].endswith("/")}
    assert files == {str(p.relative_to(tmp_path / "in")): p.read_bytes() for p in (tmp_path / "in").rglob("*") if p.is_file()}
    assert "empty/inner/" in {name(r["name"]) for r in got.select("name").collect()}
    if kind in ("zip", "tar"):
        assert got.rdd.getNumPartitions() > 3


def test_what_leads_outside_is_refused_and_odd_archives_are_told(spark, tmp_path):
    A.register(spark)
    for bad in ("../evil.txt", "a/../../evil.txt", "/etc/evil", "C:/evil", "..\\evil"):
        with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
            z.writestr("good.txt", "x")
            z.writestr(zipfile.ZipInfo(bad), "x")
        with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
            t.addfile(tarfile.TarInfo(bad), io.BytesIO(b""))
        for archive in ("a.zip", "a.tar.gz"):
            with pytest.raises(Exception, match="outside"):
                spark.read.format("members").load(str(tmp_path / archive)).collect()
    (tmp_path / "b.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no ZIP archive"):
        spark.read.format("members").load(str(tmp_path / "b.zip")).collect()
    with zipfile.ZipFile(tmp_path / "c.zip", "w"):
        pass
    assert spark.read.format("members").load(str(tmp_path / "c.zip")).collect() == []
    assert A.checked("a/../b..c/...") == "a/../b..c/..."


@pytest.mark.parametrize("kind", ["zip", "tar.gz"])
def test_a_run_in_an_archive_lands_as_its_folder(spark, tmp_path, kind):
    root = build(tmp_path / "in", graded=True)
    (root / "context_output_normalized/cut.json").write_text('[{"value": "x"}, {"va')
    (root / "context_output_normalized/none.json").write_text("")
    (root / "Positive/outputs/metadata/bad.json").write_text("{oops")
    (root / "corpus.jsonl").write_text("\ufeff" + '{"a": 1}\r\n\n{broken\n{"b": 2}')
    packed(tmp_path / "in", tmp_path / f"a.{kind}")
    def told(t):
        rows = lambda df: sorted(map(str, (r.asDict() for r in df.drop("line").collect())))
        out = {f.name: rows(df) for f in fields(t) if isinstance(df := getattr(t, f.name), DataFrame)} | {"versions": t.versions}
        t.release()
        return out

    whole = told(land(spark, root))
    (inside, packed_run), = land_archive(spark, tmp_path / f"a.{kind}").items()
    assert inside.endswith(f"{root.parent.name}/{root.name}")
    assert told(packed_run) == whole
