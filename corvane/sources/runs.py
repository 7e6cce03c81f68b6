"""Finding delivered corpus runs on a file tree, and safe extraction of archives of them."""

from __future__ import annotations

import json
import os
import re
import tarfile
import zipfile
from dataclasses import dataclass
from pathlib import Path

# Folder names of a run tree.
RUN_NAME = re.compile(r"^Version_\d{8}_\d{4}$")
SKIPPED = frozenset(".git .venv venv node_modules __pycache__ .pytest_cache .ruff_cache site-packages .idea .vscode dist-packages".split())
LANGUAGES = frozenset(
    """english spanish french german swedish japanese korean chinese portuguese italian dutch russian arabic hindi turkish polish norwegian
    danish finnish greek hebrew thai vietnamese indonesian czech hungarian romanian ukrainian bulgarian croatian slovak slovenian estonian
    latvian lithuanian serbian swahili afrikaans zulu""".split()
)


@dataclass(frozen=True)
class Run:
    path: Path
    name: str
    language: str | None
    layout: str
    source: str

    @property
    def label(self) -> str:
        return " / ".join(x for x in (self.name, self.language, self.path.name) if x)


def _form(name: str | None) -> str:
    return re.sub(r"[^a-z0-9]+", "", (name or "").lower())


def _stated_name(path: Path) -> str | None:
    """The entity's name in the export summary, else in the first metadata file of a polarity."""

    def of(file: Path) -> str | None:
        try:
            value = json.loads(file.read_text(encoding="utf-8-sig"))
        except (OSError, ValueError):
            return None
        name = value.get("sit_name") if isinstance(value, dict) else None
        return name.strip() if isinstance(name, str) and name.strip() else None

    if found := of(path / "export_summary.json"):
        return found
    for polarity in ("Positive", "Negative"):
        first = next(iter(sorted((path / polarity / "outputs" / "metadata").glob("*.json"))), None)
        if first and (found := of(first)):
            return found
    return None


def classify(path: Path, direct: bool = False) -> Run:
    """Name, language and layout of a run from what it states and from the folders above it."""
    parent, above, stated = path.parent.name, path.parent.parent.name, _stated_name(path)
    if stated and above and _form(stated) == _form(above):
        return Run(path, above, parent, "multilingual", "summary, as the folder above")
    if stated and _form(stated) == _form(parent):
        return Run(path, parent, None, "english", "summary, as the folder")
    if above and parent.strip().lower() in LANGUAGES:
        return Run(path, stated or above, parent, "multilingual", "summary" if stated else "folder")
    if stated:
        return Run(path, stated, None, "english", "summary, unlike the folder")
    return Run(path, parent, None, "unknown" if direct else "english", "folder")


def find_runs(root: str | Path) -> list[Run]:
    """All runs at or below root. Runs have no runs inside; hidden and tool folders are left out."""
    root = Path(root)
    if RUN_NAME.match(root.name) and root.is_dir():
        return [classify(root, direct=True)]
    found = []
    for top, folders, _ in os.walk(root):
        found += [Path(top) / f for f in folders if RUN_NAME.match(f)]
        folders[:] = [f for f in folders if not (RUN_NAME.match(f) or f in SKIPPED or f.startswith("."))]
    return [classify(p) for p in sorted(set(found))]


ARCHIVES = {".zip": "zip", ".tar": "tar", ".tgz": "tar", ".tar.gz": "tar", ".tar.bz2": "tar", ".7z": "7z"}


def archive_kind(name: str) -> str:
    for end in sorted(ARCHIVES, key=len, reverse=True):
        if name.lower().endswith(end):
            return ARCHIVES[end]
    raise ValueError(f"{name}: not an archive of a known kind")


def extract(archive: str | Path, target: str | Path) -> Path:
    """Extract an archive; nothing is written if a member would land outside the target."""
    target, kind = Path(target).resolve(), archive_kind(str(archive))

    def inside(names: list[str]) -> None:
        for n in names:
            if not (target / n).resolve().is_relative_to(target):
                raise ValueError(f"{n} lies outside the target folder")

    if kind == "zip":
        with zipfile.ZipFile(archive) as z:
            inside(z.namelist())
            z.extractall(target)
    elif kind == "tar":
        with tarfile.open(archive) as t:
            inside(t.getnames())
            t.extractall(target, filter="data")
    else:
        try:
            import py7zr
        except ImportError as e:
            raise RuntimeError("7z archives need the package py7zr") from e
        with py7zr.SevenZipFile(archive) as z:
            inside(z.getnames())
            z.extractall(target)
    return target
