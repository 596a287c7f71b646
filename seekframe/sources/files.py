"""Small files on the driver: evaluation sets, data folders, sizes."""

from __future__ import annotations

import json
import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import plain_name, relaxed_json


def load_cases(path: str | Path) -> list[dict]:
    """``query``, ``expected`` and ``note`` of each case; comments and trailing commas are allowed."""
    given = {plain_name(k): v for k, v in relaxed_json(Path(path).read_text("utf-8")).items()}
    return [{plain_name(k): v for k, v in case.items()} for case in given.get("queries", [])]


def save_cases(path: str | Path, cases: list[dict], description: str | None = None) -> None:
    whole = ({"description": description} if description else {}) | {"queries": [{k: v for k, v in c.items() if v is not None} for c in cases]}
    Path(path).write_text(json.dumps(whole, indent=2, ensure_ascii=False), "utf-8")


EXAMPLE_CASES = [{"query": "budget review notes", "expected": ["<message-id@example.com>"], "note": "words"}, {"query": '"INV-20431"', "expected": ["rowid:2"], "note": "an identifier"}]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """``qid, query, ref``: one row for each expected reference."""
    rows = spark.read.option("multiLine", True).option("allowComments", True).schema("queries array<struct<query:string,expected:array<string>,note:string>>").json(path)
    cases = rows.select(F.posexplode("queries").alias("qid", "c"))
    return cases.select(F.col("qid").cast("string").alias("qid"), "c.query", F.explode_outer("c.expected").alias("ref"))


@dataclass
class Usage:
    tables: int = 0
    models: int = 0
    other: int = 0

    @property
    def total(self) -> int:
        return self.tables + self.models + self.other


def _size(path: Path) -> int:
    return path.stat().st_size if path.is_file() else sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def usage(folder: str | Path, tables: tuple[str, ...] = ("index",), models: str = "models") -> Usage:
    """Bytes of a data folder: tables (entries whose names start so), models, and the rest."""
    out = Usage()
    if Path(folder).is_dir():
        for entry in Path(folder).iterdir():
            kind = "models" if entry.name == models else "tables" if entry.name.startswith(tables) else "other"
            setattr(out, kind, getattr(out, kind) + _size(entry))
    return out


def purge(folder: str | Path) -> list[str]:
    """Delete a data folder; returns what could not be deleted."""
    left = []
    place = Path(folder)
    for entry in list(place.iterdir()) if place.is_dir() else []:
        try:
            shutil.rmtree(entry) if entry.is_dir() and not entry.is_symlink() else entry.unlink()
        except OSError:
            left.append(str(entry))
    if not left and place.is_dir():
        try:
            place.rmdir()
        except OSError:
            left.append(str(place))
    return left


def size_text(n: int) -> str:
    value, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if value < 1024 or unit == "TB":
            break
        value /= 1024
    return f"{value:.0f} {unit}" if unit == "B" else f"{value:.1f} {unit}"
