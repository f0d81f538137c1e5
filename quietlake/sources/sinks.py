"""Writers: safe tables with their plans, dictionaries, reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_safe(df: DataFrame, plan: list[tuple[str, str]], out: str, source: str) -> dict:
    """The table as tab-separated text in the folder ``out``, and beside it the plan, which names columns and no values.

    Names that end in .csv are refused, so that a rule against such files can stay broad.
    """
    if out.lower().rstrip("/").endswith(".csv"):
        raise ValueError("refusing to write a .csv; use .tsv")
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("sep", "\t").option("header", "true").option("emptyValue", "").csv(out)
    summary = {"source": source, "out": out, "rows": seen.get["rows"], "columns": [{"name": n, "action": a} for n, a in plan]}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out.rstrip('/')}.schema.json")
    return summary


def write_dictionary(persons: DataFrame, out: str, generated: str) -> None:
    """A dictionary's JSON in one file that only its owner can read; readers see the old one or the new one.

    It is written row by row as Spark hands the rows over, so it needn't fit in memory.
    """
    file = Path(out).expanduser()
    file.parent.mkdir(parents=True, exist_ok=True)
    draft = file.with_suffix(".tmp")
    fields = [c for c in ("id", "names", "emails", "phones", "ids") if c in persons.columns]
    rows = persons.orderBy("position") if "position" in persons.columns else persons
    with os.fdopen(os.open(draft, os.O_CREAT | os.O_TRUNC | os.O_WRONLY, 0o600), "w", encoding="utf-8") as f:
        f.write(f'{{"generated": {json.dumps(generated)}, "persons": [')
        for i, row in enumerate(rows.select(F.to_json(F.struct(*fields)).alias("p")).toLocalIterator()):
            f.write((", " if i else "") + row["p"])
        f.write("]}")
    os.replace(draft, file)


def report(found: DataFrame) -> tuple[dict, int]:
    """Counts by file and kind, and the exit code: 1 if anything was found, else 0; the shell tool ends with 2 where it couldn't look."""
    by_file: dict = {}
    for r in found.orderBy("file", "kind").toLocalIterator():
        by_file.setdefault(r["file"], {})[r["kind"]] = r["n"]
    return by_file, int(bool(by_file))
