"""The tools in one place: every method returns plain data with ok = true or false, and errors name their class only."""

from __future__ import annotations

import functools
import json
import sys
import threading
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.pii_rules import BLOB
from .operators.admission import admit, bare, error_class, sandbox
from .operators.egress import cap_output, plain, taint, text_hits
from .operators.masking import dictionary_entries, mask
from .operators.profile import profile, row_estimate
from .operators.sums import with_exact_sums
from .operators.suppress import suppress_small_cells
from .operators.synth import synth_rows
from .session import ship
from .sources import files as source_files
from .storage import scratch, written


def _tool(method: Callable) -> Callable:
    @functools.wraps(method)
    def run(self, *args, **kwargs):
        try:
            with scratch(self.spark):  # masking stores texts on its way
                out = method(self, *args, **kwargs)
        except Exception as e:  # noqa: BLE001  a message may quote data
            return {"ok": False, "error": f"internal error in {method.__name__}: {error_class(e)}"}
        return cap_output({"ok": True} | out, self.settings.max_output_chars) if "error" not in out else {"ok": False} | out

    return run


class Inputs:
    """What an analysis function sees: ``load`` reads an input and taints its personal columns, ``log`` keeps short lines."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], is_pii):
        self.spark, self.paths, self.is_pii = spark, paths, is_pii
        self.logs: list[str] = []
        self.forms: DataFrame | None = None

    def load(self, file_id: str, **options) -> DataFrame:
        if file_id not in self.paths:
            raise FileNotFoundError(f"input {file_id} was not asked for")
        df = source_files.load(self.spark, self.paths[file_id], **options)
        forms = taint(df, self.is_pii)
        self.forms = forms if self.forms is None else self.forms.union(forms).distinct()
        return df

    def log(self, message) -> None:
        if len(self.logs) < 20:
            self.logs.append(str(message)[:200])


class Engine:
    """Guarded access to safe views and to the inbox."""

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame], settings: Settings | None = None, entries: DataFrame | None = None):
        self.spark, self.settings, self.entries = ship(spark), settings or Settings(), entries
        self.views = {name.lower(): df for name, df in views.items()}
        self.inner = sandbox(spark, self.views)

    # ---- views
    @_tool
    def schema_describe(self, view: str | None = None) -> dict:
        """The views' columns, and synthetic rows of the same shape."""
        if view is not None and view not in self.views:
            return {"error": f"no such view: {view}", "available": sorted(self.views)}
        shown = [view] if view else sorted(self.views)
        described = [{"view": v, "columns": [{"name": n, "type": t} for n, t in self.views[v].dtypes], "sample_synthetic": self._fakes(self.views[v].dtypes, 5)} for v in shown]
        return {"schema": self.settings.db_schema, "views": described, "note": "sample rows are synthetic"}

    def _fakes(self, columns, n: int) -> list[dict]:
        return [r.asDict() for r in synth_rows(self.spark, columns, n).collect()]

    def guarded(self, sql: str, limit: int | None = None, observation: Observation | None = None) -> DataFrame:
        """The admitted query as a table, with small counts suppressed outermost."""
        if reason := admit(self.inner, sql, set(self.views)):
            raise ValueError(f"rejected: {reason}")
        df = with_exact_sums(self.inner.sql(bare(sql)))
        return suppress_small_cells(df if limit is None else df.limit(limit), self.settings.small_cell, observation)

    @_tool
    def sql_run(self, sql: str, max_rows: int = 50) -> dict:
        """One SELECT over the safe views: rows are capped, small counts are null."""
        n = max(1, min(int(max_rows), self.settings.max_rows))
        if reason := admit(self.inner, sql, set(self.views)):
            return {"error": f"rejected: {reason}"}
        tag = f"quietlake-{threading.get_ident()}"
        timer = threading.Timer(self.settings.statement_timeout_s, lambda: self.inner.interruptTag(tag))
        self.inner.addTag(tag)
        timer.start()
        try:
            df = with_exact_sums(self.inner.sql(bare(sql)))
            rows = df.limit(n + 1).collect()
            kept = suppress_small_cells(self.inner.createDataFrame(rows[:n], df.schema), self.settings.small_cell).collect()
        except Exception as e:  # noqa: BLE001
            return {"error": f"query failed: {error_class(e)}"}
        finally:
            timer.cancel()
            self.inner.removeTag(tag)
        hidden = sum(a is not None and b is None for old, new in zip(rows, kept, strict=False) for a, b in zip(old, new, strict=True))
        return {"columns": df.columns, "rows": [list(r) for r in kept], "row_count": len(kept), "more_rows": len(rows) > n, "suppressed_cells": hidden, "small_cell_threshold": self.settings.small_cell}

    # ---- inbox
    def _files(self) -> dict[str, tuple]:
        return {r["file_id"]: r for r in source_files.list_inbox(self.spark, self.settings.inbox).collect()}  # a folder's names

    def _describe(self, row) -> dict:
        about = {"id": row["file_id"], "ext": row["ext"], "bytes": row["bytes"], "modified": row["modified"].isoformat(timespec="seconds")}
        if row["ext"] not in source_files.TEXT_SUFFIXES:
            return about | {"note": "no delimited text; load it in an analysis"}
        table, sep = source_files.read_delimited(self.spark, row["path"], row["ext"])
        if not table.columns:
            return about | {"columns": []}
        columns = [r.asDict() for r in profile(table, self.settings.is_pii).collect()]
        return about | {"delimiter": "tab" if sep == "\t" else sep, "rows_estimate": row_estimate(table.count()), "columns": columns}

    @_tool
    def files_describe(self) -> dict:
        """The inbox's files and the shape of their columns; a file that can't be read is said to be so."""
        described = []
        for row in self._files().values():
            try:
                described.append(self._describe(row))
            except Exception as e:  # noqa: BLE001
                described.append({"id": row["file_id"], "error": f"could not describe: {error_class(e)}"})
        return {"files": described} | ({} if described else {"note": "inbox is empty or missing"})

    @_tool
    def fixture_make(self, source: str, n: int = 5) -> dict:
        """Synthetic rows in the shape of a file or of a view."""
        files, count = self._files(), max(1, min(int(n), 50))
        if source in files:
            columns = [(c["name"], c["type"]) for c in self._describe(files[source]).get("columns", [])]
            if not columns:
                return {"error": "file has no describable columns"}
        elif source in self.views:
            columns = self.views[source].dtypes
        else:
            return {"error": f"unknown source: {source}", "views": sorted(self.views), "file_ids": sorted(files)}
        return {"source": source, "rows": self._fakes(columns, count), "note": "synthetic"}

    @_tool
    def read_masked(self, file_id: str, limit: int = 50) -> dict:
        """The first lines of an inbox file, masked."""
        files = self._files()
        if file_id not in files:
            return {"error": f"no file has the id {file_id}", "file_ids": sorted(files)}
        if files[file_id]["ext"] not in source_files.LINE_SUFFIXES:
            return {"error": "only text files can be read masked"}
        lines = source_files.head_lines(self.spark, files[file_id]["path"], limit)
        texts = self.spark.createDataFrame(list(enumerate(lines)), "n int, line string")
        masked, _ = mask(texts, "n", "line", self.entries, patient_id=self.settings.patient_id_regex, allow_emails=self.settings.allow_email_domains)
        shown = [r["text"] for r in masked.orderBy("key").collect()]
        return {"file_id": file_id, "lines": shown, "line_count": len(shown)}

    @_tool
    def run_analysis(self, fn: Callable[[Inputs], object], inputs: list[str] | None = None) -> dict:
        """The result of ``fn(inputs)`` if it is small and holds no protected value; row-wise data doesn't pass."""
        files = self._files()
        if unknown := [i for i in inputs or [] if i not in files]:
            return {"error": f"no file has the id {unknown[0]}", "file_ids": sorted(files)}
        data = Inputs(self.spark, {i: files[i]["path"] for i in inputs or []}, self.settings.is_pii)
        try:
            value = fn(data)
        except Exception as e:  # noqa: BLE001
            return {"error": f"analysis failed: {error_class(e)}"}
        if value is None:
            return {"error": "analysis returned no result"}
        result = plain(value, self.settings.string_max)
        text = json.dumps(result, ensure_ascii=False)
        size = len(text.encode())
        if size > self.settings.result_bytes:
            return {"error": "result too large", "reason": f"{size} bytes; the limit is {self.settings.result_bytes}"}
        checked = text + "\n" + "\n".join(data.logs)
        if data.forms is not None and (hits := text_hits(self.spark, checked, data.forms)):
            return {"error": "result contains protected values", "reason": f"{hits} forms"}
        if self.spark.range(1).select(F.regexp_count(F.lit(text), F.lit(BLOB)).alias("n")).first()["n"]:
            return {"error": "the answer holds encoded data (blobs) and stays here"}
        return {"result": result, "logs": data.logs}


def open_engine(spark: SparkSession, views: dict[str, DataFrame], config: str | None = None, dictionary: str | None = None) -> Engine:
    """An engine with the settings of a TOML file and the persons of a dictionary."""
    settings = Settings.load(config) if config else Settings()
    persons = source_files.read_dictionary(spark, dictionary) if dictionary else None
    return Engine(spark, views, settings, dictionary_entries(persons) if persons is not None else None)


def _scan_folder(spark: SparkSession, settings: Settings, folder: str, since: str | None, dictionary: str | None) -> int:
    """Counts by file and kind on standard output; 1 if there are any, 0 if not, 2 without such a folder."""
    from .operators.content import findings
    from .sources.sinks import report

    if "://" not in folder and not Path(folder).expanduser().is_dir():
        print(f"no such folder: {folder}", file=sys.stderr)
        return 2
    name = F.col("_metadata.file_path").alias("file")
    lines = source_files.scanned_files(spark, folder, since, (".jsonl",)).text(folder).select("value", name)
    whole = source_files.scanned_files(spark, folder, since, (".md", ".txt", ".json")).text(folder, wholetext=True).select(name, F.col("value").alias("text"))
    # stored with their keys: a second pass might number them otherwise
    texts = written(source_files.transcript_texts(lines).unionByName(whole).withColumn("key", F.monotonically_increasing_id()), "scanned")
    entries = dictionary_entries(source_files.read_dictionary(spark, dictionary)) if dictionary else None
    masked, _ = mask(texts, "key", "text", entries, site="prompt", patient_id=settings.patient_id_regex, allow_emails=settings.allow_email_domains)
    by_file, code = report(findings(texts.select("key", "file").join(masked, "key")))
    print(json.dumps(by_file, ensure_ascii=False))
    return code


def main(argv: list[str] | None = None) -> int:
    """python -m quietlake.engine: safeify, dictionary or scan from a shell."""
    import argparse
    import datetime

    from .functions.pseudonyms import create_key, load_key
    from .operators.deidentify import safeify
    from .operators.masking import build_dictionary
    from .sources.sinks import write_dictionary, write_safe

    parser = argparse.ArgumentParser(prog="quietlake")
    parser.add_argument("--config", default=None)
    tools = parser.add_subparsers(dest="tool", required=True)
    one = tools.add_parser("safeify")
    one.add_argument("source")
    one.add_argument("--out", required=True)
    for name in ("pseudo", "year", "keep", "drop"):
        one.add_argument(f"--{name}", action="append", default=[])
    one = tools.add_parser("dictionary")
    one.add_argument("source", help="a delimited file, or a database's JDBC address if --query is given")
    one.add_argument("--query", default=None, help="a SELECT whose rows are the persons")
    one.add_argument("--order", default=None, help="the query's column that gives the persons' order; else --id")
    one.add_argument("--out", required=True)
    one.add_argument("--id", required=True)
    for name in ("names", "emails", "phones", "ids"):
        one.add_argument(f"--{name}", nargs="*", default=[])
    one = tools.add_parser("scan")
    one.add_argument("folder")
    one.add_argument("--since", default=None)
    one.add_argument("--dictionary", default=None)
    tools.add_parser("key")
    args = parser.parse_args(argv)
    settings = Settings.load(args.config) if args.config else Settings()
    if args.tool == "key":
        print(create_key(settings.key_file))
        return 0
    spark = ship(SparkSession.builder.appName("quietlake").getOrCreate())
    if args.tool == "safeify":
        table, _ = source_files.read_delimited(spark, args.source)
        safe, plan = safeify(table, load_key(settings.key_file) if args.pseudo else b"", args.pseudo, args.year, args.keep, args.drop, settings.is_pii)
        print(json.dumps(write_safe(safe, plan, args.out, Path(args.source).name), ensure_ascii=False))
    elif args.tool == "dictionary":
        if args.query:
            table = source_files.jdbc(spark, args.source, args.query).withColumn("__order", F.col(args.order or args.id))
        else:
            table = source_files.read_delimited(spark, args.source, place="__order")[0]
        with scratch(spark):
            persons = build_dictionary(table, "__order", args.id, args.names, args.emails, args.phones, args.ids)
            write_dictionary(persons, args.out, datetime.datetime.now().isoformat(timespec="seconds"))
    else:
        try:
            with scratch(spark):
                return _scan_folder(spark, settings, args.folder, args.since, args.dictionary)
        except Exception as e:  # noqa: BLE001  a scan that couldn't look must not look like one that found nothing
            print(f"scan failed: {error_class(e)}", file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
