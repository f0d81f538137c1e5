"""Readers: the inbox, delimited text in several encodings, other formats, databases, transcripts."""

from __future__ import annotations

import csv
import hashlib
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .delimited import Quotes, read_records
from .workbooks import read_workbook

# Encodings in the order in which they are tried, delimiters, suffixes.
ENCODINGS = ["utf-8-sig", "cp932", "euc_jp"]
DELIMITERS = ",\t;|"
TEXT_SUFFIXES = [".csv", ".tsv", ".txt"]
LINE_SUFFIXES = [".csv", ".tsv", ".txt", ".log", ".jsonl", ".md"]
SCANNED_SUFFIXES = [".jsonl", ".md", ".txt", ".json"]
SNIFFED_BYTES = 64_000
#: The longest first record that is taken for a header.
HEADER_BYTES = 64_000 << 9


def file_id(name: str) -> str:
    """Eight digits that stand for a file's name, wherever it lies."""
    return hashlib.sha1(name.encode(), usedforsecurity=False).hexdigest()[:8]


def list_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, path, ext, bytes, modified) of regular files, without those whose names begin with a point; contents aren't read."""
    where = Path(folder.removeprefix("file://")).expanduser()
    if "://" not in folder.removeprefix("file://") and not where.exists():
        return spark.createDataFrame([], "file_id string, path string, ext string, bytes bigint, modified timestamp")
    files = spark.read.format("binaryFile").load(folder if "://" in folder else str(where)).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
    rows = files.filter(~F.startswith(name, F.lit("."))).select(F.substring(F.sha1(name), 1, 8).alias("file_id"), "path", ext.alias("ext"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return rows.orderBy("path")


def head_bytes(spark: SparkSession, path: str, n: int = SNIFFED_BYTES) -> bytes:
    """A file's first bytes, read from its start only."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _decodes(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def encoding_of(raw: bytes) -> str:
    """The first encoding that the bytes fit as a whole."""
    return next((name for name in ENCODINGS if _decodes(raw, name)), "utf-8")


def _fits(encoding: str):
    @F.pandas_udf("boolean")
    def fits(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: _decodes(line, encoding))

    return fits


def survey_lines(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether any cell may be quoted), from all lines of a text file.

    The encoding is the first that every line fits; line feeds are the same byte in all of
    them and no part of another character, so lines can be tested apart from each other.
    """
    lines = ship(spark).read.text(path)
    foreign = lines.filter(~F.rlike("value", F.lit(r"^[\x00-\x7F]*$"))).select(F.col("value").cast("binary").alias("raw"))
    fits = foreign.agg(*(F.coalesce(F.bool_and(_fits(name)("raw")), F.lit(True)).alias(name) for name in ENCODINGS)).first()
    return next((name for name in ENCODINGS if fits[name]), "utf-8"), not lines.filter(F.contains("value", F.lit('"'))).isEmpty()


def delimiter_of(text: str, suffix: str = ".csv") -> str:
    try:
        return csv.Sniffer().sniff(text[:20_000], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return "\t" if suffix == ".tsv" else ","


def file_bytes(spark: SparkSession, path: str) -> int:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen()


def free_names(header: list[str]) -> list[str]:
    """The header's names, a repeated one with its position, and with underscores where another column is called so."""
    taken, names = set(header), []
    for i, name in enumerate(header):
        if name in header[:i]:
            name = f"{name}_{i}"
            while name in taken:
                name += "_"
            taken.add(name)
        names.append(name)
    return names


def _header(spark: SparkSession, path: str, encoding: str, suffix: str) -> tuple[list[str], str, str]:
    """(cells of the first record, delimiter, line feed): as much of the file is read as that record takes, and no more than HEADER_BYTES."""
    size = SNIFFED_BYTES
    while True:
        raw = head_bytes(spark, path, size)
        text = raw.decode(encoding, errors="replace")
        sep = delimiter_of(text, suffix)
        feed = "\r" if "\r" in text and "\n" not in text else "\n"
        quotes, state, lines = Quotes(sep), 0, text.split(feed)
        # the last line may go on beyond what has been read
        for n, line in enumerate(lines if len(raw) < size else lines[:-1], 1):
            state = quotes.after(line, state)
            if not state:
                csv.field_size_limit(1 << 40)
                return next(csv.reader([feed.join(lines[:n])], delimiter=sep), []), sep, feed
        if len(raw) < size:
            raise ValueError("the first record has no end")
        if size >= HEADER_BYTES:
            raise ValueError(f"the first record is longer than {HEADER_BYTES} bytes")
        size *= 8


def read_delimited(spark: SparkSession, path: str, suffix: str | None = None, place: str | None = None) -> tuple[DataFrame, str]:
    """(table of texts, delimiter): the encoding is found from the whole file, names and delimiter from its start; missing cells are empty.

    Rows are those of Python's csv. A file without any quote, in UTF-8, is Spark's to read; in
    any other, cells may hold line feeds. Both are read in parts. ``place`` names a column that
    gives the rows' order in the file, if asked for.
    """
    encoding, quoted = survey_lines(spark, path)
    header, sep, feed = _header(spark, path, encoding, suffix or Path(path).suffix.lower())
    if not header:
        return spark.createDataFrame([], "value string").drop("value"), sep
    names = free_names(header)
    if quoted or encoding in ("cp932", "euc_jp") or feed == "\r":
        return read_records(ship(spark), path, names, sep, "utf-8" if encoding == "utf-8-sig" else encoding, file_bytes(spark, path), feed, place), sep
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    table = spark.read.schema(schema).csv(path, sep=sep, header=True, encoding="UTF-8", mode="PERMISSIVE", enforceSchema=True, maxColumns=len(names) + 20_480).na.fill("")
    return table.withColumn(place, F.monotonically_increasing_id()) if place else table, sep


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file as a table, by its suffix."""
    suffix = Path(path).suffix.lower()
    if suffix in (".csv", ".txt", ".tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == ".tsv" else ",", **options)
    if suffix == ".parquet":
        return spark.read.parquet(path, **options)
    if suffix in (".json", ".jsonl"):
        return spark.read.json(path, multiLine=suffix == ".json", **options)
    if suffix == ".xlsx":
        return read_workbook(ship(spark), path, **options)
    raise ValueError(f"unsupported input type {suffix}")


def head_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a text file, between 1 and 200; no more of it than they take is read but to find its encoding."""
    count, size = max(1, min(int(n), 200)), SNIFFED_BYTES
    encoding, _ = survey_lines(spark, path)
    while True:
        head = head_bytes(spark, path, size)
        if len(head) < size or head.count(b"\n") >= count:
            break
        size *= 4
    lines = head.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    return [line.removesuffix(b"\r").decode(encoding, errors="replace").removeprefix("﻿") for line in lines[:count]]


def jdbc(spark: SparkSession, url: str, query: str, timeout_s: int = 30, **options) -> DataFrame:
    """A query of a database, as a subquery, so nothing but a SELECT can run, and for ``timeout_s`` seconds at most.

    ``options`` are Spark's: with partitionColumn, lowerBound, upperBound and numPartitions
    the table is read in parts; ``sessionInitStatement`` can make the session read-only where the database has such a mode.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query.strip().rstrip(';')}) quietlake_rows", queryTimeout=timeout_s, **options).load()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Persons (id, names, emails, phones, ids) of a dictionary's JSON; none if the file is missing.

    A file that is damaged, or has no list of persons, is an error: known persons would pass unmasked.
    """
    from ..operators.masking import DICTIONARY_SCHEMA

    local = path.removeprefix("file://")
    if "://" not in local and not Path(local).expanduser().exists():
        return spark.createDataFrame([], DICTIONARY_SCHEMA).select(F.inline("persons"))
    rows = spark.read.schema(DICTIONARY_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    whole = rows.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("persons").isNull()).alias("empty")).first()  # reads the file to its end
    if not whole["files"] or whole["empty"]:
        raise ValueError("the dictionary has no list of persons")
    return rows.select(F.posexplode("persons").alias("position", "p")).select("p.*", "position")


def scanned_files(spark: SparkSession, folder: str, since: str | None = None, suffixes=tuple(SCANNED_SUFFIXES)):
    """A reader of the folders' files by suffix, at any depth, changed since a time if one is given."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    return reader.option("modifiedAfter", since) if since else reader


def transcript_texts(lines: DataFrame, line: str = "value") -> DataFrame:
    """(file, text): what a reader of transcript lines (JSON) would see; lines that aren't JSON objects are left out.

    Texts of messages, text blocks, tool results as text or as text blocks, and the record kept beside a result.
    """
    got = lines.withColumn("v", F.try_parse_json(line)).filter("v is not null")
    text = lambda path: F.try_variant_get("v", path, "string")
    is_text = F.expr("schema_of_variant(try_variant_get(v, '$.message.content', 'variant')) = 'STRING'")
    blocks = F.try_variant_get("v", "$.message.content", "array<variant>")
    block_type = lambda b: F.try_variant_get(b, "$.type", "string")
    stringly = lambda b, path: F.when(F.schema_of_variant(F.try_variant_get(b, path, "variant")) == "STRING", F.try_variant_get(b, path, "string"))
    inner = lambda b: F.transform(F.filter(F.coalesce(F.try_variant_get(b, "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda x: block_type(x) == "text"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))
    of_block = lambda b: F.when(block_type(b) == "text", F.array(stringly(b, "$.text"))).when(block_type(b) == "tool_result", F.concat(F.array(stringly(b, "$.content")), inner(b))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(F.when(is_text, text("$.message.content"))), F.flatten(F.transform(F.coalesce(blocks, F.array().cast("array<variant>")), of_block)), F.array(F.to_json(F.try_variant_get("v", "$.toolUseResult", "variant"))))
    return got.select("file", F.explode(F.filter(parts, lambda t: t.isNotNull() & (t != ""))).alias("text"))
