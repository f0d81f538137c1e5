"""Delimited text whose cells may hold line feeds, read in many tasks.

Whether a line feed ends a record depends on the quotes before it, back to the file's start.
So the file is scanned twice in the same splits. The first scan finds, for either state in
which a split may begin (between records, or inside of a quoted cell), the state in which it
ends, and whether a record begins in it. A running composition of these small functions gives
every split its true state. The second scan then cuts each split on its own; of a record that
crosses splits every split gives its piece, and the pieces meet under the split where the
record begins. A quote inside of an unquoted cell is text, as for Python's csv, whose rows
these are; it doesn't join lines.

Scale: the driver holds five numbers a split; a task holds a batch of lines, and a record
that lines belong to. A record, however many splits it crosses, has to fit in one task.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST_SPLIT, LEAST_SPLIT = 64 << 20, 1 << 20


class Quotes:
    """Where a line leaves off: 1 inside of a quoted cell, 0 between records."""

    def __init__(self, sep: str):
        end = re.escape(sep)
        self.cells = re.compile(f'(?:(?:"(?:[^"]|"")*+"(?!")[^{end}]*+|(?!")[^{end}]*+){end})*+')
        self.whole = re.compile('"(?:[^"]|"")*+"(?!")')
        self.rest = re.compile(f'(?:[^"]|"")*+"(?!")[^{end}]*+({end})?')

    def after(self, line: str, state: int) -> int:
        at = 0
        if state:
            closed = self.rest.match(line)
            if closed is None:
                return 1
            if closed[1] is None:
                return 0
            at = closed.end()
        at = self.cells.match(line, at).end()
        return int(line.startswith('"', at) and self.whole.match(line, at) is None)


@dataclass
class Split:
    """What a split needs to know to be cut on its own."""

    entry: int  # its state at the start
    owner: int | None  # the split where the record begins that it starts in
    opens: bool  # whether a record that begins in it goes on in the next split


def composed(found: list[tuple[int, int, int, bool, bool]]) -> dict[int, Split]:
    """(start, end state from 0, from 1, whether a record ends in it from 0, from 1) of all splits, in any order, as their true states."""
    out: dict[int, Split] = {}
    state, owner = 0, None
    for start, *ends_and_bounds in sorted(found):
        end, bound = ends_and_bounds[state], ends_and_bounds[2 + state]
        opens = bool(end) and (bound or not state)
        out[start] = Split(state, owner, opens)
        state, owner = end, start if opens else owner if end else None
    return out


def _fixed_cuts(spark: SparkSession, size: int) -> SparkSession:
    """A session whose scans cut a file alike however many executors there are at the time."""
    inner = spark.newSession()
    cores = spark.sparkContext.defaultParallelism
    inner.conf.set("spark.sql.files.minPartitionNum", "1")
    inner.conf.set("spark.sql.files.maxPartitionBytes", str(max(LEAST_SPLIT, min(LARGEST_SPLIT, -(-size // (2 * cores))))))
    return inner


def _lines(batches):
    """(start of the split, its lines) in order, a batch at a time."""
    for batch in batches:
        lines, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(lines):
            end = at + 1
            while end < len(lines) and starts[end] == starts[at]:
                end += 1
            yield starts[at], lines[at:end]
            at = end


def _ends(sep: str, encoding: str):
    def run(batches):
        quotes = Quotes(sep)
        known: dict[int, tuple[list, list]] = {}
        for start, lines in _lines(batches):
            state, bound = known.setdefault(start, ([0, 1], [False, False]))
            for line in lines:
                text = line.decode(encoding, "replace") if b'"' in line else ""
                for s in (0, 1):
                    state[s] = quotes.after(text, state[s]) if text else state[s]
                    bound[s] |= not state[s]
        rows = [(start, *state, *bound) for start, (state, bound) in known.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()))], names=["start", "zero", "one", "bound_zero", "bound_one"])

    return run


def _records(batches, sep: str, encoding: str, feed: str, splits: dict[int, Split]):
    """(split, record, whether a piece): records whole in their split, and pieces of others, in the file's order."""
    quotes, last, state, held = Quotes(sep), None, 0, []
    for start, lines in _lines(batches):
        if start not in splits:
            raise RuntimeError("the file was cut in another way than before; read it again")
        if start != last:
            if held:
                yield last, feed.join(held), True
            last, state, held = start, splits[start].entry, []
            tail = bool(state)
        for line in lines:
            text = line.decode(encoding, "replace")
            state = quotes.after(text, state) if b'"' in line else state
            held.append(text)
            if not state:
                yield start, feed.join(held), tail
                held, tail = [], False
    if held:
        yield last, feed.join(held), True


def _pieces(sep: str, encoding: str, feed: str, splits: dict[int, Split]):
    """(owner, start, text) of pieces. A split gives one piece at its start at most, to the record that it begins in, and one at its end."""

    def run(batches):
        seen: set[int] = set()
        rows = []
        for start, text, piece in _records(batches, sep, encoding, feed, splits):
            if piece:
                first = splits[start].entry and start not in seen
                rows.append((splits[start].owner if first else start, start, text))
                seen.add(start)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["owner", "start", "text"])

    return run


def _table(rows: list[list[str]], places: list[int], width: int) -> pa.RecordBatch:
    cells = [[r[i] if i < len(r) else "" for r in rows] for i in range(width)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cells), pa.array(places, pa.int64())], names=[*(str(i) for i in range(width)), "place"])


def _parsed(records: list[str], sep: str) -> list[list[str]]:
    csv.field_size_limit(1 << 40)
    return [next(csv.reader([r], delimiter=sep), []) for r in records]


#: Bits of a place in the file that number the records of a split.
_NTH = 38


def _whole(sep: str, encoding: str, feed: str, splits: dict[int, Split], width: int, most_cells: int = 400_000):
    def run(batches):
        order = {start: i for i, start in enumerate(sorted(splits))}
        texts, places, nth, step = [], [], 0, max(1, most_cells // width)

        def out():
            kept = [(r, p) for r, p in zip(_parsed(texts, sep), places, strict=True) if r]
            return _table([r for r, _ in kept], [p for _, p in kept], width)

        for start, text, piece in _records(batches, sep, encoding, feed, splits):
            nth += 1
            if not piece and not (start == 0 and nth == 1):  # the file's first record is its header
                texts.append(text)
                places.append(order[start] << _NTH | nth)
            if len(texts) >= step:
                yield out()
                texts, places = [], []
        yield out()

    return run


def _stitched(sep: str, splits: dict[int, Split], width: int):
    def run(batches):
        order = {start: i for i, start in enumerate(sorted(splits))}
        for batch in batches:
            owners, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = [(r, order[o] << _NTH | (1 << _NTH) - 1) for r, o in zip(_parsed(texts, sep), owners, strict=True) if r]
            yield _table([r for r, _ in kept], [p for _, p in kept], width)

    return run


def _handed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table of another session of the same application, in this one."""
    datasets = getattr(getattr(spark._jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$")
    return DataFrame(datasets.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)


def read_records(spark: SparkSession, path: str, names: list[str], sep: str, encoding: str, size: int, feed: str = "\n", place: str | None = None) -> DataFrame:
    """A file of ``size`` bytes as texts under ``names``, without its first record; missing cells are empty, cells beyond the names are left out.

    ``place``: the name of a column that gives the records' order in the file.
    """
    inner = _fixed_cuts(spark, size)
    lines = inner.read.option("lineSep", feed).text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"))
    found = lines.mapInArrow(_ends(sep, encoding), "start long, zero int, one int, bound_zero boolean, bound_one boolean").collect()  # five numbers a split
    splits = composed([tuple(r) for r in found])
    width = len(names)
    cells = ", ".join(f"`{i}` string" for i in range(width))
    whole = lines.mapInArrow(_whole(sep, encoding, feed, splits, width), f"{cells}, place long")
    if any(s.opens for s in splits.values()):
        pieces = lines.mapInArrow(_pieces(sep, encoding, feed, splits), "owner long, start long, text string")
        records = pieces.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts")).select("owner", F.array_join(F.col("parts.text"), feed).alias("text"))  # the pieces of one record
        if not _header_ends(found):
            records = records.filter("owner <> 0")  # the header itself goes on beyond the first split
        whole = whole.unionAll(records.mapInArrow(_stitched(sep, splits, width), f"{cells}, place long"))
    table = _handed(spark, whole)
    return table.toDF(*names, place) if place else table.drop("place").toDF(*names)


def _header_ends(found: list) -> bool:
    """Whether the first record ends in the first split, which begins between records."""
    return bool(min(found)[3]) if found else True
