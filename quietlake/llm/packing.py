"""Best-fit packing by patterns and non-negative least squares.

Documents become pieces of at most ``capacity`` ids. The histogram of piece lengths, which
has ``capacity`` entries at most, goes to the driver; there patterns of up to three lengths
that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram
by non-negative least squares and rounded without asking for more pieces than there are, and
what is left is packed best fit by falling length, again by counts of lengths alone. Pieces
then find their places by their rank among the pieces of the same length.

Scale: only ids, lengths and places are shuffled, never texts. A rank is a task's own count
plus the counts of the tasks before it, so a length that a third of all pieces share isn't
ordered in one task. The plan holds a bounded number of patterns and is broadcast.

Edge cases: null text counts as empty and becomes one piece of one id; a null doc_id is
kept; repeated rows are packed each; an empty table gives an empty result; texts are read
whole and only those longer than a sequence are cut.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, task_id, written
from .word_tokens import encode_texts, with_end

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long, ids binary"


def _pieces(model, end: int, capacity: int, keep_ids: bool):
    def run(batches):
        part, seen = task_id(), np.zeros(capacity + 1, np.int64)
        for batch in small_batches(batches):
            ids, counts = with_end(*encode_texts(model.value, batch.column(1).to_pylist()), end)
            raw, rows, at = ids.astype("<u4").tobytes(), [], 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    own = raw[4 * (at + start) : 4 * (at + start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), part, int(seen[length]), own if keep_ids else None))
                    seen[length] += 1
                at += n
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def pieces(docs: DataFrame, model: str, end: int = 0, capacity: int = 2048, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents, with each one's rank among those of its length in the same task; ids as 32-bit integers if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary has a fixed size
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_pieces(shared, end, capacity, keep_ids), _PIECES)


def full_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Up to three of the lengths, with repeats, that add up to the capacity; one pattern a row, zeros for fewer."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    out = [np.array([[capacity, 0, 0]])[: int(present[capacity])]]
    a = lengths[(2 * lengths <= capacity) & (lengths < capacity)]
    a = a[present[capacity - a]]
    out.append(np.stack([a, capacity - a, 0 * a], 1))
    for a in lengths[3 * lengths <= capacity]:
        b = lengths[(lengths >= a) & (2 * lengths <= capacity - a)]
        b = b[present[capacity - a - b]]
        out.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(out)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = 150) -> np.ndarray:
    """Non-negative least squares of the histogram over the patterns, by accelerated projected gradients."""
    used = (patterns > 0).astype(float)
    size = len(histogram)

    def apply(x):
        return np.bincount(patterns.ravel(), (used * x[:, None]).ravel(), size)

    def transpose(r):
        return (r[patterns] * used).sum(1)

    v = np.ones(len(patterns))
    for _ in range(15):  # the largest eigenvalue sets the step
        v = transpose(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x, y, t = np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - transpose(apply(y) - histogram) / (1.05 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, how often in a sequence)]) of every pattern; the pieces of the histogram are used up exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    found: list[tuple[int, list[tuple[int, int]]]] = []
    patterns = full_patterns(np.flatnonzero(left), capacity) if left.any() else np.zeros((0, 3), int)
    if len(patterns):
        repeats = fit_repeats(patterns, left.astype(float))
        for i in np.argsort(-repeats, kind="stable"):
            want = int(np.rint(repeats[i]))
            if want < 1:
                break
            need = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            want = min(want, int((left[need[0]] // need[1]).min()))
            if want > 0:
                left[need[0]] -= want * need[1]
                found.append((want, list(zip(need[0].tolist(), need[1].tolist(), strict=True))))
    # the rest, best fit: groups of equal sequences by the space that they have left
    by_space: list[list] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        space = length
        while n and space <= capacity:
            if not by_space[space]:
                space += 1
                continue
            count, content = by_space[space].pop()
            each = min(space // length, n)  # as many into each as fit
            some = min(count, n // each)
            if some < count:
                by_space[space].append((count - some, content))
            by_space[space - each * length].append((some, [*content, (length, each)]))
            n -= some * each
        each = capacity // length
        if n >= each:
            by_space[capacity - each * length].append((n // each, [(length, each)]))
        if n % each:
            by_space[capacity - n % each * length].append((1, [(length, n % each)]))
    return found + [group for groups in by_space for group in groups]


def slots(planned) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on, the pieces of a length go to which sequences and offsets."""
    rows, used, first = [], {}, 0
    for repeats, content in planned:
        offset = 0
        for length, each in content:
            rows.append((length, used.get(length, 0), each, first, offset))
            used[length] = used.get(length, 0) + repeats * each
            offset += length * each
        first += repeats
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), columns, strict=True))


def _place(table):
    def run(batches):
        t = table.value
        keys = t["length"] << 44 | t["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth = rank - t["rank"][at]
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(t["sequence"][at] + nth // t["each"][at]), pa.array(t["offset"][at] + nth % t["each"][at] * length), batch.column("ids")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    return run


def pack_documents(docs: DataFrame, model: str, end: int = 0, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (null unless asked for)."""
    cut = written(pieces(docs, model, end, capacity, keep_ids), "pieces")
    counts = cut.groupBy("part", "length").count()
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("rank"))
    return ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
