"""Token-id output in Simple-8b word-aligned coding.

Every 64-bit word holds a selector in its top four bits and as many ids as fit the rest:
from 60 of one bit to 1 of 60 bits, or 120 zeros. An id of more than 60 bits is an escape:
its word is a mark, and the id itself stands in a list of its own, so that words need no
look-back. Ids are coded in blocks of 256, and a list of block offsets lets any block be
read alone; encoder and decoder walk all blocks of a chunk side by side with numpy.

A file row is (shard, block, base, doc_ids, counts, payload): whole documents, about
``CHUNK`` ids, with ``base`` ids of the same shard before them. Documents are put in order
by a range partitioning of the ids and a sort inside each partition; the totals of shards,
one row each, give every shard's place.

Edge cases: null text counts as empty and has the end id only; null ids come first;
repeated rows are written each, equal ids side by side; an empty table writes no row; texts
are read whole, and a text longer than a chunk makes a longer row.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, small_batches, task_id, written
from .word_tokens import encode_texts, with_end

#: How many ids a word holds and of how many bits, by selector; 0 is the escape.
SELECTORS = [(1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK, CHUNK, MAGIC = 256, 1 << 16, b"S8B1"

#: Stored bytes of a table for each task that writes a shard.
TASK_BYTES = 8 << 20
#: Pieces of texts whose ids a worker keeps; more of them save time, fewer memory.
KEPT = 800_000


def _bits(ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), ids, side="right").astype(np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """Any unsigned 64-bit integers as a payload."""
    ids = ids.astype(np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    bits = np.full(blocks * BLOCK, 255, np.uint8)  # 255 fits no selector: nothing reaches over a block's end
    bits[:n] = _bits(ids)
    bits = bits.reshape(blocks, BLOCK)
    best = np.where(bits <= 60, len(SELECTORS) - 1, 0).astype(np.uint8)
    widest, span = {1: bits}, 1
    for selector in range(len(SELECTORS) - 2, 0, -1):
        count, size = SELECTORS[selector]
        while 2 * span <= count:  # the widest of twice as many ids
            widest[2 * span] = np.maximum(widest[span][:, :-span], widest[span][:, span:])
            span *= 2
        w = widest[span]
        reach = w if count == span else np.maximum(w[:, : w.shape[1] - (count - span)], w[:, count - span :])
        fits = reach <= size
        best[:, : fits.shape[1]][fits] = selector
    counts = np.array([c for c, _ in SELECTORS], np.int64)
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    at, live, flat = np.arange(blocks) * BLOCK, np.arange(blocks), best.ravel()
    places, owners = [], []
    while len(live):
        places.append(at[live].copy())
        owners.append(live)
        at[live] += counts[flat[at[live]]]
        live = live[at[live] < ends[live]]
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    place.sort()
    chosen = flat[place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, size) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == selector)
        if size and len(rows):
            parts = ids[place[rows][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(size))
            words[rows] |= np.bitwise_or.reduce(parts, axis=1)
    offsets = np.searchsorted(place, np.arange(blocks) * BLOCK).astype("<u4")
    escapes = ids[place[chosen == 0]]
    return MAGIC + struct.pack("<IIII", n, len(words), blocks, len(escapes)) + offsets.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode(payload: bytes, block: int | None = None) -> np.ndarray:
    """The integers of a payload, or those of one of its blocks."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, n_words, blocks, n_escapes = struct.unpack_from("<IIII", payload, 4)
    offsets = np.frombuffer(payload, "<u4", blocks, 20).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, 20 + 4 * blocks)
    escapes = np.frombuffer(payload, "<u8", n_escapes, 20 + 4 * blocks + 8 * n_words)
    if block is not None:
        first, last = offsets[block], offsets[block + 1] if block + 1 < blocks else n_words
        skipped = np.count_nonzero(words[:first] >> np.uint64(60) == 0)
        words, escapes = words[first:last], escapes[skipped:]
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[chosen]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector, (count, size) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == selector)
        if size and len(rows):
            mask = np.uint64((1 << size) - 1)
            out[at[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(size))) & mask
    rows = np.flatnonzero(chosen == 0)
    out[at[rows]] = escapes[: len(rows)]
    return out


_FILE = "shard int, block int, base long, n_ids long, doc_ids array<long>, counts array<long>, payload binary"


def _file_row(shard, block, base, doc_ids, counts, ids) -> pa.RecordBatch:
    values = [shard, block, base, len(ids), doc_ids, counts, encode(ids)]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["shard", "block", "base", "n_ids", "doc_ids", "counts", "payload"])


def _rows(model, end: int):
    def run(batches):
        shard, block, base = task_id(), 0, 0
        for batch in small_batches(batches):
            doc_ids = batch.column(0).to_pylist()
            ids, counts = with_end(*encode_texts(model.value, batch.column(1).to_pylist(), KEPT), end)
            ends, first, done = np.cumsum(counts), 0, 0
            while first < len(doc_ids):
                last = max(first + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
                part = ids[done : ends[last - 1]]
                yield _file_row(shard, block, base, doc_ids[first:last], counts[first:last].tolist(), part)
                block, base, first, done = block + 1, base + len(part), last, int(ends[last - 1])

    return run


def file_rows(docs: DataFrame, model: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the file format, shards and blocks in ascending order of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary has a fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = ["doc_id", F.xxhash64("text")]  # rows of an id that many have are dealt to several ranges
    ordered = rows.repartitionByRange(partitions_for(docs, TASK_BYTES), *key).sortWithinPartitions(*key)
    return ordered.mapInArrow(_rows(shared, end), _FILE)


def _read(batches):
    for batch in batches:
        for shard, base, doc_ids, payload, counts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            raw = decode(payload).astype("<u4").tobytes()
            ends = np.cumsum(counts)
            starts = ends - counts
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(counts), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts + base), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = files.select("shard", "base", "doc_ids", "payload", "counts").mapInArrow(_read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, model: str, end: int = 2) -> DataFrame:
    return read_digests(written(file_rows(docs, model, end), "simple8b"))
