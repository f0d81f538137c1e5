"""Byte-level BPE by a global shuffle of distinct words.

Encoding: texts are split into pre-tokens, block by block; a block (a bounded run of rows of
one input partition) keeps its distinct words and, per text, the words' numbers by position.
The words are shuffled by a hash of their spelling, so that every distinct word of the
corpus is encoded once, in one task, and texts by their block; the ids go back to the blocks
by a second shuffle, and there each text is put together by position with array gathers. Decoding joins ids with the
table of token bytes, which has a fixed size and is broadcast.

Scale: a word travels once per block however often it stands there, so the most frequent
words cost no more than the others, and texts travel as numbers in frequency order, packed.
Words and texts come from one pass and one exchange, which both sides read, so the numbers
of blocks and words don't depend on how another scan would be cut into tasks.

Edge cases: null text counts as empty and has no ids; a null id is kept; repeated rows are
encoded each; an empty table gives an empty result; texts are read whole; an id that the
table lacks decodes to no bytes; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, partitions_for, shuffle_partitions, small_batches, task_id, unpack, written

MAX_WORDS, MAX_BYTES, STEP, MAX_KNOWN = 250_000, 10 << 20, 500_000, 1_000_000
#: Stored bytes of a table for each task that puts texts together: about a block each.
TASK_BYTES = 4 << 20
_WORKER: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Block:
    """The distinct words of a run of rows, numbered, and the rows as numbers."""

    def __init__(self):
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.ids, self.codes, self.size = [], [], 0

    def add(self, doc_id, tokens):
        self.ids.append(doc_id)
        self.codes.append(np.fromiter(map(self.words.__getitem__, tokens), np.uint32, len(tokens)))

    def by_frequency(self):
        """The words, most frequent first, and all rows' numbers in that order."""
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(codes, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.words)
        return [words[i] for i in order], rank[codes] if len(codes) else codes


def _blocks(batches, pattern: str):
    find, block, number = regex.compile(pattern).findall, _Block(), task_id() << 24
    for batch in small_batches(batches, 4 << 20):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block.add(doc_id, find(text or ""))
            block.size += len(text or "")
            if len(block.words) >= MAX_WORDS or block.size >= MAX_BYTES:
                yield number, block
                block, number = _Block(), number + 1
    if block.ids:
        yield number, block


def _row(*values) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["place", "bucket", "block", "payload"])


def _block_rows(pattern: str, buckets: int):
    """Each block's words, placed by their bucket, and its texts, placed by the block."""

    def run(batches):
        for number, block in _blocks(batches, pattern):
            words, codes = block.by_frequency()
            planes = codes.view(np.uint8).reshape(-1, 4)
            texts = pack(doc_id=pa.array(block.ids, pa.int64()), n=np.array([len(c) for c in block.codes], np.int64))
            yield _row(number, -1, number, texts)
            yield _row(number, -2, number, pack(low=planes[:, 0].copy(), mid=planes[:, 1].copy(), high=planes[:, 2].copy()))
            raw = [w.encode() for w in words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int32, len(raw))
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    at = int(bucket[part[0]])
                    yield _row(at, at, number, pack(code=part.astype(np.uint32), word=pa.array([raw[i] for i in part], pa.binary())))

    return run


def _encoding(ranks, pattern):
    key = ("encoding", pattern, len(ranks))
    if key not in _WORKER:
        _WORKER[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _WORKER[key]


def _encode_words(ranks, pattern: str):
    def run(batches):
        piece, known = _encoding(ranks.value, pattern)._core_bpe.encode_single_piece, {}
        for batch in batches:
            batch = batch.filter(pc.greater_equal(batch.column(1), 0))
            for block, payload in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                table = unpack([payload])
                words = table.column("word").to_pylist()
                if len(known) > MAX_KNOWN:  # a block has MAX_WORDS words at most
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = piece(w)
                ids = [known[w] for w in words]
                yield _row(block, 0, block, _ids_payload(table.column("code"), ids))

    return run


def _ids_payload(codes, ids) -> bytes:
    flat = np.fromiter((i for x in ids for i in x), np.uint32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)), pa.array(flat))
    return pack(code=codes.combine_chunks(), ids=lists)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size], one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)] if total else flat[:0]


def _reassemble(placed: pa.Table, known: pa.Table) -> pa.Table:
    """One block's texts as word numbers, with its words' ids; words that are placed alike don't count."""
    of = lambda b: placed.filter(pc.equal(placed.column("bucket"), b)).column("payload").to_pylist()
    if not (own := of(-1)):
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
    texts, planes = unpack(own), unpack(of(-2))
    codes = np.zeros((planes.num_rows, 4), np.uint8)
    for i, plane in enumerate(("low", "mid", "high")):
        codes[:, i] = planes.column(plane).to_numpy()
    codes = codes.reshape(-1).view(np.uint32)
    counts = texts.column("n").to_numpy()
    raw, offsets = b"", np.zeros(len(counts) + 1, np.int64)
    if len(codes):
        words = unpack(known.column("payload").to_pylist())
        lists = words.column("ids").combine_chunks()
        at, where = lists.offsets.to_numpy().astype(np.int64), words.column("code").to_numpy()
        starts, sizes = np.empty(len(where), np.int64), np.empty(len(where), np.int64)
        starts[where], sizes[where] = at[:-1], np.diff(at)
        flat = lists.values.to_numpy()
        steps = [codes[i : i + STEP] for i in range(0, len(codes), STEP)]  # bounds what the gathers hold at once
        raw = b"".join(_gather(flat, starts[c], sizes[c]).astype("<u4").tobytes() for c in steps)
        offsets = np.append(0, np.cumsum(sizes[codes]))[np.append(0, np.cumsum(counts))]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((offsets * 4).astype(np.int64).tobytes()), pa.py_buffer(raw)])
    return pa.table({"doc_id": texts.column("doc_id").combine_chunks(), "ids": column.cast(pa.binary())})


def _shares_exchange(df: DataFrame) -> bool:
    """Whether Spark reuses an exchange over ``df`` where it is used twice: it has to see that both are the same, which it doesn't for cached tables."""
    sides = df.unionAll(df)._jdf.queryExecution().sparkPlan().children()
    leaves = sides.apply(0).collectLeaves()
    files = all(leaves.apply(i).getClass().getSimpleName() == "FileSourceScanExec" for i in range(leaves.size()))
    return files and sides.apply(0).sameResult(sides.apply(1)) and df.sparkSession.conf.get("spark.sql.exchange.reuse") == "true"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, one after another."""
    spark = docs.sparkSession
    # tasks grow in number with the texts; the words' buckets don't, as a block's words are cut into that many pieces
    n, buckets = partitions_for(docs, TASK_BYTES), 4 * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = "place long, bucket int, block long, payload binary"
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary has a fixed size
    blocks = rows.mapInArrow(_block_rows(pattern, buckets), schema)
    if not _shares_exchange(blocks):
        blocks = written(blocks, "blocks")  # else the two uses below would be two passes
    # both sides take all rows of this one exchange; a filter would be pushed below it and make it two
    placed = blocks.repartition(n, "place")
    known = placed.mapInArrow(_encode_words(shared, pattern), schema)
    return placed.groupBy("place").cogroup(known.groupBy("place")).applyInArrow(_reassemble, "doc_id long, ids binary")


def token_table(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """All tokens' bytes by id, one after another, and where each begins and ends."""
    by_id = {i: t for t, i in ranks.items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    return b"".join(tokens), np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int64)


def _decode(table):
    def run(batches):
        raw, at = table.value
        flat, starts, sizes = np.frombuffer(raw, np.uint8), np.append(at[:-1], 0), np.append(np.diff(at), 0)
        for batch in small_batches(batches, 4 << 20):
            out = []
            for ids in batch.column(1).to_pylist():
                ids = np.minimum(np.frombuffer(ids or b"", "<u4").astype(np.int64), len(starts) - 1)
                out.append(_gather(flat, starts[ids], sizes[ids]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of all tokens, in order."""
    table = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")).mapInArrow(_decode(table), "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded bytes."""
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    ranks = read_ranks(path)
    return digests(decode(encode(docs, ranks, pattern), ranks))
