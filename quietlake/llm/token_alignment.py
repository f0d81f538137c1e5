"""Alignment of two tokenizers' tokens by the bytes that they cover.

A text is cut at single spaces between other characters, where both tokenizers are known to
begin a new token whatever stands before. Block by block (a bounded run of rows of one input
partition), every distinct segment is encoded once by both tokenizers, and DuckDB aligns the
block's segments as tables of token intervals on one axis: ASOF joins find the token that a
token begins in, a range condition keeps those that overlap, and window sums over common ends
number the groups. A text's alignment is that of its segments, one after another. Each
block's counts of linked id pairs are partial counts, which Spark merges; the merged counts
go back to the blocks by a join, where each text's links are summed up.

Scale: a pair travels once per block however often it is linked there; blocks have a bounded
number of distinct segments, so neither DuckDB nor a task holds more than a block. Blocks are
written before they are used twice, so a lost executor can't number them anew.

Edge cases: null and empty texts have no tokens, nor has a text whose tokens don't spell it
(one that holds U+2581, which the second tokenizer takes for a space): zeros and the empty
text; a null id is kept; repeated rows are aligned and counted each; an empty table gives an
empty result; other columns are ignored. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pack, partitions_for, small_batches, task_id, unpack, written
from .word_tokens import spelling

MAX_SEGMENTS, MAX_CHARS, SLICE, SEGMENTS_AT_ONCE = 200_000, 12 << 20, 1 << 20, 40_000
#: Stored bytes of a table for each task that puts a block's texts together.
TASK_BYTES = 4 << 20
#: A single space whose neighbours are no white space, in the widest meaning of that.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WORKER: dict = {}


def byte_level_model(path: str) -> str:
    """The file's JSON, if it is a byte-level BPE model whose ids are its ranks, split by the usual pattern and nothing else."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    bpe, before = model["model"], model["pre_tokenizer"]
    merged = [bpe["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in bpe["merges"]]
    plain = bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or model["normalizer"] or before != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or merged != sorted(merged):
        raise ValueError(f"{path} is no plain byte-level BPE model")
    byte = {c: b for b, c in spelling().items()}
    special = {t["id"] for t in model["added_tokens"]}
    return json.dumps({base64.b64encode(bytes(byte[c] for c in token)).decode(): i for token, i in bpe["vocab"].items() if i not in special})


def piece_model(path: str) -> bytes:
    """The file's bytes, if it is a BPE model that leaves texts as they are, puts a space before them, and has no piece that goes on after a space."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        raw = f.read()
    model = sentencepiece_model_pb2.ModelProto.FromString(raw)
    how, kind = model.normalizer_spec, model.trainer_spec
    plain = not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
    if not plain or kind.model_type != kind.BPE or not kind.byte_fallback or kind.treat_whitespace_as_suffix or any(re.search("[^▁]▁", p.piece) for p in model.pieces):
        raise ValueError(f"{path} is no plain BPE model of pieces")
    return raw


class _Tokens:
    """Both tokenizers in a worker, and the bytes of their tokens."""

    def __init__(self, first: str, second: bytes, pattern: str):
        import sentencepiece

        ranks = {base64.b64decode(t): i for t, i in json.loads(first).items()}
        self.first = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        by_id = {i: t for t, i in ranks.items()}
        piece = lambda i: bytes([int(self.second.id_to_piece(i)[3:5], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = ([by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)], [piece(i) for i in range(self.second.get_piece_size())])
        self.sizes = [np.array([len(t) for t in tokens], np.int64) for tokens in self.bytes]

    def encode(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids per segment) of both."""
        out = []
        for ids in ([self.first(f" {s}") for s in segments], self.second.encode(segments, num_threads=1)):
            flat = array("i")
            for x in ids:
                flat.extend(x)
            out.append((np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.fromiter(map(len, ids), np.int64, len(ids))))
        return out

    def spells(self, which: int, ids: np.ndarray, counts: np.ndarray, segments: list[str]) -> np.ndarray:
        """Which segments their tokens spell."""
        tokens, ids = self.bytes[which], ids.tolist()
        if b"".join(map(tokens.__getitem__, ids)) == "".join(f" {s}" for s in segments).encode() and len(segments):
            sizes = np.add.reduceat(self.sizes[which][ids], np.cumsum(counts) - counts)
            if (sizes == [len(s.encode()) + 1 for s in segments]).all():
                return np.ones(len(segments), bool)
        ends = np.cumsum(counts)
        return np.fromiter((b"".join(map(tokens.__getitem__, ids[e - n : e])) == f" {s}".encode() for s, e, n in zip(segments, ends, counts, strict=True)), bool, len(segments))


ALIGN_SQL = """
CREATE OR REPLACE TEMP TABLE link AS
SELECT a.seg, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.lo >= b.lo
UNION ALL
SELECT a.seg, a.id, b.id FROM b ASOF JOIN a ON b.lo > a.lo WHERE b.lo < a.hi;
CREATE OR REPLACE TEMP TABLE common AS SELECT hi FROM a SEMI JOIN b USING (hi);
"""
#: Each token's group: how many common ends lie before it.
GROUP_SQL = "SELECT t.seg, t.id, count(common.hi) OVER (ORDER BY t.lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM {} t LEFT JOIN common USING (hi) ORDER BY t.lo"


def _intervals(first: int, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """The tokens of segments, numbered from ``first`` on, on one axis of bytes."""
    hi = np.cumsum(sizes[ids])
    return pa.table({"seg": np.repeat(np.arange(first, first + len(counts), dtype=np.int32), counts), "id": ids, "lo": hi - sizes[ids], "hi": hi})


def _joined(texts: pa.Array, of: np.ndarray, by: str) -> tuple[pa.Array, np.ndarray]:
    """Runs of texts of the same number joined, and where each run begins."""
    at = np.flatnonzero(np.diff(of, prepend=-1))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(at, len(of)).astype(np.int64)), texts), by), at


def _spelt_groups(first: pa.Table, second: pa.Table) -> pa.Table:
    """(seg, n_groups, groups): ids of both sides by group, groups by segment."""
    sides = [_joined(pc.cast(t.column("id").combine_chunks(), pa.string()), t.column("grp").to_numpy(), ",") for t in (first, second)]
    seg = first.column("seg").to_numpy()[sides[0][1]]
    groups, at = _joined(pc.binary_join_element_wise(sides[0][0], sides[1][0], "|"), seg, ";")
    return pa.table({"seg": seg[at], "n_groups": np.diff(np.append(at, len(seg))), "groups": groups})


def _align(kept: list, sizes: list[np.ndarray], step: int = SEGMENTS_AT_ONCE) -> tuple[pa.Table, pa.Table]:
    """(seg, n_groups, groups) and (seg, a, b), a row per link, both by segment; ``step`` segments at a time, so DuckDB's tables stay small."""
    import duckdb

    con, groups, links = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""}), [], []
    ends = [np.append(0, np.cumsum(counts)) for _, counts in kept]
    try:
        for start in range(0, max(1, len(kept[0][1])), step):
            for name, (ids, counts), end, size in zip("ab", kept, ends, sizes, strict=True):
                some = counts[start : start + step]
                con.register(name, _intervals(start, ids[end[start] : end[start + len(some)]], some, size))
            con.execute(ALIGN_SQL)
            groups.append(_spelt_groups(*(con.sql(GROUP_SQL.format(name)).to_arrow_table() for name in "ab")))
            links.append(con.sql("SELECT seg, a, b FROM link ORDER BY seg").to_arrow_table())
    finally:
        con.close()
    return pa.concat_tables(groups), pa.concat_tables(links)


class _Block:
    """The distinct segments of a run of rows, numbered, and the rows as numbers."""

    def __init__(self):
        self.segments: dict[str, int] = {}
        self.ids, self.codes, self.chars = [], [], 0

    def add(self, doc_id, text: str):
        number, codes, at = self.segments, array("I"), 0
        while text:
            cut = _CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
            part = text[at : cut.start()] if cut else text[at:]
            codes.extend([number.setdefault(s, len(number)) for s in _CUT.split(part)])
            if cut is None:
                break
            at = cut.end()
        self.ids.append(doc_id)
        self.codes.append(np.frombuffer(codes, np.uint32) if codes else np.zeros(0, np.uint32))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.segments) >= MAX_SEGMENTS or self.chars >= MAX_CHARS


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    ends = np.append(0, np.cumsum(values))
    at = np.append(0, np.cumsum(counts))
    return ends[at[1:]] - ends[at[:-1]]


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int64)), pa.array(flat))


_ROW = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
_ROW_DDL = "block long, idx int, a int, b int, n long, payload binary"


def _held(number: int, idx: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, idx, None, None, None, payload), _ROW, strict=True)], schema=_ROW)


def _rows(number: int, block: _Block, tokens: _Tokens):
    """A block's pairs of linked ids with their partial counts, its texts, and its segments' links."""
    segments = list(block.segments)
    encoded = tokens.encode(segments)
    good = np.logical_and(*(tokens.spells(k, *encoded[k], segments) for k in (0, 1)))
    kept = [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in encoded]
    groups, links = _align(kept, tokens.sizes)
    n_groups, spelt = np.zeros(len(segments), np.int64), [""] * len(segments)
    at = groups.column("seg").to_numpy()
    n_groups[at] = groups.column("n_groups").to_numpy()
    for s, g in zip(at.tolist(), groups.column("groups").to_pylist(), strict=True):
        spelt[s] = g
    # links as numbers of distinct pairs
    key = links.column("b").to_numpy().astype(np.int64) << 32 | links.column("a").to_numpy()
    pairs, pair = np.unique(key, return_inverse=True)
    n_links = np.bincount(links.column("seg").to_numpy(), minlength=len(segments)).astype(np.int64)
    # texts that hold a segment which isn't spelt have no tokens at all
    codes = [c if good[c].all() else c[:0] for c in block.codes]
    sizes, flat = np.array([len(c) for c in codes], np.int64), np.concatenate([*codes, np.zeros(0, np.uint32)])
    seen = np.bincount(flat, minlength=len(segments))
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, pair, np.repeat(seen, n_links))
    step = 1 << 18
    for i in range(0, len(pairs), step):
        some = slice(i, i + step)
        idx = np.arange(i, min(i + step, len(pairs)), dtype=np.int32)
        arrays = [pa.array(np.full(len(idx), number, np.int64)), pa.array(idx), pa.array((pairs[some] & 0xFFFFFFFF).astype(np.int32)), pa.array((pairs[some] >> 32).astype(np.int32)), pa.array(n[some]), pa.nulls(len(idx), pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, schema=_ROW)
    sha = [hashlib.sha256(";".join([spelt[s] for s in c.tolist()]).encode()).hexdigest() if len(c) else "" for c in codes]
    texts = {"doc_id": pa.array(block.ids, pa.int64()), "codes": _lists(flat, sizes), "groups_sha256": sha}
    texts |= {name: _sums(by[flat], sizes) for name, by in (("n_a", kept[0][1]), ("n_b", kept[1][1]), ("n_groups", n_groups), ("n_links", n_links))}
    yield _held(number, -1, pack(**texts))
    yield _held(number, -2, pack(links=_lists(pair.astype(np.uint32), n_links)))


def _blocks(models, pattern: str):
    def run(batches):
        if _WORKER.get("of") != (key := hash(models.value)):
            _WORKER.update(of=key, tokens=_Tokens(*models.value, pattern))
        tokens, number, block = _WORKER["tokens"], task_id() << 24, _Block()
        for batch in small_batches(batches, 4 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, text or "")
                if block.full():
                    yield from _rows(number, block, tokens)
                    number, block = number + 1, _Block()
        if block.ids:
            yield from _rows(number, block, tokens)

    return run


def align_blocks(docs: DataFrame, first: str, second: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligned blocks, stored: (block, idx, a, b, n) per pair of linked ids, and texts and segments packed, with idx below 0."""
    models = docs.sparkSession.sparkContext.broadcast((first, second))  # two vocabularies, of fixed size
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return written(rows.mapInArrow(_blocks(models, pattern), _ROW_DDL), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): all links of a pair of ids, and whether no other pair of that b has more."""
    counts = blocks.filter("idx >= 0").groupBy("a", "b").agg(F.sum("n").alias("count"))
    # a b has as many rows here as there are first ids, at most: the vocabulary bounds the group
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _summed(values: pa.Table, held: pa.Table) -> pa.Table:
    of = {i: unpack([p]) for i, p in zip(held.column("part").to_pylist(), held.column("payload").to_pylist(), strict=True)}
    texts, links = of[-1], of[-2].column("links").combine_chunks()
    count, best = np.zeros(values.num_rows, np.int64), np.zeros(values.num_rows, np.int64)
    at = values.column("idx").to_numpy()
    count[at], best[at] = values.column("count").to_numpy(), values.column("best").to_numpy(zero_copy_only=False)
    pair, n = links.values.to_numpy(), np.diff(links.offsets.to_numpy())
    codes = texts.column("codes").combine_chunks()
    code, size = codes.values.to_numpy(), np.diff(codes.offsets.to_numpy())
    sums = {name: _sums(_sums(by[pair], n)[code], size) for name, by in (("n_best", best), ("count_sum", count))}
    return pa.table({c: texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | sums | {"groups_sha256": texts.column("groups_sha256")})


def document_rows(blocks: DataFrame, counts: DataFrame, tasks: int) -> DataFrame:
    """One row per text: tokens, groups, links, links of best pairs, counts summed over links, digest of the groups."""
    values = blocks.filter("idx >= 0").select("block", "idx", "a", "b").join(counts, ["a", "b"]).select("block", "idx", "count", "best")
    held = blocks.filter("idx < 0").selectExpr("block as of", "idx as part", "payload")
    sides = values.repartition(tasks, "block").groupBy("block"), held.repartition(tasks, "of").groupBy("of")
    return sides[0].cogroup(sides[1]).applyInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def token_alignment(spark: SparkSession, docs: DataFrame, first: str, second: bytes, pattern: str) -> DataFrame:
    blocks = align_blocks(docs, first, second, pattern)
    return document_rows(blocks, pair_counts(blocks), partitions_for(docs, TASK_BYTES))
