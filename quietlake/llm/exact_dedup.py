"""Exact dedup by deterministic block naming.

A text is cut into fixed-size blocks of bytes. The blocks are sorted, and each distinct
block gets an integer name. Then adjacent pairs of names are sorted and named in the same
way, again and again, until one name is left for each document. Names stand for contents
without any hashing, so two documents share (round, name) only if their texts are equal.

Scale: whole text moves through one shuffle, once, as blocks. Equal blocks of one input
batch travel as one row with a list of references. Where that list is long, the block goes
to its name alone and the references to a place of their own, under a ticket that both
carry and by which they take the name, so a text that a third of all rows share reaches its
task once per batch and nothing of it is expanded there. Later rounds move a pair's two names
and a reference (numbers and the text's digest, about 100 bytes), whatever a block's size.

Edge cases: null text counts as empty; empty texts are equal to each other; rows that
repeat a doc_id are separate documents, of which one stays; a null doc_id loses to any
other; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lookup_groups, shuffle_partitions, small_batches, task_id, written

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_REFS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("n", pa.int32()), ("idx", pa.int32())])
_NAMED = pa.schema([*_REFS, ("name", pa.int64()), ("ticket", pa.int64())])
_REF_DDL = "uid long, doc_id long, sha string, n int, idx int"


#: References to one key in one batch from which on they travel apart from it.
LONG_LIST = 256


def _grouped(keyed: dict, tickets) -> pa.RecordBatch:
    """One row per key with its references as lists; of a long list, one row with the key and one with the references."""
    rows = []
    for key, refs in keyed.items():
        if len(refs) < LONG_LIST:
            rows.append((key, None, refs))
        else:
            ticket = next(tickets)
            rows += [(key, ticket, []), (None, ticket, refs)]
    lists = [[[ref[i] for ref in refs] for *_, refs in rows] for i in range(len(_REFS))]
    arrays = [pa.array([k for k, *_ in rows], pa.binary()), pa.array([t for _, t, _ in rows], pa.int64())] + [pa.array(x, pa.list_(f.type)) for x, f in zip(lists, _REFS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "ticket", *_REFS.names])


def _tickets():
    return count(task_id() << 40)


def _blocks(size: int):
    def run(batches):
        tickets = _tickets()
        for batch in small_batches(batches, 16 << 20):
            keyed: dict[bytes, list] = {}
            for uid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode().translate(_FOLD)
                sha, n = hashlib.sha256(raw).hexdigest(), max(1, -(-len(raw) // size))
                for idx in range(n):
                    keyed.setdefault(raw[idx * size : (idx + 1) * size], []).append((uid, doc_id, sha, n, idx))
            yield _grouped(keyed, tickets)

    return run


def _pairs(batches):
    tickets = _tickets()
    for batch in batches:
        keyed: dict[bytes, list] = {}
        for *ref, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keyed.setdefault(a.to_bytes(8, "big") + (b + 1).to_bytes(8, "big"), []).append(ref)
        yield _grouped(keyed, tickets)


def _names(batches):
    """Rows come sorted by key: a new name where the key changes; references without their key have none yet."""
    name, last = (task_id() << 40) - 1, None
    none = (None,) * len(_REFS)
    for batch in small_batches(batches):
        out = []
        for key, ticket, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and key != last:
                name, last = name + 1, key
            if key is None:
                out += [(*ref, None, ticket) for ref in zip(*lists, strict=True)]
            elif ticket is not None:
                out.append((*none, name, ticket))
            else:
                out += [(*ref, name, None) for ref in zip(*lists, strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * len(_NAMED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NAMED, strict=True)], names=_NAMED.names)


def _named(grouped: DataFrame) -> DataFrame:
    """The references with their names."""
    n = shuffle_partitions(grouped.sparkSession)
    placed = grouped.withColumn("place", F.when(F.col("key").isNull(), F.xxhash64("ticket")).otherwise(F.xxhash64("key"))).repartition(n, "place").sortWithinPartitions("key").drop("place")
    stored = written(placed.mapInArrow(_names, f"{_REF_DDL}, name long, ticket long"), "names")
    held = stored.filter("ticket is not null and name is null").drop("name")
    names = stored.filter("ticket is not null and name is not null").select("ticket", "name")
    return stored.filter("ticket is null").drop("ticket").unionByName(held.join(names, "ticket").drop("ticket"))


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, row_col: str | None = None) -> DataFrame:
    """(uid, doc_id, sha, round, name) per row: equal texts, and only those, share (round, name)."""
    lists = "key binary, ticket long, uid array<long>, doc_id array<long>, sha array<string>, n array<int>, idx array<int>"
    uid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(uid.cast("long"), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    level, done, k = _named(rows.mapInArrow(_blocks(block_bytes), lists)), [], 0
    while True:
        done.append(level.filter("n = 1").select("uid", "doc_id", "sha", F.lit(k).alias("round"), "name"))
        if level.filter("n > 1").isEmpty():
            break
        pairs = (
            level.filter("n > 1")
            .groupBy("uid", "doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("idx") / 2).cast("int").alias("idx"))
            .agg(F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(idx % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        )
        level, k = _named(pairs.mapInArrow(_pairs, lists)), k + 1
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and the row's number (that of ``row_col``, if given)."""
    # stored, as every later step would join all rounds' names again
    rows = written(block_identities(docs, id_col, text_col, block_bytes, row_col), "identities").withColumn("rank", F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "uid"))
    groups = written(rows.groupBy("round", "name").agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    found = lookup_groups(rows, groups, ["round", "name"], "group_size", rows.count())
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("uid").alias("row"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
