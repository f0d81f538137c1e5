"""N-gram Jaccard self-join by vertical partitioning, down to linked components.

The n-grams' global order is cut into fragments (ranges of their hashes), and every
document's set with it. Each fragment counts its n-grams' document frequencies on its own
and hands back to the documents the n-grams that at least two of them share. With those, a
document keeps the start of its set in order of frequency: two sets as similar as asked for
share an n-gram of that prefix, and a document whose prefix is its own alone is done.
Pairs that meet are verified fragment by fragment: partial overlaps are counted separately
and summed per pair.

Groups of copies stay linear. Equal sets are one class from the start. Of the classes that
share a prefix n-gram, all are first compared with the most central one only (the fewest
n-grams of its own); what that links is one component. Then only those outside of that
component look for partners that sizes and positions still allow, in the whole group, so no
link between components is lost, and pairs inside a component are never made. What they find
joins whole components, whose names alone are followed to the end.

Scale: sets travel as packed arrays, once; later steps hold shared n-grams only. Hot keys
are looked up by a bounded broadcast (see lookup_groups) or in joins that Spark can split.
Sets and classes are named by hashes of 64 and 128 bits.

Edge cases: null text counts as empty; a text without words has no set, links with nothing
and is its own component; texts of fewer words than ``k`` are one n-gram; a null id is kept
and takes the component's smallest id; repeated rows are linked as equal sets; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lookup_groups, pack, shuffle_partitions, small_batches, unpack, written

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX, _FLUSH, _SEGMENTS = np.uint64(0x9E3779B97F4A7C15), 1_000_000, 8


class _Words(dict):
    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def ngram_set(text: str | None, k: int, words: dict) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of the words, which ASCII white space divides."""
    found = (text or "").encode().translate(_FOLD).split()
    codes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(k, len(codes))
    if not size:
        return codes
    rolled = np.full(len(codes) - size + 1, size, np.uint64)
    for j in range(size):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX + codes[j : len(codes) - size + 1 + j]
    return np.unique((rolled ^ (rolled >> np.uint64(32))) * _MIX)


def _name(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves that name a set."""
    digest = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(k: int):
    def run(batches):
        words = _Words()
        for batch in small_batches(batches):
            n, a, b = [], [], []
            for text in batch.column(2).to_pylist():
                grams = ngram_set(text, k, words)
                n.append(len(grams))
                x, y = _name(grams) if len(grams) else (None, None)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["row", "doc_id", "n", "a", "b"])

    return run


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def _packed(bucket: np.ndarray, owner: np.ndarray, sets: dict, columns: dict):
    """Rows (bucket, payload): values in order of bucket and owner, as lists per owner, with what ``sets`` has of it."""
    order = np.argsort(bucket.astype(np.uint16 if len(bucket) and bucket.max() < 1 << 16 else np.int64), kind="stable")  # owners come in order
    bucket, owner = bucket[order], owner[order]
    new = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    sizes, heads = np.diff(np.append(new, len(owner))), bucket[new]
    edges = np.flatnonzero(np.append(True, heads[1:] != heads[:-1])) if len(heads) else np.zeros(0, np.int64)
    for first, last in zip(edges, np.append(edges[1:], len(heads)), strict=True):
        own, part = slice(first, last), slice(new[first], new[last] if last < len(new) else len(owner))
        lists = {name: _lists(values[order[part]], sizes[own]) for name, values in columns.items()}
        payload = pack(**{name: values[owner[new[own]]] for name, values in sets.items()}, **lists)
        yield pa.RecordBatch.from_arrays([pa.array([int(heads[first])], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "payload"])


def _fragments(k: int, fragments: int):
    def flush(grams, names):
        sizes = np.array([len(g) for g in grams])
        flat = np.concatenate(grams)
        a, b = np.array(names, np.int64).T
        fragment = ((flat >> np.uint64(40)) * np.uint64(fragments)) >> np.uint64(24)
        yield from _packed(fragment.astype(np.int64), np.repeat(np.arange(len(grams)), sizes), {"a": a, "b": b, "n": sizes.astype(np.int32)}, {"grams": flat})

    def run(batches):
        words, grams, names, seen, held = _Words(), [], [], set(), 0
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                g = ngram_set(text, k, words)
                if len(g) and (name := _name(g)) not in seen:
                    grams.append(g)
                    names.append(name)
                    seen.add(name)
                    held += len(g)
                if held >= _FLUSH:
                    yield from flush(grams, names)
                    grams, names, seen, held = [], [], set(), 0
        if grams:
            yield from flush(grams, names)

    return run


def _all(batches) -> pa.Table | None:
    payloads = [p for batch in batches for p in batch.column("payload").to_pylist()]
    return unpack(payloads) if payloads else None


def _flat(table: pa.Table, *names):
    """Owner row numbers and flat values of list columns of equal sizes."""
    lists = [table.column(n).combine_chunks() for n in names]
    sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(table.num_rows), sizes), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)


def _shared(buckets: int):
    """Of the fragments of one task: the n-grams that stand in more than one set, by set, with their frequency."""

    def run(batches):
        table = _all(batches)
        if table is None:
            return
        a, b, n = (table.column(c).to_numpy() for c in ("a", "b", "n"))
        owner, grams = _flat(table, "grams")
        sizes = table.column("grams").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = grams[np.cumsum(sizes) - sizes]
        again = pd.DataFrame({"a": a, "b": b, "g": first}).duplicated().to_numpy()  # the same set from another task
        fresh = ~again[owner]
        owner, grams = owner[fresh], grams[fresh]
        order = np.argsort(grams, kind="stable")
        new = np.flatnonzero(np.append(True, grams[order][1:] != grams[order][:-1]))
        df = np.empty(len(grams), np.uint32)
        df[order] = np.repeat(np.diff(np.append(new, len(grams))), np.diff(np.append(new, len(grams))))
        kept = df > 1
        owner, grams, df = owner[kept], grams[kept], df[kept]
        yield from _packed((a[owner].view(np.uint64) % np.uint64(buckets)).astype(np.int64), owner, {"a": a, "b": b, "n": n}, {"grams": grams, "df": df})

    return run


def _candidates(percent: int):
    """Sets with a prefix that they may share: size, how many n-grams are their own, the prefix, and all shared n-grams in segments."""

    def run(batches):
        table = _all(batches)
        if table is None:
            return
        a, b, n = (table.column(c).to_numpy() for c in ("a", "b", "n"))
        row, grams, df = _flat(table, "grams", "df")
        key = pd.DataFrame({"a": a, "b": b}).groupby(["a", "b"], sort=False).ngroup().to_numpy()
        head = np.full(key.max() + 1, 0)
        head[key] = np.arange(len(key))
        order = np.lexsort((grams, df, key[row]))
        owner = key[row][order]
        new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out = {c: [] for c in ("a", "b", "n", "own", "prefix", "segments")}
        for first, last in zip(new, np.append(new[1:], len(owner)), strict=True):
            at = head[owner[first]]
            size = int(n[at])
            own = size - int(last - first)
            room = size - -(-percent * size // 100) + 1 - own
            if room <= 0:
                continue
            ordered = grams[order[first:last]]
            cut = np.sort(ordered)
            bounds = np.searchsorted(cut, np.arange(1, _SEGMENTS, dtype=np.uint64) << np.uint64(61))
            values = (a[at], b[at], size, own, ordered[:room].view(np.int64).tolist(), [s.view(np.int64).tolist() for s in np.split(cut, bounds)])
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
            if len(out["a"]) == 512:
                yield _candidate_rows(out)
                out = {c: [] for c in out}
        if out["a"]:
            yield _candidate_rows(out)

    return run


def _candidate_rows(out: dict) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def candidate_sets(docs: DataFrame, text_col: str, k: int, percent: int) -> DataFrame:
    """(v, n, own, prefix, segments) of the classes that may have a partner."""
    parts = shuffle_partitions(docs.sparkSession)
    schema = "bucket int, payload binary"
    # buckets are partitions: no task gets several by chance
    fragments = docs.select(F.col(text_col).cast("string")).mapInArrow(_fragments(k, parts), schema).repartitionById(parts, "bucket")
    shared = fragments.mapInArrow(_shared(parts), schema).repartitionById(parts, "bucket")
    found = shared.mapInArrow(_candidates(percent), "a long, b long, n long, own long, prefix array<long>, segments array<array<long>>")
    return written(found.select(_vertex("a", "b").alias("v"), "n", "own", "prefix", "segments"), "candidates")


def _vertex(a: str, b: str):
    return F.concat_ws(":", F.hex(a), F.hex(b))


def linked(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (x, y, and what else they carry) those that link: overlaps are counted per segment and summed per pair.

    The pairs are stored first, so where they are few no exchange of the first side's segments is planned.
    """
    carried = [c for c in pairs.columns if c not in ("x", "y")]
    parts = candidates.select("v", "n", F.posexplode("segments").alias("segment", "grams"))
    left = parts.select(F.col("v").alias("x"), F.col("n").alias("nx"), "segment", F.col("grams").alias("gx"))
    right = parts.select(F.col("v").alias("y"), F.col("n").alias("ny"), "segment", F.col("grams").alias("gy"))
    both = written(pairs.distinct(), "pairs").join(left, "x").join(right, ["y", "segment"])
    summed = both.groupBy("x", "y", "nx", "ny", *carried).agg(F.sum(F.size(F.array_intersect("gx", "gy"))).alias("common"))
    return summed.filter(100 * F.col("common") >= percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("x", "y", *carried)


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of every vertex of an edge (x, y): the least vertex reached, by minima of neighbours and pointer jumps."""
    ways = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    both = written(edges.select(F.inline(ways)).distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("y")).select("v", F.least("v", "y").alias("component"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.select(F.col("v").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("v")).agg(F.min("c").alias("near"))
        step = written(labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("component")), "labels")
        jump = step.select(F.col("v").alias("component"), F.col("component").alias("further"))
        labels = written(step.join(jump, "component").select("v", F.col("further").alias("component"), (F.col("further") != F.col("old")).alias("moved")), "labels")
    return labels.select("v", "component")


def _size_class(n):
    return F.floor(F.log(n) / F.log(F.lit(1.1))).cast("int")


def classes_linked(candidates: DataFrame, percent: int) -> DataFrame:
    """(v, component) of the classes that links connect."""
    ratio = percent / (100.0 + percent)
    spread = candidates.select("v", "n", "own", F.posexplode("prefix").alias("at", "gram")).withColumn("at", F.col("at") + F.col("own"))
    rank = F.struct((F.col("own") / F.col("n")).alias("own"), F.col("v").alias("v"), F.col("n").alias("n"))
    centres = written(spread.groupBy("gram").agg(F.min(rank).alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "centres")
    total = centres.agg(F.sum("members")).first()[0] or 0
    near = lookup_groups(spread, centres, ["gram"], "members", total, least=64).filter("v != centre.v")
    alike = (percent * F.col("n") <= 100 * F.col("centre.n")) & (percent * F.col("centre.n") <= 100 * F.col("n"))
    stars = linked(near.filter(alike).select(F.least("v", "centre.v").alias("x"), F.greatest("v", "centre.v").alias("y")), candidates, percent)

    # the rest: whoever isn't in the component of its n-gram's centre looks through the whole group
    of = components(stars)
    starred = F.col("component").isNotNull().alias("starred")
    named = written(candidates.join(of, "v", "left").select("v", "n", "own", "prefix", F.coalesce("component", "v").alias("component"), starred), "starred")
    spread = named.select("v", "n", "component", "own", F.posexplode("prefix").alias("at", "gram")).withColumn("at", F.col("at") + F.col("own"))
    home = written(centres.select("gram", "members", F.col("centre.v").alias("v")).join(named.select("v", F.col("component").alias("home")), "v").select("gram", "members", "home"), "homes")
    outside = lookup_groups(spread, home, ["gram"], "members", total, least=64).filter("home is not null and component != home")
    # an overlap of at most n - at allows partners of at most this size
    most = (F.col("n") - F.col("at")) / F.lit(ratio) - F.col("n")
    low, high = F.ceil(F.col("n") * percent / 100), F.least(F.floor(F.col("n") * 100 / percent), F.floor(most + 1e-6))
    probes = outside.withColumn("low", low).withColumn("high", high).filter("low <= high").select("gram", F.col("v").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), "low", "high", F.explode(F.sequence(_size_class(F.col("low")), _size_class(F.col("high")))).alias("class"))
    members = spread.select("gram", F.col("v").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), (most + 1e-6).alias("reach"), _size_class(F.col("n")).alias("class"))
    met = probes.join(members, ["gram", "class"]).filter("cx != cy and ny between low and high and nx <= reach")
    x, y = F.struct(F.col("x").alias("v"), F.col("cx").alias("c")), F.struct(F.col("y").alias("v"), F.col("cy").alias("c"))
    pairs = met.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).select(F.col("x.v").alias("x"), F.col("y.v").alias("y"), F.col("x.c").alias("cx"), F.col("y.c").alias("cy"))
    # those links join whole components, so only components are followed any further
    joined = components(linked(pairs, candidates, percent).select(F.col("cx").alias("x"), F.col("cy").alias("y")))
    found = named.select("v", "component", "starred").join(joined.select(F.col("v").alias("component"), F.col("component").alias("least")), "component", "left")
    return found.filter("starred or least is not null").select("v", F.coalesce("least", "component").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, row_col: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id, first (whether the row stands for its component), for every row of ``docs``."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sets = written(docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(_sets(k), "row long, doc_id long, n long, a long, b long"), "sets")
    candidates = candidate_sets(docs, text_col, k, percent)
    groups = classes_linked(candidates, percent)
    # a null id ranks last
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    classes = sets.filter("n > 0").groupBy("a", "b").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("members")).withColumn("v", _vertex("a", "b"))
    classes = written(classes.join(groups, "v", "left"), "classes")
    grouped = classes.filter("component is not null")
    best = written(grouped.groupBy("component").agg(F.min("best").alias("least"), F.count(F.lit(1)).alias("classes")), "best")
    together = lookup_groups(grouped, best, ["component"], "classes", grouped.count(), least=64)
    named = together.select("a", "b", "members", "least").union(classes.filter("component is null").select("a", "b", "members", "best"))
    named = written(named, "named")
    found = lookup_groups(sets.filter("n > 0"), named, ["a", "b"], "members", sets.count(), least=64)
    alone = sets.filter("n = 0").select("row", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return found.select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("first")).union(alone)
