"""Which of many forms occur in which texts, without the forms being anywhere as a whole.

A small table, the gate, knows the forms' first eight characters (all of shorter ones), and two
filters of a fixed number of bits know fingerprints: one of the forms' first 8, 16, 32, 64
and 128 characters, one of the forms themselves. A pass over the texts looks windows of eight characters,
and of the lengths of shorter forms, up in the gate; only where that knows them, fingerprints are
made, of longer beginnings each where the one before is known, and of the lengths that forms with
such beginnings have. What passes is a substring that is joined with the forms by a shuffle, so a
false pass costs a row and no more.

Scale: the filters have ``BITS_A_FORM`` bits a form, at least ``LEAST_BITS`` and up to ``MOST_BITS``
(32 MB each), are put together by the driver from parts that tasks build, and are broadcast; more
forms only make more false passes. A form that a third of all texts contain is looked up by broadcast.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_views
from ..storage import cut, lookup, written

#: Beginnings of forms that are told by their fingerprints, one after another: a form is in the filter with all that it is long enough for.
ANCHORS = (8, 16, 32, 64, 128)
#: The beginning that every place is told by first, slots of the table of these (a power of two), and places that one look at it takes.
GATE, GATE_SLOTS, BLOCK = ANCHORS[0], 18, 1 << 15
#: Characters that one step hashes; bits of a filter for each form, at least and at most.
STEP, BITS_A_FORM, LEAST_BITS, MOST_BITS = 1 << 19, 16, 1 << 22, 1 << 28
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, _INVERSE))


class Rolling:
    """Fingerprints of any window of a text, from running sums of its characters' codes times powers of an odd base, modulo 2 to the 64."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = 1 << max(10, len(self.codes).bit_length())
        powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.add(self.codes, np.uint64(1), out=self.sums[1:])
        self.sums[1:] *= powers[: len(self.codes)]
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def at(self, places: np.ndarray, lengths) -> np.ndarray:
        h = (self.sums[places + lengths] - self.sums[places]) * self.inverse[places] + np.asarray(lengths).astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(33) & mask).astype(np.int64)


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _slots(hashes, len(bitmap) * 8)
    found = np.flatnonzero(bitmap[one >> 3] >> (one & 7).astype(np.uint8) & 1)
    two = two[found]
    return found[np.flatnonzero(bitmap[two >> 3] >> (two & 7).astype(np.uint8) & 1)]


def _gate(codes: np.ndarray, lengths):
    """(n, the gate's slot of every window of n characters) for each of these lengths, shortest first; lengths that no window has are left out."""
    h = codes.copy()
    for n in range(1, max(lengths, default=0) + 1):
        if n > len(codes):
            return
        if n > 1:
            h = h[:-1]
            h *= np.uint32(0x9E3779B1)
            h += codes[n - 1 :]
        if n in lengths:
            yield n, (h + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - GATE_SLOTS)


def _known(codes: np.ndarray, lengths, gate: np.ndarray | None) -> dict[int, np.ndarray]:
    """By length, places where windows begin that the gate knows; without a gate all places."""
    if gate is None:
        return {n: np.arange(max(0, len(codes) - n + 1)) for n in lengths}
    found: dict[int, list] = {n: [np.zeros(0, np.int64)] for n in lengths}
    for at in range(0, len(codes), BLOCK):
        for n, slots in _gate(codes[at : at + BLOCK + max(lengths, default=1) - 1], lengths):
            found[n].append(np.flatnonzero(gate.take(slots[:BLOCK], mode="clip")) + at)
    return {n: np.concatenate(x) for n, x in found.items()}


def _form_slots(bits: int, gated: bool = False):
    """(filter, slot) of forms: their anchors' slots in filter 0, their own in filter 1, the gate's in 2."""

    def run(batches):
        for batch in cut(batches):
            forms = batch.column(0).to_pylist()
            sizes = np.array([len(f) for f in forms], np.int64)
            hashed, starts = Rolling("".join(forms)), np.cumsum(sizes) - sizes
            begun = [hashed.at(starts[sizes >= a], a) for a in ANCHORS]
            slots = [np.concatenate(_slots(np.concatenate(begun), bits)), np.concatenate(_slots(hashed.at(starts, sizes), bits))]
            if gated:
                known = [of[starts[np.minimum(sizes, GATE) == n]].astype(np.int64) for n, of in _gate(hashed.codes, set(np.minimum(sizes, GATE).tolist()))]
                slots.append(np.concatenate([np.zeros(0, np.int64), *known]))
            slots = [np.unique(x) for x in slots]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(slots)), [len(x) for x in slots]).astype(np.int32)), pa.array(np.concatenate(slots))], names=["filter", "slot"])

    return run


def _filters(forms: DataFrame, bits: int, gated: bool = False) -> list[np.ndarray]:
    """Two bitmaps of a fixed number of bits, and the gate's, each built by tasks and put together here."""
    slots = forms.mapInArrow(_form_slots(bits, gated), "filter int, slot long")
    parts = slots.groupBy("filter", F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("set"))
    sizes = [bits // 8, bits // 8, *([1 << GATE_SLOTS - 3] if gated else [])]
    out = [np.zeros(max(n, 4096), np.uint8) for n in sizes]
    for which, bucket, found in parts.toLocalIterator():
        out[which][(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(found, np.uint8)
    return [x[:n] for x, n in zip(out, sizes, strict=True)]


def _pieces(rows, longest: int):
    """(text, starts of its parts, rows that they belong to): views one after another, long ones in parts that overlap by a form's length."""
    texts, owners, size = [], [], 0
    for row, views in rows:
        for view in views or ():
            for at in range(0, max(1, len(view or "")), STEP):
                part = (view or "")[at : at + STEP + longest - 1]
                texts.append(part)
                owners.append(row)
                size += len(part)
                if size >= STEP:
                    yield "".join(texts), np.cumsum([0, *map(len, texts)]), owners
                    texts, owners, size = [], [], 0
    if size:
        yield "".join(texts), np.cumsum([0, *map(len, texts)]), owners


class _Matcher:
    """Finds substrings that pass the gate, where beginnings have one, and both filters."""

    def __init__(self, beginnings, whole: np.ndarray, lengths: list[int]):
        self.anchors, gate = beginnings if isinstance(beginnings, tuple) else (beginnings, None)
        self.whole, self.longest = whole, max(lengths)
        self.gate = None if gate is None else np.unpackbits(gate, bitorder="little").view(bool)
        self.short = [n for n in lengths if n < GATE]
        ends = [*ANCHORS, self.longest + 1]
        self.steps = [(a, [n for n in lengths if a <= n < end]) for a, end in zip(ANCHORS, ends[1:], strict=True) if a <= self.longest]

    def matches(self, hashed: Rolling, ends: np.ndarray):
        """(places, lengths) of windows within one view that pass; ``ends`` has the end of every place's view."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def look(places, sizes):
            together = max(1, BLOCK // max(1, len(places)))  # few places are looked at with many lengths at once
            for i in range(0, len(sizes), together):
                some, n = np.repeat(places, len(sizes[i : i + together])), np.tile(np.array(sizes[i : i + together]), len(places))
                fits = np.flatnonzero(some + n <= ends[some])
                some, n = some[fits], n[fits]
                passed = _passes(self.whole, hashed.at(some, n))
                found.append((some[passed], n[passed]))

        known = _known(hashed.codes, {*self.short, *([GATE] if self.steps else [])}, self.gate)
        for n in self.short:
            look(known[n], [n])
        places = known.get(GATE)
        for a, sizes in self.steps:
            places = places[places + a <= ends[places]]
            places = places[_passes(self.anchors, hashed.at(places, a))]
            if len(places):
                look(places, sizes)
        return map(np.concatenate, zip(*found, strict=True))


def _once(codes: np.ndarray, places: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which matches to keep so that short windows, often found again, stay once a row: those whose characters and row fit into one number."""
    width, room = int(codes.max(initial=1)).bit_length(), 63 - int(rows.max(initial=1)).bit_length()
    most = min(GATE - 1, room // width)
    kept = [np.flatnonzero(lengths > most)]
    for n in range(1, most + 1):
        some = np.flatnonzero(lengths == n)
        window = rows[some].astype(np.int64)
        for i in range(n):
            window = window << width | codes[places[some] + i]
        kept.append(some[np.unique(window, return_index=True)[1]])
    return np.concatenate(kept)


def _viewed(batch):
    """(row, views) of a batch of views, or of texts whose views are made here."""
    plain = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(batch)
    for row, (views, text) in enumerate(zip(batch.column(1).to_pylist(), plain, strict=True)):
        yield row, views if text is None else plain_views(text)


def _candidates(shared):
    """(key, form): substrings of a text's views that pass both filters."""

    def run(batches):
        matcher = _Matcher(*shared.value)
        for batch in cut(batches):
            keys = batch.column(0).to_pylist()
            found: list[set[str]] = [set() for _ in keys]
            for text, starts, owners in _pieces(_viewed(batch), matcher.longest):
                places, lengths = matcher.matches(hashed := Rolling(text), np.repeat(starts[1:], np.diff(starts)))
                rows = np.array(owners)[np.searchsorted(starts, places, "right") - 1]
                once = _once(hashed.codes, places, lengths, rows)
                for at, n, row in zip(places[once].tolist(), lengths[once].tolist(), rows[once].tolist(), strict=True):
                    found[row].add(text[at : at + n])
            columns = [k for k, x in zip(keys, found, strict=True) for _ in x], [f for x in found for f in x]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["key", "form"])

    return run


def _shared(forms: DataFrame, bits: int, lengths: list[int]) -> tuple:
    """((filter, gate) of beginnings, filter of forms, lengths)"""
    anchors, whole, gate = _filters(forms, bits, gated=True)
    return (anchors, gate), whole, lengths


def occurring(texts: DataFrame, forms: DataFrame, bits: int | None = None) -> DataFrame:
    """(key, form), each once: which of the distinct ``forms`` (form) are substrings of any of a text's views; ``texts``: (key string, views array<string>), and where there is a column ``plain`` with a text, its views are made from that."""
    spark = texts.sparkSession
    forms = forms.select("form").filter(F.length("form") > 0)
    lengths = [r["n"] for r in forms.select(F.length("form").alias("n")).distinct().collect()]  # whole numbers, as many as there are lengths
    if not lengths:
        return spark.createDataFrame([], "key string, form string")
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_FORM * forms.count()).bit_length()))
    shared = spark.sparkContext.broadcast(_shared(forms, bits, sorted(lengths)))
    passed = written(texts.select("key", "views", *(c for c in texts.columns if c == "plain")).mapInArrow(_candidates(shared), "key string, form string"), "passed")
    return lookup(passed, forms.withColumn("known", F.lit(True)), "form").select("key", "form")
