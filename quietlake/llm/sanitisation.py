"""Personal data by fixed patterns, and terms that give it away by the corpus' own statistics.

Four patterns find e-mail addresses, network addresses, card numbers and telephone numbers.
Each distinct value is a protected entity. The terms that stand around an entity's places (at
most ``_NEAR`` words and ``_REACH`` characters to either side) co-occur with it. A term t
discloses an entity c to the degree PMI(c;t) / IC(c) = 1 - log p(c|t) / log p(c): 1 if the
term never stands in a text without the entity, 0 if it tells nothing. A term whose degree is
``most`` or more for any entity, with ``support`` different surroundings as evidence, is
sanitised wherever it stands: generalised to the longest prefix that discloses less, else
removed. Probabilities are shares of documents, copies included; surroundings that are copies
of each other are one piece of evidence.

Scale: the first pass over the texts gives spans, surroundings, and counts of words that are
frequent in a block, which bound the documents of a word from below and thus rule out common
words early. Co-occurrences are grouped by (entity, term) after equal surroundings have been
counted together. The second pass looks for the remaining terms only, by a bitmap of fixed
size (false hits go when the exact terms are joined), and counts the documents of each. Both
are joined as rows of numbers and words; no text is shuffled, but for sanitised texts.

Edge cases: null text counts as empty; a null id is kept; repeated rows are rows of their
own; an empty table gives an empty result; texts are read whole; other columns are ignored.
An entity that all documents hold can't be disclosed. A term that lies in a pattern's span
isn't a span of its own there. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import lookup
from .common import small_batches, spread, with_rows, written
from .lexical_search import term_lists

KINDS = ("email", "ip", "card", "phone")
TERM_KIND = "term"
_NEAR, _REACH = 8, 200
#: Size of the bitmap of terms: 8 MB. Words of one block that count as frequent, and a block's length.
SLOTS, FREQUENT, BLOCK_CHARS = 1 << 26, 16, 12 << 20
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+")
_NUMBER = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_DIGITS = re.compile(r"[^0-9]")


def _emails(text: str):
    """By each at sign: what stands before it, back to the last match, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    """Every four numbers of a chain of numbers joined by points."""
    for chain in _NUMBER.finditer(text):
        if chain[0].count(".") < 3:
            continue
        start, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            some = parts[i : i + 4]
            end = start + sum(map(len, some)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in some):
                yield start, end
            start = end + 1


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of the patterns' matches, by kind and start."""
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    found += [(1, *s) for s in _ips(text)] if _CHAIN.search(text) else []
    found += [(2, *s) for s in _cards(text)]
    return found + ([(3, *s) for s in _phones(text)] if "+" in text else [])


def entity(kind: int, value: str) -> str:
    """What a span's value is compared by: letters in lower case, numbers by their digits."""
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _DIGITS.sub('', value)}"


def _fold(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def _inside(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a place touches one of the spans, which are sorted and merged."""
    i = bisect_left(spans, (end, 0))
    return i > 0 and spans[i - 1][1] > start


def _merged(found) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, start, end in sorted(found, key=lambda s: s[1:]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def surroundings(text: str, found) -> dict[str, set[str]]:
    """Terms near each entity of a text, at any of its places, without those in a pattern's span."""
    merged, out = _merged(found), {}
    for kind, start, end in found:
        near = out.setdefault(entity(kind, text[start:end]), set())
        for low, high, nearest in ((max(0, start - _REACH), start, slice(-_NEAR, None)), (end, min(len(text), end + _REACH), slice(_NEAR))):
            words = [(low + m.start(), low + m.end()) for m in _TERM.finditer(text[low:high])]
            # not what the edges cut
            whole = [(a, b) for a, b in words if not (a == low > 0 and _TERM.match(text[a - 1])) and not (b == high < len(text) and _TERM.match(text[b])) and not _inside(merged, a, b)]
            near.update(_fold(text[a:b]) for a, b in whole[nearest])
    return out


_SCAN = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("counts", pa.list_(pa.int64())), ("base", pa.string()), ("entity", pa.string()), ("terms", pa.list_(pa.string())), ("df", pa.int64())])
_SCAN_DDL = "part int, row long, doc_id long, counts array<long>, base string, entity string, terms array<string>, df long"
_DOC, _AROUND, _WORD = range(3)


def _scan(batches):
    """Rows of three kinds: a text's spans; an entity's surroundings in a text; a word that is frequent in a block of texts."""
    seen, size = Counter(), 0

    def rows(kind, values):
        columns = list(zip(*values, strict=True)) or [()] * len(_SCAN)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCAN, strict=True)], schema=_SCAN)

    def words():
        return rows(_WORD, [(_WORD, None, None, None, None, None, [w.decode()], n) for w, n in seen.items() if n >= FREQUENT])

    for batch in small_batches(batches, 4 << 20):
        out = []
        for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = text or ""
            found = base_spans(text)
            counts = np.bincount([k for k, *_ in found], minlength=len(KINDS)).tolist() if found else [0] * len(KINDS)
            out.append((_DOC, row, doc_id, counts, ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found), None, None, None))
            out += [(_AROUND, row, None, None, None, e, sorted(near), None) for e, near in (surroundings(text, found) if found else {}).items()]
            distinct: set[bytes] = set()
            for some in term_lists(text):
                distinct.update(some)
            seen.update(distinct)
            size += len(text)
        yield rows(None, out)
        if size >= BLOCK_CHARS:
            yield words()
            seen, size = Counter(), 0
    yield words()


def _places(shared):
    def run(batches):
        bitmap = shared.value
        for batch in small_batches(batches, 4 << 20):
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits: set[str] = set()
                for some in term_lists(text):
                    hits.update(w.decode() for w in set(some) if bitmap[(slot := zlib.crc32(w) % SLOTS) >> 3] >> (slot & 7) & 1)
                if not hits:
                    continue
                merged = _merged(base_spans(text))
                for m in _TERM.finditer(text):
                    if (term := _fold(m[0])) in hits:
                        out.append((row, term, m.start(), m.end(), _inside(merged, *m.span())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "term", "start", "end", "inside"])

    return run


def _bitmap(terms: DataFrame) -> bytearray:
    """Which of ``SLOTS`` slots the terms fall into: a fixed number of bits, built by tasks and put together here."""
    slot = F.crc32(F.col("term").cast("binary")) % SLOTS
    parts = terms.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
    out = bytearray(SLOTS // 8)
    for bucket, bits in parts.toLocalIterator():
        at = (bucket - 1) * 4096  # buckets count from 1 and have 4096 bytes
        out[at : at + len(bits)] = bits
    return out


def _degree(together: Column, of_term: Column, of_entity: Column, documents: int) -> Column:
    """PMI / IC; entities of all documents have no information to disclose."""
    told = 1 - F.log(together / of_term) / F.log(of_entity / F.lit(float(documents)))
    return F.when(of_entity < documents, told).otherwise(F.lit(0.0))


class Scan:
    """The patterns' spans of a table, its revealing terms, and their places."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.9, support: int = 3):
        numbered, self.row = with_rows(docs)
        self.docs, self.text_col, self.most = numbered, text_col, most
        texts = spread(numbered.select(F.col(self.row).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
        scanned = written(texts.mapInArrow(_scan, _SCAN_DDL), "scanned")
        self.rows = scanned.filter(F.col("part") == _DOC).select("row", "doc_id", "counts", "base")
        self.documents = self.rows.count()
        self.frequent = scanned.filter(F.col("part") == _WORD).groupBy(F.col("terms")[0].alias("term")).agg(F.sum("df").alias("least"))
        candidates = self._candidates(scanned.filter(F.col("part") == _AROUND).select("entity", "terms"), support)
        shared = docs.sparkSession.sparkContext.broadcast(bytes(_bitmap(candidates.select("term"))))
        self.places = written(texts.select("row", "text").mapInArrow(_places(shared), "row long, term string, start int, end int, inside boolean"), "places")
        self.revealing = self._revealing(candidates)

    def _candidates(self, around: DataFrame, support: int) -> DataFrame:
        """(entity, term, together, of_entity): enough evidence, and not too common by what is known so far."""
        different = around.groupBy("entity", "terms").agg(F.count(F.lit(1)).alias("docs"))
        pairs = different.select("entity", "docs", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("docs").alias("together"), F.count(F.lit(1)).alias("evidence"))
        pairs = written(pairs.filter(F.col("evidence") >= support), "pairs")
        entities = around.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity")).join(pairs.select("entity").distinct(), "entity", "left_semi")
        known = lookup(pairs, written(entities, "entities"), "entity").join(self.frequent, "term", "left")
        told = _degree(F.col("together"), F.greatest("together", "least"), F.col("of_entity"), self.documents)
        return written(known.filter(told >= self.most).select("entity", "term", "together", "of_entity"), "candidates")

    def _revealing(self, candidates: DataFrame) -> DataFrame:
        """(term, disclosure, entities, general): terms over the threshold; ``general`` is empty where nothing but removal helps."""
        counted = self.places.select("row", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        told = _degree(F.col("together"), F.col("df"), F.col("of_entity"), self.documents)
        pairs = written(candidates.join(counted, "term").withColumn("disclosure", told).filter(F.col("disclosure") >= self.most), "revealing")
        terms = pairs.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.count(F.lit(1)).alias("entities"))
        cut = F.transform(F.sequence(F.lit(3), F.length("term") - 1), lambda n: F.substring(F.col("term"), 1, n))
        prefixes = pairs.filter(F.length("term") > 3).select("term", "of_entity", F.explode(cut).alias("prefix"))
        common = self.frequent.filter(F.length("term") >= 3).select("least", F.explode(F.transform(F.sequence(F.lit(3), F.length("term")), lambda n: F.substring(F.col("term"), 1, n))).alias("prefix")).groupBy("prefix").agg(F.max("least").alias("least"))
        # at most all documents of the entity hold the prefix, and at least as many as its most common word hold it at all
        still = _degree(F.col("of_entity"), F.greatest("of_entity", "least"), F.col("of_entity"), self.documents)
        safe = prefixes.join(common, "prefix").groupBy("term", "prefix").agg(F.max(still).alias("still"), F.count(F.lit(1)).alias("entities")).filter(F.col("still") < self.most)
        # a prefix has to be known for all entities of the term
        best = safe.join(terms.select("term", "entities"), ["term", "entities"]).groupBy("term").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
        return written(terms.join(best, "term", "left").withColumn("general", F.coalesce(F.concat("prefix", F.lit("*")), F.lit(""))).drop("prefix"), "terms")

    def marks(self) -> DataFrame:
        """(row, marks): the revealing terms' places of each document that has any, by start, with what goes there instead."""
        found = lookup(self.places.filter("not inside"), self.revealing.select("term", "general"), "term")
        return found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "general"))).alias("marks"))

    def spans(self) -> DataFrame:
        """(row, doc_id, counts, base, marks): a row per document; ``base`` are the patterns' spans as text."""
        return self.rows.join(self.marks(), "row", "left")

    def sanitised(self) -> DataFrame:
        """The table with its texts sanitised: spans named by their kind, terms generalised or removed."""
        name = lambda c: f"_{c}" if c in self.docs.columns else c
        marks = self.marks().selectExpr("row as __row", f"marks as {name('marks')}")
        joined = self.docs.join(marks, F.col(self.row) == F.col("__row"), "left")
        return joined.withColumn(self.text_col, _sanitise(F.col(self.text_col), F.col(name("marks")))).select(*[c for c in self.docs.columns if c != self.row])


@F.pandas_udf(T.StringType())
def _sanitise(texts: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([sanitise_text(t, m) for t, m in zip(texts, marks, strict=True)], dtype="object")


def sanitise_text(text: str | None, marks) -> str | None:
    if text is None:
        return None
    spans = base_spans(text)
    kinds = {start: KINDS[k] for k, start, _ in sorted(spans, key=lambda s: -s[0])}
    cuts = [(start, end, f"[{kinds[start].upper()}]") for start, end in _merged(spans)]
    cuts += [(m["start"], m["end"], m["general"] or "[REMOVED]") for m in (marks if marks is not None else [])]
    out, at = [], 0
    for start, end, instead in sorted(cuts):
        out += [text[at:start], instead]
        at = end
    return "".join([*out, text[at:]])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each pattern, the digest of those spans, and all spans as text."""
    terms = F.array_join(F.transform(F.coalesce("marks", F.array().cast("array<struct<start:int,end:int,general:string>>")), lambda m: F.concat_ws(":", F.lit(TERM_KIND), m["start"].cast("string"), m["end"].cast("string"))), ",")
    counts = [F.col("counts")[i].alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(terms != "", terms))
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), both.alias("spans"))
