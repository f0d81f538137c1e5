"""Ranked lexical search by Fagin's threshold algorithm.

Queries go through in blocks of a bounded number of terms. For a block, one pass over the
texts writes a forward index: each document's length and its counts of the block's terms.
Corpus statistics (documents, lengths, documents per term) come from that table. Then each
task goes through its part of the forward index in runs of a bounded number of postings. A
run inverts its postings into one list per term, sorted by falling impact, and every query
goes down its lists in turn: documents that show up for the first time are looked up in the
forward index and scored in full, and the search of a run ends as soon as the sum of the
impacts at the current depth, which bounds every document not yet seen, is strictly below
the k-th best score so far. That score is carried from run to run, so later runs of a task
end sooner. A document is scored in one run only; the best of all tasks are merged in Spark.

Scale: a task gives k rows per query at most, and they are merged in two steps; a term that
all documents hold is a list of a run like any other, and is never gathered anywhere. Only
the block's terms and queries are broadcast, whose number the block bounds.

Edge cases: null and empty texts, and those without terms, are in no list and don't count as
documents; items without terms give no rows; rows of the queries' table are queries of their
own, repeated ids too; equal scores go by id, null ids last; copies are ranked each; an empty
table on either side gives an empty result; other columns are ignored. One query with more
terms than a block is a block of its own.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, task_id, written

#: Terms of queries in a block; postings in a run; steps down each list between two tests.
BLOCK_TERMS, RUN_POSTINGS, DEPTH, SLICE = 200_000, 1_500_000, 64, 1 << 20
#: ASCII letters and digits, lower-cased, and all bytes of other characters; the rest are blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_lists(text: str | None):
    """The terms of a text as bytes, a slice of it at a time."""
    raw = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + SLICE)
        cut = len(raw) if cut < 0 else cut
        yield raw[at:cut].split()
        at = cut


class Block:
    """Queries, as numbers of terms with how often each stands in the query."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.items, self.queries, self.size = [], [], 0

    def add(self, item_id, text):
        counts: Counter = Counter()
        for words in term_lists(text):
            counts.update(words)
        if counts:
            self.items.append(item_id)
            self.queries.append((np.array([self.terms.setdefault(w, len(self.terms)) for w in counts], np.int64), np.array(list(counts.values()), np.int64)))
            self.size += len(counts)


def query_blocks(items: DataFrame, id_col: str, text_col: str, most: int):
    """The queries in blocks of about ``most`` terms, one block on the driver at a time."""
    block = Block()
    for item_id, text in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        block.add(item_id, text)
        if block.size >= most:
            yield block
            block = Block()
    if block.items:
        yield block


_FORWARD = "doc_id long, n long, term binary, tf binary"


def _index(terms):
    def run(batches):
        number = terms.value
        for batch in small_batches(batches, 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts: Counter = Counter()
                for words in term_lists(text):
                    counts.update(words)
                if counts:
                    held = [(number[w], c) for w, c in counts.items() if w in number]
                    ids, tf = np.array(held, np.int64).reshape(-1, 2).T
                    rows.append((doc_id, counts.total(), ids.astype("<u4").tobytes(), tf.astype("<u4").tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "n", "term", "tf"])

    return run


def forward_index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, term, tf), stored: documents with any term, and their counts of the given terms as arrays of 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most as many as the queries of a block have
    return written(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_index(shared), _FORWARD), "forward")


def _document_counts(n_terms: int):
    def run(batches):
        seen = np.zeros(n_terms, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                seen[np.frombuffer(ids, "<u4")] += 1  # a document has each term once
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "df"])

    return run


def statistics(forward: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of the given terms."""
    documents, length = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for term, n in forward.select("term").mapInArrow(_document_counts(n_terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[term] = n  # a row per term of the block
    return documents, length, df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Run:
    """Some documents: their forward index with impacts instead of counts, and one list per term by falling impact."""

    def __init__(self, rows: list, documents: int, length: int):
        self.ids = [r[0] for r in rows]
        # nulls come last where scores are equal
        order = sorted(range(len(rows)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        self.place = np.empty(len(rows), np.int64)
        self.place[order] = np.arange(len(rows))
        n = np.array([r[1] for r in rows], np.int64)
        self.terms = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows]).astype(np.int64)
        tf = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows]).astype(np.int64)
        self.sizes = np.array([len(r[2]) // 4 for r in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        m = np.repeat(75 + 25 * n * documents // max(1, length), self.sizes)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        order = np.lexsort((-self.impacts, self.terms))
        self.by_impact, self.docs = self.impacts[order], np.repeat(np.arange(len(rows)), self.sizes)[order]
        held, first, count = np.unique(self.terms[order], return_index=True, return_counts=True)
        self.lists = dict(zip(held.tolist(), zip(first.tolist(), (first + count).tolist(), strict=True), strict=True))

    def scores(self, docs: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Random access: whole scores of some documents from the forward index; ``factor``: weight times count in the query, by term."""
        sizes = self.sizes[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[docs] - (ends - sizes), sizes) + np.arange(ends[-1])
        return np.add.reduceat(factor[self.terms[at]] * self.impacts[at], ends - sizes)

    def search(self, terms: np.ndarray, factor: np.ndarray, best: list, k: int) -> tuple[list, int]:
        """``best`` ((score, id), best first, k at most) with this run's documents, and the depth that was reached."""
        lists = [(factor[t], *self.lists[t]) for t in terms.tolist() if t in self.lists and factor[t]]
        seen, depth, step = np.zeros(len(self.ids), bool), 0, DEPTH
        while lists:
            new = np.unique(np.concatenate([self.docs[a + depth : min(a + depth + step, b)] for _, a, b in lists]))
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                best = self._merge(best, new, self.scores(new, factor), k)
            depth += step
            lists = [x for x in lists if x[1] + depth < x[2]]
            # what stands at this depth or below adds no more than this to a document that hasn't been seen
            if len(best) == k and sum(int(f) * int(self.by_impact[a + depth]) for f, a, _ in lists) < best[-1][0]:
                break
            step *= 2
        return best, depth

    def _merge(self, best: list, docs: np.ndarray, scores: np.ndarray, k: int) -> list:
        some = np.lexsort((self.place[docs], -scores))[:k]
        found = best + [(int(s), self.ids[d]) for d, s in zip(docs[some].tolist(), scores[some].tolist(), strict=True) if s > 0]
        return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def _search(shared, k: int, postings: int):
    def run(batches):
        queries, weight, documents, length = shared.value
        best: list[list] = [[] for _ in queries]
        factor, rows, size = np.zeros(len(weight), np.int64), [], 0

        def go():
            part = Run(rows, documents, length)
            for q, (terms, counts) in enumerate(queries):
                factor[terms] = weight[terms] * counts
                best[q], _ = part.search(terms, factor, best[q], k)
                factor[terms] = 0

        for batch in small_batches(batches, 4 << 20):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2]:
                    rows.append(row)
                    size += len(row[2]) // 4
                if size >= postings:
                    go()
                    rows, size = [], 0
        if rows:
            go()
        found = [(q, task_id(), i, s) for q, x in enumerate(best) for s, i in x]
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "task", "doc_id", "score"])

    return run


def _top(rows: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: Block, k: int, id_col: str, text_col: str, postings: int) -> DataFrame:
    spark = docs.sparkSession
    forward = forward_index(docs, block.terms, id_col, text_col)
    documents, length, df = statistics(forward, len(block.terms))
    shared = spark.sparkContext.broadcast((block.queries, weights(documents, df), documents, length))
    found = forward.mapInArrow(_search(shared, k, postings), "query long, task long, doc_id long, score long")
    # in two steps, so that the number of rows that meet in a task doesn't grow with the number of tasks
    best = _top(_top(found, ["query", F.pmod("task", F.lit(64))], k), ["query"], k)
    items = spark.createDataFrame([(q, i) for q, i in enumerate(block.items)], "query long, item_id long")
    return best.join(F.broadcast(items), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, postings: int = RUN_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each query."""
    found = None
    for block in query_blocks(items, item_col, item_text, block_terms):
        part = _search_block(docs, block, k, id_col, text_col, postings)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
held AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM held),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM q) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
scored AS (
    SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
    FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN held USING (r), total GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
