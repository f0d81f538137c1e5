"""Lexical search, sanitisation and token alignment against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quietlake.llm import lexical_search, queries, sanitisation, token_alignment

from .conftest import SF, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [(i, t) for i, t, *_ in odd_rows()]


def _given(sf=SF, table="documents"):
    return duckdb.sql(f"select {'item_id' if table == 'benchmark' else 'doc_id'}, text from '{sf}/{table}.parquet'").fetchall()


# lexical search


def _ranked(docs, items, k=20):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, collections.Counter(t), len(t)) for i, t in terms if t]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, counts, n in held:
            m = 75 + 25 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * counts[w] // (1000 * counts[w] + 12 * m)) for w in TERM.findall((text or "").translate(LOWER)) if w in counts)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 3, "postings": 5}])
def test_search_on_odd_rows(spark, odd, sizes):
    asked = [(1, "same text twice"), (2, None), (3, "..."), (4, "alpha alpha Beta x1 日本語"), (4, "dup id"), (None, "dup id other"), (5, "nowhere"), (6, "A K ſ é don t")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    got = lexical_search.lexical_search(odd, items, k=3, **sizes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _ranked(ODD, asked, 3)


def test_search_with_ties_and_common_terms(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 12)))) for i in range(400)] + [(1000 + i, "a b c d") for i in range(300)]
    asked = [(i, " ".join(rng.choices("abcdefghz", k=5))) for i in range(12)] + [(50, "a b c d")]
    got = lexical_search.lexical_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string"), postings=500)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _ranked(docs, asked)


def test_search_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "same text")], "item_id long, text string")
    assert lexical_search.lexical_search(empty, items).count() == 0
    assert lexical_search.lexical_search(odd, items.limit(0)).count() == 0


def test_search_stops_early():
    """The threshold ends a search before the lists do."""
    rng = random.Random(1)
    rows = [(i, 100, b"\0\0\0\0\1\0\0\0", (rng.randint(1, 3) if i > 20 else 60).to_bytes(4, "little") * 2) for i in range(20_000)]
    import numpy as np

    part = lexical_search.Run(rows, 20_000, 2_000_000)
    best, depth = part.search(np.array([0, 1]), np.array([7, 9]), [], 5)
    assert depth < 1000 and [i for _, i in best] == [0, 1, 2, 3, 4]


# token alignment


def _aligned(docs):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = []
    for i, text in docs:
        a = [(t, bytes(byte[c] for c in first.id_to_token(t))) for t in first.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(t, bytes([t - 3]) if second.is_byte(t) else second.id_to_piece(t).replace("▁", " ").encode()) for t in second.encode(text or "")]
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != raw for side in (a, b)):
            out.append((i, 0, 0, [], []))
            continue
        ends = [[sum(len(x) for _, x in side[: k + 1]) for k in range(len(side))] for side in (a, b)] if len(raw) < 3000 else [_running(side) for side in (a, b)]
        links, groups, x, y = [], [([], [])], 0, 0
        while x < len(a):
            links.append((a[x][0], b[y][0]))
            ga, gb = groups[-1]
            if not ga or ga[-1] != x:
                ga.append(x)
            if not gb or gb[-1] != y:
                gb.append(y)
            p, q = ends[0][x], ends[1][y]
            x, y = x + (p <= q), y + (q <= p)
            if p == q:
                groups.append(([], []))
        groups = [",".join(str(a[k][0]) for k in ga) + "|" + ",".join(str(b[k][0]) for k in gb) for ga, gb in groups[:-1]]
        out.append((i, len(a), len(b), groups, links))
    counts = collections.Counter(pair for *_, links in out for pair in links)
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return sorted(((i, a, b, len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), digest(g)) for i, a, b, g, ls in out), key=str)


def _running(side):
    at, out = 0, []
    for _, x in side:
        at += len(x)
        out.append(at)
    return out


def _models():
    return token_alignment.byte_level_model(public_tokenizers.path("byte_bpe_50k.json")), token_alignment.piece_model(public_tokenizers.path("piece_bpe_32k.model")), public_tokenizers.PATTERN


def test_alignment_of_given_texts(spark):
    got = queries.op13_token_alignment(spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _aligned(_given())


def test_alignment_of_odd_texts(spark, odd, empty):
    more = [(-1, "▁x y"), (-2, "  a\n\n  b c "), (-3, "<|endoftext|> </s> <unk> <0x41>"), (-4, "a\t b \x1c c  d e"), (-5, " "), (-6, "don't we'll 1234 56 x" * 300), (-7, "x  y"), (-8, "é ﬁ \U0001f600")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = token_alignment.token_alignment(spark, docs, *_models())
    assert sorted((tuple(r) for r in got.collect()), key=str) == _aligned(ODD + more)
    assert token_alignment.token_alignment(spark, empty, *_models()).count() == 0


def test_alignment_in_small_blocks_and_slices(spark, odd, monkeypatch):
    """Texts cut into slices, and blocks of a few segments, change nothing."""
    one = token_alignment._Block()
    monkeypatch.setattr(token_alignment, "SLICE", 7)
    two = token_alignment._Block()
    for i, t in ODD:
        token_alignment._Block.add(two, i, t or "")
    monkeypatch.undo()
    for i, t in ODD:
        one.add(i, t or "")
    spelt = lambda block: [[list(block.segments)[c] for c in codes] for codes in block.codes if len(codes) < 100]
    assert spelt(one) == spelt(two)


def test_alignment_refuses_other_models(tmp_path):
    with pytest.raises(ValueError, match="no plain byte-level"):
        token_alignment.byte_level_model(public_tokenizers.path("word_bpe_49k.json"))


def test_pair_counts_add_up(spark, odd):
    blocks = token_alignment.align_blocks(odd, *_models())
    links = token_alignment.document_rows(blocks, token_alignment.pair_counts(blocks), 2).agg({"n_links": "sum"}).first()[0]
    assert token_alignment.pair_counts(blocks).agg({"count": "sum"}).first()[0] == links


# sanitisation

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good[k](m[0])]


PERSONAL = "a@b.c@d.e x@@y.z é.ü@host-1.co.uk a@b a@b.c%d@e.f .@-.- 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 000255.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 +1 (743) 555-3824 +12345678 +1--2 +44 20 7946 0958+1 222 333 4444 5.5.5.5@h.io 1-2 3--4 "


def test_patterns():
    rng = random.Random(5)
    texts = [PERSONAL, "", "+", "@", "1" * 3000, "a" * 3000 + "@", "1." * 2000, "+1" + " " * 500] + ["".join(rng.choices("a1.5@+- (%é2", k=60)) for _ in range(4000)]
    for text in texts:
        assert sanitisation.base_spans(text) == _base(text), text


def test_patterns_of_given_texts(spark):
    want = {}
    for i, t in _given():
        spans = _base(t or "")
        text = ",".join(f"{sanitisation.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want[i] = ([sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(text.encode()).hexdigest(), text)
    got = queries.op12_sanitisation(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        counts, sha, text = want[r["doc_id"]]
        assert ([r[f"n_{k}"] for k in sanitisation.KINDS], r["base_sha256"]) == (counts, sha)
        assert r["spans"] == text or r["spans"].startswith(text + "," if text else "term:")


def _people(seed=2):
    """Texts of common words; one person's name stands by their address, and so does a rare word that another text has too."""
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(60)]
    words = lambda n: " ".join(rng.choices(common, k=n))
    docs = [words(30) for _ in range(300)]
    docs += [f"{words(5)} Zaphodia mail zaph.{k % 1}@example.org {words(5)}" for k in range(5)]
    docs += [f"{words(5)} Zaphodia went home {words(3)}", f"only {words(4)}"]
    docs += [f"{words(6)} w1stles +1 (743) 555-3824 {words(6)}" for _ in range(4)] + [f"w1stles {words(9)}" for _ in range(60)]
    docs += [f"copies Qwertonia b@c.de {words(0)}"] * 9
    return [(i, t) for i, t in enumerate(docs)] + [(None, None), (1, ""), (2, PERSONAL)]


def _revealing(docs, most, support):
    around, df = collections.defaultdict(list), collections.Counter()
    for _, t in docs:
        t = t or ""
        df.update({w.translate(LOWER) for w in TERM.findall(t)})
        for e, near in sanitisation.surroundings(t, _base(t)).items():
            around[e].append(frozenset(near))
    out = {}
    for e, sets in around.items():
        for w in set().union(*sets):
            have = [s for s in sets if w in s]
            if len(set(have)) >= support and len(sets) < len(docs):
                told = 1 - math.log(len(have) / df[w]) / math.log(len(sets) / len(docs))
                if told >= most:
                    out[w] = max(told, out.get(w, 0))
    return out


@pytest.mark.parametrize(("most", "support"), [(0.9, 3), (0.5, 2), (0.0, 1)])
def test_revealing_terms(spark, most, support):
    docs = _people()
    frame = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id long, text string, row string, term int, marks string").repartition(3)
    scan = sanitisation.Scan(frame, most=most, support=support)
    want = _revealing(docs, most, support)
    assert {r["term"]: round(r["disclosure"], 9) for r in scan.revealing.collect()} == {w: round(d, 9) for w, d in want.items()}
    if (most, support) == (0.9, 3):
        assert "zaphodia" in want and "w1stles" not in want and "qwertonia" not in want
    rows = scan.spans().collect()
    assert len(rows) == len(docs)
    texts = collections.Counter()
    for i, t in docs:
        t, base = t or "", _base(t or "")
        marks = [(m.start(), m.end()) for m in TERM.finditer(t) if m[0].translate(LOWER) in want and not any(a < m.end() and m.start() < b for _, a, b in base)]
        texts[i, ",".join([f"{sanitisation.KINDS[k]}:{a}:{b}" for k, a, b in base] + [f"term:{a}:{b}" for a, b in marks])] += 1
    assert texts == collections.Counter((r["doc_id"], r["spans"]) for r in sanitisation.digests(scan.spans()).collect())


def test_sanitised_texts(spark):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in _people()], "doc_id long, text string, row string, marks string").repartition(3)
    rows = sanitisation.Scan(frame).sanitised()
    assert rows.columns == ["doc_id", "text", "row", "marks"]
    texts = [r["text"] for r in rows.collect()]
    assert len(texts) == len(_people()) and texts.count(None) == 1
    assert not any(w in t.lower() for t in texts if t for w in ("zaphodia", "@example", "555-3824")) and any("[EMAIL]" in t for t in texts if t)


def test_terms_are_generalised(spark):
    rng = random.Random(4)
    docs = [f"cardiology w{rng.randint(0, 9)} clinic" for _ in range(80)] + [f"cardiomyopathia w{k} +1 (743) 555-38{k % 1}1 w{rng.randint(0, 9)}" for k in range(6)]
    scan = sanitisation.Scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert {r["term"]: r["general"] for r in scan.revealing.collect()}["cardiomyopathia"] == "cardio*"


def test_sanitisation_of_odd_rows(spark, odd, empty):
    got = sanitisation.digests(sanitisation.Scan(odd).spans()).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)
    scan = sanitisation.Scan(empty)
    assert scan.spans().count() == 0 and scan.sanitised().columns == empty.columns
