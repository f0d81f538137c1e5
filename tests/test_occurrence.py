"""What the search for protected forms looks at, and that it finds what a plain search finds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietlake.functions import text
from quietlake.operators import occurrence
from quietlake.operators.egress import contained, protected_forms


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def sentences():
    """(forms, texts): sentences of many lengths, and texts that hold some of them."""
    rng = random.Random(4)
    forms = sorted({_words(rng, rng.randrange(1, 30)) for _ in range(2000)})
    forms = [f for f in forms if len(f) > 2]
    return forms, [" ".join([_words(rng, 200), *rng.sample(forms, 3), _words(rng, 200)]) for _ in range(200)]


def test_fingerprints_are_made_where_forms_may_begin_only(spark, sentences, monkeypatch):  # F2
    forms, texts = sentences
    made, real = [], occurrence.Rolling.at
    monkeypatch.setattr(occurrence.Rolling, "at", lambda self, places, lengths: (made.append(len(places)), real(self, places, lengths))[1])
    given = spark.createDataFrame([(f,) for f in forms], "form string")
    shared = type("Shared", (), {"value": occurrence._shared(given, 1 << 22, sorted({len(f) for f in forms}))})
    made.clear()
    found = {r for b in occurrence._candidates(shared)([pa.RecordBatch.from_pydict({"key": [str(i) for i in range(len(texts))], "views": [[t] for t in texts]})]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert sum(made) < sum(map(len, texts))
    assert found == {(str(i), f) for i, t in enumerate(texts) for f in forms if f in t}


def test_few_substrings_pass_that_are_no_forms(spark, sentences, monkeypatch):  # F2
    forms, texts = sentences
    passed, real = [], occurrence.written
    monkeypatch.setattr(occurrence, "written", lambda df, name: (passed.append(df.count()) if name == "passed" else None, real(df, name))[1])
    got = contained(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), spark.createDataFrame([(f,) for f in forms], "form string"), "k", "t")
    want = {str(i): n for i, t in enumerate(texts) if (n := sum(f in t or f in t.replace(" ", "") for f in forms))}
    assert {r["key"]: r["hits"] for r in got.collect()} == want and sum(passed) < 1.02 * sum(want.values())


def test_views_made_in_python_are_spark_s(spark):  # F2
    rng = random.Random(8)
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"A{chr(c)}b 1{chr(c)}2" for c in points]
    texts += ["".join(rng.choices("aZ09 \t\n\x1c\x85éÉİıßŁÑжЖがガ中、—ﬁΣ½ٰ٣🙂́", k=rng.randrange(0, 12))) for _ in range(3000)] + ["x" * 200_000 + "É\x85 7"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.odd(F.col("t")).alias("odd"), F.array_distinct(text.haystacks(F.col("t"))).alias("views")).collect()
    plain = [r for r in rows if r["odd"] is None]
    assert 22_000 < len(plain) < len(texts) - 30_000 and all(r["odd"] in (None, r["t"]) for r in rows)
    assert [r["t"] for r in plain if set(text.plain_views(r["t"])) != set(r["views"])] == []


def test_containment_in_plain_and_odd_texts(spark):
    values = spark.createDataFrame([("Straße 12",), ("ガラス窓",), ("0901 112 222",), ("ＦＵＬＬ width",), ("ὈΔΟΣ",)], "value string")
    forms = protected_forms(values)
    texts = ["in der STRASSE", "an der straße 12 da", "straße\n12", "がらす窓", "がら す窓です", "call 0901-112.222", "full width", "ｆｕｌｌ　ｗｉｄｔｈ", "ὀδος", "", None, "nothing", "Straße 12 と ガラス窓 0901112222"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    known = [r["form"] for r in forms.collect()]
    views = {r["k"]: r["v"] for r in frame.select("k", text.haystacks(F.col("t")).alias("v")).collect()}
    want = {str(k): n for k, v in views.items() if (n := sum(any(f in (x or "") for x in v) for f in known))}
    assert {"1", "2", "3", "5", "7", "12"} <= set(want) and {r["key"]: r["hits"] for r in contained(frame, forms, "k", "t").collect()} == want


def test_a_window_at_the_edge_of_a_look(monkeypatch):
    monkeypatch.setattr(occurrence, "BLOCK", 16)
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 99, 300).astype(np.uint32)
    for n in (1, 3, 8):
        gate = np.zeros(1 << occurrence.GATE_SLOTS, bool)
        gate[dict(occurrence._gate(codes[40 : 40 + n], {n}))[n]] = True
        want = [i for i in range(300 - n + 1) if (codes[i : i + n] == codes[40 : 40 + n]).all()]
        found = occurrence._known(codes, {1, 3, 8}, gate)
        assert found[n].tolist() == want and sorted(found) == [1, 3, 8]
    assert occurrence._known(codes[:2], {8}, gate)[8].tolist() == [] and occurrence._known(codes, set(), gate) == {}


@pytest.mark.parametrize("letters", ["ab", "aé日", "a\U0001f600\U0010ffff"])
def test_matches_are_kept_once_a_row(letters):
    rng = random.Random(5)
    given = "".join(rng.choices(letters, k=400))
    matches = [(at, n, at // 100) for at in range(380) for n in (1, 2, 3, 7, 8, 12)]
    places, lengths, rows = map(np.array, zip(*matches, strict=True))
    kept = [(given[a : a + n], r) for a, n, r in (matches[i] for i in occurrence._once(occurrence.Rolling(given).codes, places, lengths, rows))]
    assert set(kept) == {(given[a : a + n], r) for a, n, r in matches}
    short = [k for k in kept if len(k[0]) <= 2]
    assert len(short) == len(set(short))
