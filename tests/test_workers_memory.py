"""What goes to Python workers: only texts that may need it, and in small parts."""

import random
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from quietlake.functions import pii_rules, text
from quietlake.operators import occurrence
from quietlake.plans import pack
from quietlake.storage import cut


def test_parts_are_small_and_whole():
    batch = pa.array(["x" * 3000] * 9000)
    parts = list(cut(iter([batch, pa.array([], pa.string()), pa.array(["y" * (3 << 20), None])])))
    assert pa.concat_arrays(parts[:-2]).equals(batch) and max(p.nbytes for p in parts[:-2]) <= 1 << 20
    assert [len(p) for p in parts[-2:]] == [1, 1] and parts[-1][0].as_py() is None


def test_addresses_send_only_texts_with_an_at_sign(spark):  # F4, F6
    plan = pack.email_hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RLIKE @|Contains\(", plan) and "RLIKE [@" not in plan, plan


def test_windows_are_looked_at_in_parts(spark, monkeypatch):  # F5
    sizes, real = [], occurrence.cut
    monkeypatch.setattr(occurrence, "cut", lambda b: (sizes.append(p.nbytes) or p for p in real(b)))

    class Shared:
        value = (*occurrence._filters(spark.createDataFrame([("form",)], "form string"), 1 << 15), [4])

    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(3000)]), pa.array([["a form " * 200]] * 3000)], names=["key", "views"])
    found = [r for b in occurrence._candidates(Shared)(iter([batch])) for r in b.to_pylist()]
    assert len(found) == 3000 and {r["form"] for r in found} == {"form"} and max(sizes) <= 1 << 20


def test_texts_that_stay_as_they_are_do_not_leave_spark(spark):  # F7
    rng = random.Random(7)
    chars = "aé ñÑßж中国かガー、。「」ｶﾞ①㍿ﬁ²½ ゙́ᅡᆨ각가㈱Å①🙂"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 9))) for _ in range(600)] + [None, "", "plain", "é", "が"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", "t", text.nfkc(F.col("t")).alias("n"), F.rlike("t", F.lit(text.UNSTABLE)).alias("odd")).collect()
    assert all(r["n"] == (None if r["t"] is None else unicodedata.normalize("NFKC", r["t"])) for r in rows)
    plain = spark.createDataFrame([("Señor ñandú, straße; 中国かガー、",)], "t string").select(F.rlike("t", F.lit(text.UNSTABLE))).first()[0]
    assert plain is False and sum(bool(r["odd"]) for r in rows) > 100


def test_ascii_is_told_first_and_no_character_is_missed(spark):  # F6
    assert text.UNSTABLE.startswith(r"[\x{80}-\x{10ffff}&&")
    points = [c for c in range(0x11000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, f"a{chr(c)}z") for c in points], "c int, t string").filter(~F.rlike("t", F.lit(text.UNSTABLE))).collect()
    assert {r["c"] for r in rows} >= set(range(0x80)) and all(unicodedata.normalize("NFKC", r["t"]) == r["t"] for r in rows)


def test_what_spark_looks_for_leaves_no_match_out(spark):
    parts = ["０9", "03", "-", "1234", "5678", " ", "〒", "105", "0011", "住所", "マイナンバー", "1990", "年", "1月2日", "昭和元", "生まれ", "/", ".", "x@corp.co.jp", "+81", "٣", "090", "東京都港区芝公園", "4丁目", "(", ")"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    want = [sorted((k, m.start(), m.end()) for k, p, test in pii_rules.rules() for m in p.finditer(t) if test(t, m)) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", pii_rules.find_spans(F.col("t")).alias("s")).orderBy("k").collect()
    assert sum(map(bool, want)) > 100 and [sorted((s["kind"], s["start"], s["end"]) for s in r["s"]) for r in got] == want


def test_a_dictionary_of_known_persons_is_built_once(spark):  # F8
    plan = pack.vault_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_composed(" not in plan and "replaced(" not in plan, plan
