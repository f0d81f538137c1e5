"""Masking as keyed state: tokens last, no two values share one, a batch that breaks off is run again."""

import re

import pytest

from quietlake.operators.masking import unmask
from quietlake.streaming import keyed

KEY = b"k" * 32


def _add(spark, source, rows):
    spark.createDataFrame(rows, "k string, t string").coalesce(1).write.mode("append").parquet(source)


def _run(spark, source, where, **options):
    stream = spark.readStream.schema("k string, t string").parquet(source)
    keyed.mask_keyed_stream(stream, "k", "t", f"{where}/out", f"{where}/vault", f"{where}/mark", KEY, buckets=8, **options).awaitTermination()
    return {r["key"]: r["text"] for r in spark.read.parquet(f"{where}/out").collect()}


def test_tokens_last_and_are_never_shared(spark, tmp_path):
    source, where = str(tmp_path / "s"), str(tmp_path)
    first = [(f"a{i}", f"to u{i % 40}@b.co.jp, 03-1234-{i % 9000:04d} x") for i in range(120)] + [("e", ""), ("n", None), ("p", "nothing"), ("q", "u1@b.co.jp")]
    _add(spark, source, first)
    one = _run(spark, source, where)
    second = [(f"b{i}", f"again u{i}@b.co.jp u{i % 7}@b.co.jp") for i in range(60)]
    _add(spark, source, second)
    both = _run(spark, source, where)
    assert {k: both[k] for k in one} == one and len(both) == len(first) + len(second)
    assert both["e"] == "" and both["n"] is None and both["p"] == "nothing" and re.fullmatch(r"\[EMAIL_\d+\]", both["q"])
    vault = keyed.keyed_vault(spark, f"{where}/vault")
    rows = vault.collect()
    assert len({r["token"] for r in rows}) == len({r["mac"] for r in rows}) == len(rows) == 60 + 120
    masked = spark.createDataFrame(list(both.items()), "key string, text string")
    back = {r["key"]: r["text"] for r in unmask(masked, "key", "text", vault, KEY).collect()}
    assert back == dict(first + second)
    assert not any("@" in (t or "") for t in both.values())


def test_a_batch_that_breaks_off_is_run_again(spark, tmp_path, monkeypatch):
    source, where = str(tmp_path / "s"), str(tmp_path)
    _add(spark, source, [("a", "u1@b.co.jp u2@b.co.jp")])
    one = _run(spark, source, where)
    _add(spark, source, [("b", "u2@b.co.jp u3@b.co.jp"), ("c", "u3@b.co.jp u4@b.co.jp")])
    real = keyed.written

    def broken(df, name):
        real(df, name)
        raise RuntimeError("after the state has changed, before anything is kept")

    monkeypatch.setattr(keyed, "written", broken)
    with pytest.raises(Exception):  # noqa: B017
        _run(spark, source, where)
    monkeypatch.undo()
    both = _run(spark, source, where)
    assert both["a"] == one["a"] and both["b"].split()[0] == one["a"].split()[1] and both["b"].split()[1] == both["c"].split()[0]
    rows = keyed.keyed_vault(spark, f"{where}/vault").collect()
    assert len(rows) == len({r["token"] for r in rows}) == 4
    assert all(b"b.co.jp" not in bytes(r["value_enc"]) for r in rows)
