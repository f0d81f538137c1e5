"""The vault on disk: its layout, joins without shuffling it, batches that run again, gathering."""

import pytest
from pyspark.sql import functions as F

from quietlake.operators.masking import mask, unmask
from quietlake.sources.vault import GATHERED, LOOSE, Vault
from quietlake.streaming import incremental

KEY = b"k" * 32


def _rows(spark, first, n, mark=""):
    return spark.range(first, first + n).select(F.sha2(F.col("id").cast("string"), 256).alias("mac"), F.concat(F.lit(f"[X_{mark}"), "id", F.lit("]")).alias("token"), F.lit("X").alias("kind"), F.lit(b"e").alias("value_enc"), F.col("id").alias("ord"))


@pytest.fixture()
def vault(spark, tmp_path):
    return Vault(spark, str(tmp_path / "it's a vault"), 4)


def test_joins_leave_the_vault_where_it_is(spark, vault, monkeypatch):
    vault.append(_rows(spark, 0, 300), 0)
    vault.append(_rows(spark, 300, 300), 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(590, 610).select(F.sha2(F.col("id").cast("string"), 256).alias("mac"))
        for how, n in (("inner", 10), ("left_anti", 10)):
            joined = asked.join(vault.rows().select("mac", "token") if how == "inner" else vault.rows().select("mac"), "mac", how)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert joined.count() == n
            assert sum("Exchange" in line for line in plan.split("\n")) == 1, plan  # the asked values only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_that_run_again_replace_their_rows(spark, vault):
    vault.append(_rows(spark, 0, 10), 0)
    vault.append(_rows(spark, 10, 5, "wrong"), 1)
    vault.append(_rows(spark, 10, 8), 1)
    vault.append(_rows(spark, 100, 1))
    vault.append(_rows(spark, 101, 1))
    assert vault.batches() == [LOOSE, 0, 1]
    got = {r["token"] for r in vault.rows().collect()}
    assert got == {f"[X_{i}]" for i in [*range(18), 100, 101]}
    assert vault.rows(1).count() == 12 and vault.rows(0).count() == 2


def test_gathered_batches_keep_all_rows(spark, vault, tmp_path):
    for b in range(5):
        vault.append(_rows(spark, b * 10, 10), b)
    vault.append(_rows(spark, 3, 2, "later"), 4)
    want = sorted(map(str, vault.rows().collect()))
    vault.compact(4)
    assert vault.batches() == [GATHERED, 4] and sorted(map(str, vault.rows().collect())) == want
    vault.append(_rows(spark, 50, 10), 5)
    vault.compact(6)
    vault.compact(6)
    again = Vault(spark, str(tmp_path / "it's a vault"), 99)  # the folder says how many buckets there are
    assert again.buckets == 4 and again.batches() == [GATHERED - 1] and again.rows().count() == len(want) + 10
    assert {r["token"] for r in again.rows().filter("ord in (3, 4)").collect()} == {"[X_3]", "[X_4]"}


def test_an_empty_vault(spark, vault):
    assert vault.rows().count() == 0 and vault.batches() == []
    vault.append(_rows(spark, 0, 0), 0)
    vault.compact(9)
    assert vault.rows().count() == 0
    texts = spark.createDataFrame([(1, "a@b.co.jp")], "k int, t string")
    masked, new = mask(texts, "k", "t", vault=vault.rows(), key=KEY)
    assert masked.first()["text"] == "[EMAIL_1]" and new.count() == 1


def test_tokens_keep_their_meaning_over_gathered_batches(spark, tmp_path):
    source, out, vault, mark = (str(tmp_path / n) for n in ("s", "o", "v", "c"))
    for i in range(4):
        spark.createDataFrame([(i, f"u{i}@b.co.jp u{i // 2}@b.co.jp u0@b.co.jp")], "k int, t string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, t string").parquet(source)
        incremental.mask_stream(stream, "k", "t", out, vault, mark, KEY, gather=2).awaitTermination()
    held = Vault(spark, vault)
    assert len(held.batches()) == 2 and held.rows().count() == 4
    masked = spark.read.parquet(out)
    assert {r["key"]: r["text"] for r in masked.collect()} == {0: "[EMAIL_1] [EMAIL_1] [EMAIL_1]", 1: "[EMAIL_2] [EMAIL_1] [EMAIL_1]", 2: "[EMAIL_3] [EMAIL_2] [EMAIL_1]", 3: "[EMAIL_4] [EMAIL_2] [EMAIL_1]"}
    assert {r["text"].split()[0] for r in unmask(masked, "key", "text", held.rows(), KEY).collect()} == {f"u{i}@b.co.jp" for i in range(4)}
