import hashlib
import hmac

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quietlake.config import Settings, is_count_column, is_pii_column
from quietlake.functions.pseudonyms import create_key, load_key, pseudo_id, register
from quietlake.operators.deidentify import safeify
from quietlake.operators.profile import profile, row_estimate
from quietlake.operators.suppress import suppress_small_cells
from quietlake.operators.synth import synth_rows


@pytest.mark.parametrize("name", ["name", "User Name", "氏名", "e-mail", "tel_1", "Birth Date", "user_id", "User-ID", "customer_no", "ip", "zip code"])
def test_pii_names(name):
    assert is_pii_column(name)


@pytest.mark.parametrize("name", ["plan", "amount", "status", "created_at", "category", "score"])
def test_other_names(name):
    assert not is_pii_column(name)


def test_count_names():
    assert all(map(is_count_column, ["n", "n_users", "count", "COUNT(1)", "件数", "total price", "events_x"]))
    assert not any(map(is_count_column, ["name", "avg_age", "counter", "account", "nation"]))


def test_suppression(spark):
    rows = [("a", 3, 3.0, True), ("b", 11, 1.0, False), ("c", 0, 2.0, True), ("d", 400, 3.0, True), ("e", 10, 5.0, None), ("f", None, None, None), ("g", -4, 1.0, True)]
    df = spark.createDataFrame(rows, "category string, n_users bigint, avg_age double, n_flag boolean")
    seen = Observation()
    got = suppress_small_cells(df, 11, seen).collect()
    assert [r["n_users"] for r in got] == [None, 11, 0, 400, None, None, -4]
    assert [r["avg_age"] for r in got] == [r[2] for r in rows]
    assert seen.get["suppressed_cells"] == 2
    twice = spark.sql("select 1 as n, 2 as n, 20 as x")
    assert list(suppress_small_cells(twice).first()) == [None, None, 20]


def test_pseudonyms(spark, tmp_path):
    key = load_key(create_key(tmp_path / "k" / "key"))
    want = hmac.new(key, b"12345", hashlib.sha256).hexdigest()[:16]
    row = spark.sql("select 12345 as i, '12345' as s").select(pseudo_id(F.col("i"), key), pseudo_id(F.col("s"), key), pseudo_id(F.col("s"), b"k" * 70)).first()
    assert row[0] == row[1] == want and row[2] == hmac.new(b"k" * 70, b"12345", hashlib.sha256).hexdigest()[:16]
    (tmp_path / "open").write_text("x")
    (tmp_path / "open").chmod(0o644)
    with pytest.raises(PermissionError):
        load_key(tmp_path / "open")
    with pytest.raises(FileNotFoundError):
        load_key(tmp_path / "none")


def test_safeify(spark):
    df = spark.createDataFrame([("1234", "佐藤", "a@b.jp", "1990-05-06", "pro", None), (" ", "x", "y", "unknown", "free", "n"), ("7", "z", "", "2001/1/2 rest", "", "m")], "user_id string, name string, mail string, birth_date string, plan string, memo string")
    safe, plan = safeify(df, b"k" * 64, pseudo=["user_id", "memo"], year=["birth_date"], drop=["memo"])
    assert safe.columns == ["user_id_pseudo", "birth_date_year", "plan"]
    assert dict(plan) == {"user_id": "pseudo", "name": "drop", "mail": "drop", "birth_date": "year", "plan": "keep", "memo": "drop"}
    assert [r["birth_date_year"] for r in safe.collect()] == ["1990", "", "2001"] and safe.collect()[1]["user_id_pseudo"] == ""
    assert "佐藤" not in str(safe.collect())


def test_profile(spark):
    df = spark.createDataFrame([("1", "2.5", "2024-01-02", "yes", "hello", "a@b.jp", "", "090-1234-5678"), ("-2", "3", "2024/1/3", "0", "", "c@d.com", " ", "03-1234-5678")], "a string, b string, c string, d string, e string, f string, g string, h string")
    got = {r["name"]: r for r in profile(df).collect()}
    assert [got[c]["type"] for c in "abcdefgh"] == ["int", "float", "date", "bool", "text", "text", "empty", "text"]
    assert got["f"]["why"] == "email-like values" and got["h"]["why"] == "phone-like values" and got["e"]["null_ratio"] == 0.5 and not got["a"]["pii"]
    assert row_estimate(199) == 199 and row_estimate(500) == ">=500"
    assert profile(df.limit(0)).count() == 8


def test_synth(spark):
    columns = [("user_pseudo_id", "string"), ("n_users", "bigint"), ("birth_year", "int"), ("mail", "string"), ("created_day", "date"), ("flag", "boolean"), ("amount", "double"), ("note", "string")]
    rows = synth_rows(spark, columns, 40).collect()
    assert rows == synth_rows(spark, columns, 40).collect() and all(11 <= r["n_users"] <= 400 and 1950 <= r["birth_year"] <= 2010 and r["mail"].endswith("example.com") and len(r["user_pseudo_id"]) == 16 for r in rows)


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('[limits]\nmax_rows = 7\n[pii_columns]\npatterns = ["foo"]\n[masking]\npatient_id_regex = "PT-[0-9]+"\n')
    s = Settings.load(tmp_path / "c.toml")
    assert (s.max_rows, s.small_cell, s.patient_id_regex) == (7, 11, "PT-[0-9]+") and s.is_pii("a foo") and not s.is_pii("name")
    assert Settings.load(tmp_path / "none.toml") == Settings()


def test_pseudonyms_in_sql(spark):
    """One value has one id, whatever its type and whatever stands beside it in the column."""
    register(spark, b"k" * 32)
    df = spark.createDataFrame([(12345, "12345", 1.5, "é"), (None, None, None, None), (7, "", -0.25, "a")], "i bigint, s string, d double, u string").withColumn("n", F.col("i").cast("decimal(12,2)"))
    df.createOrReplaceTempView("values_of_types")
    got = spark.sql("select pseudo_id(i) i, pseudo_id(s) s, pseudo_id(d) d, pseudo_id(u) u, pseudo_id(n) n from values_of_types").collect()
    want = df.select(*(pseudo_id(F.col(c), b"k" * 32).alias(c) for c in ("i", "s", "d", "u", "n"))).collect()
    assert got == want and got[0]["i"] == got[0]["s"] == hmac.new(b"k" * 32, b"12345", "sha256").hexdigest()[:16] and not any(got[1])
    assert "Python" not in spark.sql("select pseudo_id(i) from values_of_types")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="name"):
        register(spark, b"k", "x; drop")
