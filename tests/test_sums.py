"""Sums of doubles in guarded SQL, which no order of rows may change."""

import math
import random

import pytest

from quietlake.engine import Engine
from quietlake.plans import pack


def _priced(spark, at, prices):
    """The rounded sum that the query finds over these prices, in this order and in one task."""
    rows = spark.createDataFrame([("A", "F", 1.0, p, 0.05) for p in prices], "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double")
    rows.coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    for name in pack.TABLES:
        if name != "lineitem":
            spark.createDataFrame([(1,)], "id bigint").write.parquet(f"{at}/{name}.parquet")
    return pack.queries()["sql_agg_pricing"](spark, str(at)).first()


def test_prices_are_summed_exactly(spark, tmp_path):  # F1
    row = _priced(spark, tmp_path, [1e14] + [0.005] * 1000 + [-1e14])
    assert (row["price"], row["quantity"], row["lines"], row["discount"]) == (5, 1002, 1002, 0.05)


def _guarded(spark, sql, rows):
    return Engine(spark, {"t": spark.createDataFrame(rows, "k int, x double").coalesce(1)}).guarded(sql)


@pytest.mark.parametrize("low, high", [(-3, 6), (-30, 13)])
def test_any_order_gives_the_true_sum(spark, low, high):
    random.seed(1)
    xs = [random.choice((-1, 1)) * 10 ** random.uniform(low, high) for _ in range(3000)]
    for some in (xs, sorted(xs)):
        row = _guarded(spark, "select sum(x) as s, avg(x) as a, sum(x) filter (where x > 0) as p from t", [(1, x) for x in some]).first()
        assert row["s"] == pytest.approx(math.fsum(xs), rel=1e-15) and row["a"] == pytest.approx(math.fsum(xs) / 3000, rel=1e-15)
        assert row["p"] == pytest.approx(math.fsum(x for x in xs if x > 0), rel=1e-15)


def test_odd_values_are_summed_as_before(spark):
    odd = [(1, 1.0), (1, math.nan), (2, math.inf), (2, 1.0), (3, math.inf), (3, -math.inf), (4, None), (5, 1e300), (5, -1e300), (6, None), (6, -0.5)]
    sql = "select k, sum(x) as s, avg(x) as a from t group by k having sum(x) is null or sum(x) > (select min(k) - 9 from t) order by k"
    got, plain = _guarded(spark, sql, odd), spark.createDataFrame(odd, "k int, x double").createOrReplaceTempView("plain") or spark.sql(sql.replace("from t", "from plain"))
    assert got.schema == plain.schema
    assert [str(tuple(r)) for r in got.collect()] == [str(tuple(r)) for r in plain.collect()]


def test_sums_inside_of_other_queries(spark):
    rows = [(1, 1e14), *[(1, 0.001)] * 1000, (1, -1e14)]
    inner = "select k, sum(x) as s from t group by k"
    assert _guarded(spark, f"with q as ({inner}) select a.s as s from q a join q b on a.k = b.k where a.s = (select max(s) from q)", rows).first()["s"] == 1.0
    assert _guarded(spark, "select k from t where k in (select cast(sum(x) as int) from t) and exists (select 1 from t having sum(x) = 1)", rows).count() == 1002
    assert _guarded(spark, "select sum(distinct x) as s, sum(k) as n from t", rows).first()["n"] == 1002
