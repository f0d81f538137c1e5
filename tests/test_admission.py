import pytest

from quietlake.engine import Engine
from quietlake.operators.admission import admit, bare, text_reason

ALLOWED = ["select a, b from t", "select a from t where b = 'a--b' or b = '/* c */'", "select a * 2 as x, 2*a as y, count(*) over () as n from t", "select a from t u join (select a from t) v using (a)", "with u as (select a from t union select a from t) select a, count(*) from u group by a", "select a from (values (1)) v(a)", "SELECT count(*) FROM t", "with x as (select a from t) select a from x", "select t.comment, t.security from t -- all of it\n;", "/* why */ select a from t"]
REJECTED = [
    ("", "nothing"), ("  ;", "nothing"), ("select a from t; select b from t", "semicolon"), ("select ';' from t", "semicolon"), ("insert into t values (1)", "SELECT or WITH"), ("(select 1)", "SELECT or WITH"),
    ("select(1)", "SELECT or WITH"), ("values (1)", "VALUES"), ("explain select 1", "EXPLAIN"), ("table t", "TABLE"), ("select t.* from t", "named"), ("select comment from t", "COMMENT"), ("select pg_sleep(1)", "PG_SLEEP"),
    ("select a from t where 1=1 union select set_config('a','b',true)", "SET_CONFIG"), ("select a from pg_catalog.x", "PG_CATALOG"), ("select $$a$$", "dollar"), ("with x as (delete from t) select 1", "DELETE"),
    ("select a from t\0", "zero character"), ("select 2.*x from t", "named"), ("select a from t\0; x", "semicolon"), ("drop table t where ';'", "semicolon"), ("select $$ from t where drop", "DROP"),
]
#: Columns that the statement doesn't name, in the plan as Spark's parser sees it.
UNNAMED = [
    "select * from t", "select distinct * from t", "select a, * from t", "select count(t.*) from t", "select struct(*) from t", "select to_json(struct(*)) from t", "select explode(array(*)) from t", "select * except (b) from t",
    "select a from (select * from t) u", "select a from t where exists (select * from t)", "select a from t where (select * from t) is null", "select a from t where a in (table t)", "select (select struct(*) from t) as s from t",
    "with x as (select a from t) table t", "with x as (select a from t) from t", "select a,b,c from t union all table t", "with x as (table t) select a from x", "with x as (from t) select a from x", "select a from t, lateral (table t) u",
    "select a from t intersect table t", "with x as (select a from t) (table t)", "with x as (select a from t) from t |> where a > 1", "select a from (select a, b, c from t union all table t) u", "with x as (select a from t) select a from x except from t",
    "with x as (select a from t) values (1)", "select a from t |> extend 1 as one", "select max(a) over (partition by (select * from t)) from t", "with x as (with y as (select * from t) select a from y) select a from x",
]
ESCAPES = [
    "select count(1) from parquet.`/etc/x`", "select reflect('java.lang.System','getProperty','user.home')", "select java_method('java.lang.System','getenv')", "select transform(a) using 'cat' as (b string) from t",
    "select struct(*) from t", "select identifier('a') from t", "select a from other", "select a from t where exists (select 1 from other)", "select /* /* */ a from t */ 1", "select a from t where (", "select a from default.t",
    "with t2 as (select a from other) select a from t2", "select system.builtin.reflect('java.lang.System','getProperty','user.home') from t", "select `java_method` ('java.lang.System','getenv') from t",
    "select a from other where ', other as (' = a", "select a from other where r'\\' || ', other as (' = a", "select uuid() from t", "select to_avro(a) from t",
]


SCOPED = [
    "select a from hidden_rows", "select a from t where 'x' in (with hidden_rows as (select a from t) select a from hidden_rows) union all select a from hidden_rows",
    "select a from hidden_rows where 'x' in (with hidden_rows as (select b from t) select b from hidden_rows)",
    "with u as (with hidden_rows as (select a from t) select a from hidden_rows) select h.a from hidden_rows h join u on u.a = h.a",
    "with u as (select a from hidden_rows), hidden_rows as (select a from t) select a from u",
    "with recursive r(n) as (select 1 union all select n + 1 from r where n < 3) select a from hidden_rows where a in (select n from r)",
    "select (with hidden_rows as (select a from t) select max(a) from hidden_rows) as m, (select max(a) from hidden_rows) as n from t",
    "select a from t where exists (select 1 from hidden_rows h where h.a = t.a)", "select a from spark_catalog.default.hidden_rows", "select a from global_temp.hidden_view",
]


def test_only_views_are_read_whatever_names_a_scope_has(spark):
    spark.sql("create table if not exists hidden_rows using parquet as select 1 as a, 'x' as b")
    spark.range(1).selectExpr("1 as a").createOrReplaceGlobalTempView("hidden_view")
    try:
        engine = Engine(spark, {"t": spark.createDataFrame([(1, "x")], "a int, b string")})
        for sql in SCOPED:
            assert not engine.sql_run(sql)["ok"], sql
            with pytest.raises(ValueError):
                engine.guarded(sql)
        for sql in ("with u as (select a from t) select a from u", "with recursive r(n) as (select 1 union all select n + 1 from r where n < 3) select n from r", "select a * 2 as x, 2*a as y from t where a in (select a from t)", "with t as (select a + 1 as a from t) select a from t", "select 1 as one"):
            assert engine.sql_run(sql)["ok"], sql
    finally:
        spark.sql("drop table hidden_rows")
        spark.catalog.dropGlobalTempView("hidden_view")


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    assert text_reason(sql, spark) is None


def test_columns_have_to_be_named(spark):
    engine = Engine(spark, {"t": spark.createDataFrame([(1, "x", 2)], "a int, b string, c int")})
    for sql in UNNAMED:
        assert "named" in (text_reason(sql, spark) or ""), sql
        assert not engine.sql_run(sql)["ok"], sql


def test_comments_and_literals(spark):
    assert bare("select '--x', \"/* y\" -- z; from\n from t /* ; */ ;") == "select '--x', \"/* y\"  \n from t"
    engine = Engine(spark, {"t": spark.createDataFrame([(1, "a--b")], "a int, b string")})
    assert engine.sql_run("select a from t where b = 'a--b' -- or not")["rows"] == [[1]]
    assert not engine.sql_run("select a from t where b = ' /* ' or b = */")["ok"]


@pytest.mark.parametrize("sql,why", REJECTED)
def test_rejected(sql, why):
    assert why.lower() in (text_reason(sql) or "").lower(), text_reason(sql)


@pytest.mark.parametrize("sql", ESCAPES)
def test_ways_out_of_spark_sql(spark, sql):
    assert admit(spark, sql, {"t"}) is not None


def test_admitted_queries_run(spark):
    t = spark.createDataFrame([(1, "x", 3), (2, "y", 30)], "a int, b string, n_users int")
    engine = Engine(spark, {"t": t})
    out = engine.sql_run("with s as (select b, sum(n_users) as n_users from t group by b) select b, n_users from s order by b")
    assert out["ok"] and out["rows"] == [["x", None], ["y", 30]] and out["suppressed_cells"] == 1 and not out["more_rows"]
    assert engine.sql_run("select a from t", max_rows=1)["more_rows"]
    assert "named" in engine.sql_run("select * from t")["error"]
    assert "secret" not in str(engine.sql_run("select cast('secret' as int) as x from t"))
    assert engine.schema_describe()["views"][0]["columns"][0] == {"name": "a", "type": "int"}
    assert not engine.schema_describe("nope")["ok"]
