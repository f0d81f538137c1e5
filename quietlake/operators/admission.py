"""Which SQL texts may run: rules on the text first, then on the relations and functions that Spark's parser finds in it."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Words that never stand alone in an admitted statement; a word after a point is a column.
FORBIDDEN = [
    "insert", "update", "delete", "merge", "drop", "alter", "create", "grant", "revoke", "truncate", "call", "do",
    "execute", "lock", "vacuum", "analyze", "listen", "notify", "copy", "set", "reset", "show", "begin", "commit",
    "rollback", "savepoint", "prepare", "deallocate", "discard", "refresh", "cluster", "reindex", "comment", "security",
    "current_setting", "pg_settings", "pg_read_file", "pg_read_binary_file", "pg_ls_dir", "pg_stat_file", "dblink",
    "pg_sleep", "lo_import", "lo_export", "lo_get", "pg_catalog", "information_schema", "search_path", "pg_shadow",
    "pg_authid", "pg_user", "pg_roles", "set_config", "pg_terminate_backend", "pg_cancel_backend", "pg_reload_conf",
    "pg_file_write", "pg_logdir_ls", "pg_stat_activity",
]
#: Groups of Spark's functions that only compute on their arguments; what stands outside of them isn't called.
FUNCTION_GROUPS = [
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs",
    "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs",
]
#: Spark's own ways out of a query, whether or not they are written as calls.
ESCAPES = ["reflect", "java_method", "try_reflect", "transform", "identifier", "read_files", "input_file_name", "raise_error", "current_database", "current_catalog", "current_user", "session_user", "version"]
_ESCAPES = re.compile(rf"(?<![\w.])(?:{'|'.join(ESCAPES)})(?!\w)", re.IGNORECASE)
#: Leaves of an analysed plan that hold no table: constants, generated rows, and references to a query's own subqueries.
OWN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
#: Nodes of a parsed plan that name columns, and those whose branches each have to.
NAMING, BRANCHING = {"Project", "Aggregate"}, {"Union", "Except", "Intersect"}
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""
_COMMENT = re.compile(rf"(?s)({_QUOTED})|--[^\n]*|/\*.*?\*/")


def bare(sql: str) -> str:
    """The statement without comments, ends and outer blanks; what looks like a comment inside of quotes stays."""
    return _COMMENT.sub(lambda m: m[1] or " ", sql).strip().rstrip(";").strip()


class Statement:
    """A text as the rules see it: its words, its first word, and its tree, if Spark can parse it."""

    def __init__(self, sql: str, spark: SparkSession | None = None):
        self.text, self.spark = bare(sql), spark
        self.head = self.text.split(maxsplit=1)[0].upper() if self.text else ""

    @functools.cached_property
    def tree(self):
        try:
            return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(self.text) if self.spark else None
        except Exception:  # noqa: BLE001  said so by a later rule
            return None

    def forbidden(self) -> str | None:
        """The first word that is on the list; words count wherever they stand, inside of literals too."""
        words = re.finditer(r"(?<![\w.])\w+", self.text)
        return next((w for m in words if (w := m[0].lower()) in FORBIDDEN), None)

    def unnamed(self) -> bool:
        """Whether columns go out that the statement doesn't name: by a star anywhere in its tree, or by a relation that no SELECT stands above."""
        return bool(re.search(r"\w\.\*", self.text)) or self.tree is not None and _unnamed(self.tree, False)


#: (what is wrong, how it is said), in the order in which the first one counts.
TEXT_RULES: list[tuple[Callable[[Statement], object], str]] = [
    (lambda s: not s.text, "there is nothing to run"),
    (lambda s: ";" in s.text, "a semicolon within the statement; send one query at a time"),
    (lambda s: "\0" in s.text, "a zero character within the statement"),
    (lambda s: s.head not in ("SELECT", "WITH", "VALUES", "TABLE", "EXPLAIN"), "a query begins with SELECT or WITH, this one with {s.head}"),
    (lambda s: s.head not in ("SELECT", "WITH"), "{s.head} shows more than named columns; write a SELECT"),
    (lambda s: s.forbidden(), "this word can't be used: {upper}"),
    (lambda s: s.unnamed(), "every column has to be named: no star, and no TABLE or FROM without a SELECT"),
    (lambda s: "$$" in s.text or "$body$" in s.text.lower(), "text between dollar signs can't be read"),
]


def text_reason(sql: str, spark: SparkSession | None = None) -> str | None:
    """Why the statement is rejected as it is written, or None; stars are looked for in Spark's tree, so only with a session."""
    statement = Statement(sql, spark)
    for broken, said in TEXT_RULES:
        if found := broken(statement):
            return said.format(s=statement, upper=str(found).upper())
    return None


def _named(node) -> str:
    return node.getClass().getSimpleName()


def _stars(expression) -> bool:
    """Whether an expression, or a query inside of it, holds a star or a relation without a SELECT."""
    if _named(expression).startswith(("UnresolvedStar", "UnresolvedRegex", "ResolvedStar")):
        return True
    if _is_query(expression) and _unnamed(expression.plan(), False):
        return True
    return any(_stars(e) for e in _each(expression.children()))


def _is_query(expression) -> bool:
    return any(m.getName() == "plan" and m.getParameterCount() == 0 for m in expression.getClass().getMethods())


def _unnamed(plan, named: bool) -> bool:
    """Whether a parsed plan has a star, or reaches a relation outside of what names columns."""
    kind = _named(plan)
    if any(_stars(e) for e in _each(plan.expressions())):
        return True
    if kind == "UnresolvedWith" and any(_unnamed(r._2(), False) for r in _each(plan.cteRelations())):
        return True
    children = list(_each(plan.children()))
    if not children:
        return not named and kind != "OneRowRelation"
    return any(_unnamed(c, kind in NAMING or named and kind not in BRANCHING) for c in children)


def _without_literals(text: str) -> str:
    return re.sub(r"""(?s)'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\"""", "''", text)


@functools.cache
def _closed_functions(jvm) -> frozenset[str]:
    """Names of built-in functions outside of FUNCTION_GROUPS."""
    infos = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.listBuiltinFunctionInfos()
    return frozenset(i.getName().lower() for i in infos if i.getGroup() and i.getGroup() not in FUNCTION_GROUPS)


def spark_reason(spark: SparkSession, sql: str, views: set[str]) -> str | None:
    """Why Spark's parsed plan is rejected: other relations than the safe views, ways out of SQL, or commands."""
    text = bare(sql)
    plain = _without_literals(text)
    if "/*" in plain or "*/" in plain:
        return "unbalanced comment"
    if re.search(r"""(?i)(?<!\w)r['"]""", text):
        return "raw strings are not allowed"
    if found := _ESCAPES.search(text):
        return f"function is not allowed: {found[0].lower()}"
    try:
        closed = _closed_functions(spark._jvm)
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    except Exception:  # noqa: BLE001  whatever can't be parsed isn't admitted
        return "statement can't be parsed"
    if called := {c.lower() for c in re.findall(r"(\w+)`?\s*\(", plain)} & closed:
        return f"function is not allowed: {min(called)}"
    if re.search(r"(?m)^[\s:+'!-]*\w*(?:Command|ScriptTransformation|InsertInto|CreateTable|SetCatalog)\w*\b", plan):
        return "statement is not a query"
    return plan_reason(spark, text, views)


def plan_reason(spark: SparkSession, text: str, views: set[str]) -> str | None:
    """Why the analysed plan is rejected: a leaf outside of the safe views, which Spark itself has resolved by scope."""
    try:
        state = spark._jsparkSession.sessionState()
        foreign = _foreign(state.analyzer().execute(state.sqlParser().parsePlan(text)), views)
    except Exception as e:  # noqa: BLE001  whatever can't be analysed isn't admitted
        return f"statement can't be analysed: {error_class(e)}"
    return "only the safe views can be read" if foreign else None


def _each(scala_seq):
    return (scala_seq.apply(i) for i in range(scala_seq.size()))


def _foreign(plan, views: set[str]) -> bool:
    """Whether a plan, or a subquery in it, reads anything but the session's views of these names."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        name = plan.desc().identifier()
        return not (plan.isTempView() and name.database().isEmpty() and name.table().lower() in views)
    children = plan.children()
    if not children.size() and kind not in OWN_LEAVES:
        return True
    return any(_foreign(p, views) for p in [*_each(children), *_each(plan.subqueries())])


def admit(spark: SparkSession, sql: str, views: set[str]) -> str | None:
    return text_reason(sql, spark) or spark_reason(spark, sql, views)


def sandbox(spark: SparkSession, views: dict[str, DataFrame]) -> SparkSession:
    """A session of its own with the safe views only, in which paths aren't relations."""
    inner = spark.newSession()
    inner.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in views.items():
        # a view belongs to its session, so the plan is handed over as it is
        DataFrame(df._jdf, inner).createOrReplaceTempView(name) if df.sparkSession is inner else _hand_over(inner, name, df)
    return inner


def _hand_over(inner: SparkSession, name: str, df: DataFrame) -> None:
    jvm = inner._jvm
    copied = getattr(getattr(jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$").ofRows(inner._jsparkSession, df._jdf.queryExecution().analyzed())
    copied.createOrReplaceTempView(name)


def error_class(error: Exception) -> str:
    """An error's class and no more: messages may quote values."""
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return f"{type(error).__name__}{f' [{condition}]' if condition else ''}"
