"""Sums and averages of doubles that are the same in whatever order rows come.

A running sum of doubles rounds at every row, so at some ten million rows its units depend on how the
table is split. Here every value is taken apart into whole numbers, whose sums are exact, and
the whole is rounded at its end. Values of 2 to the 48 or more, NaN, the infinities, and what values
have below 2 to the -48, are summed as they come.

Windows and DISTINCT keep Spark's own sums, as do aggregates inside of the views themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

#: Bits of a value before the point, and after it, that are summed exactly; a half of them is a number, so 2 to the 39 rows have room in a long.
BITS = 48
_HALF = BITS // 2


def _total(number: Column) -> Column:
    """The sum of longs of BITS bits, as a decimal."""
    high, low = F.sum(F.shiftright(number, _HALF)), F.sum(number.bitwiseAND(F.lit((1 << _HALF) - 1)))
    return high.cast("decimal(19,0)") * F.lit(1 << _HALF).cast("decimal(8,0)") + low.cast("decimal(19,0)")


def exact_sum(value: Column) -> Column:
    """The sum of a column of doubles, rounded once; null where no row has a value."""
    unit, near = float(1 << BITS), F.abs(value) < float(1 << BITS)
    held = F.when(near, value).otherwise(0.0)
    whole = held.cast("bigint")
    part = (held - whole.cast("double")) * unit
    units = part.cast("bigint")
    rest = F.sum(F.when(near, (part - units.cast("double")) / unit).otherwise(value))
    fraction = _total(units)
    over = fraction % F.lit(1 << BITS).cast("decimal(15,0)")
    return _total(whole).cast("double") + (fraction - over).cast("double") / unit + over.cast("double") / unit + rest


def exact_avg(value: Column) -> Column:
    n = F.count(value)
    return F.when(n > 0, exact_sum(value) / n)


_EXACT = {"Sum": exact_sum, "Average": exact_avg}
#: Expressions that hold a query of their own.
_QUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


def _single(package, name: str):
    """A Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


class _Rewriter:
    """Walks an analysed plan from the driver; what has nothing to replace stays the same object."""

    def __init__(self, spark):
        self.jvm = spark._jvm
        classic = self.jvm.org.apache.spark.sql.classic
        self.column, self.converter = classic.ExpressionUtils.column, _single(classic, "ColumnNodeToExpressionConverter")

    def _all(self, nodes, change):
        """(nodes, whether any has changed), as a Scala sequence."""
        given = [nodes.apply(i) for i in range(nodes.size())]
        made = [change(x) for x in given]
        changed = any(a is not b for a, b in zip(given, made, strict=True))
        return (self.jvm.PythonUtils.toSeq(made) if changed else nodes), changed

    def expression(self, e):
        kind = e.getClass().getSimpleName()
        if kind == "AggregateExpression":
            return self._aggregate(e)
        if kind == "WindowExpression":
            return e
        children, changed = self._all(e.children(), self.expression)
        if changed:
            e = e.withNewChildren(children)
        if kind in _QUERIES:
            plan = self.plan(inner := e.plan())
            return e if plan is inner else e.withNewPlan(plan)
        return e

    def _aggregate(self, e):
        exact = _EXACT.get(e.aggregateFunction().getClass().getSimpleName())
        if exact is None or e.isDistinct():
            return e
        value = e.aggregateFunction().children().apply(0)
        if value.dataType().typeName() not in ("double", "float"):
            return e
        column = ClassicColumn(self.column(value)).cast("double")
        if e.filter().isDefined():
            column = F.when(ClassicColumn(self.column(e.filter().get())), column)
        return self.converter.apply(exact(column)._jc.node())

    def plan(self, p):
        kind = p.getClass().getSimpleName()
        if kind == "View":
            return p
        children, changed = self._all(p.children(), self.plan)
        if changed:
            p = p.withNewChildren(children)
        if kind == "Aggregate":
            made, changed = self._all(p.aggregateExpressions(), self.expression)
            return p.copy(p.groupingExpressions(), made, p.child(), p.hint()) if changed else p
        if kind == "Project":
            made, changed = self._all(p.projectList(), self.expression)
            return p.copy(made, p.child()) if changed else p
        if kind == "Filter":
            made = self.expression(p.condition())
            return p if made is p.condition() else p.copy(made, p.child())
        return p


def with_exact_sums(df: DataFrame) -> DataFrame:
    """The same query, its sums and averages of doubles exact."""
    analysed = df._jdf.queryExecution().analyzed()
    made = (rewriter := _Rewriter(df.sparkSession)).plan(analysed)
    if made is analysed:
        return df
    return DataFrame(_single(rewriter.jvm.org.apache.spark.sql.classic, "Dataset").ofRows(df.sparkSession._jsparkSession, made), df.sparkSession)
