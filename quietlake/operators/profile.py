"""What a table's columns look like, without a value of theirs: type, signs of personal data, share of blanks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import is_pii_column
from ..functions.text import strip

# The forms of values, and of those that are personal data.
INT = r"^[+-]?\d+$"
FLOAT = r"^(?i)[+-]?\d*\.\d+(e[+-]?\d+)?$"
DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"
BOOLS = ["true", "false", "0", "1", "yes", "no"]
EMAIL_LIKE = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE_LIKE = r"(?:\+81|0)\d{1,4}[-\s()]?\d{1,4}[-\s()]?\d{3,4}"


def _all(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(True))


def column_profile(value: Column, name: str, is_pii: Callable[[str], bool] = is_pii_column) -> Column:
    """One struct per column, from aggregates of all its rows."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    given = F.when(strip(text) != "", strip(text))
    whole, number = F.rlike(given, F.lit(INT)), F.rlike(given, F.lit(INT)) | F.rlike(given, F.lit(FLOAT))
    kind = (
        F.when(F.count(given) == 0, "empty")
        .when(_all(whole), "int")
        .when(_all(number), "float")
        .when(_all(F.rlike(given, F.lit(DATE))), "date")
        .when(_all(F.lower(given).isin(BOOLS)), "bool")
        .otherwise("text")
    )
    filled = F.count(F.when(text != "", 1))
    needed = F.greatest(F.lit(1), F.floor(filled / 2))
    like = lambda pattern: (filled > 0) & (F.sum(F.rlike(text, F.lit(pattern)).cast("int")) >= needed)
    why = F.lit("column name") if is_pii(name) else F.when(like(EMAIL_LIKE), "email-like values").when(like(PHONE_LIKE), "phone-like values")
    blanks = F.round(F.sum((strip(text) == "").cast("int")) / F.greatest(F.lit(1), F.count(F.lit(1))), 2)
    return F.struct(F.lit(name).alias("name"), kind.alias("type"), why.isNotNull().alias("pii"), why.cast("string").alias("why"), F.coalesce(blanks, F.lit(0.0)).alias("null_ratio"))


def profile(df: DataFrame, is_pii: Callable[[str], bool] = is_pii_column) -> DataFrame:
    """(name, type, pii, why, null_ratio) per column, in one pass over all rows."""
    columns = F.array(*(column_profile(F.col(f"`{c}`"), c, is_pii) for c in df.columns))
    return df.agg(columns.alias("columns")).select(F.inline("columns"))


def row_estimate(n: int, sample: int = 200) -> int | str:
    """The number of rows below the sample's size, else a lower bound as text."""
    return n if n < sample else f">={n}"
