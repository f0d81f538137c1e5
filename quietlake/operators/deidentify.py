"""Column-wise de-identification of tables, and the safe views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import is_pii_column
from ..functions.pseudonyms import pseudo_id
from ..functions.text import strip

_YEAR = r"^(\d{4})[-/.]\d{1,2}[-/.]\d{1,2}"


def year_of(value: Column) -> Column:
    """The year at the start of a date's text, else the empty text."""
    return F.coalesce(F.regexp_extract(strip(value), _YEAR, 1), F.lit(""))


def safe_pseudo(value: Column, key: bytes) -> Column:
    """The pseudonym of a value as it is; blanks stay empty."""
    return F.when(strip(value) != "", pseudo_id(value, key)).otherwise("")


def plan_columns(names: list[str], pseudo=(), year=(), keep=(), drop=(), is_pii: Callable[[str], bool] = is_pii_column) -> list[tuple[str, str]]:
    """(column, action) in order; what is dropped by name is so whatever else names it."""

    def action(name: str) -> str:
        ranked = [("drop", drop), ("pseudo", pseudo), ("year", year), ("keep", keep)]
        asked = next((what for what, listed in ranked if name in listed), None)
        return asked or ("drop" if is_pii(name) else "keep")

    return [(name, action(name)) for name in names]


def safeify(df: DataFrame, key: bytes = b"", pseudo=(), year=(), keep=(), drop=(), is_pii: Callable[[str], bool] = is_pii_column) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The safe table, all text, and the plan; columns that aren't kept never reach the scan."""
    plan = plan_columns(df.columns, pseudo, year, keep, drop, is_pii)
    shapes = {"pseudo": ("_pseudo", lambda c: safe_pseudo(c, key)), "year": ("_year", year_of), "keep": ("", lambda c: c)}
    text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    return df.select(*(shapes[what][1](text(name)).alias(name + shapes[what][0]) for name, what in plan if what != "drop")), plan


def users_safe(users: DataFrame, key: bytes) -> DataFrame:
    """Users without direct identifiers: region block, birth year, days instead of times."""
    return users.select(
        pseudo_id(F.col("id"), key).alias("user_pseudo_id"),
        "app_version",
        "plan",
        F.substring(F.col("prefecture_code").cast("string"), 1, 1).alias("region_block"),
        F.year("birth_date").alias("birth_year"),
        F.to_date("created_at").alias("created_day"),
        F.to_date("last_login_at").alias("last_login_day"),
        "status",
    )


def tickets_safe(tickets: DataFrame, key: bytes) -> DataFrame:
    """Tickets without their texts."""
    return tickets.select(
        F.col("id").alias("ticket_id"),
        pseudo_id(F.col("user_id"), key).alias("user_pseudo_id"),
        "category",
        "product",
        "status",
        F.to_date("created_at").alias("created_day"),
        F.to_date("resolved_at").alias("resolved_day"),
    )


def events_weekly(events: DataFrame) -> DataFrame:
    """Events and users by week and type; no rows of persons."""
    week = F.to_date(F.date_trunc("week", "occurred_at")).alias("week")
    return events.groupBy(week, "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"))
