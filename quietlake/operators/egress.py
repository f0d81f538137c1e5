"""What may leave: no protected value in any form, no encoded blobs, no large results."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import is_pii_column
from ..functions.text import admitted, egress_forms, haystacks, odd
from ..storage import written
from .occurrence import occurring


def protected_forms(values: DataFrame, column: str = "value") -> DataFrame:
    """(form): the distinct forms of values that are long enough to tell something."""
    given = values.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    forms = given.select(F.explode(egress_forms(F.col("value"))).alias("form"))
    return forms.filter(admitted(F.col("form"))).distinct()


def taint(df: DataFrame, is_pii=is_pii_column) -> DataFrame:
    """(form): those of all values in columns that are personal data by name."""
    marked = [c for c in df.columns if is_pii(c)]
    if not marked:
        return df.sparkSession.createDataFrame([], "form string")
    values = df.select(F.explode(F.array(*(F.col(f"`{c}`").cast("string") for c in marked))).alias("value"))
    return protected_forms(values)


def contained(texts: DataFrame, forms: DataFrame, key: str, text: str, bits: int | None = None) -> DataFrame:
    """(key, hits): how many protected forms each text contains in any view; texts without any are left out.

    One pass over the texts, however many forms there are; see ``occurring``.
    """
    told = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("plain"), odd(F.col(text)).alias("odd"))
    views = told.select("key", F.when(F.col("odd").isNotNull(), F.array_distinct(haystacks(F.col("odd")))).alias("views"), F.when(F.col("odd").isNull(), F.col("plain")).alias("plain"))
    forms = written(forms.select("form").distinct(), "forms")
    return occurring(views, forms, bits).groupBy("key").agg(F.count(F.lit(1)).alias("hits"))


def text_hits(spark, text: str, forms: DataFrame) -> int:
    """How many protected forms one text contains; never which."""
    one = spark.createDataFrame([("result", text)], "key string, text string").select("key", haystacks(F.col("text")).alias("views"))
    views = one.select(F.explode("views").alias("view"))
    return forms.join(F.broadcast(views), F.contains("view", "form"), "left_semi").count()  # eight short texts


#: Rows of a table that an analysis may return; more never fit into an answer.
MOST_ROWS = 10_000


def plain(value, longest: int = 64, depth: int = 0):
    """A result as JSON data: rows become dicts, long texts are cut, what JSON lacks becomes null or a notice."""
    inner = lambda v: plain(v, longest, depth + 1)
    if depth > 6:
        return "[nested too deep]"
    if isinstance(value, DataFrame):
        rows = value.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"a table of more than {MOST_ROWS} rows is no result")
        return inner([r.asDict(recursive=True) for r in rows])
    if isinstance(value, pd.DataFrame):
        return inner(value.to_dict("records"))
    if isinstance(value, pd.Series):
        return inner(value.to_dict())
    if hasattr(value, "item") and getattr(value, "shape", None) == ():
        return inner(value.item())
    if isinstance(value, dict):
        return {str(k)[:longest]: inner(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [inner(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, bool | int):
        return value
    if isinstance(value, bytes | bytearray):
        return "[bytes withheld]"
    text = str(value)
    return text if len(text) <= longest else text[:longest] + "…"


#: Lists of a result that may be cut, in this order.
TRIMMED = ("rows", "sample", "files", "items", "result", "logs")


def _size(value) -> int:
    return len(json.dumps(value, ensure_ascii=False, default=str))


def cap_output(result: dict, most: int = 40_000) -> dict:
    """The result if it fits, else with its lists cut to the longest start that fits, else a notice."""
    if _size(result) <= most:
        return result
    out = result | {"truncated": True}
    for name in TRIMMED:
        if not isinstance(out.get(name), list):
            continue
        rows, room = out[name], most - _size(out | {name: [], f"{name}_dropped": len(out[name])})
        kept = 0
        for row in rows:
            room -= _size(row) + (2 if kept else 0)
            if room < 0:
                break
            kept += 1
        out |= {name: rows[:kept], f"{name}_dropped": len(rows) - kept}
        if _size(out) <= most:
            return out
    return {"ok": result.get("ok", True), "truncated": True, "note": f"nothing of this answer fits into {most} characters; ask for less"}
