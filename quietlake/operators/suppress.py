"""Small counts don't leave: integral cells of count columns between 1 and the threshold become null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import is_count_column

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def count_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind in _INTEGRAL and is_count_column(name)]


def suppress_small_cells(df: DataFrame, threshold: int = 11, observation: Observation | None = None) -> DataFrame:
    """The same rows; with an observation, ``suppressed_cells`` is counted in the same pass. It has to be the outermost step."""
    names = [f.name for f in df.schema.fields]
    found = set(count_columns(df))
    unique = [f"c{i}" for i in range(len(names))]  # results may have two columns of one name
    plain = df.toDF(*unique)
    small = {u: (F.col(u) > 0) & (F.col(u) < threshold) for u, n in zip(unique, names, strict=True) if n in found}
    if observation is not None:
        total = sum((F.coalesce(cond.cast("int"), F.lit(0)) for cond in small.values()), F.lit(0))
        plain = plain.observe(observation, F.coalesce(F.sum(total), F.lit(0)).alias("suppressed_cells"))
    return plain.select(*(F.when(~small[u], F.col(u)).alias(u) if u in small else F.col(u) for u in unique)).toDF(*names)
