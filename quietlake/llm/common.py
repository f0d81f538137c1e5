"""Helpers shared by the operators: shared storage, ids, packed payloads, skew-safe lookups."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import partitions_for, shuffle_partitions, spread, written

__all__ = ["partitions_for", "shuffle_partitions", "spread", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from: crc32(doc_id as text) mod 3 is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label): at most ``per_class`` labelled ids of either class outside the held-out fold, chosen by a hash of the id, each with one text.

    An id that is labelled more than once takes the larger label, and one that several rows
    have the text with the smallest hash, so neither makes the sample longer.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    one = rows.groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = one.filter("label = 1").orderBy(*order).limit(per_class).union(one.filter("label = 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class ids, so the broadcast has a fixed bound
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return texts.groupBy("id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("id", "r.text", "r.label")


def task_id() -> int:
    return TaskContext.get().partitionId()


def pack(**columns) -> bytes:
    """Arrow IPC bytes (zstd) of equally long arrays, for rows that carry many small records."""
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payloads) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads])


def small_batches(batches, max_bytes: int = 8 << 20):
    """Cut Arrow batches so that each piece holds about ``max_bytes``; a single longer row stays whole.

    At the end of a task's batches the worker, which lives on, hands its free memory back.
    """
    for batch in batches:
        rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def lookup_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, hot_share: int = 2000, least: int = 1000) -> DataFrame:
    """Left-join per-group values to rows without sending a hot group's rows to one task.

    Groups of at least ``total / hot_share`` rows are at most ``hot_share`` in number, so
    that list has a proven bound and is broadcast; all other groups are joined by a shuffle.
    """
    hot = groups.filter(F.col(size) >= max(least, -(-total // hot_share)))
    values = [c for c in groups.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    done = marked.filter("__hot").drop("__hot")
    cold = marked.filter("__hot is null").drop("__hot", *values).join(groups, keys, "left")
    return done.unionByName(cold)


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def with_rows(docs: DataFrame, most_files: int = 1_000_000) -> tuple[DataFrame, str]:
    """The table with a number for every row, and that column's name.

    Numbers must not depend on how a scan is cut into tasks, which changes with the
    executors. Rows of a Parquet table have the number of their file, of which there are
    ``most_files`` at most (their names, about 100 bytes each, are broadcast), and their place
    in it. Any other table is stored together with its numbers.
    """
    name = _fresh(docs, "row")
    if files := _file_numbers(docs, most_files):
        file, place = _fresh(docs, "file"), _fresh(docs, "place")
        numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{name} long, {file} string")
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)).join(F.broadcast(numbers), file)
        return placed.select(*docs.columns, F.shiftleft(name, 40).bitwiseOR(F.col(place)).alias(name)), name
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _file_numbers(docs: DataFrame, most: int) -> list[str] | None:
    """The names of a plain Parquet table's files, in order; None for any other table, and for more than ``most``."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.relation().fileFormat().toString().lower() or "_metadata" in docs.columns:
        return None
    names = docs.select("_metadata.file_path").distinct().limit(most + 1).collect()
    return sorted(r["file_path"] for r in names) if len(names) <= most else None


def without_rows(docs: DataFrame, row_col: str, dropped: DataFrame, most: int = 4_000_000) -> DataFrame:
    """``docs`` but the rows whose numbers stand in ``dropped``: by a broadcast of up to ``most`` numbers, else by a shuffle."""
    dropped = written(dropped, "dropped")
    side = F.broadcast(dropped) if dropped.count() <= most else dropped
    return docs.join(side, row_col, "left_anti").drop(row_col)
