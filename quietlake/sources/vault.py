"""The vault on disk: rows bucketed by their value's keyed hash, in a partition for each batch.

A join by that hash, and the choice of the first row of a value, find the vault already dealt
out, so only the new values are shuffled to it, however large it has become. A batch that is
run again replaces its own partition. ``compact`` gathers the partitions of finished batches
into one; until the old ones are gone, readers see rows twice, with the same tokens.

The number of buckets stands in the folder's name, so every session opens a vault alike. The
table is known to the session's catalog under a name made from the path; rows and layout are
in the folder only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a row; the value itself is encrypted.
VAULT_SCHEMA = "mac string, token string, kind string, value_enc binary, ord bigint"
#: Rows from outside of batches, which add up, and the first number of those that hold gathered batches; they count down.
LOOSE, GATHERED = -1, -2
BUCKETS = 64


class Vault:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, top = spark, spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        self.fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in self.fs.listStatus(top)] if self.fs.exists(top) else []
        known = [n for n in found if n.startswith("buckets-")]
        self.buckets = int(known[0].partition("-")[2]) if known else buckets
        self.folder = f"{self.fs.makeQualified(top).toString()}/buckets-{self.buckets}"
        self.name = f"quietlake_vault_{hashlib.md5(self.folder.encode(), usedforsecurity=False).hexdigest()[:16]}"
        self.fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(self.folder))
        place = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({VAULT_SCHEMA}, batch bigint) USING parquet PARTITIONED BY (batch) CLUSTERED BY (mac) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        spark.sql(f"MSCK REPAIR TABLE {self.name} SYNC PARTITIONS")
        spark.catalog.refreshTable(self.name)

    def rows(self, before: int | None = None) -> DataFrame:
        """One row a value, the first that was recorded; ``before``: without the rows of this batch and later ones."""
        rows = self.spark.table(self.name)
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        first = rows.groupBy("mac").agg(F.min_by(F.struct("token", "kind", "value_enc", "ord"), F.struct("ord", "token", "batch")).alias("r"))
        return first.select("mac", "r.*")

    def append(self, new: DataFrame, batch: int = LOOSE) -> None:
        """New rows in the partition of their batch, in place of what it had; those from outside of batches are added."""
        self._insert(new, batch, "INTO" if batch == LOOSE else "OVERWRITE")

    def _insert(self, rows: DataFrame, batch: int, how: str) -> None:
        view = f"{self.name}_new"
        rows.select("mac", "token", "kind", "value_enc", "ord").repartition(self.buckets, "mac").createOrReplaceTempView(view)
        session = rows.sparkSession
        session.sql(f"INSERT {how} TABLE {self.name} PARTITION (batch = {batch}) SELECT mac, token, kind, value_enc, ord FROM {view}")
        session.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.name)

    def batches(self) -> list[int]:
        return sorted(int(r["partition"].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def compact(self, before: int) -> None:
        """Gather the partitions of batches earlier than ``before`` into one."""
        old = [b for b in self.batches() if b < before]
        if len(old) < 2:
            return
        gathered = min([GATHERED + 1, *old]) - 1
        self._insert(self.rows(before), gathered, "INTO")  # a partition of its own, which nothing reads yet
        for b in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {b})")
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={b}"), True)
        self.spark.catalog.refreshTable(self.name)
