"""Incremental jobs: transcripts scanned as they arrive, texts masked with a vault that lasts, weekly counts of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.content import findings
from ..operators.masking import dictionary_entries, mask
from ..sources.files import read_dictionary, transcript_texts
from ..sources.vault import Vault
from ..storage import written


def scan_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, dictionary: str | None = None, glob: str = "*.jsonl", **rules) -> StreamingQuery:
    """Count protected values in transcript files that no earlier run has seen; ends when all are done.

    Files are tracked exactly once by the checkpoint, and the dictionary is read anew for every batch.
    """
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("value", F.col("_metadata.file_path").alias("file"))

    def batch(rows: DataFrame, number: int) -> None:
        inner = rows.sparkSession
        # stored with their keys: a second pass might number them otherwise
        texts = written(transcript_texts(rows).withColumn("key", F.monotonically_increasing_id()), "lines")
        entries = dictionary_entries(read_dictionary(inner, dictionary)) if dictionary else None
        masked, _ = mask(texts, "key", "text", entries, site="prompt", **rules)
        found = findings(texts.select("key", "file").join(masked, "key"))
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mask_stream(texts: DataFrame, key_col: str, text_col: str, out: str, vault_path: str, checkpoint: str, key: bytes, dictionary: str | None = None, gather: int = 50, **rules) -> StreamingQuery:
    """Mask a stream of texts; tokens keep their meaning from batch to batch. One query writes a vault.

    A batch that is run again overwrites its own output and its own vault rows. Every
    ``gather`` batches the vault's earlier ones are gathered.
    """

    def batch(rows: DataFrame, number: int) -> None:
        inner = rows.sparkSession
        vault = Vault(inner, vault_path)
        if number % gather == gather - 1:
            vault.compact(number)
        known = vault.rows(number)
        entries = dictionary_entries(read_dictionary(inner, dictionary)) if dictionary else None
        done, new = mask(rows, key_col, text_col, entries, vault=known, key=key, **rules)
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")
        vault.append(new, number)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events by week and type of a stream (an extension: the batch view has exact distinct users, this one an estimate)."""
    week = F.window("occurred_at", "7 days", "7 days", "4 days")  # weeks begin on Mondays; the epoch was a Thursday
    return events.withWatermark("occurred_at", delay).groupBy(week, "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct("user_id").alias("n_users"))

