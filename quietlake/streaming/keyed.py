"""Masking as keyed state: a stream's values get lasting tokens from a state store, without any writer that all batches go through.

Values are dealt to a fixed number of buckets by their keyed hash. A bucket's state maps the
hash of each value it has met to its token, and counts its tokens by kind; it numbers them
from numbers of its own (those that leave its own number as the rest when they are divided by
the number of buckets), so no two buckets, wherever they run, ever give the same token. The
store keeps hashes and tokens only; values are encrypted before they get there.

A batch that is run again starts from the state before it and replaces what it wrote. Its
rows are stored once and both outputs made from them, as a second pass might number anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.pii_rules import find_spans, resolve
from ..functions.text import light
from ..operators.masking import _mac, encrypted
from ..storage import scratch, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "key string, nth int, gap string, mac string, kind string, value_enc binary, token string, fresh boolean"


class _Tokens(StatefulProcessor):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "mac string", "token string")
        self.counts = handle.getMapState("counts", "kind string", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for part in rows:
            given = [self._token(key[0], m, k) if m is not None else (None, False) for m, k in zip(part["mac"], part["kind"], strict=True)]
            yield part.drop(columns=["bucket"]).assign(token=[t for t, _ in given], fresh=[f for _, f in given])

    def _token(self, bucket: int, mac: str, kind: str) -> tuple[str, bool]:
        if self.tokens.containsKey((mac,)):
            return self.tokens.getValue((mac,))[0], False
        n = self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0
        token = f"[{kind}_{n * self.buckets + bucket + 1}]"
        self.counts.updateValue((kind,), (n + 1,))
        self.tokens.updateValue((mac,), (token,))
        return token, True

    def close(self) -> None:
        pass


def pieces(texts: DataFrame, key_col: str, text_col: str, key: bytes, buckets: int, **rules) -> DataFrame:
    """Texts as rows, dealt to buckets: each value's hash, kind and cipher by the hash, and what stands between values by its own place, so a value that many texts hold brings no text to its bucket."""
    base = texts.select(F.col(key_col).cast("string").alias("key"), light(F.col(text_col).cast("string")).alias("text"))
    found = base.withColumn("spans", F.coalesce(resolve(F.col("text"), find_spans(F.col("text"), **rules)), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")))
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    gap = lambda start, end: F.substring(F.col("text"), start + 1, end - start)
    none = F.lit(None).cast("string")
    piece = lambda nth, gap, kind, value: F.struct(nth.alias("nth"), gap.alias("gap"), kind.alias("kind"), value.alias("value"))
    inner = F.flatten(F.transform("spans", lambda s, i: F.array(piece(i * 2, gap(F.get(ends, i), s["start"]), none, none), piece(i * 2 + 1, none, s["kind"], s["value"]))))
    last = piece(F.size("spans") * 2, gap(F.element_at(ends, -1), F.length("text")), none, none)
    rows = found.select("key", F.explode(F.concat(inner, F.array(last))).alias("p")).select("key", "p.*")
    mac = F.when(F.col("value").isNotNull(), _mac(F.col("value"), key))
    rows = rows.select("key", "nth", "gap", mac.alias("mac"), "kind", F.when(F.col("value").isNotNull(), encrypted(F.col("value"), key)).alias("value_enc"))
    return rows.withColumn("bucket", F.pmod(F.crc32(F.coalesce("mac", F.concat_ws("/", "key", "nth")).cast("binary")), F.lit(buckets)).cast("int"))


def mask_keyed_stream(texts: DataFrame, key_col: str, text_col: str, out: str, vault: str, checkpoint: str, key: bytes, buckets: int = 256, **rules) -> StreamingQuery:
    """Mask a stream of texts by the rules: (key, text) in ``out``, and (mac, token, kind, value_enc) of new values in ``vault``, each by batch.

    ``key_col`` is unique. The number of buckets belongs to the checkpoint and stays as it is.
    """
    spark = texts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = pieces(texts, key_col, text_col, key, buckets, **rules)
    given = rows.groupBy("bucket").transformWithStateInPandas(_Tokens(buckets), _OUT, outputMode="Append", timeMode="None")

    def batch(found: DataFrame, number: int) -> None:
        with scratch(found.sparkSession):
            stored = written(found, "pieces")
            parts = stored.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "gap", "token"))).alias("parts"))  # a text's own pieces
            text = F.array_join(F.transform("parts", lambda p: F.concat(F.coalesce(p["gap"], F.lit("")), F.coalesce(p["token"], F.lit("")))), "")
            whole = F.when(F.get("parts", F.lit(0))["gap"].isNotNull(), text)
            parts.select("key", whole.alias("text")).write.mode("overwrite").parquet(f"{out}/batch={number}")
            stored.filter("fresh").select("mac", "token", "kind", "value_enc", F.monotonically_increasing_id().alias("ord")).write.mode("overwrite").parquet(f"{vault}/batch={number}")

    return given.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_vault(spark: SparkSession, vault: str) -> DataFrame:
    """The vault's rows; a token stands once, in the batch that gave it."""
    return spark.read.parquet(vault).drop("batch")
