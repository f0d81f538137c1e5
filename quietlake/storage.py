"""What jobs share: the folder that driver and executors both see, tables that are written once, few files spread over the cores, lookups that survive hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many bytes a core are worth a shuffle if they come in fewer files than there are cores.
SPREAD_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own; on a cluster executors
    couldn't reach such a folder, so there it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders that the running ``scratch`` blocks of a thread have to take away.
_OPEN = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is written within this block is deleted at its end, however it ends: for jobs that hand out results and not tables."""
    outer, _OPEN.paths = getattr(_OPEN, "paths", None), []
    try:
        yield
    finally:
        paths, _OPEN.paths = _OPEN.paths, outer
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quietlake-{name}-{uuid.uuid4().hex}"
    if getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A small table that comes in fewer files than there are cores, dealt to all cores; any other table as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df


def cut(batches, most: int = 1 << 20):
    """Arrow arrays or batches in parts of about ``most`` bytes, so a worker holds what it makes of one part only; a longer row stays whole.

    At the end the worker, which lives on, hands its free memory back.
    """
    for batch in batches:
        rows = max(1, len(batch) * most // max(1, batch.nbytes))
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
        del batch
    pa.default_memory_pool().release_unused()


def lookup(rows: DataFrame, values: DataFrame, key: str, hot: int = 2000, least: int = 1000) -> DataFrame:
    """``rows`` inner-joined with the value of their ``key``, which stands once in ``values``.

    The ``hot`` most frequent keys of ``least`` rows or more, a list of fixed size, are
    broadcast, so the rows of such a key stay where they are; all others are shuffled.
    """
    often = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).orderBy(F.desc("__n"), key).limit(hot).join(values, key).drop("__n"), "hot")
    cold = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(values, key)
    return rows.join(F.broadcast(often), key).unionByName(cold)


def partitions_for(df: DataFrame, task_bytes: int, most: int = 20_000) -> int:
    """How many tasks share out ``df`` so that each has about ``task_bytes`` of its files: spark.sql.shuffle.partitions at least, ``most`` at most above that.

    A table that isn't read from files alone has no size that is known beforehand, and gets the least.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    known = all(leaf.getClass().getSimpleName() == "LogicalRelation" for leaf in leaves)
    size = sum(int(leaf.stats().sizeInBytes()) for leaf in leaves) if known else 0
    return max(shuffle_partitions(df.sparkSession), min(most, -(-size // task_bytes)))
