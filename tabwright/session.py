"""Session set-up, staging tables and size-checked joins."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Largest lookup (in rows) that is ever broadcast.
BROADCAST_ROWS = 100_000


def build_session(app: str = "tabwright", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the one the cluster names, or a temporary one in local mode."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    if not hasattr(spark, "_tabwright_scratch"):
        spark._tabwright_scratch = tempfile.mkdtemp(prefix="tabwright-")
    return spark._tabwright_scratch


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(getattr(spark, "_tabwright_within", None) or shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Whatever is staged inside is deleted at the end, and shuffles that nothing refers to any more are given back.

    For loops whose rounds leave only numbers behind; no table made inside may be read after it.
    """
    outer, mine = getattr(spark, "_tabwright_within", None), new_path(spark, "round")
    spark._tabwright_within = mine
    try:
        yield
    finally:
        spark._tabwright_within = outer
        discard(spark, mine)
        gc.collect()                                # Spark deletes a shuffle once the driver has collected its plan
        spark._jvm.System.gc()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back: several passes then share one computation.

    A written table is columnar (each later pass reads only its columns), outlives lost
    executors and cuts the lineage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Inputs up to this many bytes may be dealt out again when they fill too few tasks.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a small input out over the cores when its few files would keep most of them idle.

    Never applies to big inputs, whose splits already fill the cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size <= SPREAD_BYTES else df


#: Rows that a task of an algorithm that keeps its rows (MLlib's) should hold at most.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows out again where there are more than ``TASK_ROWS`` of them.

    A scan's split is bounded in bytes as written; columns of few values are written in very few, so that one split may hold tens
    of millions of rows, and what MLlib keeps of them is many times as large. Smaller tables keep their partitions.
    """
    n = df.count()
    if n <= TASK_ROWS:
        return df
    return df.repartition(max(math.ceil(n / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism))


def attach(df: DataFrame, lookup: DataFrame, on: list[str], weight: str, how_many: int) -> DataFrame:
    """Inner join to a lookup with unique keys where some keys may be hot on the ``df`` side.

    ``weight`` is the lookup column counting the ``df`` rows behind each key and ``how_many``
    their total. Keys holding more than a thousandth of the rows (so fewer than 1000 keys)
    are joined by broadcast, all others by a shuffle.
    """
    hot = lookup.filter(F.col(weight) > how_many / 1000.0)
    cold = lookup.filter(F.col(weight) <= how_many / 1000.0)
    first = df.join(F.broadcast(hot), on, "inner")
    rest = df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, "inner")
    return first.unionByName(rest)


def lookup_join(df: DataFrame, lookup: DataFrame, on, how: str = "inner",
                limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a lookup, broadcast only after counting that it has at most ``limit`` rows."""
    small = lookup.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(lookup) if small else lookup, on, how)
