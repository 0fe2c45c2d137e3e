"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words; everything else, other Unicode spaces included, belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables up to this many (estimated) bytes may be broadcast.
BROADCAST_BYTES = 8 << 20
FILES_A_CORE = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own if the master is local, and else an error."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if shared is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (shared or tempfile.mkdtemp(prefix="marlstone-")).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in spark.checkpoint.dir. At most FILES_A_CORE files for each core are written: tasks
    then read several partitions one after the other, in the memory of one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.coalesce(FILES_A_CORE * sc.defaultParallelism).checkpoint(eager=True)


def text_batches(spark: SparkSession) -> None:
    """Have texts travel to Python workers in small batches: 10,000 rows, Spark's default, are tens of megabytes that the
    executor's JVM holds outside its heap, for each task. Settings that the session has changed stay."""
    for key, usual, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", None, str(8 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now in (None, usual):
            spark.conf.set(key, value)


def compact(df: DataFrame, rows_each: int = 250_000) -> tuple[DataFrame, int]:
    """Materialise a table that may be small in few partitions, so that what reads it doesn't start a task for nothing;
    and its number of rows."""
    done = materialize(df)
    n = done.count()
    return done.coalesce(max(1, n // rows_each + 1)), n


def bounded(df: DataFrame, rows: int, row_bytes: int = 32, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` as the broadcast side of a join if its known number of rows (at most) keeps it within `limit`."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def release(spark: SparkSession, tries: int = 10) -> None:
    """Have shuffle files removed that nothing refers to any more, and checkpoints where the session has
    spark.cleaner.referenceTracking.cleanCheckpoints. Spark does so when the driver's JVM collects garbage, which small plans
    may not bring about for a long time. Plans stay referred to while listeners still work on their events, hence the wait;
    then garbage is collected until no shuffle is registered, or often enough where others hold theirs."""
    context = spark.sparkContext._jsc.sc()
    try:
        context.listenerBus().waitUntilEmpty(30_000)
        registered = context.env().mapOutputTracker().shuffleStatuses
        registered().size()
    except Exception:  # internals that another Spark may not have: the garbage is collected all the same
        registered = None
    for _ in range(tries):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
        if registered is not None and registered().size() == 0:
            break


def buckets(spark: SparkSession) -> int:
    """Partitions that keyed shuffles of an operator aim at: what the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", strings: tuple[str, ...] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join `right` (already materialised) to `left`: by broadcast when its measured size is within `limit`, else by
    a shuffle join, whose skewed partitions adaptive execution splits."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(16 * len(right.columns)))
    measured = right.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    return left.join(F.broadcast(right) if measured <= limit else right, on, how)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
