"""Signal statistics: histograms, entropies, moments, context models.

Bytes are never exploded to rows: tasks count them with numpy and Spark adds the partial histograms. Planes are small
arrays, so their statistics are plain aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_histogram(blobs: DataFrame, key: str, order: int = 0) -> DataFrame:
    """A-07, A-11, A-12: (key, prev, sym, freq) over all bytes of `data`; with order 0, prev is 0. A blob's first byte
    follows a 0."""
    kind = blobs.schema[key].dataType.simpleString()
    size = 65536 if order else 256

    def run(batches):
        held, of = {}, None
        for b in batches:
            of = b[key].type
            for k, data in zip(b[key].to_pylist(), b["data"], strict=True):
                x = np.frombuffer(data.as_buffer() or b"", dtype=np.uint8)
                if order:
                    x = np.concatenate(([0], x[:-1])).astype(np.int64) << 8 | x if len(x) else np.zeros(0, dtype=np.int64)
                if k not in held:
                    held[k] = np.zeros(size, dtype=np.int64)
                held[k] += np.bincount(x, minlength=size)
        for k, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), of), pa.array(at, pa.int32()), pa.array(counts[at])], [key, "code", "freq"])

    part = blobs.where("data is not null").select(key, "data").mapInArrow(run, f"{key} {kind}, code int, freq long")
    return part.groupBy(key, "code").agg(F.sum("freq").alias("freq")).select(key, F.expr("code div 256").alias("prev"), (F.col("code") % 256).alias("sym"), "freq")


def pair_histogram(blobs: DataFrame, key: str) -> DataFrame:
    """A-13: (key, sym, freq) of little-endian 16-bit words; an odd last byte counts neither here nor in the length."""
    kind = blobs.schema[key].dataType.simpleString()

    def run(batches):
        held, of = {}, None
        for b in batches:
            of = b[key].type
            for k, data in zip(b[key].to_pylist(), b["data"].to_pylist(), strict=True):
                held.setdefault(k, np.zeros(65536, dtype=np.int64))
                held[k] += np.bincount(np.frombuffer(data, dtype="<u2", count=len(data) // 2), minlength=65536)
        for k, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), of), pa.array(at, pa.int32()), pa.array(counts[at])], [key, "sym", "freq"])

    return blobs.where("data is not null").select(key, "data").mapInArrow(run, f"{key} {kind}, sym int, freq long").groupBy(key, "sym").agg(F.sum("freq").alias("freq"))


def bits(freq: Column | str, total: Column | str) -> Column:
    """Code length of a symbol in bits times its frequency."""
    f, n = (F.col(c) if isinstance(c, str) else c for c in (freq, total))
    return -f * F.log2(f / n)


def entropy(hist: DataFrame, keys: list[str], contexts: list[str] | None = None) -> DataFrame:
    """A-08, C-01, C-02: per `keys`, the number of symbols and the total code length in bits, with one static model per
    `contexts` value."""
    w = Window.partitionBy(*keys, *(contexts or []))
    return hist.withColumn("n", F.sum("freq").over(w)).groupBy(*keys).agg(F.sum("freq").alias("count"), F.sum(bits("freq", "n")).alias("bits"))


def star_histogram(hist: DataFrame) -> DataFrame:
    """A-14: bars of 96 * freq div peak stars."""
    return hist.withColumn("stars", F.expr("cast(freq * 96 div max(freq) over (partition by 1) as int)")).withColumn("bar", F.repeat(F.lit("*"), F.col("stars")))


def moments(planes: DataFrame) -> DataFrame:
    """A-15: mean, sample deviation and mean absolute deviation (over n - 1)."""
    m = planes.withColumn("mean", F.avg("v").over(Window.partitionBy("image_id")))
    return m.groupBy("image_id").agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.pow(F.col("v") - F.col("mean"), 2)) / (F.count("*") - 1)).alias("sdev"), (F.sum(F.abs(F.col("v") - F.col("mean"))) / (F.count("*") - 1)).alias("mad"))


def depth_of(lo: Column, hi: Column, at_least: int = 0) -> Column:
    """A-09: bits for the value range, ceil(log2(2 * max(hi + 1, |lo|)))."""
    return F.greatest(F.lit(at_least), F.ceil(F.log2(2 * F.greatest(hi + 1, F.abs(lo)))).cast("int"))


def token(v: Column, exp: int = 4, msb: int = 1) -> tuple[Column, Column]:
    """C-08: hybrid integer (token, bypass bits) of a non-negative value: values under 2 ** exp are tokens; larger ones
    give their magnitude and leading bits to the token."""
    lg = F.floor(F.log2(F.greatest(v, F.lit(1)))).cast("int")
    low = lg - msb
    rest = v - F.pow(F.lit(2), lg).cast("long")
    lead = F.floor(rest / F.pow(F.lit(2), low)).cast("long")
    return F.when(v < (1 << exp), v).otherwise((1 << exp) + (lg - exp) * (1 << msb) + lead), F.when(v < (1 << exp), 0).otherwise(low)


def quantile_cuts(hist: DataFrame, q: int) -> DataFrame:
    """A-24: for k in 1 .. q - 1, the least symbol whose cumulative count reaches k / q of all."""
    w = Window.partitionBy("image_id")
    cum = hist.select("image_id", "sym", F.sum("freq").over(w.orderBy("sym").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("freq").over(w).alias("n"))
    ks = cum.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(q - 1))))
    return ks.where(F.col("cum") * q >= F.col("k") * F.col("n")).groupBy("image_id", "k").agg(F.min("sym").alias("cut"))


def quantised_cdf(hist: DataFrame, total: int = 4096) -> DataFrame:
    """W-18: a CDF of `total` slots in which every used symbol keeps one: cum * (total - used) div n + rank."""
    w = Window.partitionBy("image_id")
    o = w.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    h = hist.select("*", F.sum("freq").over(w).alias("n"), F.count("*").over(w).alias("used"), F.coalesce(F.sum("freq").over(o), F.lit(0)).alias("before"), (F.row_number().over(w.orderBy("sym")) - 1).alias("rank"))
    return h.select("image_id", "sym", F.expr(f"before * ({total} - used) div n + rank").cast("long").alias("cdf"))


def principal_axes(rgb: DataFrame) -> np.ndarray:
    """A-25, T-18: eigenvectors of the 3 x 3 channel covariance (rows, largest first), from one aggregate row."""
    pairs = [(a, b) for i, a in enumerate("rgb") for b in "rgb"[i:]]
    row = rgb.agg(*[F.covar_pop(a, b).alias(a + b) for a, b in pairs]).first()
    c = np.array([[row["".join(sorted((a, b), key="rgb".index))] or 0.0 for b in "rgb"] for a in "rgb"])
    return np.linalg.eigh(c)[1].T[::-1]


def cscore(planes: DataFrame, depth: int = 8, channels: int = 1) -> DataFrame:
    """C-15, C-16: millionths of the order-0 entropy of the clamped gradient residual, with raster neighbours: the left
    neighbour of a row's first sample is the last of the row before, and everything before the plane is 0."""
    w = Window.partitionBy("image_id").orderBy("y", "x")
    p = planes.withColumn("u", F.col("v") + (1 << (depth - 1)))
    col = Window.partitionBy("image_id", "x").orderBy("y")
    p = p.withColumn("W", F.lag("u", 1, 0).over(w)).withColumn("N", F.lag("u", 1, 0).over(col))
    p = p.withColumn("NW", F.lag("W", 1, 0).over(col))
    pred = F.greatest(F.least("N", "W"), F.least(F.greatest("N", "W"), F.col("N") + F.col("W") - F.col("NW")))
    res = p.select("image_id", ((F.col("u") - pred).bitwiseAND((1 << depth) - 1)).alias("sym"))
    hist = res.groupBy("image_id", "sym").agg(F.count("*").alias("freq"))
    e = entropy(hist, ["image_id"])
    return e.select("image_id", F.round(F.col("bits") / F.col("count") * 1e6 / (channels * depth)).cast("long").alias("cscore"))


def wav_cscore(pcm: DataFrame) -> DataFrame:
    """C-17: order-0 bits of first differences (16 bit, the first against 0) over bytes, rounded."""
    d = F.col("sample") - F.lag("sample", 1, 0).over(Window.partitionBy("track_id").orderBy("pos"))
    hist = pcm.select("track_id", d.bitwiseAND(65535).alias("sym")).groupBy("track_id", "sym").agg(F.count("*").alias("freq"))
    return entropy(hist, ["track_id"]).select("track_id", F.round(F.col("bits") / (F.col("count") * 2)).cast("long").alias("cscore"))
