"""Pairwise quality: bit-exactness, RMSE and PSNR variants, SSIM, differences, phase search, rate-distortion distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits per sample and PSNR of the reference curve, by quality; its last point, without loss, has no PSNR.
CURVE = (
    (0.113, 25.484142), (0.139, 27.991428), (0.184, 29.615995), (0.205, 30.297540), (0.234, 31.133699), (0.278, 32.215792),
    (0.346, 33.726246), (0.391, 34.617069), (0.453, 35.742132), (0.688, 38.923345), (0.985, 41.586402), (1.761, 45.738214),
)


def psnr(mse: Column, peak: float) -> Column:
    """20 log10(peak / rmse); null for identical inputs, whose PSNR is infinite."""
    return F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse))


def verify(a: DataFrame, b: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Q-01, Q-02, Q-16: per group the number of differing or missing samples and the first of them."""
    right = b.select(*keys, F.col("v").alias("w"))
    both = a.join(right, keys, "full_outer").where(~F.col("v").eqNullSafe(F.col("w")))
    place = F.struct(*[k for k in keys if k != group])
    bad = both.groupBy(group).agg(F.count("*").alias("differing"), F.min(place).alias("first"))
    return bad


def errors(pairs: DataFrame, group: str) -> DataFrame:
    """A-03, Q-04, Q-05, Q-06: squared error sums per group of pairs (v, w)."""
    d = F.col("v") - F.col("w")
    return pairs.groupBy(group).agg(F.count("*").alias("n"), F.sum(d * d).alias("sq"), F.max(F.abs(d)).alias("peak_error"))


def difference(v: Column, w: Column) -> Column:
    """Q-13: difference plus 128, modulo 256."""
    return (v - w + 128).bitwiseAND(255)


def ssim_map(pairs: DataFrame, size: int, peak: float = 255.0) -> DataFrame:
    """Q-07, Q-08, Q-10, Q-11: SSIM of every full size x size window, by its top left corner: two passes of window sums."""
    sums = {"sv": "v", "sw": "w", "vv": "v * v", "ww": "w * w", "vw": "v * w"}
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(0, size - 1)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(0, size - 1)
    p = pairs.repartition("image_id").select("image_id", "y", "x", *[F.sum(F.expr(e)).over(row).alias(n) for n, e in sums.items()], F.count("*").over(row).alias("nx"))
    p = p.select("image_id", "y", "x", "nx", *[F.sum(n).over(col).alias(n) for n in sums], F.count("*").over(col).alias("ny")).where((F.col("nx") == size) & (F.col("ny") == size))
    n, c1, c2 = float(size * size), (0.01 * peak) ** 2, (0.03 * peak) ** 2
    mv, mw = F.col("sv") / n, F.col("sw") / n
    var_v, var_w, cov = F.col("vv") / n - mv * mv, F.col("ww") / n - mw * mw, F.col("vw") / n - mv * mw
    value = (2 * mv * mw + c1) * (2 * cov + c2) / ((mv * mv + mw * mw + c1) * (var_v + var_w + c2))
    return p.select("image_id", "y", "x", value.alias("ssim"))


def phase(a: DataFrame, b: DataFrame, shifts: tuple[int, int]) -> DataFrame:
    """J-10, O-06, Q-14: per track the first shift of `b` with the least mean squared error against `a` (over the full
    length). Shifted copies meet on (track, position), so one join serves all shifts."""
    moved = b.select("track_id", F.col("sample").alias("other"), F.explode(F.sequence(F.lit(shifts[0]), F.lit(shifts[1]))).alias("shift"), F.col("pos").alias("at"))
    moved = moved.select("track_id", "other", "shift", (F.col("at") - F.col("shift")).alias("pos"))
    length = a.groupBy("track_id").agg(F.count("*").alias("n"))
    d = F.col("sample") - F.col("other")
    cost = a.join(moved, ["track_id", "pos"]).groupBy("track_id", "shift").agg(F.sum(d * d).alias("sq"))
    best = cost.groupBy("track_id").agg(F.min(F.struct("sq", "shift")).alias("best"))
    return best.join(length, "track_id").select("track_id", F.col("best.shift").alias("shift"), F.col("best.sq").alias("sq"), "n")


def curve_distance(points: DataFrame, curve=CURVE) -> DataFrame:
    """Q-17: largest signed distance of (bps, psnr) to the segments of a reference curve."""
    out = []
    for (x0, y0), (x1, y1) in zip(curve, curve[1:]):
        dx, dy = x1 - x0, y1 - y0
        out.append(((F.col("psnr") - y0) * dx - (F.col("bps") - x0) * dy) / (dx * dx + dy * dy) ** 0.5)
    return points.withColumn("distance", F.greatest(*out))


def curve_score(points: DataFrame, key: str, curve=CURVE) -> DataFrame:
    """Q-17: (key, n, score): the distances of a codec's points (one per quality) added up."""
    return curve_distance(points, curve).groupBy(key).agg(F.count("*").alias("n"), F.sum("distance").alias("score"))
