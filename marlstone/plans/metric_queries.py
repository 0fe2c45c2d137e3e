"""Registered queries over pairwise metrics, sequential models and codecs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import codecs, metrics, predict
from ..sources import views as v
from .registry import register


def pairs(s, d):
    """Planes beside their copies, quantised by 4 (every tenth plane is left as it is)."""
    return v.planes(s, d).withColumn("w", F.expr("case when image_id % 10 = 0 then v else 4 * (v div 4) end"))


PAIRS = v.PLANES + ", pairs AS (SELECT *, CASE WHEN image_id % 10 = 0 THEN v ELSE 4 * (v // 4) END AS w FROM planes)"


def _verify(s, d):
    p = pairs(s, d)
    return metrics.verify(p.select("image_id", "y", "x", "v"), p.select("image_id", "y", "x", F.col("w").alias("v")), ["image_id", "y", "x"], "image_id").select("image_id", "differing", F.col("first.y").alias("first_y"), F.col("first.x").alias("first_x"))


register(
    "q01_q02_q16_verify",
    _verify,
    f"WITH {PAIRS} SELECT image_id, count(*) AS differing, CAST(min(y * 8 + x) // 8 AS INT) AS first_y, CAST(min(y * 8 + x) % 8 AS INT) AS first_x FROM pairs WHERE v <> w GROUP BY image_id",
)
_PS = {"psnr255": 255.0, "psnr_half": 128.0}
register(
    "q04_q06_psnr",
    lambda s, d: metrics.errors(pairs(s, d), "image_id").select("image_id", "peak_error", F.round(F.sqrt(F.col("sq") / F.col("n")), 6).alias("rmse"), *[F.round(metrics.psnr(F.col("sq") / F.col("n"), p), 6).alias(k) for k, p in _PS.items()]),
    f"WITH {PAIRS}, e AS (SELECT image_id, count(*) AS n, sum((v - w) * (v - w)) AS sq, max(abs(v - w)) AS peak_error FROM pairs GROUP BY image_id) SELECT image_id, peak_error, round(sqrt(sq / n), 6) AS rmse, " + ", ".join(f"round(CASE WHEN sq > 0 THEN 10 * log10({p * p} / (sq / n)) END, 6) AS {k}" for k, p in _PS.items()) + " FROM e",
)
register(
    "a03_q18_pooled_psnr",
    lambda s, d: metrics.errors(pairs(s, d).withColumn("all", F.lit(1)), "all").select("n", "sq", F.round(metrics.psnr(F.col("sq") / F.col("n"), 255.0), 6).alias("psnr")),
    f"WITH {PAIRS} SELECT count(*) AS n, CAST(sum((v - w) * (v - w)) AS BIGINT) AS sq, round(10 * log10(65025.0 / (sum((v - w) * (v - w)) / count(*))), 6) AS psnr FROM pairs",
)
register(
    "q03_yuv_psnr",
    lambda s, d: v.rgb(s, d).groupBy("image_id").agg(*[F.sqrt(F.avg((F.col(c) - 4 * F.expr(f"{c} div 4")) ** 2)).alias(c) for c in "rgb"]).select("image_id", F.round(F.when(6 * F.col("g") + F.col("b") + F.col("r") > 0, 20 * F.log10(255 * 8 / (6 * F.col("g") + F.col("b") + F.col("r")))), 6).alias("psnr")),
    f"WITH {v.RGB}, e AS (SELECT image_id, " + ", ".join(f"sqrt(avg(({c} - 4 * ({c} // 4)) * ({c} - 4 * ({c} // 4)))) AS {c}" for c in "rgb") + " FROM rgb GROUP BY image_id) SELECT image_id, round(CASE WHEN 6 * g + b + r > 0 THEN 20 * log10(2040 / (6 * g + b + r)) END, 6) AS psnr FROM e",
)
register(
    "q05_psnr16",
    lambda s, d: v.pcm(s, d).groupBy("track_id").agg(F.count("*").alias("n"), F.sum((F.col("sample") - 100 * F.expr("sample div 100")) ** 2).cast("long").alias("sq")).select("track_id", F.round(metrics.psnr(F.col("sq") / F.col("n"), 65535.0), 6).alias("psnr")),
    f"WITH {v.PCM} SELECT track_id, round(10 * log10(4294836225.0 / (sum((sample - 100 * (sample // 100)) * (sample - 100 * (sample // 100))) / count(*))), 6) AS psnr FROM pcm GROUP BY track_id HAVING sum(abs(sample - 100 * (sample // 100))) > 0",
)
register(
    "q13_t45_difference",
    lambda s, d: pairs(s, d).groupBy(metrics.difference(F.col("v"), F.col("w")).alias("level")).agg(F.count("*").alias("n")),
    f"WITH {PAIRS} SELECT (v - w + 128) & 255 AS level, count(*) AS n FROM pairs GROUP BY 1",
)


def _ssim_sql(size):
    n, c1, c2 = float(size * size), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    sums = {"sv": "v", "sw": "w", "vv": "v * v", "ww": "w * w", "vw": "v * w"}
    return f"""WITH {PAIRS}, r AS (SELECT image_id, y, x, {', '.join(f'sum({e}) OVER w AS {k}' for k, e in sums.items())}, count(*) OVER w AS nx FROM pairs WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
        c AS (SELECT image_id, y, x, nx, {', '.join(f'CAST(sum({k}) OVER w AS DOUBLE) AS {k}' for k in sums)}, count(*) OVER w AS ny FROM r WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
        m AS (SELECT image_id, y, x, sv / {n} AS mv, sw / {n} AS mw, vv / {n} AS vv, ww / {n} AS ww, vw / {n} AS vw FROM c WHERE nx = {size} AND ny = {size}),
        t AS (SELECT image_id, y, x, (2 * mv * mw + {c1}::DOUBLE) * (2 * (vw - mv * mw) + {c2}::DOUBLE) / ((mv * mv + mw * mw + {c1}::DOUBLE) * (vv - mv * mv + ww - mw * mw + {c2}::DOUBLE)) AS ssim FROM m)"""


register(
    "q07_ssim",
    lambda s, d: metrics.ssim_map(pairs(s, d), 5).groupBy("image_id").agg(F.round(F.avg("ssim"), 6).alias("ssim"), F.count("*").alias("patches")),
    _ssim_sql(5) + " SELECT image_id, round(avg(ssim), 6) AS ssim, count(*) AS patches FROM t GROUP BY image_id",
)
register(
    "q08_q10_ssim_stride",
    lambda s, d: metrics.ssim_map(pairs(s, d), 4).where("x % 2 = 0 and y % 2 = 0").groupBy("image_id").agg(F.round(F.avg("ssim"), 6).alias("ssim")),
    _ssim_sql(4) + " SELECT image_id, round(avg(ssim), 6) AS ssim FROM t WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY image_id",
)
register(
    "q11_t46_ssim_map",
    lambda s, d: metrics.ssim_map(pairs(s, d), 5).select("image_id", "y", "x", F.round("ssim", 6).alias("ssim")),
    _ssim_sql(5) + " SELECT image_id, y, x, round(ssim, 6) AS ssim FROM t",
)
register(
    "a04_weighted_ssim",
    lambda s, d: metrics.ssim_map(pairs(s, d), 5).groupBy("image_id").agg(F.avg("ssim").alias("ssim")).withColumn("weight", F.col("image_id") % 7 + 1).agg(F.round(F.sum(F.col("ssim") * F.col("weight")) / F.sum("weight"), 6).alias("ssim")),
    _ssim_sql(5) + ", e AS (SELECT image_id, avg(ssim) AS ssim, image_id % 7 + 1 AS weight FROM t GROUP BY image_id) SELECT round(sum(ssim * weight) / sum(weight), 6) AS ssim FROM e",
)
register(
    "q14_o06_phase",
    lambda s, d: metrics.phase(v.pcm(s, d), v.pcm(s, d).select("track_id", "pos", (F.lag("sample", 2, 0).over(Window.partitionBy("track_id").orderBy("pos")) + 1).alias("sample")), (-3, 6)),
    f"WITH {v.PCM}, b AS (SELECT track_id, pos, lag(sample, 2, 0) OVER (PARTITION BY track_id ORDER BY pos) + 1 AS other FROM pcm), m AS (SELECT track_id, other, shift, pos - shift AS pos FROM b, range(-3, 7) t(shift)), c AS (SELECT track_id, shift, sum((sample - other) * (sample - other)) AS sq FROM pcm JOIN m USING (track_id, pos) GROUP BY ALL), n AS (SELECT track_id, count(*) AS n FROM pcm GROUP BY track_id) SELECT track_id, CAST(arg_min(shift, (sq, shift)) AS INT) AS shift, CAST(min(sq) AS BIGINT) AS sq, any_value(n) AS n FROM c JOIN n USING (track_id) GROUP BY track_id",
)


def _curve_sql():
    parts = []
    for (x0, y0), (x1, y1) in zip(metrics.CURVE, metrics.CURVE[1:]):
        parts.append(f"((psnr - {y0}::DOUBLE) * {x1 - x0!r}::DOUBLE - (bps - {x0}::DOUBLE) * {y1 - y0!r}::DOUBLE) / {((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5!r}::DOUBLE")
    return f"WITH {PAIRS}, e AS (SELECT image_id, count(DISTINCT v) / 64.0::DOUBLE AS bps, 10 * log10(65025.0 / (sum((v - w) * (v - w)) / count(*))) AS psnr FROM pairs GROUP BY image_id HAVING sum(abs(v - w)) > 0) SELECT image_id, round(greatest({', '.join(parts)}), 6) AS distance FROM e"


register(
    "q17_curve_distance",
    lambda s, d: metrics.curve_distance(pairs(s, d).groupBy("image_id").agg((F.countDistinct("v") / 64.0).alias("bps"), metrics.psnr(F.sum((F.col("v") - F.col("w")) ** 2) / F.count("*"), 255.0).alias("psnr")).where("psnr is not null")).select("image_id", F.round("distance", 6).alias("distance")),
    _curve_sql(),
)
register(
    "t20_compare",
    lambda s, d: predict.with_neighbours(v.planes(s, d)).groupBy("image_id").agg(F.sum(F.expr(f"abs({predict.text('t38_clampgrad')}) - abs({predict.text('t40_av2')})")).cast("long").alias("gain")),
    f"WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes')}) SELECT image_id, CAST(sum(abs({predict.text('t38_clampgrad', 'duck')}) - abs({predict.text('t40_av2', 'duck')})) AS BIGINT) AS gain FROM n GROUP BY image_id",
)

register(
    "codecs_lossless",
    lambda s, d: codecs.measure(v.texts(s, d), tuple(codecs.CODECS)).groupBy("codec").agg(F.sum("usize").alias("usize"), F.sum((~F.col("lossless")).cast("long")).alias("lossy")),
    "SELECT codec, CAST(sum(strlen(text)) AS BIGINT) AS usize, CAST(0 AS BIGINT) AS lossy FROM documents, (SELECT unnest(['store', 'rle', 'rice', 'huffman', 'rans0', 'lz', 'zlib', 'bz2', 'lzma']) AS codec) GROUP BY codec",
)
register(
    "codecs_sizes",
    lambda s, d: codecs.measure(v.texts(s, d), tuple(codecs.CODECS), restore=False).groupBy("codec").agg(F.sum("csize").alias("csize"), F.round(8 * F.sum("csize") / F.sum("usize"), 6).alias("bpd")),
)
register(
    "codecs_rle_size",
    lambda s, d: codecs.measure(v.texts(s, d), ("rle",), restore=False).select("blob_id", "csize"),
    f"WITH {v.BYTES}, e AS (SELECT blob_id, pos, sym <> lag(sym, 1, -1) OVER (PARTITION BY blob_id ORDER BY pos) AS fresh FROM bytes), r AS (SELECT blob_id, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY blob_id ORDER BY pos) AS run FROM e), n AS (SELECT blob_id, run, count(*) AS n FROM r GROUP BY ALL) SELECT blob_id, CAST(sum(2 + CASE WHEN n > 127 THEN 1 ELSE 0 END + CASE WHEN n > 16383 THEN 1 ELSE 0 END) AS BIGINT) AS csize FROM n GROUP BY blob_id",
)
