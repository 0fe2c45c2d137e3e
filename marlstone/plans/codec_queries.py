"""Registered queries over image codecs: losslessness, sizes, and streams written to and read from binary columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, image_codecs
from ..sources import views as v
from .context_queries import running_sql
from .registry import register
from .sequential_queries import near_sql, wrapped

COUNT = f"WITH {v.RGB}, images AS (SELECT image_id, count(*) AS n FROM rgb GROUP BY image_id)"


def _lossless(name):
    return lambda s, d: image_codecs.measure(v.rgb_bytes(s, d), (name,)).groupBy("codec").agg(F.count("*").alias("images"), F.sum("usize").alias("usize"), F.sum("wrong").alias("wrong"))


for _name in image_codecs.NAMES:
    register(
        f"codec_{_name}",
        _lossless(_name),
        f"{COUNT} SELECT '{_name}' AS codec, count(*) AS images, CAST(sum(3 * n) AS BIGINT) AS usize, CAST(0 AS BIGINT) AS wrong FROM images",
    )

register(
    "codec_sizes",
    lambda s, d: image_codecs.measure(v.rgb_bytes(s, d), (*image_codecs.NAMES, *image_codecs.LOSSY)).groupBy("codec").agg(F.sum("csize").alias("csize"), F.round(8 * F.sum("csize") / F.sum("usize"), 6).alias("bpd"), F.round(F.when(F.sum("squared_error") > 0, 10 * F.log10(65025.0 * F.sum("usize") / F.sum("squared_error"))), 6).alias("psnr")),
)


def _rice_sql(near: tuple[str, ...], prediction: str, subgreen: bool, choices: int = 4) -> str:
    """Bytes of adaptive Golomb-Rice codes of one predictor's residuals, and of the choices in front."""
    channels = ("((r - g + 128) & 255) - 128", "g", "((b - g + 128) & 255) - 128") if subgreen else ("r", "g", "b")
    planes = " UNION ALL ".join(f"SELECT image_id * 3 + {c} AS image_id, y, x, {e} AS v FROM rgb" for c, e in enumerate(channels))
    return f"""WITH RECURSIVE {v.RGB}, chan AS ({planes}), n AS ({near_sql(near, 'chan')}), res AS (SELECT image_id, k, {wrapped(prediction)} AS e FROM n),
        zs AS (SELECT image_id, list(CAST(CASE WHEN e < 0 THEN -2 * e - 1 ELSE 2 * e END AS BIGINT) ORDER BY k) AS zs FROM res GROUP BY image_id), {running_sql('zs', 6)},
        bits AS (SELECT image_id // 3 AS image_id, sum((zs[k + 1] >> CAST(floor(log2((state >> 6) + 1)) AS INT)) + 1 + CAST(floor(log2((state >> 6) + 1)) AS INT)) AS bits FROM st WHERE k < 64 GROUP BY 1)
        SELECT image_id, CAST({choices} + (bits + 7) // 8 AS BIGINT) AS csize FROM bits"""


for _name, _near, _p, _green in (
    ("c27_rice", ("N", "W", "NW"), "greatest(least(N, W), least(greatest(N, W), N + W - NW))", True),
    ("c17_previous_rice", ("N", "W"), "CASE WHEN x > 0 THEN W ELSE N END", True),
    ("c57_fast_rice", ("N", "W"), "CASE WHEN x > 0 THEN W ELSE N END", False),
):
    register(
        f"codec_{_name}_size",
        lambda s, d, name=_name: image_codecs.measure(v.rgb_bytes(s, d), (name,)).select("image_id", "csize"),
        _rice_sql(_near, _p, _green),
    )


def _streams(s, d):
    """K-07: streams are written as a binary column, read again and decoded; the pixels that come back."""
    streams = image_codecs.encoded(v.rgb_bytes(s, d), "c29_static_magnitude")
    back = image_codecs.decoded(streams, "c29_static_magnitude")
    weighted = "aggregate(transform({c}, (p, i) -> p * (i + 1)), 0L, (a, p) -> a + p)"
    return back.select("image_id", *[F.expr(weighted.format(c=c)).alias(c) for c in "rgb"])


register(
    "k07_streams",
    _streams,
    f"WITH {v.RGB} SELECT image_id, " + ", ".join(f"CAST(sum({c} * (y * 8 + x + 1)) AS BIGINT) AS {c}" for c in "rgb") + " FROM rgb GROUP BY image_id",
)


def _lossy(name):
    """What a lossy codec restores is what its quantised coefficients say, and its error is measured."""

    def query(s, d):
        got = image_codecs.measure(v.rgb_bytes(s, d), (name,))
        return got.select("image_id", "csize", F.round(F.when(F.col("squared_error") > 0, 10 * F.log10(65025.0 * F.col("usize") / F.col("squared_error"))), 6).alias("psnr"))

    return query


def _coefficients_sql(name: str) -> str:
    """The coefficients of wrapped colour differences, by the transform's own SQL."""
    _, transform, step, _ = image_codecs.LOSSY[name]
    w = lambda e: f"((({e}) + 128) & 255) - 128"
    lifted = f"SELECT image_id, y, x, {w('r - g')} AS r, {w('b - g')} AS b, g FROM rgb"
    lifted = f"SELECT image_id, y, x, r, b, {w('g + ((r + b) >> 2)')} AS g FROM ({lifted})"
    planes = " UNION ALL ".join(f"SELECT image_id * 3 + {i} AS image_id, y * 8 + x AS k, {c} AS v FROM lifted" for i, c in enumerate("rgb"))
    wide = "SELECT image_id, " + ", ".join(f"max(CASE WHEN k = {i} THEN v END) AS p{i}" for i in range(64)) + " FROM planes3 GROUP BY image_id"
    kept = " + ".join(f"least(127, greatest(-128, (p{i} + {step // 2}) >> {step.bit_length() - 1})) * ({i + 1} + 64 * (image_id % 3))" for i in range(64))
    return f"WITH {v.RGB}, lifted AS ({lifted}), planes3 AS ({planes}), wide AS ({wide}), t AS ({blocks.sql('wide', transform)}) SELECT image_id // 3 AS image_id, CAST(sum({kept}) AS BIGINT) AS digest FROM t GROUP BY 1"


def _coefficients(name):
    weighted = "aggregate(transform(px, (p, i) -> p * (i + 1)), 0L, (a, p) -> a + p)"
    return lambda s, d: image_codecs.coefficients(v.rgb_bytes(s, d), name).select("image_id", F.expr(weighted).alias("digest"))


for _name in image_codecs.LOSSY:
    register(f"codec_{_name}", _lossy(_name))
    register(f"codec_{_name}_coefficients", _coefficients(_name), _coefficients_sql(_name))
