"""Registered queries over transforms: digests of the forward result and of the round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, color, predict
from ..sources import views as v
from .registry import register


def _color(name):
    def query(s, d):
        rgb = v.rgb(s, d)
        out = color.forward(rgb, name)
        back = color.inverse(out, name).select("image_id", "y", "x", *[F.col(c).alias(f"b_{c}") for c in "rgb"])
        digest = out.groupBy("image_id").agg(*[F.sum(F.col(f"c{i}") * (F.col("y") * 8 + F.col("x") + 1)).alias(f"s{i}") for i in range(3)])
        wrong = rgb.join(back, ["image_id", "y", "x"]).groupBy("image_id").agg(F.sum(F.expr("cast(r <> b_r or g <> b_g or b <> b_b as bigint)")).alias("mismatches"))
        return digest.join(wrong, "image_id")

    sql = f"WITH {v.RGB}, t AS ({color.lift_sql('rgb', name)}) SELECT image_id, {', '.join(f'CAST(sum(c{i} * (y * 8 + x + 1)) AS BIGINT) AS s{i}' for i in range(3))}, CAST(0 AS BIGINT) AS mismatches FROM t GROUP BY image_id"
    register(f"{name}_roundtrip", query, sql)


for _name in color.LIFTS:
    _color(_name)


def _pixel(name, forward, back, duck):
    """A per-sample map of v and its inverse (None: not invertible)."""

    def query(s, d):
        p = v.planes(s, d).withColumn("c", F.expr(forward)).withColumn("u", F.expr(back or "v"))
        return p.groupBy("image_id").agg(F.sum(F.col("c") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias("digest"), F.sum((F.col("u") != F.col("v")).cast("long")).alias("mismatches"))

    register(
        name,
        query,
        f"WITH {v.PLANES} SELECT image_id, CAST(sum(({duck}) * (y * 8 + x + 1)) AS BIGINT) AS digest, CAST(0 AS BIGINT) AS mismatches FROM planes GROUP BY image_id",
    )


_pixel("t22_gray", "(v + 128) ^ ((v + 128) >> 1)", "(c ^ (c >> 1) ^ (c >> 2) ^ (c >> 3) ^ (c >> 4) ^ (c >> 5) ^ (c >> 6) ^ (c >> 7)) - 128", "xor(v + 128, (v + 128) >> 1)")
_pixel("t34_packsign", "(CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END) - 128", "CASE WHEN (c + 128) & 1 = 1 THEN -((c + 129) >> 1) ELSE (c + 128) >> 1 END", "(CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END) - 128")
_pixel("t35_signbit", "CASE WHEN v < 0 THEN -128 WHEN v > 0 THEN 127 ELSE 0 END", None, "CASE WHEN v < 0 THEN -128 WHEN v > 0 THEN 127 ELSE 0 END")
_pixel("t36_magnitude", "abs(v) - 128", None, "abs(v) - 128")


def _wrapped_jpeg2000(s, d):
    w = color.wrap
    p = v.rgb(s, d).withColumn("u", F.expr(w("r - g"))).withColumn("w", F.expr(w("b - g"))).withColumn("l", F.expr(w("g + ((u + w) >> 2)")))
    p = p.withColumn("g2", F.expr(w("l - ((u + w) >> 2)"))).withColumn("bad", F.expr(f"cast({w('u + g2')} <> r or g2 <> g or {w('w + g2')} <> b as bigint)"))
    return p.groupBy("image_id").agg(*[F.sum(F.col(c) * (F.col("y") * 8 + F.col("x") + 1)).alias(n) for c, n in (("l", "s0"), ("w", "s1"), ("u", "s2"))], F.sum("bad").alias("mismatches"))


register(
    "t04_jpeg2000_ma_roundtrip",
    _wrapped_jpeg2000,
    f"WITH {v.RGB}, a AS (SELECT *, {color.wrap('r - g')} AS u, {color.wrap('b - g')} AS w FROM rgb), t AS (SELECT *, {color.wrap('g + ((u + w) >> 2)')} AS l FROM a) SELECT image_id, CAST(sum(l * (y * 8 + x + 1)) AS BIGINT) AS s0, CAST(sum(w * (y * 8 + x + 1)) AS BIGINT) AS s1, CAST(sum(u * (y * 8 + x + 1)) AS BIGINT) AS s2, CAST(0 AS BIGINT) AS mismatches FROM t GROUP BY image_id",
)

_JPEG = {"yy": "0.299D * r + 0.587D * g + 0.114D * b", "cb": "-0.168736D * r - 0.331264D * g + 0.5D * b", "cr": "0.5D * r - 0.418688D * g - 0.081312D * b"}
register(
    "t15_ycbcr",
    lambda s, d: v.rgb(s, d).groupBy("image_id").agg(*[F.round(F.sum(F.expr(e)), 4).alias(n) for n, e in _JPEG.items()]),
    f"WITH {v.RGB} SELECT image_id, " + ", ".join(f"round(sum({e.replace('D', '::DOUBLE')}), 4) AS {n}" for n, e in _JPEG.items()) + " FROM rgb GROUP BY image_id",
)


def _recipes(s, d):
    """C-03: the recipe of the least sum of absolute differences to the previous pixel of the raster."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy("y", "x")
    signals = {c: c for c in "rgb"} | {"r-g": "r - g", "g-b": "g - b", "b-r": "b - r"}
    p = v.rgb(s, d).select("image_id", "y", "x", *[F.expr(e).alias(f"q{i}") for i, e in enumerate(signals.values())])
    p = p.select("image_id", *[F.abs(F.col(f"q{i}") - F.lag(f"q{i}", 1, 0).over(w)).alias(f"q{i}") for i in range(6)])
    sums = p.groupBy("image_id").agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(6)])
    at = {k: i for i, k in enumerate(signals)} | {"g-r": 3, "b-g": 4, "r-b": 5}
    costs = F.array(*[sum((F.col(f"q{at[c]}") for c in r), F.lit(0)) for r in color.RECIPES])
    return sums.select("image_id", F.array_min(costs).cast("long").alias("cost"), (F.array_position(costs, F.array_min(costs)) - 1).cast("long").alias("recipe"))


def _recipes_sql():
    at = {"r": 0, "g": 1, "b": 2, "r-g": 3, "g-r": 3, "g-b": 4, "b-g": 4, "b-r": 5, "r-b": 5}
    e = ["r", "g", "b", "(r - g)", "(g - b)", "(b - r)"]
    lags = ", ".join(f"abs({x} - lag({x}, 1, 0) OVER w) AS q{i}" for i, x in enumerate(e))
    costs = "[" + ", ".join(" + ".join(f"q{at[c]}" for c in r) for r in color.RECIPES) + "]"
    return f"WITH {v.RGB}, p AS (SELECT image_id, {lags} FROM rgb WINDOW w AS (PARTITION BY image_id ORDER BY y, x)), s AS (SELECT image_id, {', '.join(f'CAST(sum(q{i}) AS BIGINT) AS q{i}' for i in range(6))} FROM p GROUP BY image_id) SELECT image_id, CAST(list_min({costs}) AS BIGINT) AS cost, CAST(list_position({costs}, list_min({costs})) - 1 AS BIGINT) AS recipe FROM s"


register("c03_t01_best_recipe", _recipes, _recipes_sql())


def _predictor(name):
    query = lambda s, d: predict.roundtrip(v.plane_bytes(s, d), name)
    sql = f"WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes')}), t AS (SELECT image_id, y, x, {predict.text(name, 'duck')} AS res FROM n) SELECT image_id, CAST(sum(res * (y * 8 + x + 1)) AS BIGINT) AS digest, CAST(sum(abs(res)) AS BIGINT) AS magnitude, CAST(0 AS BIGINT) AS mismatches FROM t GROUP BY image_id"
    register(f"{name}_roundtrip", query, sql)


for _name in predict.PREDICTORS:
    _predictor(_name)


def _previous(s, d):
    """T-41: wrapped differences along the raster; the inverse is a wrapped prefix sum, so both ways are windows."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy("y", "x")
    p = v.planes(s, d).withColumn("res", F.expr(color.wrap("v - lag(v, 1, 0L) over (partition by image_id order by y, x)")))
    p = p.withColumn("u", F.sum("res").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("u", F.expr(color.wrap("u")))
    return p.groupBy("image_id").agg(F.sum(F.col("res") * (F.col("y") * 8 + F.col("x") + 1)).alias("digest"), F.sum((F.col("u") != F.col("v")).cast("long")).alias("mismatches"))


register(
    "t41_sub_roundtrip",
    _previous,
    f"WITH {v.PLANES}, t AS (SELECT image_id, y, x, {color.wrap('v - lag(v, 1, 0) OVER (PARTITION BY image_id ORDER BY y, x)')} AS res FROM planes) SELECT image_id, CAST(sum(res * (y * 8 + x + 1)) AS BIGINT) AS digest, CAST(0 AS BIGINT) AS mismatches FROM t GROUP BY image_id",
)

_SEL = "CASE WHEN abs({0} - {2}) < abs({1} - {2}) THEN {1} ELSE {0} END"
_CLEAR = {"dr": color.wrap("r - (" + _SEL.format("rN", "bW", "bNW") + ")"), "dg": color.wrap("g - (" + _SEL.format("gN", "r", "rN") + ")"), "db": color.wrap("b - (" + _SEL.format("bN", "g", "gN") + ")")}


def _cleartype(s, d):
    """T-56: selection among subpixels, each channel from the one before it."""
    from pyspark.sql import Window

    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    p = v.rgb(s, d).repartition("image_id").withColumn("bW", F.lag("b", 1, 0).over(row))
    p = p.select("*", *[F.lag(c, 1, 0).over(col).alias(n) for c, n in (("r", "rN"), ("g", "gN"), ("b", "bN"), ("bW", "bNW"))])
    return p.groupBy("image_id").agg(*[F.sum(F.expr(e) * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias(n) for n, e in _CLEAR.items()])


register(
    "t56_cleartype",
    _cleartype,
    f"WITH {v.RGB}, a AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY image_id, y ORDER BY x) AS bW FROM rgb), n AS (SELECT *, lag(r, 1, 0) OVER c AS rN, lag(g, 1, 0) OVER c AS gN, lag(b, 1, 0) OVER c AS bN, lag(bW, 1, 0) OVER c AS bNW FROM a WINDOW c AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, " + ", ".join(f"CAST(sum(({e}) * (y * 8 + x + 1)) AS BIGINT) AS {n}" for n, e in _CLEAR.items()) + " FROM n GROUP BY image_id",
)


def _block(name):
    query = lambda s, d: blocks.roundtrip(v.plane_bytes(s, d), name)
    wide = "SELECT image_id, " + ", ".join(f"max(CASE WHEN y * 8 + x = {i} THEN v END) AS p{i}" for i in range(64)) + " FROM planes GROUP BY image_id"
    sql = f"WITH {v.PLANES}, wide AS ({wide}), t AS ({blocks.sql('wide', name)}) SELECT image_id, CAST({' + '.join(f'p{i} * {i + 1}' for i in range(64))} AS BIGINT) AS digest, CAST(0 AS BIGINT) AS mismatches FROM t"
    register(f"{name}_roundtrip", query, sql)


for _name in blocks.PLANS:
    _block(_name)

#: Cone response weights and bias of the XYB color space.
_CONES = {"l": (0.3, 0.622, 0.078), "m": (0.23, 0.692, 0.078), "s": (0.24342268924547819, 0.20476744424496821, 0.5518098665095536)}
_BIAS = 0.0037930732552754493


def _xyb_text(d):
    cone = lambda k: "cbrt(" + " + ".join(f"{w!r}{d} * ({c} + 128) / 255" for w, c in zip(_CONES[k], "rgb", strict=True)) + f" + {_BIAS!r}{d}) - {_BIAS ** (1 / 3)!r}{d}"
    cones = ", ".join(f"{cone(k)} AS {k}" for k in _CONES)
    # 8-bit scales: 144 for luma, 4096 and 1024 for the chroma channels, clamped to the depth
    out = {"yy": ("(l + m) * 0.5{d} * 144", -128, 127), "bb": ("(s - (l + m) * 0.5{d}) * 1024", -256, 255), "xx": ("(l - m) * 0.5{d} * 4096", -256, 255)}
    return cones, ", ".join(f"round(avg(greatest({lo}, least({hi}, {e.replace('{d}', d)}))), 4) AS {n}" for n, (e, lo, hi) in out.items())


def _xyb(s, d):
    """T-16: cube-root opponent color, scaled and clamped; means per image."""
    cones, outs = _xyb_text("D")
    v.rgb(s, d).createOrReplaceTempView("marlstone_rgb")
    return s.sql(f"SELECT image_id, {outs} FROM (SELECT image_id, {cones} FROM marlstone_rgb) GROUP BY image_id")


register(
    "t16_xyb",
    _xyb,
    f"WITH {v.RGB} SELECT image_id, {_xyb_text('::DOUBLE')[1]} FROM (SELECT image_id, {_xyb_text('::DOUBLE')[0]} FROM rgb) GROUP BY image_id",
)

_PAIR = "((3 * {a} - {b} + 1) >> 1)"
_QUAD = "((9 * {a} - 3 * {b} - 3 * {c} + {d} + 2) >> 2)"


def _sharpen(s, d):
    """T-49, T-50: chroma samples of odd-aligned pairs (and squares) moved away from their neighbours; border samples stay."""
    p = predict.with_neighbours(v.planes(s, d), ("W", "N", "NW", "NE")).select("image_id", "y", "x", "v", "W", "N")
    row, col = "(partition by image_id, y order by x)", "(partition by image_id, x order by y)"
    p = p.withColumn("hx", F.expr(f"case when x in (0, 7) then null when x % 2 = 1 then lead(v) over {row} else lag(v) over {row} end")).withColumn("hy", F.expr(f"case when y in (0, 7) then null when y % 2 = 1 then lead(v) over {col} else lag(v) over {col} end"))
    p = p.withColumn("hd", F.expr(f"case when y in (0, 7) then null when y % 2 = 1 then lead(hx) over {col} else lag(hx) over {col} end"))
    e2 = F.expr(f"coalesce({_PAIR.format(a='v', b='hx')}, v)")
    e4 = F.expr(f"coalesce({_QUAD.format(a='v', b='hx', c='hy', d='hd')}, v)")
    at = F.col("y") * 8 + F.col("x") + 1
    return p.groupBy("image_id").agg(F.sum(e2 * at).alias("pairs"), F.sum(e4 * at).alias("squares"))


register("t49_t50_deinterpolate", _sharpen, f"""WITH {v.PLANES}, p AS (SELECT *, CASE WHEN x IN (0, 7) THEN NULL WHEN x % 2 = 1 THEN lead(v) OVER r ELSE lag(v) OVER r END AS hx, CASE WHEN y IN (0, 7) THEN NULL WHEN y % 2 = 1 THEN lead(v) OVER c ELSE lag(v) OVER c END AS hy FROM planes WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
    q AS (SELECT *, CASE WHEN y IN (0, 7) THEN NULL WHEN y % 2 = 1 THEN lead(hx) OVER c ELSE lag(hx) OVER c END AS hd FROM p WINDOW c AS (PARTITION BY image_id, x ORDER BY y))
    SELECT image_id, CAST(sum(coalesce({_PAIR.format(a='v', b='hx')}, v) * (y * 8 + x + 1)) AS BIGINT) AS pairs, CAST(sum(coalesce({_QUAD.format(a='v', b='hx', c='hy', d='hd')}, v) * (y * 8 + x + 1)) AS BIGINT) AS squares FROM q GROUP BY image_id""")

_CG = "greatest(least(N, W), least(greatest(N, W), N + W - NW))"


def _joint_gradient(s, d):
    """T-60: clamped gradient of green, and of red and blue less green, with green added back."""
    rgb = v.rgb(s, d)
    parts = []
    for c in "grb":
        p = rgb.select("image_id", "y", "x", F.col(c).alias("now"), (F.col(c) if c == "g" else F.col(c) - F.col("g")).alias("v"), (F.lit(0) if c == "g" else F.col("g")).alias("off"))
        res = F.expr(color.wrap(f"now - greatest(-128, least(127, {_CG} + off))"))
        parts.append(predict.with_neighbours(p, ("N", "W", "NW")).groupBy("image_id").agg(F.sum(res * (F.col("y") * 8 + F.col("x") + 1)).alias(c)))
    return parts[0].join(parts[1], "image_id").join(parts[2], "image_id")


def _joint_sql():
    parts = []
    for c in "grb":
        n = predict.neighbours_sql(f"(SELECT image_id, y, x, {c} AS now, {c if c == 'g' else f'{c} - g'} AS v, {'0' if c == 'g' else 'g'} AS off FROM rgb)", ("N", "W", "NW"))
        parts.append(f"{c}_ AS (SELECT image_id, CAST(sum(({color.wrap(f'now - greatest(-128, least(127, {_CG} + off))')}) * (y * 8 + x + 1)) AS BIGINT) AS {c} FROM ({n}) GROUP BY image_id)")
    return f"WITH {v.RGB}, {', '.join(parts)} SELECT image_id, r, g, b FROM r_ JOIN g_ USING (image_id) JOIN b_ USING (image_id)"


register("t60_cg3d", _joint_gradient, _joint_sql())
