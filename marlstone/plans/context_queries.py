"""Registered queries over running-context estimators and colour analyses; states are recursive queries in the SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analysis, color, contexts, metrics, predict
from ..sources import views as v
from .registry import register

PX = "px AS (SELECT image_id, list(v ORDER BY y, x) AS vs FROM planes GROUP BY image_id)"
ZS = f"WITH RECURSIVE {v.PLANES}, {PX}, zs AS (SELECT image_id, [CASE WHEN e < 0 THEN -2 * e - 1 ELSE 2 * e END FOR e IN vs] AS zs FROM px)"


def running_sql(source: str, precision: int = 3, near: tuple[int, int] = (2, 3)) -> str:
    """st(image_id, k, zs, above, state): the state before sample k of `source` (image_id, zs), of rows of 8."""
    a, b = (f"coalesce(above[k % 8 + {d + 1}], 0)" for d in near)
    return f"""st AS (SELECT image_id, 0 AS k, zs, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS above, CAST(0 AS BIGINT) AS state FROM {source}
        UNION ALL
        SELECT image_id, k + 1, zs, list_concat(list_concat(above[1:k % 8], [after]), above[k % 8 + 2:]), CASE WHEN (k + 1) % 8 = 0 THEN 0 ELSE after END
        FROM (SELECT *, CAST((2 * state + zs[k + 1] * {1 << precision} + greatest({a}, {b})) >> 2 AS BIGINT) AS after FROM st WHERE k < 64))"""


NOISE = """st AS (SELECT image_id, 0 AS k, zs, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS above, CAST(0 AS BIGINT) AS state FROM zs
        UNION ALL
        SELECT image_id, k + 1, zs, list_concat(list_concat(above[1:k % 8], [up + ((8 * zs[k + 1] - up) >> 3)]), above[k % 8 + 2:]), CASE WHEN (k + 1) % 8 = 0 THEN 0 ELSE state + ((8 * zs[k + 1] - state) >> 3) END
        FROM (SELECT *, above[k % 8 + 1] AS up FROM st WHERE k < 64))"""
LG = "CAST(floor(log2({0} * {0} + 1)) AS INT)"
CTX = {
    "magnitude": f"ctx AS (SELECT image_id, k, least(16, {LG.format('state')}) AS ctx, CAST(CASE WHEN zs[k + 1] % 2 = 1 THEN -((zs[k + 1] + 1) // 2) ELSE zs[k + 1] // 2 END AS INT) AS level FROM st WHERE k < 64)",
    "noise": f"ctx AS (SELECT image_id, k, CAST(least(11, {LG.format('least(up, state)')}) + CASE WHEN up < state THEN 12 ELSE 0 END AS INT) AS ctx, CAST(CASE WHEN zs[k + 1] % 2 = 1 THEN -((zs[k + 1] + 1) // 2) ELSE zs[k + 1] // 2 END AS INT) AS level FROM (SELECT *, above[k % 8 + 1] AS up FROM st WHERE k < 64))",
}
HIST = "hist AS (SELECT image_id, ctx, level, count(*) AS freq FROM ctx GROUP BY ALL), total AS (SELECT image_id, ctx, CAST(sum(freq) AS BIGINT) AS n, count(*) AS used FROM hist GROUP BY ALL)"
COSTS = """coded AS (SELECT image_id, ctx, sum(-freq * log2((freq * (4096 - used) // n + 1) / 4096.0::DOUBLE)) AS bits FROM hist JOIN total USING (image_id, ctx) GROUP BY ALL),
    dense AS (SELECT d.image_id, d.ctx, n, used, ks, coalesce(freq, 0) AS freq FROM (SELECT *, CASE WHEN ks % 2 = 1 THEN -((ks + 1) // 2) ELSE ks // 2 END AS lv FROM total, (SELECT unnest(range(0, 256)) AS ks)) d
        LEFT JOIN hist h ON d.image_id = h.image_id AND d.ctx = h.ctx AND ((d.lv + 128) & 255) = h.level + 128),
    cdf AS (SELECT image_id, ctx, ks, coalesce(sum(freq) OVER w, 0) * (4096 - used) // n + coalesce(sum(CASE WHEN freq > 0 THEN 1 ELSE 0 END) OVER w, 0) AS cdf FROM dense WINDOW w AS (PARTITION BY image_id, ctx ORDER BY ks ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    steps AS (SELECT image_id, ctx, ks, CAST(cdf - lag(cdf) OVER w AS BIGINT) AS step, CAST(4096 - lag(cdf) OVER w AS BIGINT) AS remaining FROM cdf WINDOW w AS (PARTITION BY image_id, ctx ORDER BY ks)),
    header AS (SELECT image_id, ctx, CAST(sum((step >> bypass) + 1 + bypass) AS BIGINT) AS bits FROM (SELECT *, greatest(0, CAST(floor(log2(remaining)) AS INT) - CASE WHEN ks > 1 THEN 7 ELSE 0 END) AS bypass FROM steps WHERE ks > 0 AND remaining > 0) GROUP BY ALL)"""


def px(s, d):
    return v.plane_bytes(s, d)


def _size(name):
    return lambda s, d: contexts.sizes(px(s, d), name)


register("w19_running_state", lambda s, d: contexts.running_states(px(s, d)).select("image_id", F.expr("aggregate(transform(states, (e, i) -> e * (i + 1)), 0L, (a, e) -> a + e)").alias("digest"), F.array_max("states").alias("peak")),
         f"{ZS}, {running_sql('zs')} SELECT image_id, CAST(sum(state * (k + 1)) AS BIGINT) AS digest, max(state) AS peak FROM st WHERE k < 64 GROUP BY image_id")
register(
    "a19_context_histogram",
    lambda s, d: contexts.context_histogram(px(s, d)),
    f"{ZS}, {running_sql('zs')}, {CTX['magnitude']}, {HIST} SELECT * FROM hist",
)
register("a19_noise_histogram", lambda s, d: contexts.context_histogram(px(s, d), "noise"), f"{ZS}, {NOISE}, {CTX['noise']}, {HIST} SELECT * FROM hist")
_SUM = "SELECT image_id, round((sum(c.bits) + coalesce(sum(h.bits), 0)) / 512, 6) AS size FROM coded c LEFT JOIN header h USING (image_id, ctx) GROUP BY image_id"
register("c09_grctx", _size("c09_grctx"), f"{ZS}, {running_sql('zs')}, {CTX['magnitude']}, {HIST}, {COSTS} {_SUM}")
register("c10_c2", _size("c10_c2"), f"{ZS}, {NOISE}, {CTX['noise']}, {HIST}, {COSTS} {_SUM}")
register(
    "c11_golomb_rice",
    _size("c11_golomb_rice"),
    f"{ZS}, {running_sql('zs', 6)} SELECT image_id, sum((zs[k + 1] >> bypass) + 1 + bypass) / 512.0::DOUBLE AS size FROM (SELECT *, CAST(floor(log2((state >> 6) + 1)) AS INT) AS bypass FROM st WHERE k < 64) GROUP BY image_id",
)
register("c14_model_view", lambda s, d: contexts.model_view(px(s, d)).select("image_id", "ctx", "n", *[F.round(c, 6).alias(c) for c in ("bits", "mean", "sdev", "model_bits")], "header_bits"), f"""{ZS}, {running_sql('zs')}, {CTX['magnitude']}, {HIST}, {COSTS},
    moments AS (SELECT image_id, ctx, sum(freq * (level + 128)) / sum(freq)::DOUBLE AS mean FROM hist GROUP BY ALL),
    spread AS (SELECT image_id, ctx, any_value(mean) AS mean, sqrt(sum(freq * (level + 128 - mean) * (level + 128 - mean)) / sum(freq)) AS sdev FROM hist JOIN moments USING (image_id, ctx) GROUP BY ALL),
    bell AS (SELECT image_id, ctx, lv - 128 AS level, floor(exp(-((lv - mean) / sdev) * ((lv - mean) / sdev)) * 65536) AS b FROM spread, (SELECT unnest(range(0, 256)) AS lv) WHERE sdev > 0),
    widths AS (SELECT image_id, ctx, sum(b) AS all_b FROM bell GROUP BY ALL),
    crossed AS (SELECT image_id, ctx, sum(CASE WHEN b > 0 THEN -freq * log2(b / all_b) ELSE 0 END) AS model_bits FROM hist JOIN bell USING (image_id, ctx, level) JOIN widths USING (image_id, ctx) GROUP BY ALL)
    SELECT image_id, ctx, n, round(c.bits, 6) AS bits, round(mean, 6) AS mean, round(sdev, 6) AS sdev, round(model_bits, 6) AS model_bits, h.bits AS header_bits
    FROM total JOIN coded c USING (image_id, ctx) JOIN header h USING (image_id, ctx) JOIN spread USING (image_id, ctx) LEFT JOIN crossed USING (image_id, ctx)""")  # fmt: skip


def _binary_sql(order: int) -> str:
    ctx = "(west + CASE WHEN y > 0 THEN north - corner ELSE 0 END) & 255" if order else "0"
    return f"""WITH RECURSIVE {v.PLANES}, around AS (SELECT image_id, y, x, v, lag(v, 1, 0) OVER r AS west, CASE WHEN x > 0 THEN lag(v, 1, 0) OVER c ELSE 0 END AS north FROM planes WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
    cornered AS (SELECT *, lag(north, 1, 0) OVER (PARTITION BY image_id, y ORDER BY x) AS corner FROM around),
    bit AS (SELECT image_id, y * 8 + x AS pos, {ctx} AS ctx, (v & 255) AS u, k, (v >> (7 - k)) & 1 AS bit FROM cornered, (SELECT unnest(range(0, 8)) AS k)),
    node AS (SELECT *, (1 << k) + (u >> (8 - k)) AS node FROM bit),
    visit AS (SELECT *, row_number() OVER (PARTITION BY image_id, ctx, node ORDER BY pos) AS nth FROM node),
    prob AS (SELECT image_id, ctx, node, nth, bit, CAST(32768 AS BIGINT) AS p FROM visit WHERE nth = 1
        UNION ALL SELECT n.image_id, n.ctx, n.node, n.nth, n.bit, o.p + (((1 - o.bit) * 65536 - o.p + 64) >> 7) FROM (SELECT image_id, ctx, node, nth, bit, greatest(16, least(65520, p)) AS p FROM prob) o JOIN visit n ON n.image_id = o.image_id AND n.ctx = o.ctx AND n.node = o.node AND n.nth = o.nth + 1),
    coded AS (SELECT image_id, list({{'p': CAST(greatest(16, least(65520, p)) AS HUGEINT), 'bit': v.bit}} ORDER BY pos, k) AS cs FROM visit v JOIN prob USING (image_id, ctx, node, nth) GROUP BY image_id),
    coder AS (SELECT image_id, 0 AS i, CAST(0 AS HUGEINT) AS low, CAST(4294967295 AS HUGEINT) AS span, 0 AS words FROM coded
        UNION ALL SELECT image_id, i + 1, CASE WHEN bit = 1 THEN low + part ELSE low END, CASE WHEN bit = 1 THEN span - part ELSE part - 1 END, words
        FROM (SELECT *, span * cs[i + 1].p // 65536 AS part, cs[i + 1].bit AS bit FROM (
            SELECT image_id, i, cs, CASE WHEN span < 65536 THEN low * 4294967296 % 18446744073709551616 ELSE low END AS low,
                CASE WHEN span < 65536 THEN least(span * 4294967296 + 4294967295, 18446744073709551615 - low * 4294967296 % 18446744073709551616) ELSE span END AS span, words + CASE WHEN span < 65536 THEN 1 ELSE 0 END AS words
            FROM coder JOIN coded USING (image_id) WHERE i < 512)))
    SELECT image_id, words * 32 / 512.0::DOUBLE AS size FROM coder WHERE i = 512"""


for _order in (0, 1):
    register(f"c13_abac{_order}", _size(f"c13_abac{_order}"), _binary_sql(_order))

_TOKEN = "(CASE WHEN {0} < 16 THEN {0} ELSE 16 + (CAST(floor(log2(greatest({0}, 1))) AS INT) - 4) * 2 + (({0} - (1 << CAST(floor(log2(greatest({0}, 1))) AS INT))) >> greatest(0, CAST(floor(log2(greatest({0}, 1))) AS INT) - 1)) END)"


def _tok(e: str) -> str:
    return _TOKEN.format(f"(CASE WHEN ({e}) < 0 THEN -2 * ({e}) - 1 ELSE 2 * ({e}) END)")


_CHANGES = {"W": "W - WW", "NW": "NW - NNWW", "N": "N - NN", "NE": "NE - NNEE"}
_LEAST = "least(" + ", ".join(f"abs({e})" for e in _CHANGES.values()) + ")"
_TOKEN_CONTEXTS = {
    "qnw": _tok("(N + W) >> 1"),
    "max_qn_qw": f"greatest({_tok('(W - WW) >> 1')}, {_tok('(N - NN) >> 1')})",
    "min_qn_qw": f"least({_tok('(W - WW) >> 1')}, {_tok('(N - NN) >> 1')})",
    "min_n_w_nw_ne": "least(" + ", ".join(_tok(f"({e}) >> 1") for e in _CHANGES.values()) + ")",
    "argmin_n_w_nw_ne": _tok("CASE " + " ".join(f"WHEN abs({e}) = {_LEAST} THEN {k}" for k, e in _CHANGES.items()) + " END"),
    "zero": "0",
}
_NEAR = ("N", "W", "NW", "NE", "NN", "WW", "NNWW", "NNEE")
for _name, _ctx in _TOKEN_CONTEXTS.items():
    # planes of 64 samples never reach the count that halves; a test of the operator does
    register(f"c07_adaptive_{_name}", _size(f"c07_adaptive_{_name}"), f"""WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes', _NEAR)}), z AS (SELECT image_id, y, x, v, {_ctx} AS ctx, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z FROM n),
        t AS (SELECT *, {_TOKEN.format('z')} AS tok, CASE WHEN z < 16 THEN 0 ELSE CAST(floor(log2(z)) AS INT) - 1 END AS bypass FROM z),
        c AS (SELECT image_id, v, bypass, count(*) OVER (PARTITION BY image_id, ctx, tok ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same, count(*) OVER (PARTITION BY image_id, ctx ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t)
        SELECT image_id, round(CASE WHEN min(v) = max(v) THEN 8 ELSE sum(bypass - log2((1 + same) / (27.0::DOUBLE + seen))) END / 512, 6) AS size FROM c GROUP BY image_id""")


# --- colour analyses


def images(s, d):
    return v.rgb_bytes(s, d)


def _channels_sql() -> str:
    ch = "rgb"
    rows = []
    for a, b, over in analysis.OFFSETS:
        for c in range(3):
            rows.append((ch[c], f"({a} * {ch[(c + 1) % 3]} + {b} * {ch[(c + 2) % 3]}) // {over}"))
    parts = " UNION ALL ".join(f"SELECT image_id * 18 + {k} AS image_id, y, x, {t} AS t, CAST({o} AS BIGINT) AS o, CAST({t} - {o} AS BIGINT) AS v FROM rgb" for k, (t, o) in enumerate(rows))
    o, n = predict.Sql("duck"), {k: predict.Text(k) for k in analysis.AT}
    syms = ", ".join(f"CAST({analysis.wrapped(o, predict.Text('t'), p(o, n), predict.Text('o'))} AS BIGINT)" for p in analysis.PREDICTORS)
    return f"""WITH {v.RGB}, sig AS ({parts}), n AS ({predict.neighbours_sql('sig', tuple(analysis.AT))}),
        l AS (SELECT image_id, unnest(range(0, 12))::INT AS pred, unnest([{syms}]) AS sym FROM n WHERE x >= 2 AND x < 6 AND y >= 2),
        h AS (SELECT image_id, pred, sym, count(*) AS f FROM l GROUP BY ALL),
        e AS (SELECT image_id, pred, round(sum(-f * log2(f / 24.0::DOUBLE)) / 24 / 8, 9) AS size FROM h GROUP BY image_id, pred),
        best AS (SELECT image_id // 18 AS image_id, image_id % 18 AS ch, arg_min(pred, (size, pred)) AS pred, min(size) AS size FROM e GROUP BY image_id)"""


register(
    "c18_o04_best_predictor",
    lambda s, d: analysis.best_predictors(images(s, d)),
    f"{_channels_sql()} SELECT image_id, list_value({', '.join(map(repr, analysis.CHANNELS))})[ch + 1] AS channel, pred, round(size, 6) AS size FROM best",
)
_C18_RECIPES = ", ".join("({}, {!r}, {})".format(i, r, ", ".join(str(analysis.CHANNELS.index(c)) for c in r.split())) for i, r in enumerate(analysis.RECIPES))
register("c18_recipe", lambda s, d: analysis.best_recipe(images(s, d)), f"""{_channels_sql()}, rec(k, name, a, b, c) AS (VALUES {_C18_RECIPES}),
    sums AS (SELECT x.image_id, k, name, x.pred || ' ' || y.pred || ' ' || z.pred AS preds, round(x.size + y.size + z.size, 9) AS total FROM rec JOIN best x ON x.ch = a JOIN best y ON y.ch = b AND y.image_id = x.image_id JOIN best z ON z.ch = c AND z.image_id = x.image_id)
    SELECT image_id, arg_min(name, (total, k)) AS recipe, arg_min(preds, (total, k)) AS preds, round(min(total) / 3, 6) AS size FROM sums GROUP BY image_id""")  # fmt: skip

_SIGNALS = ("r", "g", "b", "r - g", "g - b", "b - r")
_SIGNAL_ROWS = " UNION ALL ".join(f"SELECT image_id * 6 + {k} AS image_id, y, x, {e} AS v FROM rgb" for k, e in enumerate(_SIGNALS))
_COSTS = "[" + ", ".join("round(" + " + ".join(f"q{analysis.SIGNAL_OF[c]}" for c in r) + ", 9)" for r in color.RECIPES) + "]"
_GRADIENT = "greatest(least(N, W), least(greatest(N, W), N + W - NW))"
register("c04_entropy_recipe", lambda s, d: analysis.entropy_recipe(images(s, d)), f"""WITH {v.RGB}, sig AS ({_SIGNAL_ROWS}), n AS ({predict.neighbours_sql('sig', ('N', 'W', 'NW'))}),
    h AS (SELECT image_id, (v - {_GRADIENT} + 128) & 255 AS sym, count(*) AS f FROM n GROUP BY ALL), e AS (SELECT image_id // 6 AS image_id, image_id % 6 AS k, sum(-f * log2(f / 64.0::DOUBLE)) / 8 AS size FROM h GROUP BY ALL),
    w AS (SELECT image_id, {', '.join(f'sum(CASE WHEN k = {k} THEN size END) AS q{k}' for k in range(6))} FROM e GROUP BY image_id)
    SELECT image_id, CAST(list_position({_COSTS}, list_min({_COSTS})) - 1 AS INT) AS recipe, round(list_min({_COSTS}), 6) AS size FROM w""")  # fmt: skip


def _bpd_sql() -> str:
    names = ["r", "g", "b", "(r - g)", "(g - b)", "(b - r)"]
    lags = ", ".join(f"abs({x} - lag({x}, 1, 0) OVER w) AS q{i}" for i, x in enumerate(names))
    costs = "[" + ", ".join(" + ".join(f"q{analysis.SIGNAL_OF[c]}" for c in r) for r in color.RECIPES) + "]"
    rows = []
    for k, recipe in enumerate(color.RECIPES):
        for c, name in enumerate(recipe):
            t, _, o = name.partition("-")
            rows.append(f"SELECT image_id * 3 + {c} AS image_id, y, x, {t} AS t, {o or 0} AS o, {t} - {o or 0} AS v FROM rgb JOIN chosen USING (image_id) WHERE recipe = {k}")
    return f"""WITH RECURSIVE {v.RGB}, p AS (SELECT image_id, {lags} FROM rgb WINDOW w AS (PARTITION BY image_id ORDER BY y, x)),
        s AS (SELECT image_id, {', '.join(f'CAST(sum(q{i}) AS BIGINT) AS q{i}' for i in range(6))} FROM p GROUP BY image_id), chosen AS (SELECT image_id, CAST(list_position({costs}, list_min({costs})) - 1 AS INT) AS recipe FROM s),
        sig AS ({' UNION ALL '.join(rows)}), n AS ({predict.neighbours_sql('sig', ('N', 'W', 'NW'))}),
        res AS (SELECT image_id, y, x, ((t - least(127, greatest(-128, {_GRADIENT} + o)) + 128) & 255) - 128 AS e FROM n),
        zs AS (SELECT image_id, list(CAST(CASE WHEN e < 0 THEN -2 * e - 1 ELSE 2 * e END AS BIGINT) ORDER BY y, x) AS zs FROM res GROUP BY image_id), {running_sql('zs', 3, (3, 3))},
        c AS (SELECT image_id, least(17, {LG.format('state')}) AS ctx, zs[k + 1] AS sym, count(*) AS f FROM st WHERE k < 64 GROUP BY ALL),
        b AS (SELECT image_id // 3 AS image_id, sum(-f * log2(f / n)) AS bits FROM (SELECT *, sum(f) OVER (PARTITION BY image_id, ctx) AS n FROM c) GROUP BY ALL)
        SELECT image_id, recipe, round(bits / 192, 6) AS bpd FROM b JOIN chosen USING (image_id)"""


register("c19_bpd0", lambda s, d: analysis.bits_per_sample(images(s, d)), _bpd_sql())


# --- rate and distortion

#: Steps of the quantiser that stand for qualities.
QUALITIES = (2, 4, 8, 16, 32)


def _curve(s, d):
    """Q-17: each image at several qualities against the curve; the best segment of each, summed over qualities."""
    planes = v.planes(s, d)
    rows = planes.withColumn("q", F.explode(F.array(*map(F.lit, QUALITIES)))).withColumn("w", F.col("v") - F.col("v") % F.col("q"))
    points = rows.groupBy("image_id", "q").agg((F.countDistinct("w") / 64.0).alias("bps"), metrics.psnr(F.sum((F.col("v") - F.col("w")) ** 2) / F.count("*"), 255.0).alias("psnr"))
    return metrics.curve_score(points.where("psnr is not null"), "image_id").select("image_id", "n", F.round("score", 6).alias("score"))


def _curve_sql() -> str:
    parts = []
    for (x0, y0), (x1, y1) in zip(metrics.CURVE, metrics.CURVE[1:]):
        parts.append(f"((psnr - {y0}::DOUBLE) * {x1 - x0!r}::DOUBLE - (bps - {x0}::DOUBLE) * {y1 - y0!r}::DOUBLE) / {((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5!r}::DOUBLE")
    return f"""WITH {v.PLANES}, e AS (SELECT image_id, q, v, v % q AS lost, v - v % q AS w FROM planes, (SELECT unnest([{', '.join(map(str, QUALITIES))}]) AS q)),
        pt AS (SELECT image_id, q, count(DISTINCT w) / 64.0::DOUBLE AS bps, CASE WHEN sum(lost * lost) > 0 THEN 10 * log10(65025.0 / (sum(lost * lost) / count(*))) END AS psnr FROM e GROUP BY ALL)
        SELECT image_id, count(*) AS n, round(sum(greatest({', '.join(parts)})), 6) AS score FROM pt WHERE psnr IS NOT NULL GROUP BY image_id"""


register("q17_curve_score", _curve, _curve_sql())


def _channels(s, d):
    """A-16: per channel, 8 / entropy and the number of levels; and of whole colours."""
    px = v.rgb(s, d)
    long = px.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("level")) for c in "rgb"], F.struct(F.lit("rgb").alias("channel"), F.expr("((r + 128) * 256 + g + 128) * 256 + b + 128").alias("level")))).alias("p"))
    hist = long.groupBy("image_id", "p.channel", "p.level").agg(F.count("*").alias("f"))
    per = hist.groupBy("image_id", "channel").agg(F.sum("f").alias("n"), F.sum(F.col("f") * F.log2("f")).alias("flogf"), F.count("*").alias("levels"))
    bits = F.log2("n") - F.col("flogf") / F.col("n")
    return per.select("image_id", "channel", "levels", F.round(F.when(bits > 1e-9, F.when(F.col("channel") == "rgb", 24).otherwise(8) / bits), 6).alias("ratio"))


register("a16_channel_ratios", _channels, f"""WITH {v.RGB}, l AS (SELECT image_id, unnest(['r', 'g', 'b', 'rgb']) AS channel, unnest([r, g, b, ((r + 128) * 256 + g + 128) * 256 + b + 128]) AS level FROM rgb),
    h AS (SELECT image_id, channel, level, count(*) AS f FROM l GROUP BY ALL), e AS (SELECT image_id, channel, count(*) AS levels, log2(sum(f)) - sum(f * log2(f)) / sum(f) AS bits FROM h GROUP BY ALL)
    SELECT image_id, channel, levels, round(CASE WHEN bits > 1e-9 THEN CASE WHEN channel = 'rgb' THEN 24 ELSE 8 END / bits END, 6) AS ratio FROM e""")  # fmt: skip


def _blocks(s, d):
    """C-20: bits of a plane under one histogram, under one per block of 4 x 4 samples, and under a block's histogram mixed
    with that of the blocks before it."""
    w = Window.partitionBy("image_id", "v").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    hist = v.planes(s, d).withColumn("block", F.expr("cast(y div 4 * 2 + x div 4 as int)")).groupBy("image_id", "block", "v").agg(F.count("*").alias("f"))
    hist = hist.withColumn("before", F.coalesce(F.sum("f").over(w), F.lit(0))).withColumn("all", F.sum("f").over(Window.partitionBy("image_id", "v")))
    bits = {"whole": -F.col("f") * F.log2(F.col("all") / 64.0), "blocks": -F.col("f") * F.log2(F.col("f") / 16.0), "mixed": -F.col("f") * F.log2((F.col("f") + F.col("before")) / (16.0 + 16.0 * F.col("block")))}
    return hist.groupBy("image_id").agg(*[F.round(F.sum(e), 6).alias(k) for k, e in bits.items()])


register("c20_block_sizes", _blocks, f"""WITH {v.PLANES}, h AS (SELECT image_id, CAST(y // 4 * 2 + x // 4 AS INT) AS block, v, count(*) AS f FROM planes GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY image_id, v ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(f) OVER (PARTITION BY image_id, v) AS everywhere FROM h)
    SELECT image_id, round(sum(-f * log2(everywhere / 64.0::DOUBLE)), 6) AS whole, round(sum(-f * log2(f / 16.0::DOUBLE)), 6) AS blocks, round(sum(-f * log2((f + before) / (16.0::DOUBLE + 16 * block))), 6) AS mixed FROM b GROUP BY image_id""")  # fmt: skip
