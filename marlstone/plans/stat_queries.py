"""Registered queries over histograms, entropies and context models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import predict, stats
from ..sources import views as v
from .registry import register


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _byte_entropy(s, d):
    blobs = v.texts(s, d)
    zero = stats.entropy(stats.byte_histogram(blobs, "source"), ["source"]).select("source", F.col("count").alias("n_bytes"), F.round(F.col("bits") / 8, 4).alias("order0"))
    one = stats.entropy(stats.byte_histogram(blobs, "source", 1), ["source"], ["prev"]).select("source", F.round(F.col("bits") / 8, 4).alias("order1"))
    return zero.join(one, "source").withColumn("percent0", F.round(100 * F.col("order0") / F.col("n_bytes"), 4))


register("a11_a12_byte_entropy", _byte_entropy, f"""WITH {v.BYTES}, pairs AS (SELECT source, sym, lag(sym, 1, 0) OVER (PARTITION BY blob_id ORDER BY pos) AS prev FROM bytes),
    h AS (SELECT source, prev, sym, count(*) AS f FROM pairs GROUP BY ALL),
    h0 AS (SELECT source, sym, sum(f) AS f FROM h GROUP BY ALL),
    e0 AS (SELECT source, sum(f) AS n, sum(-f * log2(f / n)) / 8 AS b FROM (SELECT *, sum(f) OVER (PARTITION BY source) AS n FROM h0) GROUP BY source),
    e1 AS (SELECT source, sum(-f * log2(f / n)) / 8 AS b FROM (SELECT *, sum(f) OVER (PARTITION BY source, prev) AS n FROM h) GROUP BY source)
    SELECT e0.source, CAST(e0.n AS BIGINT) AS n_bytes, round(e0.b, 4) AS order0, round(e1.b, 4) AS order1, round(100 * round(e0.b, 4) / e0.n, 4) AS percent0 FROM e0 JOIN e1 USING (source)""")
register("a13_u16_entropy", lambda s, d: stats.entropy(stats.pair_histogram(v.texts(s, d), "source"), ["source"]).select("source", F.col("count").alias("n_words"), F.round(F.col("bits") / 8, 4).alias("order0")), f"""WITH {v.BYTES}, w AS (SELECT source, blob_id, pos // 2 AS k, sum(CASE WHEN pos % 2 = 0 THEN sym ELSE sym * 256 END) AS sym FROM bytes GROUP BY ALL HAVING count(*) = 2),
    h AS (SELECT source, sym, count(*) AS f FROM w GROUP BY ALL) SELECT source, CAST(sum(f) AS BIGINT) AS n_words, round(sum(-f * log2(f / n)) / 8, 4) AS order0 FROM (SELECT *, sum(f) OVER (PARTITION BY source) AS n FROM h) GROUP BY source""")


def _hist(s, d):
    return v.planes(s, d).groupBy("image_id", F.col("v").alias("sym")).agg(F.count("*").alias("freq"))


HIST = v.PLANES + ", hist AS (SELECT image_id, v AS sym, count(*) AS freq FROM planes GROUP BY image_id, v)"
register(
    "a07_histogram",
    lambda s, d: v.planes(s, d).where("x between 1 and 6 and y between 1 and 6").groupBy(F.col("v").alias("sym")).agg(F.count("*").alias("freq"), F.countDistinct("image_id").alias("n_images")),
    f"WITH {v.PLANES} SELECT v AS sym, count(*) AS freq, count(DISTINCT image_id) AS n_images FROM planes WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY v",
)
register(
    "a08_c01_entropy",
    lambda s, d: stats.entropy(_hist(s, d), ["image_id"]).select("image_id", F.round(F.col("bits") / (F.col("count") * 8), 6).alias("size")),
    f"WITH {HIST} SELECT image_id, round(sum(-freq * log2(freq / n)) / (sum(freq) * 8), 6) AS size FROM (SELECT *, sum(freq) OVER (PARTITION BY image_id) AS n FROM hist) GROUP BY image_id",
)
register(
    "a09_depth",
    lambda s, d: v.planes(s, d).groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select("image_id", "lo", "hi", stats.depth_of(F.col("lo"), F.col("hi"), 1).alias("depth")),
    f"WITH {v.PLANES} SELECT image_id, min(v) AS lo, max(v) AS hi, greatest(1, CAST(ceil(log2(2 * greatest(max(v) + 1, abs(min(v))))) AS INT)) AS depth FROM planes GROUP BY image_id",
)
register(
    "a14_star_histogram",
    lambda s, d: stats.star_histogram(stats.byte_histogram(v.texts(s, d).withColumn("all", F.lit(0)), "all").select("sym", "freq")),
    f"WITH {v.BYTES}, h AS (SELECT CAST(sym AS INT) AS sym, count(*) AS freq FROM bytes GROUP BY sym) SELECT sym, freq, CAST(freq * 96 // max(freq) OVER () AS INT) AS stars, repeat('*', CAST(freq * 96 // max(freq) OVER () AS INT)) AS bar FROM h",
)
register(
    "a15_moments",
    lambda s, d: stats.moments(v.planes(s, d)).select("image_id", *r6("mean", "sdev", "mad")),
    f"WITH {v.PLANES}, m AS (SELECT image_id, v, avg(v) OVER (PARTITION BY image_id) AS mean FROM planes) SELECT image_id, round(any_value(mean), 6) AS mean, round(sqrt(sum(pow(v - mean, 2)) / (count(*) - 1)), 6) AS sdev, round(sum(abs(v - mean)) / (count(*) - 1), 6) AS mad FROM m GROUP BY image_id",
)
_FIT = "sum(least(256.0{D}, -log2(greatest(exp(-pow((v - mean) / sdev, 2)) / (sdev * 2.5066282746310002{D}), 1e-70{D})))) / 8"
_LAP = "sum(least(256.0{D}, -log2(greatest(exp(-abs(v - mean) / mad) / (2 * mad), 1e-70{D})))) / 8"
register("a15_fit", lambda s, d: v.planes(s, d).join(stats.moments(v.planes(s, d)).where("sdev > 0 and mad > 0"), "image_id").groupBy("image_id").agg(F.round(F.expr(_FIT.replace("{D}", "D")), 4).alias("gauss_bytes"), F.round(F.expr(_LAP.replace("{D}", "D")), 4).alias("laplace_bytes")),
         f"WITH {v.PLANES}, m0 AS (SELECT *, avg(v) OVER (PARTITION BY image_id) AS mean FROM planes), m AS (SELECT *, sqrt(sum(pow(v - mean, 2)) OVER w / (count(*) OVER w - 1)) AS sdev, sum(abs(v - mean)) OVER w / (count(*) OVER w - 1) AS mad FROM m0 WINDOW w AS (PARTITION BY image_id)) SELECT image_id, round({_FIT.replace('{D}', '::DOUBLE')}, 4) AS gauss_bytes, round({_LAP.replace('{D}', '::DOUBLE')}, 4) AS laplace_bytes FROM m WHERE sdev > 0 AND mad > 0 GROUP BY image_id")
register("a16_channel_entropy", lambda s, d: v.rgb(s, d).groupBy(((F.col("r") + 128) * 65536 + (F.col("g") + 128) * 256 + F.col("b") + 128).alias("color")).agg(F.count("*").alias("freq")).select(F.lit(1).alias("one"), "color", "freq").transform(lambda h: stats.entropy(h, ["one"]).select(F.round(24 * F.col("count") / F.col("bits"), 6).alias("ratio"), "count").join(h.agg(F.count("*").alias("colors")))),
         f"WITH {v.RGB}, h AS (SELECT (r + 128) * 65536 + (g + 128) * 256 + b + 128 AS color, count(*) AS freq FROM rgb GROUP BY 1) SELECT round(24 * sum(freq) / sum(-freq * log2(freq / n)), 6) AS ratio, CAST(sum(freq) AS BIGINT) AS count, count(*) AS colors FROM (SELECT *, sum(freq) OVER () AS n FROM h)")
for _mode, _parts in {"color": ("r", "g", "b"), "cww": ("v", "W", "WW"), "cnn": ("v", "N", "NN"), "cnw": ("v", "N", "W")}.items():
    _key = " + ".join(f"((({c} + 128) >> 4) << {4 * i})" for i, c in enumerate(_parts))
    if _mode == "color":
        register(
            "a17_joint_histogram_color",
            lambda s, d, k=_key: v.rgb(s, d).groupBy(F.expr(k).cast("long").alias("cell")).agg(F.count("*").alias("freq")),
            f"WITH {v.RGB} SELECT {_key} AS cell, count(*) AS freq FROM rgb GROUP BY 1",
        )
    else:
        register(
            f"a17_joint_histogram_{_mode}",
            lambda s, d, k=_key, p=_parts: predict.with_neighbours(v.planes(s, d), p[1:]).groupBy(F.expr(k).cast("long").alias("cell")).agg(F.count("*").alias("freq")),
            f"WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes', _parts[1:])}) SELECT {_key} AS cell, count(*) AS freq FROM n GROUP BY 1",
        )
register(
    "a18_pair_histogram",
    lambda s, d: predict.with_neighbours(v.planes(s, d), ("W", "N")).groupBy("v", "W").agg(F.count("*").alias("freq"), F.sum("N").alias("sum_n")),
    f"WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes', ('W', 'N'))}) SELECT v, W, count(*) AS freq, CAST(sum(N) AS BIGINT) AS sum_n FROM n GROUP BY v, W",
)


def _grouped_entropy(bin_sql, name, where="true", duck=None):
    """Mean over bins of the order-0 entropy of each bin, over 8 bits."""
    register(name, lambda s, d: stats.entropy(v.planes(s, d).where(where).groupBy("image_id", F.expr(bin_sql).alias("bin"), F.col("v").alias("sym")).agg(F.count("*").alias("freq")), ["image_id", "bin"]).groupBy("image_id").agg(F.round(F.avg(F.col("bits") / F.col("count")) / 8, 6).alias("size"), F.count("*").alias("bins")),
             f"WITH {v.PLANES}, h AS (SELECT image_id, {duck or bin_sql} AS bin, v, count(*) AS f FROM planes WHERE {where} GROUP BY ALL), e AS (SELECT image_id, bin, sum(-f * log2(f / n)) / sum(f) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY image_id, bin) AS n FROM h) GROUP BY image_id, bin) SELECT image_id, round(avg(e) / 8, 6) AS size, count(*) AS bins FROM e GROUP BY image_id")


_grouped_entropy("cast(x >= 4 as int) + 2 * cast(y >= 4 as int)", "a20_c12_quadrant_entropy")
_grouped_entropy("x % 2 + 2 * (y % 2)", "a21_c12_polyphase_entropy", "x < 7 and y < 7")
_grouped_entropy("case when image_id % 3 = 0 then cast(x % 8 + y % 8 = 0 as int) else 2 + cast(x % 2 = 0 and y % 2 = 0 as int) end", "a22_c12_yuv420_bins")
_grouped_entropy("case when image_id % 3 = 0 then cast(x % 8 + y % 8 = 0 as int) else 2 + cast(x % 2 = 0 as int) end", "a22_c12_yuv422_bins")
register("a23_bayes_counters", lambda s, d: predict.with_neighbours(v.planes(s, d), ("N", "W")).select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"), ((F.col("v") + 128)).alias("u"), F.expr("((N + 128) >> 6) * 4 + ((W + 128) >> 6)").alias("ctx")).groupBy("bit", F.col("ctx").cast("long").alias("ctx")).agg(F.sum(F.expr("(u >> bit) & 1")).alias("ones"), F.count("*").alias("n")),
         f"WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes', ('N', 'W'))}), e AS (SELECT unnest(range(0, 8))::INT AS bit, v + 128 AS u, ((N + 128) >> 6) * 4 + ((W + 128) >> 6) AS ctx FROM n) SELECT bit, ctx, CAST(sum((u >> bit) & 1) AS BIGINT) AS ones, count(*) AS n FROM e GROUP BY bit, ctx")
register(
    "a24_quantile_cuts",
    lambda s, d: stats.quantile_cuts(_hist(s, d), 4),
    f"WITH {HIST}, c AS (SELECT image_id, sym, sum(freq) OVER (PARTITION BY image_id ORDER BY sym) AS cum, sum(freq) OVER (PARTITION BY image_id) AS n FROM hist) SELECT image_id, CAST(k AS INT) AS k, min(sym) AS cut FROM c, range(1, 4) t(k) WHERE cum * 4 >= k * n GROUP BY image_id, k",
)
register(
    "a25_covariance",
    lambda s, d: v.rgb(s, d).agg(*[F.round(F.covar_pop(a, b), 4).alias(f"c_{a}{b}") for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")]),
    f"WITH {v.RGB} SELECT " + ", ".join(f"round(covar_pop({a}, {b}), 4) AS c_{a}{b}" for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")) + " FROM rgb",
)
register(
    "w18_quantised_cdf",
    lambda s, d: stats.quantised_cdf(_hist(s, d)),
    f"WITH {HIST} SELECT image_id, sym, CAST(coalesce(sum(freq) OVER (PARTITION BY image_id ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (4096 - count(*) OVER (PARTITION BY image_id)) // sum(freq) OVER (PARTITION BY image_id) + row_number() OVER (PARTITION BY image_id ORDER BY sym) - 1 AS BIGINT) AS cdf FROM hist",
)
register("c02_order1_size", lambda s, d: stats.entropy(v.planes(s, d).select("image_id", "v", F.lag("v", 1, 0).over(Window.partitionBy("image_id", "y").orderBy("x")).alias("ctx")).groupBy("image_id", "ctx", "v").agg(F.count("*").alias("freq")), ["image_id", "ctx"]).groupBy("image_id").agg(F.round((F.sum("bits") + F.count("*") * 84 * 8) / (F.sum("count") * 8), 6).alias("size")),
         f"WITH {v.PLANES}, p AS (SELECT image_id, v, lag(v, 1, 0) OVER (PARTITION BY image_id, y ORDER BY x) AS ctx FROM planes), h AS (SELECT image_id, ctx, v, count(*) AS f FROM p GROUP BY ALL) SELECT image_id, round((sum(-f * log2(f / n)) + count(DISTINCT ctx) * 84 * 8) / (sum(f) * 8), 6) AS size FROM (SELECT *, sum(f) OVER (PARTITION BY image_id, ctx) AS n FROM h) GROUP BY image_id")

#: C-05: context functions over the magnitudes of causal neighbours (named by what they compute).
CONTEXTS = {
    "qnw": "least(15, (abs(N) + abs(W)) >> 2)", "max_qn_qw": "least(15, greatest(abs(N), abs(W)) >> 1)", "min_qn_qw": "least(15, least(abs(N), abs(W)) >> 1)",
    "min_n_w_nw_ne": "least(15, least(abs(N), abs(W), abs(NW), abs(NE)) >> 1)", "argmin_n_w_nw_ne": "case when abs(N) <= least(abs(W), abs(NW), abs(NE)) then 0 when abs(W) <= least(abs(NW), abs(NE)) then 1 when abs(NW) <= abs(NE) then 2 else 3 end", "zero": "0",
}
for _name, _ctx in CONTEXTS.items():

    def _context(s, d, c=_ctx):
        p = predict.with_neighbours(v.planes(s, d), ("N", "W", "NW", "NE")).withColumn("z", F.expr("case when v < 0 then -2 * v - 1 else 2 * v end"))
        tok, low = stats.token(F.col("z"))
        h = p.select("image_id", F.expr(c).cast("long").alias("ctx"), tok.alias("sym"), low.alias("low")).groupBy("image_id", "ctx", "sym").agg(F.count("*").alias("freq"), F.sum("low").alias("bypass"))
        e = h.withColumn("n", F.sum("freq").over(Window.partitionBy("image_id", "ctx")))
        return e.groupBy("image_id").agg(F.round((F.sum(stats.bits("freq", "n")) + F.sum("bypass")) / (F.sum("freq") * 8), 6).alias("size"))

    register(f"c05_c06_{_name}", _context, f"""WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes', ('N', 'W', 'NW', 'NE'))}), z AS (SELECT image_id, {_ctx} AS ctx, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z FROM n),
        l AS (SELECT *, CAST(floor(log2(greatest(z, 1))) AS INT) AS lg FROM z), t AS (SELECT image_id, ctx, CASE WHEN z < 16 THEN z ELSE 16 + (lg - 4) * 2 + ((z - (1 << lg)) >> (lg - 1)) END AS sym, CASE WHEN z < 16 THEN 0 ELSE lg - 1 END AS low FROM l),
        h AS (SELECT image_id, ctx, sym, count(*) AS f, sum(low) AS bypass FROM t GROUP BY ALL) SELECT image_id, round((sum(-f * log2(f / n)) + sum(bypass)) / (sum(f) * 8), 6) AS size FROM (SELECT *, sum(f) OVER (PARTITION BY image_id, ctx) AS n FROM h) GROUP BY image_id""")

register("c15_c16_cscore", lambda s, d: stats.cscore(v.planes(s, d)), f"""WITH {v.PLANES}, p AS (SELECT image_id, v + 128 AS u, lag(v + 128, 1, 0) OVER w AS W, lag(v + 128, 8, 0) OVER w AS N, lag(v + 128, 9, 0) OVER w AS NW FROM planes WINDOW w AS (PARTITION BY image_id ORDER BY y, x)),
    h AS (SELECT image_id, (u - greatest(least(N, W), least(greatest(N, W), N + W - NW))) & 255 AS sym, count(*) AS f FROM p GROUP BY ALL) SELECT image_id, CAST(round(sum(-f * log2(f / n)) / sum(f) * 1e6 / 8) AS BIGINT) AS cscore FROM (SELECT *, sum(f) OVER (PARTITION BY image_id) AS n FROM h) GROUP BY image_id""")
register(
    "c17_wav_cscore",
    lambda s, d: stats.wav_cscore(v.pcm(s, d)),
    f"WITH {v.PCM}, p AS (SELECT track_id, (sample - lag(sample, 1, 0) OVER (PARTITION BY track_id ORDER BY pos)) & 65535 AS sym FROM pcm), h AS (SELECT track_id, sym, count(*) AS f FROM p GROUP BY ALL) SELECT track_id, CAST(round(sum(-f * log2(f / n)) / (sum(f) * 2)) AS BIGINT) AS cscore FROM (SELECT *, sum(f) OVER (PARTITION BY track_id) AS n FROM h) GROUP BY track_id",
)
register(
    "j08_self_information",
    lambda s, d: v.planes(s, d).withColumn("f", F.count("*").over(Window.partitionBy("image_id", "v"))).groupBy("image_id").agg(F.round(F.sum(-F.log2(F.col("f") / 64)), 6).alias("bits"), F.max("f").alias("peak")),
    f"WITH {v.PLANES}, p AS (SELECT image_id, count(*) OVER (PARTITION BY image_id, v) AS f FROM planes) SELECT image_id, round(sum(-log2(f / 64)), 6) AS bits, max(f) AS peak FROM p GROUP BY image_id",
)
register(
    "p09_constant_planes",
    lambda s, d: v.planes(s, d).withColumn("v", F.when(F.col("image_id") % 5 == 0, 7).otherwise(F.col("v"))).groupBy("image_id").agg((F.min("v") == F.max("v")).alias("constant"), F.when(F.min("v") == F.max("v"), 8).otherwise(0).alias("bypass_bits")),
    f"WITH {v.PLANES}, p AS (SELECT image_id, CASE WHEN image_id % 5 = 0 THEN 7 ELSE v END AS v FROM planes) SELECT image_id, min(v) = max(v) AS constant, CASE WHEN min(v) = max(v) THEN 8 ELSE 0 END AS bypass_bits FROM p GROUP BY image_id",
)

def _filters(s, d):
    """W-16, T-47, T-48: separable 3 x 3 median and truncated 3 x 3 mean, 0 outside."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    p = v.planes(s, d).repartition("image_id").select("image_id", "y", "x", F.lag("v", 1, 0).over(col).alias("a"), F.col("v").alias("b"), F.lead("v", 1, 0).over(col).alias("c"))
    p = p.withColumn("m", F.expr("greatest(least(a, b), least(greatest(a, b), c))")).withColumn("t", F.expr("a + b + c"))
    p = p.select("image_id", "y", "x", *[f(n, 1, 0).over(row).alias(n + k) for n in "mt" for k, f in (("l", F.lag), ("r", F.lead))], "m", "t")
    med, mean = "greatest(least(ml, m), least(greatest(ml, m), mr))", "(tl + t + tr) div 9"
    return p.groupBy("image_id").agg(F.sum(F.expr(f"{med} * (y * 8 + x + 1)")).alias("median"), F.sum(F.expr(f"({mean}) * (y * 8 + x + 1)")).alias("mean"))


register("w16_t47_t48_filters", _filters, f"""WITH {v.PLANES}, a AS (SELECT image_id, y, x, lag(v, 1, 0) OVER w AS a, v AS b, lead(v, 1, 0) OVER w AS c FROM planes WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
    m AS (SELECT image_id, y, x, greatest(least(a, b), least(greatest(a, b), c)) AS m, a + b + c AS t FROM a), n AS (SELECT *, lag(m, 1, 0) OVER w AS ml, lead(m, 1, 0) OVER w AS mr, lag(t, 1, 0) OVER w AS tl, lead(t, 1, 0) OVER w AS tr FROM m WINDOW w AS (PARTITION BY image_id, y ORDER BY x))
    SELECT image_id, CAST(sum(greatest(least(ml, m), least(greatest(ml, m), mr)) * (y * 8 + x + 1)) AS BIGINT) AS median, CAST(sum(((tl + t + tr) // 9) * (y * 8 + x + 1)) AS BIGINT) AS mean FROM n GROUP BY image_id""")
register(
    "w17_temporal_prediction",
    lambda s, d: v.planes(s, d).join(v.plane_bytes(s, d).select("image_id", "label"), "image_id").withColumn("d", F.col("v") - F.lag("v", 1, 0).over(Window.partitionBy("label", "y", "x").orderBy("image_id"))).groupBy("label").agg(F.sum(F.abs("d")).alias("magnitude")),
    f"WITH {v.PLANES}, f AS (SELECT label, v - lag(v, 1, 0) OVER (PARTITION BY label, y, x ORDER BY image_id) AS d FROM planes JOIN embeddings ON vec_id = image_id) SELECT label, CAST(sum(abs(d)) AS BIGINT) AS magnitude FROM f GROUP BY label",
)
register(
    "w14_raster_neighbours",
    lambda s, d: v.planes(s, d).select("image_id", "v", *[F.lag("v", k, 0).over(Window.partitionBy("image_id").orderBy("y", "x")).alias(n) for k, n in ((1, "W"), (8, "N"), (9, "NW"))]).groupBy("image_id").agg(*[F.sum(F.col("v") * F.col(n)).alias(n) for n in ("W", "N", "NW")]),
    f"WITH {v.PLANES}, p AS (SELECT image_id, v, lag(v, 1, 0) OVER w AS a, lag(v, 8, 0) OVER w AS b, lag(v, 9, 0) OVER w AS c FROM planes WINDOW w AS (PARTITION BY image_id ORDER BY y, x)) SELECT image_id, CAST(sum(v * a) AS BIGINT) AS W, CAST(sum(v * b) AS BIGINT) AS N, CAST(sum(v * c) AS BIGINT) AS NW FROM p GROUP BY image_id",
)
register(
    "w13_neighbours",
    lambda s, d: predict.with_neighbours(v.planes(s, d)).groupBy("image_id").agg(*[F.sum(F.col("v") * F.col(n)).alias(n) for n in predict.AT]),
    f"WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes')}) SELECT image_id, " + ", ".join(f'CAST(sum(v * "{n}") AS BIGINT) AS "{n}"' for n in predict.AT) + " FROM n GROUP BY image_id",
)
register(
    "t52_palette",
    lambda s, d: _hist(s, d).select("image_id", "sym", (F.dense_rank().over(Window.partitionBy("image_id").orderBy("sym")) - 1 - F.expr("count(*) over (partition by image_id) div 2")).cast("long").alias("rank")),
    f"WITH {HIST} SELECT image_id, sym, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY sym) - 1 - count(*) OVER (PARTITION BY image_id) // 2 AS BIGINT) AS rank FROM hist",
)
