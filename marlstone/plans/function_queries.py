"""Registered queries over scalar functions, predicates, pipelines and remaining joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import color, history, predict
from ..sources import views as v
from .registry import register

register("f03_f06_paths", lambda s, d: v.table(s, d, "pages").select("page_id", fn.last_index(F.col("url"), "/").cast("long").alias("slash"), fn.clean_path(F.col("url")).alias("folder"), fn.file_title(F.col("url")).alias("title"), fn.extension(F.col("url")).alias("ext")),
         r"""SELECT page_id, CAST(length(url) - instr(reverse(url), '/') AS BIGINT) AS slash, CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END AS folder, regexp_extract(url, '([^/\\]*?)(\.[^./\\]*)?$', 1) AS title, CASE WHEN regexp_matches(url, '\.[^./\\]*$') THEN regexp_extract(url, '\.([^./\\]*)$', 1) END AS ext FROM pages""")
register(
    "f07_f08_parse",
    lambda s, d: v.table(s, d, "events").select("event_id", fn.parse_uint(F.regexp_extract("props", ": *(.*)$", 1)).alias("n"), fn.parse_float(F.col("value").cast("string")).alias("x"), fn.parse_until(F.col("props"), ":").alias("head")),
    r"SELECT event_id, CASE WHEN regexp_extract(regexp_extract(props, ': *(.*)$', 1), '^\s*(\d+)', 1) <> '' THEN TRY_CAST(regexp_extract(regexp_extract(props, ': *(.*)$', 1), '^\s*(\d+)', 1) AS BIGINT) ELSE 0 END AS n, value AS x, rtrim(split_part(props, ':', 1)) AS head FROM events",
)
register(
    "f11_f12_text",
    lambda s, d: v.files(s, d).select("file_idx", fn.duration_text(F.col("usize") / 100).alias("duration"), fn.scaled_size(F.col("usize")).alias("size")),
    f"WITH {v.CELLS}, t AS (SELECT file_idx, usize, usize / 100.0::DOUBLE AS s FROM files) SELECT file_idx, CASE WHEN s >= 86400 THEN CAST(floor(s / 86400) AS BIGINT) || '-' ELSE '' END || printf('%02d-%02d-%09.6f', CAST(floor(s % 86400 / 3600) AS INT), CAST(floor(s % 86400 % 3600 / 60) AS INT), s % 86400 % 60) AS duration, printf('%.2f %s', usize / pow(1024.0, least(4, floor(log2(usize) / 10))), ['B', 'KB', 'MB', 'GB', 'TB'][CAST(least(4, floor(log2(usize) / 10)) AS INT) + 1]) AS size FROM t",
)
register("f14_f20_bits", lambda s, d: v.files(s, d).select("file_idx", F.bit_count("usize").cast("int").alias("weight"), fn.floor_log2(F.col("usize")).alias("lo"), fn.ceil_log2(F.col("usize")).alias("hi"), fn.lowest_bit(F.col("usize")).alias("lsb"), F.floor(F.log10("usize")).cast("int").alias("digits"), F.floor(F.sqrt("usize")).cast("long").alias("root"), fn.zigzag(F.col("usize") - 9000000).alias("zig"), fn.unzigzag(fn.zigzag(F.col("usize") - 9000000)).alias("back"), F.expr("usize ^ (usize >> 1)").alias("gray"), F.bin("usize").alias("bits"), fn.median3(F.col("usize"), F.lit(9000000), F.col("file_idx")).cast("long").alias("mid")),
         f"WITH {v.CELLS} SELECT file_idx, CAST(bit_count(usize) AS INT) AS weight, CAST(length(bin(usize)) - 1 AS INT) AS lo, CAST(length(bin(usize - 1)) AS INT) AS hi, CAST(length(bin(usize)) - length(rtrim(bin(usize), '0')) AS INT) AS lsb, CAST(floor(log10(usize)) AS INT) AS digits, CAST(floor(sqrt(usize)) AS BIGINT) AS root, CASE WHEN usize < 9000000 THEN -2 * (usize - 9000000) - 1 ELSE 2 * (usize - 9000000) END AS zig, usize - 9000000 AS back, xor(usize, usize >> 1) AS gray, bin(usize) AS bits, CAST(greatest(least(usize, 9000000), least(greatest(usize, 9000000), file_idx)) AS BIGINT) AS mid FROM files")
register(
    "f17_fixed_point",
    lambda s, d: v.files(s, d).select("file_idx", fn.log2_fix24(F.col("usize")).alias("log"), fn.exp2_fix24(F.col("usize") % 16777216).alias("exp")),
    f"WITH {v.CELLS} SELECT file_idx, CAST(floor(log2(usize / 16777216.0::DOUBLE) * 16777216) AS BIGINT) AS log, CAST(floor(pow(2.0::DOUBLE, (usize % 16777216) / 16777216.0::DOUBLE) * 16777216) AS BIGINT) AS exp FROM files",
)


def _templates(s, d):
    ext = F.concat(F.lit("c"), (F.col("p_partkey") % 60).cast("string"))
    t = v.table(s, d, "part").select("p_partkey", F.concat(F.lit("enc *.ppm *."), ext).alias("e"), F.concat(F.lit("dec *."), F.when(F.col("p_partkey") % 7 == 0, "bad").otherwise(ext), F.lit(" *.ppm")).alias("d"))
    return t.select("p_partkey", fn.template_ok(F.col("e"), F.col("d")).alias("ok"), fn.fill_template(F.col("e"), F.lit("in file"), F.lit("out")).alias("command"))


register("p13_p14_templates", _templates, """SELECT p_partkey, p_partkey % 7 <> 0 AS ok, 'enc "in file" "out"' AS command FROM part""")
register(
    "p10_p12_matches",
    lambda s, d: v.table(s, d, "part").select("p_partkey", (F.lower("p_type") == F.lit("large anodized")).alias("same"), F.lower("p_type").startswith("large").alias("prefix"), (F.col("p_type") == "LARGE").alias("exact")),
    "SELECT p_partkey, lower(p_type) = 'large anodized' AS same, starts_with(lower(p_type), 'large') AS prefix, p_type = 'LARGE' AS exact FROM part",
)
register(
    "p07_p08_roi",
    lambda s, d: v.planes(s, d).where("x >= 2 and x < 7 and y >= 1 and y < 5 and image_id % 4 <> 3").groupBy("image_id").agg(F.sum("v").alias("total"), F.count("*").alias("n")),
    f"WITH {v.PLANES} SELECT image_id, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM planes WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 5 AND image_id % 4 <> 3 GROUP BY image_id",
)
register(
    "d10_timestamps",
    lambda s, d: v.table(s, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("text"), F.unix_timestamp(F.to_timestamp(F.date_format("ts", "yyyyMMdd_HHmmss"), "yyyyMMdd_HHmmss")).alias("back")),
    "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS text, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS back FROM events",
)
register(
    "j02_pixels",
    lambda s, d: v.planes(s, d).alias("a").join(v.planes(s, d).select((F.col("image_id") - 1).alias("image_id"), "y", "x", F.col("v").alias("w")), ["image_id", "y", "x"]).groupBy("image_id").agg(F.sum(F.abs(F.col("v") - F.col("w"))).alias("sad"), F.count("*").alias("n")),
    f"WITH {v.PLANES} SELECT a.image_id, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS sad, count(*) AS n FROM planes a JOIN planes b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y GROUP BY a.image_id",
)
register(
    "j06_earlier_runs",
    lambda s, d: history.run_totals(v.cells(s, d)).select(F.lower("codec").alias("name"), "run_seq", "csize", F.min("csize").over(Window.partitionBy(F.lower("codec")).orderBy("run_seq").rangeBetween(Window.unboundedPreceding, -1)).alias("best_before")),
    f"WITH {v.CELLS} SELECT lower(a.codec) AS name, a.run_seq, a.csize, min(b.csize) AS best_before FROM runs a LEFT JOIN runs b ON lower(a.codec) = lower(b.codec) AND b.run_seq < a.run_seq GROUP BY lower(a.codec), a.run_seq, a.csize",
)


def _recipe_costs(s, d):
    """J-07: signal sums looked up three times per recipe of a small constant table."""
    rgb = v.rgb(s, d)
    names = ("r", "g", "b", "r-g", "g-b", "b-r")
    sums = rgb.groupBy("image_id").agg(*[F.sum(F.abs(F.expr(n.replace("-", " - ")))).alias(n) for n in names])
    long = sums.select("image_id", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))])).alias("signal", "cost"))
    flip = {"g-r": "r-g", "b-g": "g-b", "r-b": "b-r"}
    recipes = s.createDataFrame([(i, flip.get(c, c)) for i, r in enumerate(color.RECIPES) for c in r], "recipe int, signal string")
    return long.join(F.broadcast(recipes), "signal").groupBy("image_id", "recipe").agg(F.sum("cost").alias("cost"))


_SIG = {"r": "r", "g": "g", "b": "b", "r-g": "rg", "g-r": "rg", "g-b": "gb", "b-g": "gb", "b-r": "br", "r-b": "br"}
register(
    "j07_recipe_lookup",
    _recipe_costs,
    f"WITH {v.RGB}, s AS (SELECT image_id, sum(abs(r)) AS r, sum(abs(g)) AS g, sum(abs(b)) AS b, sum(abs(r - g)) AS rg, sum(abs(g - b)) AS gb, sum(abs(b - r)) AS br FROM rgb GROUP BY image_id) " + " UNION ALL ".join(f"SELECT image_id, CAST({i} AS INT) AS recipe, CAST({' + '.join(_SIG[c] for c in r)} AS BIGINT) AS cost FROM s" for i, r in enumerate(color.RECIPES)),
)


def _pipeline(s, d):
    """§3.2: JPEG2000 color transform, clamped gradient, order-0 size, per image."""
    from ..operators import stats

    p = color.forward(v.rgb(s, d), "t03_jpeg2000")
    long = p.select((F.col("image_id") * 3).alias("base"), "y", "x", F.explode(F.array(F.struct(F.lit(0).alias("ch"), F.col("c0").alias("v")), F.struct(F.lit(1).alias("ch"), F.col("c1").alias("v")), F.struct(F.lit(2).alias("ch"), F.col("c2").alias("v")))).alias("e"))
    planes = long.select((F.col("base") + F.col("e.ch")).alias("image_id"), "y", "x", F.col("e.v").alias("v"))
    res = predict.with_neighbours(planes).select("image_id", F.expr(predict.text("t38_clampgrad", depth=9)).cast("long").alias("sym"))
    e = stats.entropy(res.groupBy("image_id", "sym").agg(F.count("*").alias("freq")), ["image_id"])
    return e.groupBy(F.expr("image_id div 3").alias("image_id")).agg(F.round(F.sum("bits") / 8, 4).alias("bytes"))


register("pipeline_color_predict_size", _pipeline, f"""WITH {v.RGB}, t AS ({color.lift_sql('rgb', 't03_jpeg2000')}), l AS (SELECT image_id * 3 + ch AS image_id, y, x, CASE ch WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS v FROM t, range(0, 3) r(ch)),
    n AS ({predict.neighbours_sql('l')}), s AS (SELECT image_id, {predict.text('t38_clampgrad', 'duck', 9)} AS sym FROM n), h AS (SELECT image_id, sym, count(*) AS f FROM s GROUP BY ALL), e AS (SELECT image_id, sum(-f * log2(f / n)) AS bits FROM (SELECT *, sum(f) OVER (PARTITION BY image_id) AS n FROM h) GROUP BY image_id)
    SELECT image_id // 3 AS image_id, round(sum(bits) / 8, 4) AS bytes FROM e GROUP BY image_id // 3""")


def _histmatch(s, d):
    """T-19: each channel's levels matched to green's by equal cumulative counts, then subtracted."""
    rgb = v.rgb(s, d)
    long = rgb.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("v")) for c in "rgb"])).alias("e")).select("image_id", "e.ch", "e.v")
    h = long.groupBy("image_id", "ch", "v").agg(F.count("*").alias("f"))
    cdf = h.withColumn("cdf", F.sum("f").over(Window.partitionBy("image_id", "ch").orderBy("v")))
    g = cdf.where("ch = 'g'").select("image_id", F.col("v").alias("gv"), F.col("cdf").alias("gc"))
    to = g.join(cdf.where("ch <> 'g'"), "image_id").where("cdf >= gc").groupBy("image_id", "ch", "gv").agg(F.min("v").alias("m"))
    m = to.groupBy("image_id", "gv").pivot("ch", ["b", "r"]).agg(F.first("m"))
    out = rgb.join(m.select("image_id", F.col("gv").alias("g"), F.col("r").alias("mr"), F.col("b").alias("mb")), ["image_id", "g"])
    return out.groupBy("image_id").agg(F.sum(F.abs(F.col("r") - F.col("mr"))).alias("red"), F.sum(F.abs(F.col("b") - F.col("mb"))).alias("blue"))


register("t19_histmatch", _histmatch, f"""WITH {v.RGB}, l AS (SELECT image_id, 'r' AS ch, r AS v FROM rgb UNION ALL SELECT image_id, 'g', g FROM rgb UNION ALL SELECT image_id, 'b', b FROM rgb), h AS (SELECT image_id, ch, v, count(*) AS f FROM l GROUP BY ALL),
    c AS (SELECT *, sum(f) OVER (PARTITION BY image_id, ch ORDER BY v) AS cdf FROM h), m AS (SELECT g.image_id, g.v AS gv, min(o.v) FILTER (o.ch = 'r') AS mr, min(o.v) FILTER (o.ch = 'b') AS mb FROM c g JOIN c o ON g.image_id = o.image_id AND g.ch = 'g' AND o.ch <> 'g' AND o.cdf >= g.cdf GROUP BY g.image_id, g.v)
    SELECT image_id, CAST(sum(abs(r - mr)) AS BIGINT) AS red, CAST(sum(abs(b - mb)) AS BIGINT) AS blue FROM rgb JOIN m USING (image_id) WHERE g = gv GROUP BY image_id""")
_KERNEL = {"NW": 1, "N": 2, "NE": 1, "W": 2}
register(
    "t43_t84_convolution",
    lambda s, d: predict.with_neighbours(v.planes(s, d)).groupBy("image_id").agg(F.sum(F.expr("((" + " + ".join(f"{w} * {k}" for k, w in _KERNEL.items()) + " + 4 * v) div 10) * (y * 8 + x + 1)")).alias("digest")),
    f"WITH {v.PLANES}, n AS ({predict.neighbours_sql('planes')}) SELECT image_id, CAST(sum(((" + " + ".join(f"{w} * {k}" for k, w in _KERNEL.items()) + " + 4 * v) // 10) * (y * 8 + x + 1)) AS BIGINT) AS digest FROM n GROUP BY image_id",
)


def _pca(s, d):
    """T-18: rotation by the eigenvectors of the channel covariance; the first axis carries most."""
    from ..operators import stats

    rgb = v.rgb(s, d)
    axes = stats.principal_axes(rgb)
    rotated = [sum((F.col(c) * float(a) for c, a in zip("rgb", axis, strict=True)), F.lit(0.0)) for axis in axes]
    return rgb.agg(*[F.round(F.var_pop(e), 2).alias(f"var{i}") for i, e in enumerate(rotated)])


def _pca_sql() -> str:
    """Power iteration on the covariance for the first axis, and the variances of the other two from trace and determinant."""
    pairs = [(a, b) for i, a in enumerate("rgb") for b in "rgb"[i:]]
    m = {frozenset(p): "".join(p) for p in pairs}
    row = lambda a: " + ".join(f"{m[frozenset((a, b))]} * {b}" for b in "rgb")
    cov = ", ".join(f"covar_pop({a}::DOUBLE, {b}::DOUBLE) AS {a}{b}" for a, b in pairs)
    return f"""WITH RECURSIVE {v.RGB}, c AS (SELECT {cov} FROM rgb), it AS (SELECT 0 AS i, 1.0::DOUBLE AS r, 0.9::DOUBLE AS g, 0.8::DOUBLE AS b, 0.0::DOUBLE AS top
        UNION ALL SELECT i + 1, x / norm, y / norm, z / norm, norm FROM (SELECT *, sqrt(x * x + y * y + z * z) AS norm FROM (SELECT i, {row('r')} AS x, {row('g')} AS y, {row('b')} AS z FROM it, c WHERE i < 3000))),
        t AS (SELECT top AS a, rr + gg + bb - top AS s, (rr * (gg * bb - gb * gb) - rg * (rg * bb - gb * rb) + rb * (rg * gb - gg * rb)) / top AS p FROM it, c WHERE i = 3000)
        SELECT round(a, 2) AS var0, round((s + sqrt(greatest(0, s * s - 4 * p))) / 2, 2) AS var1, round((s - sqrt(greatest(0, s * s - 4 * p))) / 2, 2) AS var2 FROM t"""


register("t18_pca", _pca, _pca_sql())
