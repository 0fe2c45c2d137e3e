"""Registered queries over the run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as h
from ..sources import views as v
from .registry import register


def runs(s, d):
    return h.run_totals(v.cells(s, d))


def best(s, d):
    return h.best_runs(runs(s, d))


BEST = v.CELLS + """,
    scored AS (SELECT *, lower(codec) AS name, csize / 1048576.0 + etime + 2 * dtime AS score FROM runs),
    best AS (SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score, run_seq DESC) AS turn FROM scored) WHERE turn = 1)"""
FRONT = BEST + """,
    placed AS (SELECT *, row_number() OVER o AS place, min(etime) OVER (ORDER BY csize, run_seq, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM best WINDOW o AS (ORDER BY csize, run_seq, name)),
    front AS (SELECT * FROM placed WHERE place <= (SELECT place FROM placed ORDER BY etime, csize DESC, place LIMIT 1) AND (least IS NULL OR etime <= least))"""
RIVALS = BEST + """,
    chosen AS (SELECT c.file_idx, b.name, min(c.csize) AS csize FROM cells c JOIN best b ON c.codec = b.codec AND c.run_seq = b.run_seq GROUP BY c.file_idx, b.name)"""

register("a01_run_totals", runs, f"WITH {v.CELLS} SELECT * FROM runs")
register(
    "a02_weighted_rmse",
    lambda s, d: h.weighted_rmse(v.cells(s, d), v.files(s, d)),
    f"WITH {v.CELLS} SELECT codec, run_seq, CAST(sum(emem * usize) AS DOUBLE) / CAST(sum(usize) AS DOUBLE) AS rmse_total, CAST(sum(usize) AS BIGINT) AS usize FROM cells JOIN files USING (file_idx) GROUP BY codec, run_seq",
)
register(
    "a05_dataset_usize",
    lambda s, d: v.files(s, d).agg(F.sum("usize").alias("usize"), F.count("*").alias("n_files")),
    f"WITH {v.CELLS} SELECT CAST(sum(usize) AS BIGINT) AS usize, count(*) AS n_files FROM files",
)
register(
    "a06_script_totals",
    lambda s, d: v.cells(s, d).join(v.files(s, d), "file_idx").groupBy(F.lower("codec").alias("name")).agg(F.sum("usize").alias("usize"), F.sum("csize").alias("csize"), F.try_divide(F.sum(F.greatest("usize", "csize")).cast("double"), F.sum("etime") * 1048576.0).alias("mb_s")),
    f"WITH {v.CELLS} SELECT lower(codec) AS name, CAST(sum(usize) AS BIGINT) AS usize, CAST(sum(csize) AS BIGINT) AS csize, CASE WHEN sum(etime) > 0 THEN CAST(sum(greatest(usize, csize)) AS DOUBLE) / (CAST(sum(etime) AS DOUBLE) * 1048576.0) END AS mb_s FROM cells JOIN files USING (file_idx) GROUP BY lower(codec)",
)
register("p01_p06_measures", lambda s, d: v.cells(s, d).join(v.files(s, d), "file_idx").where("etime > 0 and usize > 0").agg(*[F.round(F.max(e), 6).alias(n) for n, e in (("mb_s", F.expr("usize / (etime * 1048576.0D)")), ("ms_mb", F.expr("etime * 1048576.0D * 1000 / usize")), ("delta", F.expr("cast(csize - usize as double)")), ("percent", F.expr("100.0D * csize / usize")), ("ratio", F.expr("usize / csize")), ("bpd", F.expr("8.0D * csize / usize")), ("score_mib", F.expr("csize / 1048576.0D + etime + 2 * dtime_cs / 100.0D")), ("score_raw", F.expr("csize + etime + 2 * dtime_cs / 100.0D")), ("mem_mb", F.expr("emem / 1048576.0D")))]),
         f"WITH {v.CELLS} SELECT round(max(CAST(usize AS DOUBLE) / (etime * 1048576.0)), 6) AS mb_s, round(max(CAST(etime AS DOUBLE) * 1048576.0 * 1000 / usize), 6) AS ms_mb, round(max(CAST(csize - usize AS DOUBLE)), 6) AS delta, round(max(CAST(100.0 AS DOUBLE) * csize / usize), 6) AS percent, round(max(CAST(usize AS DOUBLE) / csize), 6) AS ratio, round(max(CAST(8.0 AS DOUBLE) * csize / usize), 6) AS bpd, round(max(csize / CAST(1048576.0 AS DOUBLE) + etime + 2 * dtime_cs / CAST(100.0 AS DOUBLE)), 6) AS score_mib, round(max(csize + etime + 2 * dtime_cs / CAST(100.0 AS DOUBLE)), 6) AS score_raw, round(max(emem / CAST(1048576.0 AS DOUBLE)), 6) AS mem_mb FROM cells JOIN files USING (file_idx) WHERE etime > 0 AND usize > 0")
register("a10_best_run", best, f"WITH {BEST} SELECT * FROM best")
register(
    "w01_rank",
    lambda s, d: h.ranked(best(s, d)).select("name", "csize", F.col("rank").cast("long").alias("rank")),
    f"WITH {BEST} SELECT name, csize, row_number() OVER (ORDER BY csize, run_seq, name) AS rank FROM best",
)
register(
    "w02_insert_rank",
    lambda s, d: h.insert_rank(best(s, d), runs(s, d)),
    f"WITH {BEST} SELECT r.codec, r.run_seq, CAST(1 + count(b.name) AS BIGINT) AS place FROM runs r LEFT JOIN best b ON b.csize < r.csize OR (b.csize = r.csize AND b.etime + 2 * b.dtime <= r.etime + 2 * r.dtime) GROUP BY r.codec, r.run_seq",
)
register(
    "w03_running_best",
    lambda s, d: h.running_best(best(s, d)),
    f"WITH {BEST} SELECT name, csize, etime, dtime, coalesce(etime < min(etime) OVER w, true) AS enc_mark, coalesce(dtime < min(dtime) OVER w, true) AS dec_mark FROM best WINDOW w AS (ORDER BY csize, run_seq, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
register(
    "w04_pareto_front",
    lambda s, d: h.pareto_front(best(s, d)).select("name", "csize", "etime", F.col("place").cast("long").alias("place")),
    f"WITH {FRONT} SELECT name, csize, etime, place FROM front",
)
register(
    "w07_pareto_rank",
    lambda s, d: h.pareto_ranks(best(s, d)),
    f"WITH {FRONT}, counted AS (SELECT b.name, b.csize, f.name IS NOT NULL AS is_on, count(f.name) OVER (ORDER BY b.csize, b.run_seq, b.name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM best b LEFT JOIN front f ON b.name = f.name) SELECT name, csize, CAST(CASE WHEN is_on THEN 2 * k WHEN k > 0 THEN 2 * k + 1 ELSE 0 END AS BIGINT) AS half_rank FROM counted",
)
register(
    "w08_zoom_bounds",
    lambda s, d: h.zoom_bounds(best(s, d)),
    f"WITH {FRONT} SELECT name, coalesce(lag(csize) OVER w, csize) AS csize_lo, coalesce(lead(csize) OVER w, csize) AS csize_hi, coalesce(lead(etime) OVER w, etime) AS time_lo, coalesce(lag(etime) OVER w, etime) AS time_hi FROM front WINDOW w AS (ORDER BY csize, run_seq, name)",
)
register(
    "w09_axis_step",
    lambda s, d: runs(s, d).select("codec", "run_seq", F.round(h.axis_step(F.col("etime") / 7), 6).alias("step")),
    f"WITH {v.CELLS}, m AS (SELECT codec, run_seq, etime / 7 AS span, pow(10.0, floor(log10(etime / 7))) AS p FROM runs WHERE etime > 0) SELECT codec, run_seq, round(p * CASE WHEN span / p < 1.5 THEN 1.0 WHEN span / p < 3 THEN 2.0 WHEN span / p < 4.5 THEN 2.5 WHEN span / p < 7 THEN 5.0 ELSE 10.0 END, 6) AS step FROM m",
)
register(
    "w10_w11_tiers",
    lambda s, d: h.tiers(v.files(s, d).withColumn("bpd0", F.col("usize") % 997), "bpd0"),
    f"WITH {v.CELLS}, r AS (SELECT file_idx, CAST(row_number() OVER w - 1 AS BIGINT) AS rank, CAST(floor(5 * CAST(sum(usize) OVER w2 - usize AS DOUBLE) / CAST(sum(usize) OVER () AS DOUBLE)) AS BIGINT) AS raw FROM files WINDOW w AS (ORDER BY usize % 997, file_idx), w2 AS (ORDER BY usize % 997, file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT file_idx, rank, CAST(dense_rank() OVER (ORDER BY raw) - 1 AS BIGINT) AS tier FROM r",
)
register(
    "w12_medians",
    lambda s, d: h.medians(v.files(s, d), 30),
    f"WITH {v.CELLS}, p AS (SELECT file_idx, usize, row_number() OVER (ORDER BY usize, file_idx) - 1 AS place, count(*) OVER () AS total FROM files) SELECT file_idx, usize, place FROM p WHERE (place >= (total - 30) // 2 AND place < (total + 30) // 2) OR place = 0 OR place = total - 1",
)
register(
    "j01_cells_files",
    lambda s, d: v.cells(s, d).join(v.files(s, d), "file_idx").groupBy("filename").agg(F.sum("csize").alias("csize"), F.max("usize").alias("usize")),
    f"WITH {v.CELLS} SELECT filename, CAST(sum(csize) AS BIGINT) AS csize, max(usize) AS usize FROM cells JOIN files USING (file_idx) GROUP BY filename",
)
register(
    "j03_rivals",
    lambda s, d: h.rivals(v.cells(s, d), best(s, d)),
    f"WITH {RIVALS} SELECT file_idx, name, csize, count(*) OVER (PARTITION BY file_idx) - 1 AS n_rivals, min(csize) OVER (PARTITION BY file_idx) AS smallest FROM chosen",
)
register(
    "j04_nearest_rivals",
    lambda s, d: h.nearest_rivals(h.rivals(v.cells(s, d), best(s, d))),
    f"WITH {RIVALS} SELECT c.file_idx, c.name, c.csize, max(o.csize) FILTER (o.csize < c.csize) AS below, min(o.csize) FILTER (o.csize > c.csize) AS above FROM chosen c JOIN chosen o USING (file_idx) GROUP BY c.file_idx, c.name, c.csize",
)
register(
    "j05_own_best",
    lambda s, d: h.against_own_best(runs(s, d), best(s, d)),
    f"WITH {BEST} SELECT r.codec, r.run_seq, r.csize, b.run_seq AS best_run, r.csize - b.csize AS delta FROM runs r LEFT JOIN best b ON r.codec = b.codec",
)
register(
    "j11_ab_compare",
    lambda s, d: h.compare_codecs(v.cells(s, d), "c1", "c2"),
    f"WITH {v.CELLS}, a AS (SELECT file_idx, min(csize) AS csize_a FROM cells WHERE lower(codec) = 'c1' GROUP BY file_idx), b AS (SELECT file_idx, min(csize) AS csize_b FROM cells WHERE lower(codec) = 'c2' GROUP BY file_idx) SELECT file_idx, csize_a, csize_b, csize_b - csize_a AS delta FROM a JOIN b USING (file_idx)",
)
register(
    "a26_profile",
    lambda s, d: h.profile(runs(s, d)).select("codec", "run_seq", *[F.round(c, 6).alias(c) for c in ("percent", "mb_s", "ms_mb")]),
    f"WITH {v.CELLS} SELECT codec, run_seq, round(100 * etime / sum(etime) OVER (), 6) AS percent, round(csize / (etime * 1048576.0), 6) AS mb_s, round(etime * 1048576.0 * 1000 / csize, 6) AS ms_mb FROM runs",
)
register(
    "a28_a29_conversion_totals",
    lambda s, d: h.conversion_totals(v.cells(s, d), v.files(s, d)),
    f"WITH {v.CELLS} SELECT lower(codec) AS name, CAST(sum(CASE WHEN starts_with(kind, 'LARGE') THEN csize ELSE 0 END) AS BIGINT) AS large_csize, CAST(sum(CASE WHEN starts_with(kind, 'LARGE') THEN 0 ELSE csize END) AS BIGINT) AS other_csize, CAST(sum(CASE WHEN starts_with(kind, 'LARGE') THEN 1 ELSE 0 END) AS BIGINT) AS n_large FROM cells JOIN files USING (file_idx) GROUP BY lower(codec)",
)
register(
    "k03_tex_export",
    lambda s, d: h.tex_rows(best(s, d)),
    f"WITH {BEST} SELECT 0 AS block, printf('%8.3f %11.6f %s', csize / 1048576.0, etime, name) AS line FROM best UNION ALL SELECT 1, printf('%8.3f %11.6f %s', csize / 1048576.0, dtime, name) FROM best",
)
register(
    "o01_sorted_dataset",
    lambda s, d: v.files(s, d).orderBy("usize", "filename").select("filename", "usize"),
    f"WITH {v.CELLS} SELECT filename, usize FROM files ORDER BY usize, filename",
)
register(
    "o09_union_all",
    lambda s, d: v.files(s, d).unionByName(v.files(s, d)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("usize").alias("usize")),
    f"WITH {v.CELLS} SELECT kind, count(*) AS n, CAST(sum(usize) AS BIGINT) AS usize FROM (SELECT * FROM files UNION ALL SELECT * FROM files) GROUP BY kind",
)
