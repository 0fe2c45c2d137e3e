"""Benchmark history: totals, best runs, rankings, rivals, Pareto fronts, tiers. All functions are DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MB = 1048576.0


def run_totals(cells: DataFrame) -> DataFrame:
    """A-01: sums of sizes and times, maxima of memory, per run."""
    return cells.groupBy("codec", "run_seq").agg(
        F.sum("csize").alias("csize"), F.sum("etime").cast("double").alias("etime"), (F.sum("dtime_cs").cast("double") / 100.0).alias("dtime"), F.max("emem").alias("emem"), F.count("*").alias("n_files")
    )


def weighted_rmse(cells: DataFrame, files: DataFrame) -> DataFrame:
    """A-02: the size-weighted mean of per-file RMSE values (not the pooled RMSE); `emem` stands for the RMSE."""
    joined = cells.join(files, "file_idx")
    return joined.groupBy("codec", "run_seq").agg((F.sum(F.col("emem") * F.col("usize")) / F.sum("usize")).alias("rmse_total"), F.sum("usize").alias("usize"))


def score(csize: Column, etime: Column, dtime: Column, unit: float = MB) -> Column:
    """P-05: size in `unit` bytes plus encode time plus twice the decode time."""
    return csize / unit + etime + 2 * dtime


def best_runs(runs: DataFrame, unit: float = MB) -> DataFrame:
    """A-10, O-07: per codec, ignoring case, the run of the lowest score; of equal scores the later run."""
    scored = runs.withColumn("score", score(F.col("csize"), F.col("etime"), F.col("dtime"), unit)).withColumn("name", F.lower("codec"))
    turn = F.row_number().over(Window.partitionBy("name").orderBy("score", F.desc("run_seq")))
    return scored.withColumn("turn", turn).where("turn = 1").drop("turn")


def ranked(best: DataFrame) -> DataFrame:
    """W-01: rank by size (ties: earlier run, name). The window sees one row per codec."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy("csize", "run_seq", "name")))


#: Ranges that a running sum over a whole table is cut into.
RANGES = 64


def running_sums(df: DataFrame, first: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """`df` with running sums (this row's included) in the order of `first`, then `order`, and their totals as `<name>_all`.

    Rows are dealt to ranges of `first` by its approximate quantiles, which hold equal values together; sums run inside
    each range, and what the ranges before hold is added. At the driver are RANGES cuts and a row per range."""
    cuts = sorted(set(df.approxQuantile(first, [i / RANGES for i in range(1, RANGES)], 0.001)))
    range_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(first))) if cuts else F.lit(0)
    dealt = df.withColumn("range", range_of)
    totals = {r["range"]: r for r in dealt.groupBy("range").agg(*[F.sum(e).alias(k) for k, e in sums.items()]).collect()}
    w = Window.partitionBy("range").orderBy(first, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(e).over(w).alias(k) for k, e in sums.items()])
    for k in sums:
        held = [totals[i][k] if i in totals else 0 for i in range(len(cuts) + 1)]
        before = [sum(held[:i]) for i in range(len(held))]
        out = out.withColumn(k, F.col(k) + F.get(F.array(*map(F.lit, before)), F.col("range"))).withColumn(f"{k}_all", F.lit(sum(held)))
    return out.drop("range")


def insert_rank(best: DataFrame, current: DataFrame) -> DataFrame:
    """W-02: where each current run would stand among the best runs: behind all that are smaller, or of equal size and
    not slower by etime + 2 * dtime. One running count over both."""
    time = (F.col("etime") + 2 * F.col("dtime")).alias("time")
    held = best.select(F.lit(None).cast("string").alias("codec"), F.lit(None).cast("int").alias("run_seq"), F.col("csize").cast("long").alias("csize"), time, F.lit(0).alias("asked"))
    asked = current.select("codec", F.col("run_seq").cast("int").alias("run_seq"), F.col("csize").cast("long").alias("csize"), time, F.lit(1).alias("asked"))
    placed = running_sums(held.unionByName(asked), "csize", ["time", "asked"], {"place": 1 - F.col("asked")})
    return placed.where("asked = 1").select("codec", "run_seq", (F.col("place") + 1).cast("long").alias("place"))


def running_best(best: DataFrame) -> DataFrame:
    """W-03: marks a strict running minimum of each time in order of size; the first row is always marked."""
    w = Window.orderBy("csize", "run_seq", "name").rowsBetween(Window.unboundedPreceding, -1)
    mark = lambda c: F.coalesce(F.col(c) < F.min(c).over(w), F.lit(True))
    return best.select("name", "csize", "etime", "dtime", mark("etime").alias("enc_mark"), mark("dtime").alias("dec_mark"))


def pareto_front(best: DataFrame, time: str = "etime") -> DataFrame:
    """W-04, W-05: the staircase front of size against time: no slower than every smaller run, and not behind the
    fastest point (of equally fast points the larger one)."""
    order = Window.orderBy("csize", "run_seq", "name")
    placed = best.withColumn("place", F.row_number().over(order)).withColumn("least", F.min(time).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    last = placed.withColumn("fastest", F.min(F.struct(F.col(time), (-F.col("csize")).alias("size"), F.col("place"))).over(Window.partitionBy()).getField("place"))
    return last.where((F.col("place") <= F.col("fastest")) & (F.col(time) <= F.coalesce("least", F.lit(float("inf"))))).drop("least", "fastest")


def pareto_ranks(best: DataFrame, time: str = "etime") -> DataFrame:
    """W-07: 2k for the k-th front point, 2k + 1 for runs between it and the next, 0 before the first."""
    front = pareto_front(best, time).select("name", F.lit(1).alias("on"))
    joined = best.join(front, "name", "left")
    count = F.sum(F.coalesce("on", F.lit(0))).over(Window.orderBy("csize", "run_seq", "name").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("name", "csize", F.when(F.col("on") == 1, 2 * count).when(count > 0, 2 * count + 1).otherwise(0).cast("long").alias("half_rank"))


def zoom_bounds(best: DataFrame, time: str = "etime") -> DataFrame:
    """W-08: for each front point, the sizes and times of its front neighbours."""
    w = Window.orderBy("csize", "run_seq", "name")
    near = lambda f, c: F.coalesce(f(c, 1).over(w), F.col(c))
    return pareto_front(best, time).select("name", near(F.lag, "csize").alias("csize_lo"), near(F.lead, "csize").alias("csize_hi"), near(F.lead, time).alias("time_lo"), near(F.lag, time).alias("time_hi"))


def axis_step(span: Column) -> Column:
    """W-09: a step of 1, 2, 2.5, 5 or 10 times a power of ten; cuts at 1.5, 3, 4.5 and 7."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(span)))
    m = span / power
    return F.when(span > 0, power * F.when(m < 1.5, 1.0).when(m < 3, 2.0).when(m < 4.5, 2.5).when(m < 7, 5.0).otherwise(10.0))


def rivals(cells: DataFrame, best: DataFrame) -> DataFrame:
    """J-03: every best run's cells beside each other, per file: (file_idx, name, csize, n_rivals, smallest)."""
    chosen = cells.withColumn("name", F.lower("codec")).join(best.select("name", "run_seq", F.col("codec").alias("as")), ["name", "run_seq"]).where("codec = as")
    chosen = chosen.groupBy("file_idx", "name").agg(F.min("csize").alias("csize"))
    w = Window.partitionBy("file_idx")
    return chosen.select("file_idx", "name", "csize", (F.count("*").over(w) - 1).alias("n_rivals"), F.min("csize").over(w).alias("smallest"))


def nearest_rivals(rows: DataFrame) -> DataFrame:
    """J-04: per file, the next smaller and the next larger size of another codec (strict; first name on ties)."""
    w = Window.partitionBy("file_idx").orderBy("csize")
    below = F.max(F.struct("csize")).over(w.rangeBetween(Window.unboundedPreceding, -1)).getField("csize")
    above = F.min(F.struct("csize")).over(w.rangeBetween(1, Window.unboundedFollowing)).getField("csize")
    return rows.select("file_idx", "name", "csize", below.alias("below"), above.alias("above"))


def against_own_best(runs: DataFrame, best: DataFrame) -> DataFrame:
    """J-05, P-12: each run against its codec's best, by the exact spelling of the codec."""
    b = best.select("codec", F.col("csize").alias("best_csize"), F.col("run_seq").alias("best_run"))
    return runs.join(F.broadcast(b), "codec", "left").select("codec", "run_seq", "csize", "best_run", (F.col("csize") - F.col("best_csize")).alias("delta"))


def compare_codecs(cells: DataFrame, a: str, b: str) -> DataFrame:
    """J-11: totals per file of two codecs side by side."""
    side = lambda c, n: cells.where(F.lower("codec") == c).groupBy("file_idx").agg(F.min("csize").alias(f"csize_{n}"))
    both = side(a, "a").join(side(b, "b"), "file_idx")
    return both.withColumn("delta", F.col("csize_b") - F.col("csize_a"))


def tiers(files: DataFrame, order: str, n: int = 5) -> DataFrame:
    """W-10, W-11: rank by `order`, then tiers by exclusive cumulative size; skipped tiers close up."""
    placed = running_sums(files.select("file_idx", "usize", F.col(order).alias("by")), "by", ["file_idx"], {"rank": F.lit(1), "size": F.col("usize")})
    raw = placed.select("file_idx", (F.col("rank") - 1).cast("long").alias("rank"), F.floor(n * (F.col("size") - F.col("usize")) / F.col("size_all")).alias("raw"))
    known = sorted(r["raw"] for r in raw.select("raw").distinct().collect())  # n + 1 values at most
    return raw.select("file_idx", "rank", (F.array_position(F.array(*map(F.lit, known)), F.col("raw")) - 1).cast("long").alias("tier"))


def medians(files: DataFrame, n: int) -> DataFrame:
    """W-12: the n median files by size, and the smallest and the largest."""
    placed = running_sums(files.select("file_idx", "usize"), "usize", ["file_idx"], {"place": F.lit(1)})
    placed = placed.select("file_idx", "usize", (F.col("place") - 1).cast("long").alias("place"), F.col("place_all").alias("total"))
    mid = (F.col("place") >= F.expr(f"(total - {n}) div 2")) & (F.col("place") < F.expr(f"(total + {n}) div 2"))
    return placed.where(mid | (F.col("place") == 0) | (F.col("place") == F.col("total") - 1)).select("file_idx", "usize", "place")


def profile(runs: DataFrame) -> DataFrame:
    """A-26: each run's share of all time, MB/s and ms/MB (null where undefined)."""
    everything = runs.agg(F.sum("etime").alias("t")).first()["t"]
    share = 100 * F.try_divide(F.col("etime"), F.lit(everything))
    return runs.select("codec", "run_seq", share.alias("percent"), F.try_divide(F.col("csize"), F.col("etime") * MB).alias("mb_s"), (F.col("etime") * MB * 1000 / F.col("csize")).alias("ms_mb"))


def conversion_totals(cells: DataFrame, files: DataFrame) -> DataFrame:
    """A-28, A-29: totals per source format by conditional sums."""
    j = cells.join(files, "file_idx")
    big = F.col("kind").startswith("LARGE")
    return j.groupBy(F.lower("codec").alias("name")).agg(
        F.sum(F.when(big, F.col("csize")).otherwise(0)).alias("large_csize"), F.sum(F.when(~big, F.col("csize")).otherwise(0)).alias("other_csize"), F.sum(F.when(big, 1).otherwise(0)).cast("long").alias("n_large")
    )


def tex_rows(best: DataFrame) -> DataFrame:
    """K-03: lines of an encode block (0) and a decode block (1): MiB, seconds, label."""
    line = lambda block, t: best.select(F.lit(block).alias("block"), F.format_string("%8.3f %11.6f %s", F.col("csize") / MB, F.col(t), F.col("name")).alias("line"))
    return line(0, "etime").unionByName(line(1, "dtime"))
