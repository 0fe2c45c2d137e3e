"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, materialize

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Rotations of the draws among which each source takes the one that brings its words nearest to the target.
TURNS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes by weight. A target
    stops at `max_repeat` times its source's size; what it can't take goes to the others by weight until none is above.
    In order of cap / weight, level i = (total - caps before i) / (weights from i on) rises up to the first source that
    isn't capped and falls behind it, so the final level is the highest one. The windows run over one row of some 100 bytes
    per source in one task, which sorts (and spills) millions of sources; they don't grow with the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("turn", turn).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "source", "source_size", "w", "cap", F.sum("source_size").over(everything).alias("total"), F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    level = F.max((F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))).over(everything)
    return per.withColumn("level", level).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only: 52 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def _extra(u: Column, turn: Column | int) -> Column:
    """1 where the draw, rotated by turn / TURNS, falls below the fraction of the rate."""
    moved = u + (F.lit(turn) if isinstance(turn, int) else turn) / F.lit(float(TURNS))
    return F.when(moved - F.floor(moved) < _rate() - F.floor(_rate()), 1).otherwise(0)


def source_plan(drawn: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(of, source_size, target, turn) from rows (source, size, u).

    The rotation is chosen per source by one aggregate, which keeps the taken words near the target where few long
    documents would not. The extra copy is thus no plain Bernoulli draw but one conditioned on the nearest of TURNS
    rotations: a source of one document gets it always or never.
    """
    per = materialize(source_targets(drawn.select("source", "size"), weights, max_repeat)).withColumnRenamed("source", "of")
    rows = attach(drawn, per, F.col("source").eqNullSafe(F.col("of")), "inner", ("of",))
    sums = F.array(*[F.sum(F.col("size") * _extra(F.col("u"), k)) for k in range(TURNS)])
    taken = rows.groupBy("of", "source_size", "target").agg(sums.alias("extra"), F.sum(F.col("size") * F.floor(_rate())).alias("whole"))
    off = F.transform("extra", lambda e: F.abs(e + F.col("whole") - F.col("target")))
    return taken.select("of", "source_size", "target", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("turn"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies): `row` holds all columns of `docs`, so no name can clash.

    A document is taken floor(rate) times, rate = target / size of its source, and perhaps once more for rate -
    floor(rate), by a draw seeded with its id and rotated to bring its source near the target. Null and blank texts have
    size 0; rows with equal ids are drawn alike (a null id counts as one id); null is a source of its own; an empty table
    gives an empty mix.
    """
    sized = docs.select(F.struct("*").alias("row"), draw(F.col("doc_id"), seed).alias("u"), F.col("source").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    per = materialize(source_plan(materialize(sized.select("source", "size", "u")), weights, max_repeat))
    joined = attach(sized, per, F.col("source").eqNullSafe(F.col("of")), "inner", ("of",))
    return joined.select("row", "size", "source_size", "target", (F.floor(_rate()) + _extra(F.col("u"), F.col("turn"))).cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken."""
    return mix(docs, **options).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
