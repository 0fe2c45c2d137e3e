"""Reversible color transforms as lifting steps on the columns r, g, b.

A step (target, sign, term) adds or subtracts a term made of the other channels; the inverse runs the steps backwards
with the signs flipped. Terms are SQL text with floor shifts (>>) and truncating division (div), which Spark evaluates
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = tuple[str, str, str]
_SUB: list[Step] = [("r", "-", "g"), ("b", "-", "g")]


def _ycbcr(luma: str) -> list[Step]:
    return [("r", "-", "g"), ("g", "+", "r >> 1"), ("b", "-", "g"), ("g", "+", luma)]


#: Lifting steps by name; the output order of the channels follows in ORDER.
LIFTS: dict[str, list[Step]] = {
    "t02_subgreen": _SUB,
    "t03_jpeg2000": [*_SUB, ("g", "+", "(r + b) >> 2")],
    "t05_nbli": [*_SUB, ("g", "+", "(r + b) >> 2"), ("b", "-", "r >> 2")],
    "t06_ycocg_r": [("r", "-", "b"), ("b", "+", "r >> 1"), ("g", "-", "b"), ("b", "+", "g >> 1")],
    "t07_ycbcr_r_v1": _ycbcr("b >> 1"),
    "t08_ycbcr_r_v2": _ycbcr("(2 * b - r) >> 3"),
    "t09_ycbcr_r_v3": _ycbcr("(2 * b + r) >> 3"),
    "t10_ycbcr_r_v4": _ycbcr("b div 3"),
    "t11_ycbcr_r_v5": _ycbcr("(6 * b) >> 4"),
    "t12_ycbcr_r_v6": _ycbcr("(14 * b) >> 5"),
    "t13_ycbcr_r_v7": _ycbcr("(10 * b - r) >> 5"),
    "t14_pei09": [("b", "-", "(87 * r + 169 * g + 128) >> 8"), ("r", "-", "g"), ("g", "+", "(86 * r + 29 * b + 128) >> 8")],
    # a parametric lifting transform: coefficients in 1/32 as the caller's search finds them
    "t17_custom": [("r", "-", "(20 * g + 12 * b) >> 5"), ("b", "-", "(28 * g + 4 * r) >> 5"), ("g", "+", "(9 * r + 7 * b) >> 5")],
}
ORDER = {name: ("b", "r", "g") if name == "t06_ycocg_r" else ("g", "b", "r") for name in LIFTS}
#: Recipes of channel subtraction: signals per output channel; the first of equal cost wins.
RECIPES = (
    ("r", "g", "b"), ("r", "g", "b-g"), ("r", "g", "b-r"), ("g", "b", "r-g"), ("g", "b", "r-b"), ("b", "r", "g-r"), ("b", "r", "g-b"), ("g", "b-g", "r-g"),
    ("g", "b-g", "r-b"), ("g", "r-g", "b-r"), ("b", "r-b", "g-b"), ("b", "r-b", "g-r"), ("b", "g-b", "r-g"), ("r", "g-r", "b-r"), ("r", "g-r", "b-g"), ("r", "b-r", "g-b"),
)


def wrap(e: str, depth: int = 8) -> str:
    half = 1 << (depth - 1)
    return f"((({e}) + {half}) & {2 * half - 1}) - {half}"


def lift(df: DataFrame, steps: list[Step], inverse: bool = False) -> DataFrame:
    for target, sign, term in reversed(steps) if inverse else steps:
        flip = {"+": "-", "-": "+"}[sign] if inverse else sign
        df = df.withColumn(target, F.expr(f"{target} {flip} ({term})"))
    return df


def forward(df: DataFrame, name: str) -> DataFrame:
    """Columns c0, c1, c2 instead of r, g, b."""
    out = lift(df, LIFTS[name])
    return out.select("image_id", "y", "x", *[F.col(c).alias(f"c{i}") for i, c in enumerate(ORDER[name])])


def inverse(df: DataFrame, name: str) -> DataFrame:
    back = df.select("image_id", "y", "x", *[F.col(f"c{i}").alias(c) for i, c in enumerate(ORDER[name])])
    return lift(back, LIFTS[name], inverse=True).select("image_id", "y", "x", "r", "g", "b")


def lift_sql(source: str, name: str) -> str:
    """The forward transform as nested SQL, for comparison."""
    sql = f"SELECT image_id, y, x, r, g, b FROM {source}"
    for target, sign, term in LIFTS[name]:
        e = f"{target} {sign} ({term.replace(' div ', ' // ')}) AS {target}"
        sql = f"SELECT image_id, y, x, {', '.join(e if c == target else c for c in 'rgb')} FROM ({sql})"
    return f"SELECT image_id, y, x, {', '.join(f'{c} AS c{i}' for i, c in enumerate(ORDER[name]))} FROM ({sql})"
