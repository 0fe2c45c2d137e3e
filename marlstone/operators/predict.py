"""Neighbour prediction over planes: residuals and their inverse in Arrow kernels, or residuals as windows over pixels.

Each predictor is written once, over an arithmetic `o` and named neighbours, and runs on arrays (all samples of a batch of
planes at once; for the inverse one sample of all planes) or on SQL text (windows over pixels, and DuckDB for comparison).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Neighbours by name: (rows up, columns to the left; negative: to the right).
AT = {"W": (0, 1), "WW": (0, 2), "N": (1, 0), "NW": (1, 1), "NE": (1, -1), "NEE": (1, -2), "NEEE": (1, -3), "NWW": (1, 2), "NN": (2, 0), "NNE": (2, -1), "NNEE": (2, -2), "NNW": (2, 1), "NNWW": (2, 2)}


class Text(str):
    """SQL text with arithmetic."""

    def _two(self, op: str, other, swap: bool = False) -> Text:
        a, b = (other, self) if swap else (self, other)
        return Text(f"({a} {op} {b})")

    def __add__(self, o):
        return self._two("+", o)

    def __radd__(self, o):
        return self._two("+", o, True)

    def __sub__(self, o):
        return self._two("-", o)

    def __rsub__(self, o):
        return self._two("-", o, True)

    def __mul__(self, o):
        return self._two("*", o)

    __rmul__ = __mul__

    def __rshift__(self, o):
        return self._two(">>", o)

    def __and__(self, o):
        return self._two("&", o)

    def __gt__(self, o):
        return self._two(">", o)

    def __lt__(self, o):
        return self._two("<", o)


class Sql:
    def __init__(self, dialect: str = "spark"):
        self.divides = "div" if dialect == "spark" else "//"

    def min(self, *a):
        return Text(f"least({', '.join(map(str, a))})")

    def max(self, *a):
        return Text(f"greatest({', '.join(map(str, a))})")

    def abs(self, a):
        return Text(f"abs({a})")

    def where(self, c, a, b):
        return Text(f"(CASE WHEN {c} THEN {a} ELSE {b} END)")

    def div(self, a, b):
        return Text(f"({a} {self.divides} {b})")


def clamp(o, v, *among):
    return o.max(o.min(*among), o.min(o.max(*among), v))


def gradient(o, n):
    return clamp(o, n["N"] + n["W"] - n["NW"], n["N"], n["W"])


def select(o, n):
    return o.where(o.abs(n["N"] - n["NW"]) > o.abs(n["W"] - n["NW"]), n["N"], n["W"])


def average(o, n):
    return (n["N"] + n["W"]) >> 1


def average4(o, n):
    return clamp(o, (4 * (n["N"] + n["W"]) + n["NE"] - n["NW"]) >> 3, n["N"], n["W"], n["NE"], n["NEEE"])


def flattest(o, n):
    """The neighbour in the direction that changes least; of equal changes W, N, NW, NE in this order."""
    change = {k: o.abs(n[k] - n[k2]) for k, k2 in (("W", "WW"), ("N", "NN"), ("NW", "NNWW"), ("NE", "NNEE"))}
    best, least = n["W"], change["W"]
    for k in ("N", "NW", "NE"):
        best, least = o.where(least > change[k], n[k], best), o.min(least, change[k])
    return best


def gradient_weighted(o, n):
    gx, gy = o.abs(n["W"] - n["NW"]) + 1, o.abs(n["N"] - n["NW"]) + 1
    return o.div(gx * n["N"] + gy * n["W"], gx + gy)


def taps(shift: int, **weights: int):
    """A clamped linear predictor: weighted neighbours over 2 ** shift."""

    def run(o, n):
        total = sum(w * n[k] for k, w in weights.items())
        return clamp(o, total >> shift, n["N"], n["W"], n["NE"])

    return run


Predictor = Callable[[object, dict], object]
#: name -> (predictor, edge rule): "zero" outside the plane, or "clamp" (row 0 uses W, column 0 uses N).
PREDICTORS: dict[str, tuple[Predictor, str]] = {
    "t38_clampgrad": (gradient, "clamp"),
    "t39_select": (select, "zero"),
    "t40_av2": (average, "zero"),
    "t57_av4": (average4, "zero"),
    "t58_sel4": (flattest, "zero"),
    "t62_cg422": (lambda o, n: o.where((n["x"] & 1) > 0, n["W"], gradient(o, n)), "zero"),
    "t63_cg420": (lambda o, n: o.where((n["y"] & 1) > 0, o.where((n["x"] & 1) > 0, gradient(o, n), n["N"]), o.where((n["x"] & 1) > 0, n["W"], gradient(o, n))), "zero"),
    "t83_custom": (taps(5, N=13, W=14, NW=-5, NE=8, NN=1, WW=1), "zero"),
    "c18_zero": (lambda o, n: n["N"] * 0, "zero"),
    "c18_n": (lambda o, n: n["N"] + 0, "zero"),
    "c18_w": (lambda o, n: n["W"] + 0, "zero"),
    "c18_wg": (gradient_weighted, "zero"),
    "c18_av3": (taps(2, N=3, W=3, NW=-2), "zero"),
    "c18_av5": (taps(3, N=5, W=8, NW=-5, NE=1, WW=-1), "zero"),
    "c18_av6": (taps(3, NN=-1, N=6, W=8, NW=-5, NE=1, WW=-1), "zero"),
    "c18_av9": (taps(4, NN=-2, N=10, W=16, NW=-9, NE=4, WW=-2, NNW=1, NNE=-1, NWW=-1), "zero"),
    "c18_avb": (taps(8, NNWW=4, NNW=3, NN=-31, NNE=-38, NWW=7, NW=-158, N=219, NE=30, NEE=19, WW=-42, W=243), "zero"),
}


def with_neighbours(planes: DataFrame, names=tuple(AT), value: str = "v") -> DataFrame:
    """Columns of neighbours, 0 outside. Both windows are partitioned inside one image, so one exchange serves both."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    side = lambda dx: F.col(value) if not dx else F.lag(value, dx, 0).over(row) if dx > 0 else F.lead(value, -dx, 0).over(row)
    shifts = sorted({dx for k in names for _, dx in [AT[k]]})
    df = planes.repartition("image_id").select("*", *[side(dx).alias(f"_s{dx + 9}") for dx in shifts])
    return df.select(*planes.columns, *[(F.col(f"_s{dx + 9}") if not dy else F.lag(f"_s{dx + 9}", dy, 0).over(col)).alias(k) for k, (dy, dx) in ((k, AT[k]) for k in names)])


def neighbours_sql(source: str, names=tuple(AT), value: str = "v") -> str:
    side = {dx: value if not dx else f"{'lag' if dx > 0 else 'lead'}({value}, {abs(dx)}, 0) OVER (PARTITION BY image_id, y ORDER BY x)" for dx in {AT[k][1] for k in names}}
    inner = f"SELECT *, {', '.join(f'{e} AS s{dx + 9}' for dx, e in side.items())} FROM {source}"
    outer = ", ".join(f"s{AT[k][1] + 9} AS \"{k}\"" if not AT[k][0] else f"lag(s{AT[k][1] + 9}, {AT[k][0]}, 0) OVER (PARTITION BY image_id, x ORDER BY y) AS \"{k}\"" for k in names)
    return f"SELECT * EXCLUDE ({', '.join(f's{dx + 9}' for dx in side)}), {outer} FROM ({inner})"


def text(name: str, dialect: str = "spark", depth: int = 8) -> str:
    """The wrapped residual as SQL over neighbour columns."""
    predictor, edge = PREDICTORS[name]
    n = {k: Text(k) for k in (*AT, "x", "y")}
    p = predictor(Sql(dialect), n)
    if edge == "clamp":
        p = f"(CASE WHEN y = 0 THEN W WHEN x = 0 THEN N ELSE {p} END)"
    half = 1 << (depth - 1)
    return f"(((v - {p}) + {half}) & {2 * half - 1}) - {half}"


class Arrays:
    """Arithmetic of predictors over arrays."""

    @staticmethod
    def min(*a):
        return np.minimum.reduce(np.broadcast_arrays(*a))

    @staticmethod
    def max(*a):
        return np.maximum.reduce(np.broadcast_arrays(*a))

    abs = staticmethod(np.abs)
    where = staticmethod(np.where)

    @staticmethod
    def div(a, b):
        return np.where(a < 0, -(-a // b), a // b)


def moved(v: np.ndarray, up: int, left: int) -> np.ndarray:
    """Planes moved so that each sample sees that neighbour, 0 outside."""
    n, h, w = v.shape
    out = np.zeros_like(v)
    a, b = max(0, left), min(w, w + left)
    out[:, up:, a:b] = v[:, : h - up, a - left : b - left]
    return out


def _prediction(name: str, n: dict, y, x):
    predictor, edge = PREDICTORS[name]
    p = predictor(Arrays, n | {"x": x, "y": y})
    return np.where(y == 0, n["W"], np.where(x == 0, n["N"], p)) if edge == "clamp" else p


def forward(v: np.ndarray, name: str, depth: int = 8) -> np.ndarray:
    """Wrapped residuals of planes (n, h, w), all samples at once."""
    half = 1 << (depth - 1)
    y, x = np.indices(v.shape[1:])
    return (v - _prediction(name, {k: moved(v, *d) for k, d in AT.items()}, y, x) + half & 2 * half - 1) - half


def inverse(res: np.ndarray, name: str, depth: int = 8) -> np.ndarray:
    """Planes from their residuals, sample by sample for all planes at once."""
    n, h, w = res.shape
    half, pad = 1 << (depth - 1), 4
    out = np.zeros((n, h + 2, w + 2 * pad), dtype=np.int64)
    for y in range(h):
        for x in range(w):
            near = {k: out[:, y + 2 - dy, x + pad - dx] for k, (dy, dx) in AT.items()}
            out[:, y + 2, x + pad] = (res[:, y, x] + _prediction(name, near, np.int64(y), np.int64(x)) + half & 2 * half - 1) - half
    return out[:, 2:, pad : pad + w]


def roundtrip(planes: DataFrame, name: str, side: int = 8) -> DataFrame:
    """(image_id, digest, magnitude, mismatches) of planes `px` of rows of `side` samples: residuals weighted by place, their
    sum of magnitudes, and samples that the inverse doesn't restore. Every plane stays in its task."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = b["px"].flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1, side)
                res = forward(v, name)
                flat = res.reshape(len(v), -1)
                yield pa.RecordBatch.from_arrays([b["image_id"], pa.array(flat @ np.arange(1, flat.shape[1] + 1)), pa.array(np.abs(flat).sum(1)), pa.array((inverse(res, name) != v).sum((1, 2)))], ["image_id", "digest", "magnitude", "mismatches"])

    return planes.select("image_id", "px").mapInArrow(run, "image_id long, digest long, magnitude long, mismatches long")


def residuals(planes: DataFrame, name: str) -> DataFrame:
    """(image_id, y, x, v, res) of pixels, by windows inside images; for planes as arrays see `forward`."""
    return with_neighbours(planes).select("image_id", "y", "x", "v", F.expr(text(name)).cast("long").alias("res"))
