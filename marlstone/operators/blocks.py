"""Block and wavelet transforms as integer lifting plans, run by numpy over batches of planes.

A step (target, mode, terms, mul, shift) updates one lane of every row of a block by s = sum(terms) * mul >> shift:
"+" and "-" add and subtract it, "r" replaces the lane by s minus the lane (its own inverse).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Step = tuple[int, str, tuple[int, ...], int, int]


def butterflies(size: int, full: bool) -> list[Step]:
    """Lifting butterflies of distance 1, 2, 4, ...: over all lanes (Walsh-Hadamard) or the leading ones (Haar)."""
    steps: list[Step] = []
    gap = 1
    while gap < size:
        lows = [i for i in range(size) if not i & gap and (full or not i % (2 * gap))]
        steps += [(i + gap, "-", (i,), 1, 0) for i in lows] + [(i, "+", (i + gap,), 1, 1) for i in lows]
        gap *= 2
    return steps


def folded(size: int, lanes: list[int]) -> list[Step]:
    """Differences and means of lanes mirrored about the middle."""
    half = len(lanes) // 2
    pairs = [(lanes[i], lanes[-1 - i]) for i in range(half)]
    return [(b, "r", (a,), 1, 0) for a, b in pairs] + [(a, "-", (b,), 1, 1) for a, b in pairs]


_EVEN4 = [*folded(4, [0, 1, 2, 3]), *folded(4, [0, 1]), (2, "r", (3,), 13, 5), (3, "-", (2,), 11, 5)]
#: Rotations of the published binDCT-C7 lattice behind the fold.
_ODD8 = [(5, "-", (6,), 13, 5), (6, "+", (5,), 11, 4), (5, "r", (6,), 15, 5), *folded(8, [4, 5]), *folded(8, [7, 6]), (4, "r", (7,), 3, 4), (7, "-", (4,), 3, 4), (5, "+", (6,), 11, 4), (6, "-", (5,), 15, 5)]


def wavelet(size: int, kind: str) -> list[Step]:
    """One level over even lanes (details) and odd lanes (means), symmetric at the borders; size is even."""
    steps: list[Step] = []
    if kind == "haar":
        steps = [(k, "-", (k + 1,), 1, 0) for k in range(0, size, 2)] + [(k + 1, "+", (k,), 1, 1) for k in range(0, size, 2)]
    if kind == "legall53":
        steps = [(k, "-", (max(k - 1, 1), k + 1), 1, 1) for k in range(0, size, 2)]
        steps += [(k, "+", (k - 1, min(k + 1, size - 2)), 1, 2) for k in range(1, size, 2)]
    if kind == "cdf97":
        for mul, odd in zip((-103949, -3472, 57862, 29066), (False, True, False, True), strict=True):  # lifting constants of CDF 9/7 in 1/65536
            steps += [(k, "+", (max(k - 1, 1), k + 1) if not odd else (k - 1, min(k + 1, size - 2)), mul, 16) for k in range(int(odd), size, 2)]
    return steps


#: name -> (block size, steps, order in which lanes are stored)
PLANS: dict[str, tuple[int, list[Step], tuple[int, ...]]] = {
    # LeGall 5/3 whose first detail has one neighbour, and whose last mean takes half of the one detail beside it
    "t64_legallcg": (8, [(0, "-", (1,), 1, 0), (2, "-", (1, 3), 1, 1), (1, "+", (0, 2), 1, 2), (4, "-", (3, 5), 1, 1), (3, "+", (2, 4), 1, 2), (6, "-", (5, 7), 1, 1), (5, "+", (4, 6), 1, 2), (7, "+", (6,), 1, 1)], (1, 3, 5, 7, 0, 2, 4, 6)),
    "t95_lazy": (8, [], (1, 3, 5, 7, 0, 2, 4, 6)),
    "t96_haar": (8, wavelet(8, "haar"), (1, 3, 5, 7, 0, 2, 4, 6)),
    "t98_legall53": (8, wavelet(8, "legall53"), (1, 3, 5, 7, 0, 2, 4, 6)),
    "t99_cdf97": (8, wavelet(8, "cdf97"), (1, 3, 5, 7, 0, 2, 4, 6)),
    "t101_dct4": (4, _EVEN4, (0, 2, 1, 3)),
    "t102_dct8": (8, [*folded(8, list(range(8))), *_EVEN4, *_ODD8], (0, 7, 3, 6, 1, 5, 2, 4)),
    "t103_wht4": (4, butterflies(4, True), (0, 1, 2, 3)),
    "t104_wht8": (8, butterflies(8, True), tuple(range(8))),
    "t105_haar8": (8, butterflies(8, False), tuple(range(8))),
}


def run(x: np.ndarray, name: str, inverse: bool = False) -> np.ndarray:
    """Transform the last axis, block by block."""
    size, steps, order = PLANS[name]
    v = x.reshape(*x.shape[:-1], -1, size).copy()
    if inverse:
        back = np.empty_like(v)
        back[..., list(order)] = v
        v = back
    for target, mode, terms, mul, shift in reversed(steps) if inverse else steps:
        s = sum(v[..., t] for t in terms) * mul >> shift
        sign = {"+": "-", "-": "+", "r": "r"}[mode] if inverse else mode
        v[..., target] = s - v[..., target] if sign == "r" else v[..., target] + s if sign == "+" else v[..., target] - s
    return (v if inverse else v[..., list(order)]).reshape(x.shape)


def forward2d(x: np.ndarray, name: str) -> np.ndarray:
    """Rows, then columns."""
    return np.swapaxes(run(np.swapaxes(run(x, name), -1, -2), name), -1, -2)


def inverse2d(x: np.ndarray, name: str) -> np.ndarray:
    return run(np.swapaxes(run(np.swapaxes(x, -1, -2), name, True), -1, -2), name, True)


#: Rotations of the fast DCT in single precision: cosine and sine by pair of lanes.
_ROOT = np.float32(0.7071067811865475)
_TURNS = ((2, 6, np.float32(0.9238795325112868), np.float32(0.3826834323650898)), (1, 7, np.float32(0.19509032201612827), np.float32(0.9807852804032304)), (5, 3, np.float32(0.8314696123025453), np.float32(0.5555702330196022)))


def fast_dct8(x: np.ndarray) -> np.ndarray:
    """T-106: the DCT of the last axis (8 samples) in single precision, rounded to the nearest (even) number."""
    t = [x[..., k].astype(np.float32) for k in range(8)]
    two = np.float32(2)
    d = [t[k] - t[7 - k] for k in range(4)]
    a = [two * t[k] - d[k] for k in range(4)]
    mid, out = ((-d[2] + d[1]) * _ROOT, (d[2] + d[1]) * _ROOT), [None] * 8
    low = [a[0] - a[3], a[1] - a[2]]
    top = [two * a[0] - low[0], two * a[1] - low[1]]
    inner, outer = d[3] - mid[0], d[0] - mid[1]
    sums = [two * d[3] - inner, two * d[0] - outer]
    out[0], out[4] = (top[0] + top[1]) * _ROOT, (top[0] - top[1]) * _ROOT
    for (i, j, c, s), (u, w) in zip(_TURNS, ((low[1], low[0]), (sums[0], sums[1]), (inner, outer)), strict=True):
        out[i], out[j] = u * c + w * s, u * -s + w * c
    return np.stack([np.rint(v).astype(np.int64) for v in out], axis=-1)


def fast_dct2d(x: np.ndarray) -> np.ndarray:
    """Rows, then columns, whose results are scaled down by 8. Both passes gather lanes by frequency, which for one block a
    side leaves them where they are."""
    rows = fast_dct8(x)
    return np.swapaxes(fast_dct8(np.swapaxes(rows, -1, -2)) >> 3, -1, -2)


def apply(planes: DataFrame, transform, side: int = 8) -> DataFrame:
    """Apply a numpy function (n, side, side) -> (n, side, side) to the px arrays of (image_id, px)."""

    def kernel(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b["px"].flatten()).astype(np.int64).reshape(b.num_rows, side, side)
                yield pa.RecordBatch.from_arrays([b["image_id"], pa.array(transform(x).reshape(b.num_rows, -1).tolist(), pa.list_(pa.int64()))], ["image_id", "px"])

    return planes.select("image_id", "px").mapInArrow(kernel, "image_id long, px array<long>")


def forward(planes: DataFrame, name: str) -> DataFrame:
    return apply(planes, partial(forward2d, name=name))


def inverse(planes: DataFrame, name: str) -> DataFrame:
    return apply(planes, partial(inverse2d, name=name))


def roundtrip(planes: DataFrame, name: str, side: int = 8) -> DataFrame:
    """(image_id, digest, mismatches): coefficients weighted by place, and 1 if the inverse doesn't restore the plane."""

    def kernel(batches):
        for b in batches:
            if b.num_rows:
                x = b["px"].flatten().to_numpy().astype(np.int64).reshape(b.num_rows, side, side)
                out = forward2d(x, name)
                flat = out.reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([b["image_id"], pa.array(flat @ np.arange(1, flat.shape[1] + 1)), pa.array((inverse2d(out, name) != x).any((1, 2)).astype(np.int64))], ["image_id", "digest", "mismatches"])

    return planes.select("image_id", "px").mapInArrow(kernel, "image_id long, digest long, mismatches long")


def sql(source: str, name: str) -> str:
    """The same 2D transform of a table (image_id, p0 ... p63) as nested SQL, for comparison."""
    size, steps, order = PLANS[name]
    text = f"SELECT * FROM {source}"
    for axis in ("row", "col"):
        at = lambda line, lane, axis=axis: line * 8 + lane if axis == "row" else lane * 8 + line
        for target, mode, terms, mul, shift in steps:
            sets = []
            for line in range(8):
                for base in range(0, 8, size):
                    t = f"p{at(line, base + target)}"
                    s = f"((({' + '.join(f'p{at(line, base + k)}' for k in terms)}) * {mul}) >> {shift})"
                    sets.append(f"{s} - {t} AS {t}" if mode == "r" else f"{t} {mode} {s} AS {t}")
            text = f"SELECT * REPLACE ({', '.join(sets)}) FROM ({text})"
        moved = [f"p{at(line, base + order[k])} AS p{at(line, base + k)}" for line in range(8) for base in range(0, 8, size) for k in range(size)]
        text = f"SELECT image_id, {', '.join(moved)} FROM ({text})"
    return text
