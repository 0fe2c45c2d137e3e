"""Size estimators whose contexts follow a running state of the residuals: C-07, C-09 to C-11, C-13, C-14 and C-19.

The state of a sample depends on all samples before it, so it is computed sample by sample, but for all planes of a batch
at once: a step is a handful of numpy operations over the planes. Histograms and costs are arrays over planes as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .predict import moved

SIDE, DEPTH, PRECISION = 8, 8, 3
HALF, LEVELS = 1 << (DEPTH - 1), 1 << DEPTH
CONTEXTS, C2_CONTEXTS, BPD_CONTEXTS = 17, 24, 18
#: Probabilities have 12 bits; planes that are worked on at a time.
SLOTS, PLANES_AT_ONCE = 1 << 12, 256
#: A count that reaches this halves the counts of its context.
HALVE_AT = 3200
#: A symbol's bits by size, without floating point near the powers of two.
_LOG2 = np.array([max(0, i.bit_length() - 1) for i in range(1 << 16)])


def floor_log2(x: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1 on (0 counts as 1); below 2 ** 48."""
    high, middle = x >> 32, x >> 16
    return np.where(high > 0, 32 + _LOG2[np.minimum(high, 65535)], np.where(middle > 0, 16 + _LOG2[np.minimum(middle, 65535)], _LOG2[np.minimum(x, 65535)]))


def zigzag(v: np.ndarray) -> np.ndarray:
    return np.where(v < 0, -2 * v - 1, 2 * v)


def running(sym: np.ndarray, precision: int = PRECISION, near: tuple[int, int] = (2, 3)) -> np.ndarray:
    """W-19: the state before each sample, (2 * state + (sym << precision) + max(two states of the row above)) >> 2; it
    starts a row at 0, and is 0 outside the plane. `near` tells how far to the right the states above stand."""
    n, h, w = sym.shape
    out, above = np.zeros((n, h, w), dtype=np.int64), np.zeros((n, w + max(near)), dtype=np.int64)
    for y in range(h):
        state = np.zeros(n, dtype=np.int64)
        row = np.zeros_like(above)
        for x in range(w):
            out[:, y, x] = state
            state = (2 * state + (sym[:, y, x] << precision) + np.maximum(above[:, x + near[0]], above[:, x + near[1]])) >> 2
            row[:, x] = state
        above = row
    return out


def by_state(state: np.ndarray, contexts: int) -> np.ndarray:
    return np.minimum(contexts - 1, floor_log2(state * state + 1))


def magnitude_contexts(v: np.ndarray) -> np.ndarray:
    """C-09, C-14."""
    return by_state(running(zigzag(v)), CONTEXTS)


def noise_contexts(v: np.ndarray) -> np.ndarray:
    """C-10: the smaller of a column's and a row's running magnitude, and which one it is."""
    n, h, w = v.shape
    sym, out = zigzag(v) << PRECISION, np.zeros(v.shape, dtype=np.int64)
    column = np.zeros((n, w), dtype=np.int64)
    for y in range(h):
        row = np.zeros(n, dtype=np.int64)
        for x in range(w):
            up = column[:, x]
            out[:, y, x] = by_state(np.minimum(up, row), C2_CONTEXTS // 2) + C2_CONTEXTS // 2 * (up < row)
            row = row + (sym[:, y, x] - row >> 3)
            column[:, x] = up + (sym[:, y, x] - up >> 3)
    return out


def histogram(ctx: np.ndarray, v: np.ndarray, contexts: int) -> np.ndarray:
    """A-19: counts by plane, context and level (from the least level on)."""
    n = len(v)
    key = (np.arange(n)[:, None, None] * contexts + ctx) * LEVELS + (v + HALF & LEVELS - 1)
    return np.bincount(key.ravel(), minlength=n * contexts * LEVELS).reshape(n, contexts, LEVELS)


def model_bits(hist: np.ndarray) -> np.ndarray:
    """Bits of the samples by context: probabilities of SLOTS steps, of which each used level keeps one."""
    total, used = hist.sum(-1, keepdims=True), (hist > 0).sum(-1, keepdims=True)
    prob = hist * (SLOTS - used) // np.maximum(total, 1) + 1
    return np.where(hist > 0, -hist * np.log2(prob / SLOTS), 0.0).sum(-1)


#: Levels in the order 0, -1, 1, -2, 2 .. as places of a histogram.
OUTWARD = np.array([((k >> 1 ^ -(k & 1)) + HALF) & (LEVELS - 1) for k in range(LEVELS)])


def header_bits(hist: np.ndarray) -> np.ndarray:
    """Bits of the cumulative tables by context: steps from the middle level outward as Golomb-Rice codes whose parameter
    follows what is left of the range."""
    h = hist[..., OUTWARD]
    total, used = h.sum(-1, keepdims=True), (h > 0).sum(-1, keepdims=True)
    before, ranks = np.cumsum(h, -1) - h, np.cumsum(h > 0, -1) - (h > 0)
    cdf = before * (SLOTS - used) // np.maximum(total, 1) + ranks
    step, left = np.diff(cdf, axis=-1), SLOTS - cdf[..., :-1]
    bypass = np.maximum(0, floor_log2(np.maximum(left, 1)) - np.where(np.arange(1, LEVELS) > 1, 7, 0))
    return np.where((left > 0) & (total > 0), (step >> bypass) + 1 + bypass, 0).sum(-1)


def _static(contexts: Callable[[np.ndarray], np.ndarray], count: int):
    def size(v: np.ndarray) -> np.ndarray:
        hist = histogram(contexts(v), v, count)
        return (model_bits(hist) + header_bits(hist)).sum(-1)

    return size


def golomb_bits(v: np.ndarray) -> np.ndarray:
    """C-11: adaptive Golomb-Rice codes; the parameter follows the running state at 6 bits of precision."""
    sym = zigzag(v)
    bypass = floor_log2((running(sym, 6) >> 6) + 1)
    return ((sym >> bypass) + 1 + bypass).sum((1, 2)).astype(np.float64)


def binary_bits(v: np.ndarray, order: int) -> np.ndarray:
    """C-13: a range coder of 32-bit words over the bits of each sample, one adaptive probability per node of the tree of
    bits, and with order 1 per W + N - NW (W in the first row). What the coder still holds at the end isn't counted."""
    n, h, w = v.shape
    p = np.full((n, LEVELS if order else 1, LEVELS), 0x8000, dtype=np.int64)
    low, span, bits = np.zeros(n, dtype=np.uint64), np.full(n, 0xFFFFFFFF, dtype=np.uint64), np.zeros(n)
    each, one, word = np.arange(n), np.uint64(1), np.uint64(32)
    for y in range(h):
        for x in range(w):
            west = v[:, y, x - 1] if x else np.zeros(n, dtype=np.int64)
            # N is the NE of the sample before: unknown (0) at the start of a row
            north, corner = (v[:, y - 1, x] if y and x else 0), (v[:, y - 1, x - 1] if y and x > 1 else 0)
            ctx = (west + north - corner if y else west) & (LEVELS - 1) if order else np.zeros(n, dtype=np.int64)
            node = np.ones(n, dtype=np.int64)
            for k in reversed(range(DEPTH)):
                bit = v[:, y, x] >> k & 1
                zero = np.clip(p[each, ctx, node], 16, 0x10000 - 16)
                full = span < np.uint64(0x10000)
                bits += 32 * full
                low = np.where(full, low << word, low)
                span = np.where(full, np.minimum(span << word | np.uint64(0xFFFFFFFF), ~low), span)
                part = span * zero.astype(np.uint64) >> np.uint64(16)
                low = np.where(bit > 0, low + part, low)
                span = np.where(bit > 0, span - part, part - one)
                p[each, ctx, node] = zero + ((1 - bit << 16) - zero + 64 >> 7)
                node = node * 2 + bit
    return bits


def tokens(z: np.ndarray, exp: int = 4, msb: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """C-08: hybrid integers (token, bypass bits) of zigzag values."""
    lg = floor_log2(np.maximum(z, 1))
    large = z >= 1 << exp
    shift = np.where(large, lg - msb, 0)
    return np.where(large, (1 << exp) + ((lg - exp) << msb) + (z - (1 << lg) >> shift), z), shift


def _token(v: np.ndarray) -> np.ndarray:
    return tokens(zigzag(v))[0]


def token_contexts(v: np.ndarray, name: str) -> np.ndarray:
    """C-05 by what they compute (the largest or smallest token of the changes around, not what their names say)."""
    at = {k: moved(v, *d) for k, d in {"W": (0, 1), "WW": (0, 2), "N": (1, 0), "NN": (2, 0), "NW": (1, 1), "NNWW": (2, 2), "NE": (1, -1), "NNEE": (2, -2)}.items()}
    west, north = at["W"] - at["WW"], at["N"] - at["NN"]
    falling, rising = at["NW"] - at["NNWW"], at["NE"] - at["NNEE"]
    if name == "zero":
        return np.zeros_like(v)
    if name == "qnw":
        return _token(at["N"] + at["W"] >> 1)
    if name in ("max_qn_qw", "min_qn_qw"):
        return (np.maximum if name[:3] == "max" else np.minimum)(_token(west >> 1), _token(north >> 1))
    if name == "min_n_w_nw_ne":
        return np.minimum.reduce([_token(d >> 1) for d in (west, north, falling, rising)])
    changes = np.stack([np.abs(d) for d in (west, falling, north, rising)])  # of equal changes the first wins
    values = np.stack([at["W"], at["NW"], at["N"], at["NE"]])
    return _token(np.take_along_axis(values, changes.argmin(0)[None], 0)[0])


TOKEN_CONTEXTS = ("qnw", "max_qn_qw", "min_qn_qw", "min_n_w_nw_ne", "argmin_n_w_nw_ne", "zero")


def adaptive_bits(v: np.ndarray, name: str, halve_at: int = HALVE_AT) -> np.ndarray:
    """C-07: C-05 with counts that start at 1, grow by 1 and are halved, rounded up, when one reaches `halve_at`."""
    n, h, w = v.shape
    ctx, (tok, bypass) = token_contexts(v, name), tokens(zigzag(v))
    size = int(tokens(np.array([LEVELS * 2]))[0][0]) + 1
    counts, each, bits = np.ones((n, size, size), dtype=np.int64), np.arange(n), np.zeros(n)
    for y in range(h):
        for x in range(w):
            c, t = ctx[:, y, x], tok[:, y, x]
            bits += bypass[:, y, x] - np.log2(counts[each, c, t] / counts[each, c].sum(1))
            counts[each, c, t] += 1
            over = np.flatnonzero(counts[each, c, t] >= halve_at)
            counts[over, c[over]] = counts[over, c[over]] + 1 >> 1
    return np.where((v == v[:, :1, :1]).all((1, 2)), DEPTH, bits)


ESTIMATORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "c09_grctx": _static(magnitude_contexts, CONTEXTS),
    "c10_c2": _static(noise_contexts, C2_CONTEXTS),
    "c11_golomb_rice": golomb_bits,
    "c13_abac0": lambda v: binary_bits(v, 0),
    "c13_abac1": lambda v: binary_bits(v, 1),
} | {f"c07_adaptive_{k}": (lambda v, k=k: adaptive_bits(v, k)) for k in TOKEN_CONTEXTS}


def _batches(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("px",), side: int = SIDE) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, PLANES_AT_ONCE):
            part = b.slice(i, PLANES_AT_ONCE)
            yield part["image_id"], *[part[c].flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1, side) for c in names]


#: Estimators of whole bits, whose fractions need no rounding.
WHOLE = ("c11_golomb_rice", "c13_abac0", "c13_abac1")


def sizes(planes: DataFrame, name: str) -> DataFrame:
    """(image_id, size): fraction of the raw size. Planes are arrays `px` of whole rows of SIDE samples."""

    def run(batches):
        for ids, v in _batches(batches):
            size = ESTIMATORS[name](v) / (v[0].size * DEPTH)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size if name in WHOLE else np.round(size, 6))], ["image_id", "size"])

    return planes.select("image_id", "px").mapInArrow(run, "image_id long, size double")


def context_histogram(planes: DataFrame, kind: str = "magnitude") -> DataFrame:
    """A-19: (image_id, ctx, level, freq); levels are signed."""
    contexts, count = {"magnitude": (magnitude_contexts, CONTEXTS), "noise": (noise_contexts, C2_CONTEXTS)}[kind]

    def run(batches):
        for ids, v in _batches(batches):
            hist = histogram(contexts(v), v, count)
            at = np.nonzero(hist)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[0])), pa.array(at[1].astype(np.int32)), pa.array((at[2] - HALF).astype(np.int32)), pa.array(hist[at])], ["image_id", "ctx", "level", "freq"])

    return planes.select("image_id", "px").mapInArrow(run, "image_id long, ctx int, level int, freq long")


def running_states(planes: DataFrame) -> DataFrame:
    """W-19: (image_id, states): the state before each sample, in raster order."""

    def run(batches):
        for ids, v in _batches(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(running(zigzag(v)).reshape(len(v), -1).tolist(), pa.list_(pa.int64()))], ["image_id", "states"])

    return planes.select("image_id", "px").mapInArrow(run, "image_id long, states array<long>")


def model_view(planes: DataFrame) -> DataFrame:
    """C-14: (image_id, ctx, n, bits, mean, sdev, model_bits, header_bits) per used context: coded size, moments of the
    levels (counted from 0), size under a bell curve exp(-z ** 2) of 16 bits, and size of the table. The bell's levels of
    no width cost nothing, as described; a context of one level has no deviation, and its bell size is null."""

    def run(batches):
        for ids, v in _batches(batches):
            hist = histogram(magnitude_contexts(v), v, CONTEXTS)
            n, level = hist.sum(-1), np.arange(LEVELS)
            safe = np.maximum(n, 1)
            mean = (hist * level).sum(-1) / safe
            sdev = np.sqrt((hist * (level - mean[..., None]) ** 2).sum(-1) / safe)
            z = (level - mean[..., None]) / np.where(sdev > 0, sdev, 1.0)[..., None]
            bell = np.floor(np.exp(-z * z) * 0x10000)
            cross = np.where(bell > 0, -hist * np.log2(np.maximum(bell, 1) / bell.sum(-1, keepdims=True)), 0.0).sum(-1)
            at = np.nonzero(n)
            columns = {"n": n[at], "bits": model_bits(hist)[at], "mean": mean[at], "sdev": sdev[at], "model_bits": pa.array(cross[at], mask=sdev[at] == 0), "header_bits": header_bits(hist)[at]}
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[0])), pa.array(at[1].astype(np.int32)), *[pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()]], ["image_id", "ctx", *columns])

    return planes.select("image_id", "px").mapInArrow(run, "image_id long, ctx int, n long, bits double, mean double, sdev double, model_bits double, header_bits long")
