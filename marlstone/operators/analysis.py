"""Analyses that choose channels, predictors and recipes for colour images: C-04, C-18 and C-19.

Images travel as three arrays of samples a row, and kernels work on all images of a batch at once. Predictors are written
once over an arithmetic, so that the same formulas run on arrays here and as SQL text for comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import color, contexts, sequential
from .predict import Arrays, clamp, gradient, moved

HALF, MASK = 128, 255
#: The channels of C-18, by what is subtracted from a channel: a weighted mean of the next and the next but
#: one channel, as (weight of the next, weight of the one after, divisor).
OFFSETS = ((0, 0, 1), (1, 0, 1), (3, 1, 4), (1, 1, 2), (1, 3, 4), (0, 1, 1))
CHANNELS = ("r", "g", "b", "rg", "gb", "br", "r1", "g1", "b1", "r2", "g2", "b2", "r3", "g3", "b3", "rb", "gr", "bg")
#: Recipes of C-18 as channels of a luma and two chromas; the first of equal size wins.
RECIPES = (
    "r g b", "r g bg", "r g br", "r g b1", "r g b2", "r g b3", "r gr br", "r gr bg", "r gr b1", "r gr b2", "r gr b3", "r b g1", "r b g2", "r b g3", "r br gb", "r br g1", "r br g2", "r br g3",
    "g b rg", "g b rb", "g b r1", "g b r2", "g b r3", "g bg rg", "g bg rb", "g bg r1", "g bg r2", "g bg r3", "g rg br", "g rg b1", "g rg b2", "g rg b3",
    "b r gr", "b r gb", "b rb gb", "b rb gr", "b rb g1", "b rb g2", "b rb g3", "b gb rg", "b gb r1", "b gb r2", "b gb r3",
)


def _within(total):
    """A predictor that stays within its neighbours N, W and NE."""
    return lambda o, n: clamp(o, total(n), n["N"], n["W"], n["NE"])


def _slope_weighted(o, n):
    across = o.abs(n["W"] - n["WW"]) + o.abs(n["N"] - n["NW"]) + o.abs(n["NE"] - n["N"]) + 1
    down = o.abs(n["W"] - n["NW"]) + o.abs(n["N"] - n["NN"]) + o.abs(n["NE"] - n["NNE"]) + 1
    return o.div(across * n["N"] + down * n["W"], across + down)


#: The predictors of C-18 in their order.
PREDICTORS = (
    lambda o, n: n["N"] * 0,
    lambda o, n: n["N"] + 0,
    lambda o, n: n["W"] + 0,
    lambda o, n: o.div(n["N"] + n["W"], 2),
    _slope_weighted,
    gradient,
    _within(lambda n: (3 * (n["N"] + n["W"]) - 2 * n["NW"] + 2) >> 2),
    _within(lambda n: (4 * (n["N"] + n["W"]) + n["NE"] - n["NW"] + 4) >> 3),
    _within(lambda n: n["W"] + ((5 * (n["N"] - n["NW"]) + n["NE"] - n["WW"] + 4) >> 3)),
    _within(lambda n: n["W"] + ((6 * n["N"] - 5 * n["NW"] + n["NE"] - n["NN"] - n["WW"] + 4) >> 3)),
    _within(lambda n: n["W"] + ((10 * n["N"] - 9 * n["NW"] + 4 * n["NE"] - 2 * (n["NN"] + n["WW"]) - n["NNE"] + n["NNW"] - n["NWW"] + 8) >> 4)),
    _within(lambda n: (4 * n["NNWW"] + 3 * n["NNW"] - 31 * n["NN"] - 38 * n["NNE"] + 7 * n["NWW"] - 158 * n["NW"] + 219 * n["N"] + 30 * n["NE"] + 19 * n["NEE"] - 42 * n["WW"] + 243 * n["W"] + 128) >> 8),
)
#: Neighbours by name: rows up, columns to the left.
AT = {"W": (0, 1), "WW": (0, 2), "N": (1, 0), "NW": (1, 1), "NE": (1, -1), "NEE": (1, -2), "NWW": (1, 2), "NN": (2, 0), "NNE": (2, -1), "NNW": (2, 1), "NNWW": (2, 2)}


def wrapped(o, target, prediction, offset):
    """The residual in 0 .. 255 of a prediction of what an offset leaves."""
    return (target - o.min(o.max(prediction + offset, -HALF), HALF - 1) + HALF) & MASK


def entropy_bits(sym: np.ndarray, levels: int = 256) -> np.ndarray:
    """Order-0 bits of each row of symbols."""
    n = len(sym)
    hist = np.bincount((np.arange(n)[:, None] * levels + sym.reshape(n, -1)).ravel(), minlength=n * levels).reshape(n, levels)
    return np.where(hist > 0, -hist * np.log2(np.maximum(hist, 1) / max(1, sym[0].size)), 0.0).sum(1)


def offsets(rgb: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(channel, offset) of the 18 channels of C-18."""
    for a, b, over in OFFSETS:
        for c in range(3):
            yield rgb[c], Arrays.div(a * rgb[(c + 1) % 3] + b * rgb[(c + 2) % 3], over)


def channel_sizes(rgb: list[np.ndarray]) -> np.ndarray:
    """C-18: bytes a pixel of each image, channel and predictor, over the interior (two samples away from the left, right
    and upper edges)."""
    n, h, w = rgb[0].shape
    out = np.zeros((n, len(CHANNELS), len(PREDICTORS)))
    inside = np.s_[:, 2:h, 2 : w - 2]
    for k, (target, offset) in enumerate(offsets(rgb)):
        v = target - offset
        near = {name: v[:, 2 - up : h - up, 2 - left : w - 2 - left] for name, (up, left) in AT.items()}
        for p, predictor in enumerate(PREDICTORS):
            sym = wrapped(Arrays, target[inside], predictor(Arrays, near), offset[inside])
            out[:, k, p] = entropy_bits(sym) / sym[0].size / 8
    return np.round(out, 9)


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for ids, *planes in contexts._batches(batches, ("r", "g", "b")):
        yield ids, planes


def best_predictors(images: DataFrame) -> DataFrame:
    """C-18, O-04: (image_id, channel, pred, size): the best predictor of each channel, the first of equal size."""

    def run(batches):
        for ids, rgb in _images(batches):
            size = channel_sizes(rgb)
            best, k = size.argmin(2), np.arange(len(CHANNELS))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(size)), len(k)))), pa.array(list(CHANNELS) * len(size)), pa.array(best.ravel().astype(np.int32)), pa.array(np.round(size.min(2).ravel(), 6))], ["image_id", "channel", "pred", "size"])

    return images.mapInArrow(run, "image_id long, channel string, pred int, size double")


def best_recipe(images: DataFrame) -> DataFrame:
    """C-18: (image_id, recipe, preds, size): the recipe whose three channels, each with its best predictor, are smallest
    together; the first of equal size. `size` is their mean."""
    table = np.array([[CHANNELS.index(c) for c in r.split()] for r in RECIPES])

    def run(batches):
        for ids, rgb in _images(batches):
            size = channel_sizes(rgb)
            total = np.round(size.min(2)[:, table].sum(2), 9)
            best = total.argmin(1)
            preds = np.take_along_axis(size.argmin(2), table[best], 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array([RECIPES[k] for k in best]), pa.array([" ".join(map(str, p)) for p in preds.tolist()]), pa.array(np.round(total.min(1) / 3, 6))], ["image_id", "recipe", "preds", "size"])

    return images.mapInArrow(run, "image_id long, recipe string, preds string, size double")


def signals(rgb: list[np.ndarray]) -> dict[str, np.ndarray]:
    r, g, b = rgb
    return {"r": r, "g": g, "b": b, "r-g": r - g, "g-b": g - b, "b-r": b - r}


#: A difference and its negative are one signal.
SIGNAL_OF = {"r": 0, "g": 1, "b": 2, "r-g": 3, "g-r": 3, "g-b": 4, "b-g": 4, "b-r": 5, "r-b": 5}
_RECIPES = np.array([[SIGNAL_OF[c] for c in r] for r in color.RECIPES])


def gradient_of(v: np.ndarray) -> np.ndarray:
    """The clamped gradient of planes, 0 outside."""
    return gradient(Arrays, {k: moved(v, *AT[k]) for k in ("N", "W", "NW")})


def entropy_recipe(images: DataFrame) -> DataFrame:
    """C-04: (image_id, recipe, size): the recipe whose signals have the least order-0 bytes after the clamped gradient."""

    def run(batches):
        for ids, rgb in _images(batches):
            bits = np.stack([entropy_bits(s - gradient_of(s) + HALF & MASK) for s in signals(rgb).values()], axis=1)
            total = np.round(bits[:, _RECIPES].sum(2) / 8, 9)
            yield pa.RecordBatch.from_arrays([ids, pa.array(total.argmin(1).astype(np.int32)), pa.array(np.round(total.min(1), 6))], ["image_id", "recipe", "size"])

    return images.mapInArrow(run, "image_id long, recipe int, size double")


def least_change_recipe(rgb: list[np.ndarray]) -> np.ndarray:
    """C-03: by the sums of absolute differences to the previous pixel of the raster (0 before the first)."""
    n = len(rgb[0])
    costs = np.stack([np.abs(np.diff(s.reshape(n, -1), axis=1, prepend=0)).sum(1) for s in signals(rgb).values()], axis=1)
    return costs[:, _RECIPES].sum(2).argmin(1)


#: What codes a channel once the recipe is chosen.
RECIPE_MODELS = {"t37_cgcrct": sequential.Gradient, "t29_l1crct": sequential.MODELS["t30_ols7"], "t31_l1bcrct": sequential.TwoStageMix, "ols": sequential.Ols, "wp": sequential.Weighted}


def recipe_code(images: np.ndarray, name: str, recipe: np.ndarray, inverse: bool = False) -> np.ndarray:
    """T-29, T-31, T-37: images (n, 3, h, w) as residuals in the order of their recipes' channels, or the images."""
    out = np.empty_like(images)
    for k in np.unique(recipe):
        at = np.flatnonzero(recipe == k)
        known: dict[str, np.ndarray] = {} if inverse else {c: images[at, i] for i, c in enumerate("rgb")}
        for i, signal in enumerate(color.RECIPES[k]):
            target, _, offset = signal.partition("-")
            here = images[at, i] if inverse else known[target]
            got = sequential.code_offset(here, known[offset] if offset else np.zeros_like(here), RECIPE_MODELS[name], inverse)
            if inverse:
                known[target] = got
            else:
                out[at, i] = got
        if inverse:
            out[at] = np.stack([known[c] for c in "rgb"], axis=1)
    return out


def model_sizes(images: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """C-21, C-22: (image_id, a column per model, best): order-0 bits a sample of each model's residuals per channel and
    running context, after C-03's recipe; the first of equal size is best."""

    def run(batches):
        for ids, rgb in _images(batches):
            v, recipe, sizes = np.stack(rgb, axis=1), least_change_recipe(rgb), []
            for name in names:
                res, bits = recipe_code(v, name, recipe), np.zeros(len(v))
                for c in range(3):
                    ctx = contexts.by_state(contexts.running(contexts.zigzag(res[:, c])), contexts.BPD_CONTEXTS)
                    hist = contexts.histogram(ctx, res[:, c], contexts.BPD_CONTEXTS)
                    bits += np.where(hist > 0, -hist * np.log2(np.maximum(hist, 1) / np.maximum(hist.sum(-1, keepdims=True), 1)), 0.0).sum((1, 2))
                sizes.append(np.round(bits / v[0].size, 6))
            best = np.stack(sizes).argmin(0)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, sizes), pa.array([names[k] for k in best])], ["image_id", *names, "best"])

    return images.mapInArrow(run, "image_id long, " + ", ".join(f"{n} double" for n in names) + ", best string")


#: C-23: levels of each of two weights of a blend of three predictors; the third weight is what is left of a quarter of the levels.
GRID_BITS = 5


def blend_choices(planes: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """C-23: (a, b, n): how many samples (two rows from above and one column from the sides on) are predicted best by each
    pair of weights of (N + W) >> 1 and N + W - NW, the rest of the weight on W + NE - N; of equal errors the first pair in
    order of b, then a."""
    levels = 1 << bits
    a, b = np.tile(np.arange(1, levels + 1), levels), np.repeat(np.arange(1, levels + 1), levels)

    def run(batches):
        total = np.zeros(levels * levels, dtype=np.int64)
        for _, v in contexts._batches(batches):
            n = {k: moved(v, *AT[k])[:, 2:, 1:-1].reshape(-1, 1) for k in ("N", "W", "NW", "NE")}
            here = v[:, 2:, 1:-1].reshape(-1, 1)
            for i in range(0, len(here), 1024):
                at = {k: e[i : i + 1024] for k, e in n.items()}
                p = a * (at["N"] + at["W"] >> 1) + b * (at["N"] + at["W"] - at["NW"]) + ((levels >> 2) - a - b) * (at["W"] + at["NE"] - at["N"]) >> bits - 2
                p = clamp(Arrays, p, at["N"], at["W"], at["NE"])
                total += np.bincount(np.abs(here[i : i + 1024] - p).argmin(1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a[at].astype(np.int32)), pa.array(b[at].astype(np.int32)), pa.array(total[at])], ["a", "b", "n"])

    return planes.select("image_id", "px").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def channel_roundtrip(images: DataFrame, name: str) -> DataFrame:
    """(image_id, digest, magnitude, mismatches) of T-24, T-29, T-31, T-37 or T-61 over all three channels in coding order."""

    def run(batches):
        for ids, rgb in _images(batches):
            v = np.stack(rgb, axis=1)
            if name in RECIPE_MODELS:
                recipe = least_change_recipe(rgb)
                out = recipe_code(v, name, recipe)
                back = recipe_code(out, name, recipe, True)
            else:
                both = {"t24_mixnc": sequential.cross_channels, "t61_pu": sequential.predict_update}[name]
                out = both(v)
                back = both(out, True)
            flat = out.reshape(len(v), 3, -1)
            yield pa.RecordBatch.from_arrays([ids, pa.array((flat * np.arange(1, flat.shape[2] + 1) * np.arange(1, 4)[:, None]).sum((1, 2))), pa.array(np.abs(flat).sum((1, 2))), pa.array((back != v).sum((1, 2, 3)))], ["image_id", "digest", "magnitude", "mismatches"])

    return images.mapInArrow(run, "image_id long, digest long, magnitude long, mismatches long")


def bits_per_sample(images: DataFrame) -> DataFrame:
    """C-19: (image_id, recipe, bpd): C-03's recipe, clamped gradient of each channel less its offset, contexts from the
    running state (the row above read three to the right), order-0 bits per channel and context over all samples."""

    def run(batches):
        for ids, rgb in _images(batches):
            recipe, bits = least_change_recipe(rgb), np.zeros(len(rgb[0]))
            for k in np.unique(recipe):
                at = np.flatnonzero(recipe == k)
                for name in color.RECIPES[k]:
                    target, _, offset = name.partition("-")
                    t = rgb["rgb".index(target)][at]
                    off = rgb["rgb".index(offset)][at] if offset else np.zeros_like(t)
                    res = wrapped(Arrays, t, gradient_of(t - off), off) - HALF
                    ctx = contexts.by_state(contexts.running(contexts.zigzag(res), near=(3, 3)), contexts.BPD_CONTEXTS)
                    hist = contexts.histogram(ctx, res, contexts.BPD_CONTEXTS)
                    bits[at] += np.where(hist > 0, -hist * np.log2(np.maximum(hist, 1) / np.maximum(hist.sum(-1, keepdims=True), 1)), 0.0).sum((1, 2))
            yield pa.RecordBatch.from_arrays([ids, pa.array(recipe.astype(np.int32)), pa.array(np.round(bits / (3 * rgb[0][0].size), 6))], ["image_id", "recipe", "bpd"])

    return images.mapInArrow(run, "image_id long, recipe int, bpd double")
