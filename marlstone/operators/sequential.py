"""Order-dependent models over planes: adaptive predictors, move-to-front, squeeze, polyphase gradients.

Planes travel as arrays (image_id, px), one row each, through mapInArrow: no exchange, no grouping, memory of one batch. A
predictor sees reconstructed neighbours and learns from each sample's true value, so forward and inverse share a loop. The
loop goes over samples and works on all planes of a batch at once; sums are written out in a fixed order, so that results
don't depend on how many planes share a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE, DEPTH, PLANES_AT_ONCE = 8, 8, 1024
HALF, MASK = 1 << (DEPTH - 1), (1 << DEPTH) - 1
#: Rows above and columns beside a plane that neighbours may reach; they hold 0.
ABOVE, BESIDE = 6, 7


def wrap(v: np.ndarray) -> np.ndarray:
    return (v + HALF & MASK) - HALF


def offset_of(name: str) -> tuple[int, int]:
    """Rows up and columns to the left of a neighbour by its name, such as NNE or SWW."""
    return name.count("N") - name.count("S"), name.count("W") - name.count("E")


class Near:
    """Neighbours by name of the samples coded so far, 0 outside and ahead."""

    def __init__(self, n: int, h: int, w: int):
        self.px, self.y, self.x = np.zeros((n, h + ABOVE, w + 2 * BESIDE), dtype=np.int64), 0, 0

    def __getitem__(self, name: str) -> np.ndarray:
        up, left = offset_of(name)
        return self.px[:, self.y + ABOVE - up, self.x + BESIDE - left]

    def put(self, v: np.ndarray) -> None:
        self.px[:, self.y + ABOVE, self.x + BESIDE] = v


def inside(v: np.ndarray) -> np.ndarray:
    return np.clip(v, -HALF, HALF - 1)


def within(v: np.ndarray, *among: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(v, reduce(np.minimum, among)), reduce(np.maximum, among))


def total(terms) -> np.ndarray:
    """A sum in the order of its terms."""
    return reduce(lambda a, b: a + b, terms)


def toward_zero(a: np.ndarray, b) -> np.ndarray:
    return np.where(a < 0, -(-a // b), a // b)


class SignMix:
    """A mix of predictors in whole numbers whose weights move by the sign of the error times each predictor."""

    def __init__(self, n: int, terms: Callable[[Near], list], shift: int, first: int, bias_step: int = 0, among: tuple[str, ...] = ("N", "W", "NE", "NEEE")):
        self.terms, self.shift, self.bias_step, self.among = terms, shift, bias_step, among
        self.w = [np.full(n, first, dtype=np.int64) for _ in terms(Near(1, 1, 1))]
        self.bias = np.full(n, 1 << shift >> 1, dtype=np.int64)

    def predict(self, near):
        self.inputs = self.terms(near)
        self.p = total([self.bias, *(w * x for w, x in zip(self.w, self.inputs, strict=True))]) >> self.shift
        return within(self.p, *(near[k] for k in self.among))

    def learn(self, v):
        sign = np.sign(v - self.p)
        self.w = [w + sign * x for w, x in zip(self.w, self.inputs, strict=True)]
        self.bias = self.bias + sign * self.bias_step


#: Terms of the mixes by name, over neighbours: the arithmetic also runs on SQL text.
def mixn_terms(n):
    return [n["N"], n["W"], n["N"] + n["W"] - n["NW"], n["W"] + n["NE"] - n["N"], 2 * n["N"] - n["NN"], 2 * n["W"] - n["WW"]]


def bestn_terms(n):
    return [n["W"], n["NE"], 2 * n["N"] - n["NN"], n["N"] + n["W"] - n["NW"]]


def ols7_terms(n):
    far = (n["WWWW"] + n["WWW"] + n["NNN"] + n["NNEE"] + n["NEEE"] + n["NEEEE"] - (n["N"] + n["W"])) >> 2
    return [n["N"], n["W"], n["NNN"], n["WWW"], n["NEEE"], 3 * (n["N"] - n["NN"]) + n["NNN"], 3 * (n["W"] - n["WW"]) + n["WWW"], n["W"] + n["NE"] - n["N"], n["N"] + n["W"] - n["NW"], n["N"] + n["NE"] - n["NNE"], far]


def ols9_terms(n):
    """In sixteenths, but for the first two and the last three of 24ths and 20ths."""
    return [
        4 * (n["WWWW"] + n["WWW"] + n["NNN"]) + 3 * n["NEEEE"] + n["NW"], 24 * n["W"] - 8 * n["WW"] - 4 * n["NW"] + 3 * n["N"] + n["NE"], 6 * n["W"] + 8 * n["NE"] + 2 * n["NEE"], 24 * n["N"] - 8 * n["NN"] + 4 * (n["W"] - n["NW"] + n["NE"] - n["NNE"]),
        8 * (n["N"] + n["W"]) + 2 * (n["NE"] - n["NW"]), 20 * n["N"] - 4 * n["NN"], 20 * n["W"] - 4 * n["WW"],
    ]


#: Terms, shift, first weight and step of the bias of each mix.
MIXES = {
    "t23_mixn": (mixn_terms, 18, (1 << 18) // 6, 0),
    "t25_bestn": (bestn_terms, 24, 1 << 22, 1),
    "t30_ols7": (ols7_terms, 21, (1 << 21) // 11, 16),
    "t33_ols9": (ols9_terms, 26, (1 << 26 >> 4) // 7, 0),
}


def ols8_terms(n):
    plane = n["N"] + n["W"] - n["NW"]
    return [
        plane, plane + 0, n["N"] + 0, n["W"] + 0, 3 * (n["N"] - n["NN"]) + n["NNN"], 3 * (n["W"] - n["WW"]) + n["WWW"], n["W"] + n["NE"] - n["N"], n["N"] + n["NE"] - n["NNE"], n["W"] + ((n["NEEE"] + n["NEEEEE"] - n["N"] - n["W"]) >> 3),
        n["W"] + n["NW"] - n["NWW"], n["N"] + n["NW"] - n["NNW"], n["NE"] + n["NEE"] - n["NNEEE"], (n["WWWWW"] + n["WW"] - n["W"] + n["NNN"] + n["N"] + n["NEEEEE"]) >> 2, n["NW"] + 0, n["NE"] + 0, n["NEEE"] + 0, n["NN"] + 0, n["WW"] + 0, n["NNN"] + 0, n["WWW"] + 0,
    ]


class TwoStageMix:
    """T-32: a mix of samples, corrected by a mix of what it missed around; weights start at 0 and move by signs, the second
    stage's by sixteen contexts of the mean of N and W."""

    FIRST, SECOND, CONTEXTS = 19, 17, 16

    def __init__(self, n: int):
        self.n, self.missed, self.each = n, None, np.arange(n)
        self.w, self.w2 = np.zeros((21, n), dtype=np.int64), np.zeros((self.CONTEXTS, 21, n), dtype=np.int64)

    def predict(self, near):
        if self.missed is None:
            self.missed = Near(self.n, near.px.shape[1] - ABOVE, near.px.shape[2] - 2 * BESIDE)
        self.missed.y, self.missed.x = near.y, near.x
        one = np.ones(self.n, dtype=np.int64)
        first = ols8_terms(near)
        self.inputs = np.stack([within(first[0], near["N"], near["W"]), *first[1:], one])
        self.inputs2 = np.stack([*ols8_terms(self.missed), one])
        self.context = (toward_zero(near["N"] + near["W"], 2) << 4 >> DEPTH) & self.CONTEXTS - 1
        raw = (self.w2[self.context, :, self.each].T * self.inputs2).sum(0)
        self.p1 = (self.w * self.inputs).sum(0) + (raw << 3) + (1 << self.FIRST >> 1) >> self.FIRST
        self.p = self.p1 + (raw + (1 << self.SECOND >> 1) >> self.SECOND)
        return within(self.p, near["N"], near["W"], near["NE"], near["NEEE"])

    def learn(self, v):
        self.missed.put(v - self.p1)
        self.w = self.w + np.sign(v - self.p1) * self.inputs
        self.w2[self.context, :, self.each] += (np.sign(v - self.p) * self.inputs2).T


class ErrorMix:
    """T-67: predictors weighted by the inverse of their fading errors (of the row so far)."""

    def __init__(self, n: int):
        self.n, self.row = n, None

    def predict(self, near):
        if self.row != near.y:
            self.row, self.err = near.y, [np.zeros(self.n, dtype=np.int64) for _ in range(8)]
        self.inputs = error_mix_terms(near)
        w = [1.0 / (e + 1) for e in self.err]
        p = total([0.0, *(a * x for a, x in zip(w, self.inputs, strict=True))]) / total([0.0, *w])
        return np.trunc(p).astype(np.int64)

    def learn(self, v):
        self.err = [(e + np.abs(v - x)) * 0xE6 >> 8 for e, x in zip(self.err, self.inputs, strict=True)]


def error_mix_terms(n):
    return [n["N"] + n["W"] - n["NW"], n["W"] + n["NE"] - n["N"], n["N"] + n["NE"] - n["NNE"], n["N"], n["W"], 3 * (n["N"] - n["NN"]) + n["NNN"], 3 * (n["W"] - n["WW"]) + n["WWW"], (n["W"] + n["NEEE"]) >> 1]


def faded_mix_terms(n):
    far = toward_zero(n["WWWW"] + n["WWW"] + n["NNN"] + n["NEE"] + n["NEEE"] + n["NEEEE"] - 2 * n["NW"], 4)
    return [n["N"], n["W"], 3 * (n["N"] - n["NN"]) + n["NNN"], 3 * (n["W"] - n["WW"]) + n["WWW"], n["W"] + n["NE"] - n["N"], far, n["N"] + n["W"] - n["NW"], n["N"] + n["NE"] - n["NNE"]]


class FadedMix:
    """T-71: predictors weighted by fixed weights over their errors so far: a fading sum, and smoothed errors of the row
    above (an error also adds to the place above to its right) and of the one above that. 0 outside."""

    WEIGHTS, FADE, HALVED, AMONG = (240, 240, 180, 180, 140, 160, 120, 120), 97, 0, ("N", "W", "NE")

    def __init__(self, n: int):
        self.n, self.row, self.faded = n, None, np.zeros((len(self.WEIGHTS), n), dtype=np.int64)

    def terms(self, near) -> list:
        return faded_mix_terms(near)

    def predict(self, near):
        if self.row != near.y:
            h, w = near.px.shape[1] - ABOVE, near.px.shape[2] - 2 * BESIDE
            fresh = np.zeros((w + 2, len(self.WEIGHTS), self.n), dtype=np.int64)
            if self.row is None:
                self.far, self.above, self.here, self.missed = fresh, fresh.copy(), fresh.copy(), Near(self.n, h, w)
            else:
                self.far, self.above, self.here = self.above, self.here, fresh
            self.row = near.y
        self.missed.y, self.missed.x, self.x = near.y, near.x, near.x + 1
        x = self.x
        self.inputs = np.stack([t + np.zeros(self.n, dtype=np.int64) for t in self.terms(near)])
        error = (self.faded + self.above[x - 1] + 2 * self.above[x] + self.above[x + 1] + self.far[x + 1] >> self.HALVED) + 1
        w = [k / e for k, e in zip(self.WEIGHTS, error, strict=True)]
        mean = self._sum([a * b for a, b in zip(w, self.inputs, strict=True)]) / self._sum(w)
        self.p = within(np.rint(mean).astype(np.int64), *(near[k] for k in self.AMONG))
        return self.p

    @staticmethod
    def _sum(terms: list) -> np.ndarray:
        """In a fixed order: every fourth term, then the four sums by twos."""
        lanes = [total(terms[k::4]) for k in range(4)]
        return (lanes[2] + lanes[3]) + (lanes[0] + lanes[1])

    def learn(self, v):
        error, x = np.abs(v - self.inputs) * 2, self.x
        self.faded = (self.faded + error) * self.FADE >> 7
        self.here[x] = 2 * self.here[x - 1] + error + self.above[x + 1] >> 2
        self.above[x + 1] += error
        self.missed.put(v - self.p)


class FadedMixOfMore(FadedMix):
    """T-70: the same with twelve predictors that know what was missed around, errors at half weight, and one more bound."""

    WEIGHTS, HALVED, AMONG = (210, 210, 215, 215, 140, 230, 120, 140, 45, 97, 65, 40), 1, ("N", "W", "NE", "NEEE")

    def terms(self, near) -> list:
        n, e, q = near, self.missed, toward_zero
        return [
            *shift_mix_terms(n, e), q(4 * (n["N"] + n["NNN"]) - 6 * n["NN"] + n["NNNW"] + n["NNNE"] - q(n["NNWW"] + n["NNEE"], 2) + n["NNE"] + n["NNW"] - n["NE"] - n["NW"] - e["N"] - e["NN"] + e["NNN"], 3),
            q(6 * (n["W"] + n["WWW"]) + 20 * n["WW"] + q(e["W"] - e["WW"] + e["WWW"], 3), 32), q(n["W"] + 3 * n["NW"] - n["NWW"] - n["NNWW"], 2) + q(e["NW"], 4) + q(e["W"], 6),
            q(3 * n["NE"] + n["NEE"] + n["NEEEE"] - n["NNEE"] - n["NNEEE"] + q(3 * e["NE"] + 6 * e["NEE"] + 3 * e["NEEE"], 2), 3),
        ]


class ShiftMix:
    """T-72: predictors that know what was missed around, weighted by whole numbers that stand for fixed weights over their
    errors above the best one: a running mean and the errors of nine places around, 0 outside."""

    WEIGHTS = (210, 210, 215, 215, 140, 230, 120, 140)
    INVERSE = np.array([(1 << 15) // (k + 1) for k in range(128)])

    def __init__(self, n: int):
        self.n, self.row, self.mean = n, None, np.zeros((8, n), dtype=np.int64)

    def predict(self, near):
        if self.row != near.y:
            h, w = near.px.shape[1] - ABOVE, near.px.shape[2] - 2 * BESIDE
            fresh = np.zeros((w + 4, 8, self.n), dtype=np.int64)
            if self.row is None:
                self.far, self.above, self.here, self.missed = fresh, fresh, fresh.copy(), Near(self.n, h, w)
            else:
                self.far, self.above, self.here = self.above, self.here, fresh
            self.row = near.y
        self.missed.y, self.missed.x = near.y, near.x
        self.x = x = near.x + 2
        self.inputs = np.stack(shift_mix_terms(near, self.missed))
        error = (self.mean >> 3) + 2 * (self.above[x - 1] + self.above[x] + self.here[x - 1]) + self.far[x] + self.far[x + 1] + self.above[x + 1] + self.here[x - 2] + 1
        shift = np.maximum(0, (np.frexp((error + 1).astype(np.float64))[1] - 1) - 6)
        w = (np.array(self.WEIGHTS)[:, None] * self.INVERSE[error >> shift] >> shift) + 4
        w = w >> np.frexp(w.sum(0).astype(np.float64))[1] - 1 - 5
        p = (w * self.inputs).sum(0) * self.INVERSE[w.sum(0) - 1] >> 15
        self.p = within(p, near["N"], near["W"], near["NE"])
        return self.p

    def learn(self, v):
        error = np.abs(v - self.inputs)
        error = error - error.min(0)
        self.mean = self.mean + ((error << 6) - self.mean + 4 >> 3)
        self.here[self.x] = error
        self.missed.put(v - self.p)


def shift_mix_terms(n, e):
    z, q = np.zeros_like(n["N"]), toward_zero
    return [
        n["N"] + q(23 * e["N"] - 2 * (e["NN"] + e["NW"]) + 9 * e["W"], 110), n["W"] + q(23 * e["W"] - 2 * (e["WW"] + e["NW"]) + 9 * e["N"], 110),
        3 * (n["N"] - n["NN"]) + n["NNN"] + q(q(e["N"], 2) + q(e["NN"], 2) + e["NNN"], 3), 3 * (n["W"] - n["WW"]) + n["WWW"] + q(q(e["W"], 2) + q(e["WW"], 2) + e["WWW"], 3),
        n["W"] + n["NE"] - n["N"] + (-13 * e["N"] >> 4) + q(e["W"] * 13, 32) - (e["W"] >> 7),
        q(n["WWW"] + n["NN"] - 2 * n["NW"] + n["NEE"] + n["NEEE"] + n["NEEEE"] + q(n["N"] - n["W"], 6) + q(n["NNN"] - n["NE"] - (5 * (e["N"] + e["W"]) + e["WW"]), 2), 3),
        n["N"] + n["W"] - n["NW"] + q(e["N"] + e["W"] - e["NW"], 3), n["N"] + n["NE"] - n["NNE"] + (e["N"] + e["NE"] + e["NNE"] + 4 >> 3) + z,
    ]


class CorrectedMix:
    """T-73: four predictors that correct by what was missed around, weighted by fixed weights over their errors above the
    best one, in eighths: a running mean and the errors of the row above (an error also adds to the place above to its
    right). 0 outside."""

    WEIGHTS = (0x0DB8, 0x0E22, 0x181F, 0x0BF3)

    def __init__(self, n: int):
        self.n, self.row, self.mean = n, None, np.zeros((4, n), dtype=np.int64)

    def predict(self, near):
        if self.row != near.y:
            h, w = near.px.shape[1] - ABOVE, near.px.shape[2] - 2 * BESIDE
            fresh = np.zeros((w + 2, 4, self.n), dtype=np.int64)
            if self.row is None:
                self.above, self.here, self.missed = fresh, fresh.copy(), Near(self.n, h, w)
            else:
                self.above, self.here = self.here, fresh
            self.row = near.y
        self.missed.y, self.missed.x, self.x = near.y, near.x, near.x + 1
        n, e, x = near, self.missed, self.x
        bend = 0x00DF * e["NW"] + 0x0051 * e["N"] + 0x00BD * e["NE"] + 0x005C * (n["NN"] - n["N"]) - 0x0102 * (n["NW"] - n["W"])
        self.inputs = np.stack([n["W"] + n["NE"] - n["N"], n["N"] - ((e["N"] + e["W"] + e["NE"]) * -0x005C >> 8), n["W"] - ((e["N"] + e["W"] + e["NW"]) * -0x005B >> 8), n["N"] - (bend >> 8)])
        w = (np.array(self.WEIGHTS)[:, None] << 8) // ((self.mean >> 4) + self.above[x - 1] + self.above[x] + self.above[x + 1] + 2)
        self.p = within(toward_zero((w * self.inputs).sum(0), np.maximum(w.sum(0), 1)), n["N"], n["W"], n["NE"], n["NEEE"])
        return self.p

    def learn(self, v):
        error = np.abs(v - self.inputs) + 4 >> 3
        error = error - error.min(0)
        self.mean = self.mean + ((error << 6) - self.mean + 4 >> 3)
        self.here[self.x] = error
        self.above[self.x + 1] += error
        self.missed.put(v - self.p)


class ParametricMix:
    """T-78: twenty predictors in 1/256, of which eight correct by what was missed around by given factors; weighted by given
    weights over their errors in the row above (an error also adds to the place above to its right). 0 outside."""

    # fixed values: 20 weights and 11 factors in 1/256 for each channel
    PARAMETERS = (
        (0x00EA, 0x01C8, 0x00A2, 0x005E, 0x01F4, 0x0045, 0x0091, 0x0066, 0x003B, 0x0027, -0x0011, 0x001B, 0x00FF, 0x007E, 0x00D1, 0x00F3, 0x008F, 0x0130, 0x018E, -0x00AC, 0x010C, 0x0008, -0x007E, 0x00A2, 0x000E, -0x0069, -0x0073, -0x0125, -0x0092, 0x0000, 0x0078),
        (0x0006, 0x003D, 0x0031, 0x002F, 0x003F, 0x0015, 0x0011, 0x0036, 0x002E, -0x0022, 0x0011, 0x0034, -0x0007, 0x0012, -0x0018, 0x0012, 0x002F, 0x0000, 0x0000, 0x001C, 0x00A2, 0x02E1, 0x00C9, -0x00E0, -0x0068, -0x004E, -0x013E, -0x0012, 0x0001, 0x0000, -0x0046),
        (0x003D, 0x0036, 0x0006, 0x007E, 0x0012, 0x0007, 0x0007, 0x0005, 0x001E, 0x0000, 0x0028, 0x0055, -0x0020, 0x0020, 0x0005, 0x0011, 0x0034, 0x0000, 0x0004, 0x003E, -0x0100, 0x0001, -0x0086, -0x0041, 0x0051, -0x0080, 0x0004, 0x0002, -0x0003, -0x0003, 0x00D9),
    )

    def __init__(self, n: int, channel: int):
        self.n, self.row = n, None
        self.weights, self.factors = np.array(self.PARAMETERS[channel][:20])[:, None], self.PARAMETERS[channel][20:]

    def predict(self, near):
        if self.row != near.y:
            h, w = near.px.shape[1] - ABOVE, near.px.shape[2] - 2 * BESIDE
            fresh = np.zeros((w + 2, 20, self.n), dtype=np.int64)
            if self.row is None:
                self.above, self.here, self.missed = fresh, fresh.copy(), Near(self.n, h, w)
            else:
                self.above, self.here = self.here, fresh
            self.row = near.y
        self.missed.y, self.missed.x, self.x = near.y, near.x, near.x + 1
        scaled = {k: near[k] << DEPTH for k in PARAMETRIC_NEAR}
        self.inputs, x = np.stack(parametric_terms(scaled, self.missed, self.factors)), self.x
        w = toward_zero(self.weights << 8, self.above[x - 1] + self.above[x] + self.above[x + 1] + 1)
        s = w.sum(0)
        mean = toward_zero(((s >> 1) - 1 + (w * self.inputs).sum(0)) * np.where(s < 0, -1, 1), np.maximum(np.abs(s), 1))
        self.p = within(np.where(s == 0, self.inputs[0], mean), scaled["W"], scaled["N"], scaled["NE"])
        return self.p + 127 >> 8

    def learn(self, v):
        self.missed.put((v << 8) - self.p)
        self.here[self.x] = error = np.abs((v << 8) - self.inputs)
        if self.row:
            self.above[self.x + 1] += error


PARAMETRIC_NEAR = (
    "N", "W", "NW", "NE", "NEE", "NN", "NNW", "NNE", "NNN", "NNNNNN", "NEEEE", "NEEEEE", "NEEEEEE", "NEEEEEEE", "WWWW", "WWWWWW",
)


def parametric_terms(n, e, f):
    around = lambda v, *more: within(v, n["W"], n["N"], n["NE"], *(n[k] for k in more))
    return [
        n["N"] - (e["NW"] * f[0] + e["N"] * f[1] + e["NE"] * f[2] + (n["NN"] - n["N"]) * f[3] + (n["NW"] - n["W"]) * f[4] >> 8),
        n["W"] - ((e["N"] + e["W"] + e["NW"]) * f[5] >> 8), n["N"] - ((e["N"] + e["W"] + e["NE"]) * f[6] >> 8), n["W"] + n["NE"] - n["N"],
        *(n[k] - (e[k] * f[i] >> 8) for i, k in enumerate(("W", "N", "NW", "NE"), 7)),
        around(n["W"] + n["N"] - n["NW"], "NW"), around(n["W"] + n["NE"] - n["N"], "NW"), around(n["N"] + n["NW"] - n["NNW"], "NW"), around(n["N"] + n["NE"] - n["NNE"], "NEE"),
        n["W"] + n["NEE"] >> 1, n["NNNNNN"], n["NEEEE"] + n["NEEEEEE"] >> 1, n["WWWW"] + n["WWWWWW"] >> 1, n["W"] + n["N"] + n["NEEEEE"] + n["NEEEEEEE"] >> 2,
        around(2 * n["N"] - n["NN"], "NEE"), n["N"] + n["NNN"] >> 1, 3 * (n["W"] + n["N"]) - 2 * n["NW"] >> 2,
    ]


class Angles:
    """T-85: the neighbour pair along the direction of least change mixed with a linear predictor, the more the directions
    differ; corrected by what was missed in the context of the activity around and of eight comparisons."""

    # fixed values: steps of the mix, and of the activity
    THRESHOLDS, ACTIVITY = (1, 3, 9, 20, 50, 110, 300, 800), (0, 2, 4, 7, 10, 14, 20, 26, 34, 42, 52, 64, 78, 95, 135, 200)

    def __init__(self, n: int):
        self.each, self.row = np.arange(n), None
        self.corrections = np.zeros((n, len(self.ACTIVITY) << 7), dtype=np.int64)

    def predict(self, near):
        if self.row != near.y:
            self.row, self.missed = near.y, np.zeros(len(self.each), dtype=np.int64)
        n = near
        cost, ahead = (np.stack(t) for t in zip(*(angle_terms(n, *d) for d in ANGLES), strict=True))
        least = cost.min(0)
        differ = cost.sum(0) - len(ANGLES) * least
        share = (np.array(self.THRESHOLDS)[:, None] * MASK <= differ << 3).sum(0)
        linear = np.clip(9 * (n["N"] + n["W"]) + 2 * (n["NE"] - n["NW"]) - n["NN"] - n["WW"], -HALF << 4, HALF << 4)
        p = 8 * share * ahead[cost.argmin(0), self.each] + (8 - share) * linear + 64 >> 7
        active = total(abs(n[a] - n[b]) for a, b in ACTIVE) + 2 * abs(self.missed)
        level = np.searchsorted(self.ACTIVITY, active, side="right") - 1
        self.context = total([level >> 1 << 8, *((p > q).astype(np.int64) << 7 - k for k, q in enumerate((2 * n["N"] - n["NN"], 2 * n["W"] - n["WW"], n["NN"], n["WW"], n["NE"], n["NW"], n["N"], n["W"])))])
        self.correction = self.corrections[self.each, self.context]
        self.p = np.clip(p + (self.correction >> 8), -HALF, HALF)
        return self.p

    def learn(self, v):
        self.missed = v - self.p
        self.corrections[self.each, self.context] += (self.missed << 7) - self.correction + 64 >> 7


#: Directions by their two steps (the same step twice along the grid's own directions), and the differences that tell activity.
ANGLES = (("W", "W"), ("N", "N"), ("NW", "NW"), ("NE", "NE"), ("W", "NW"), ("NW", "N"), ("N", "NE"))
ACTIVE = (("W", "WW"), ("N", "NW"), ("N", "NE"), ("W", "NW"), ("N", "NN"), ("NE", "NNE"))


def angle_name(*steps: str) -> str:
    """Where the steps lead, by name."""
    up = sum(offset_of(s)[0] for s in steps)
    left = sum(offset_of(s)[1] for s in steps)
    return "N" * up + ("W" * left if left > 0 else "E" * -left)


def angle_terms(n, a: str, b: str):
    """The change along a direction at four places around, and the two samples ahead on it. At one place the rule as described
    leaves the direction: it takes NNW where the step leads to NWW."""
    step = lambda k, by: "NNW" if (k, by, b) == ("NW", "W", "NW") else angle_name(k, by)
    change = total(abs(2 * n[k] - n[step(k, a)] - n[step(k, b)]) for k in ("W", "NW", "N", "NE"))
    return change, n[a] + n[b]


class LearnedAverage:
    """T-93: five predictors in 1/256, of which some correct by what was missed around; weighted by fixed weights and learned
    factors over their errors around. Factors move by what is missed here and around times each predictor."""

    FIXED, ONE = (0x2100, 0x0DB8, 0x0E22, 0x181F, 0x0BF3), 1 << 16

    def __init__(self, n: int):
        self.n, self.missed = n, None
        self.factors = [np.full(n, self.ONE, dtype=np.int64) for _ in self.FIXED]

    def predict(self, near):
        if self.missed is None:
            h, w = near.px.shape[1] - ABOVE, near.px.shape[2] - 2 * BESIDE
            self.missed, self.errors = Near(self.n, h, w), [Near(self.n, h, w) for _ in self.FIXED]
        for held in (self.missed, *self.errors):
            held.y, held.x = near.y, near.x
        n, e = {k: near[k] << 8 for k in ("N", "W", "NW", "NE", "NN")}, self.missed
        bend = 0x00DF * e["NW"] + 0x0051 * e["N"] + 0x00BD * e["NE"] + 0x005C * (n["NN"] - n["N"]) - 0x0102 * (n["NW"] - n["W"])
        self.inputs = [
            within(n["N"] + n["W"] - n["NW"], n["N"], n["W"]), n["W"] + n["NE"] - n["N"], n["N"] - ((e["N"] + e["W"] + e["NE"]) * -0x005C >> 8), n["W"] - ((e["N"] + e["W"] + e["NW"]) * -0x005B >> 8), n["N"] - (bend >> 8),
        ]
        around = [total(held[k] for k in ("NW", "N", "NE", "WW", "W")) + 1 for held in self.errors]
        w = [toward_zero(f * fixed, error) for f, fixed, error in zip(self.factors, self.FIXED, around, strict=True)]
        all_w = total(w)
        some = np.where(all_w == 0, 1, all_w)
        top = total(a * b for a, b in zip(w, self.inputs, strict=True)) + (all_w >> 1)
        mean = np.sign(top) * np.sign(some) * (np.abs(top) // np.abs(some))
        self.p = within(np.where(all_w == 0, self.inputs[0], mean), n["N"], n["W"], n["NE"])
        return self.p + 128 >> 8

    def learn(self, v):
        e, here = self.missed, v << 8
        e.put(here - self.p)
        change = 2 * e["W"] + (here - self.p) + e["N"] + e["NE"] + e["NEEE"]
        for held, x in zip(self.errors, self.inputs, strict=True):
            held.put(np.abs(here - x))
        self.factors = [np.clip(f + (change * x >> DEPTH), -self.ONE, self.ONE) for f, x in zip(self.factors, self.inputs, strict=True)]


class Weighted:
    """T-65: predictors weighted by the inverse of their recent errors."""

    def __init__(self, n: int, decay: float = 0.75):
        self.err, self.decay = [np.ones(n) for _ in range(4)], decay

    def predict(self, n):
        self.inputs = [n["W"] + n["NE"] - n["N"], n["N"] + 0, n["W"] + 0, n["N"] + n["W"] - n["NW"]]
        w = [1 / (e + 1) for e in self.err]
        p = total([a * x for a, x in zip(w, self.inputs, strict=True)]) / total(w)
        return np.rint(inside(p)).astype(np.int64)

    def learn(self, v):
        self.err = [e * self.decay + np.abs(x - v) for e, x in zip(self.err, self.inputs, strict=True)]


class SlopeWeighted:
    """T-66: N and W weighted by the changes across and down."""

    def __init__(self, n: int):
        pass

    def predict(self, n):
        down = np.abs(n["N"] - n["NN"]) + np.abs(n["W"] - n["NW"]) + np.abs(n["NE"] - n["NNE"]) + np.abs(n["NW"] - n["NNW"]) + 1
        across = np.abs(n["N"] - n["NW"]) + np.abs(n["W"] - n["WW"]) + np.abs(n["NE"] - n["N"]) + np.abs(n["NW"] - n["NWW"]) + 1
        return toward_zero(across * n["N"] + down * n["W"], across + down)

    def learn(self, v):
        pass


class Rls:
    """T-26: recursive least squares over four predictors, forgetting by FORGET a sample."""

    FORGET = 0.998

    def __init__(self, n: int):
        self.w = [np.full(n, 0.25) for _ in range(4)]
        self.cov = [[np.full(n, 0.01 if i == j else 0.0) for j in range(4)] for i in range(4)]

    def predict(self, n):
        self.x = [n["N"] + 0, n["W"] + 0, n["N"] + n["W"] - n["NW"], n["NE"] + 0]
        self.p = total([w * x for w, x in zip(self.w, self.x, strict=True)])
        return np.rint(inside(self.p)).astype(np.int64)

    def learn(self, v):
        g = [total([c * x for c, x in zip(row, self.x, strict=True)]) for row in self.cov]
        norm = self.FORGET + total([a * x for a, x in zip(g, self.x, strict=True)])
        k = [a / norm for a in g]
        self.w = [w + a * (v - self.p) for w, a in zip(self.w, k, strict=True)]
        self.cov = [[(c - k[i] * g[j]) / self.FORGET for j, c in enumerate(row)] for i, row in enumerate(self.cov)]


class Ols:
    """T-86: ordinary least squares of the sample on four neighbours over all samples so far, by elimination."""

    def __init__(self, n: int):
        self.a = [[np.full(n, 8 if i == j else 0, dtype=np.int64) for j in range(4)] for i in range(4)]
        self.b = [np.full(n, k, dtype=np.int64) for k in (4, 4, 0, 0)]

    def predict(self, n):
        self.x = [n["N"] + 0, n["W"] + 0, n["NW"] + 0, n["NE"] + 0]
        a = [[c.astype(np.float64) for c in row] for row in self.a]
        b = [c.astype(np.float64) for c in self.b]
        for i in range(3):
            for k in range(i + 1, 4):
                f = a[k][i] / a[i][i]
                a[k] = [a[k][j] - f * a[i][j] if j > i else a[k][j] for j in range(4)]
                b[k] = b[k] - f * b[i]
        w: list = [None] * 4
        for i in reversed(range(4)):
            rest = b[i]
            for j in range(i + 1, 4):
                rest = rest - a[i][j] * w[j]
            w[i] = rest / a[i][i]
        return np.rint(inside(total([u * x for u, x in zip(w, self.x, strict=True)]))).astype(np.int64)

    def learn(self, v):
        self.a = [[c + self.x[i] * self.x[j] for j, c in enumerate(row)] for i, row in enumerate(self.a)]
        self.b = [c + x * v for c, x in zip(self.b, self.x, strict=True)]


class RecentOls(Ols):
    """T-87: least squares over a sliding window: a sample comes in, and the one LAST before it goes out."""

    LAST = 24

    def __init__(self, n: int):
        super().__init__(n)
        self.past: list = []

    def learn(self, v):
        super().learn(v)
        self.past.append((self.x, v))
        if len(self.past) > self.LAST:
            x, old = self.past.pop(0)
            self.a = [[c - x[i] * x[j] for j, c in enumerate(row)] for i, row in enumerate(self.a)]
            self.b = [c - e * old for c, e in zip(self.b, x, strict=True)]


class Tables:
    """Sums and counts by context, one table a plane; contexts are mapped to places by the caller."""

    def __init__(self, n: int, places: int):
        self.sums, self.counts, self.each = np.zeros((n, places), dtype=np.int64), np.zeros((n, places), dtype=np.int64), np.arange(n)

    def look(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.place = place
        return self.sums[self.each, place], self.counts[self.each, place]

    def add(self, error: np.ndarray, most: int | None = None) -> None:
        """`most`: a context that has seen so many samples halves both, toward zero."""
        self.sums[self.each, self.place] += error
        self.counts[self.each, self.place] += 1
        if most:
            over = np.flatnonzero(self.counts[self.each, self.place] >= most)
            at = self.each[over], self.place[over]
            self.sums[at], self.counts[at] = toward_zero(self.sums[at], 2), self.counts[at] // 2


class Calic:
    """T-42: gradient-adjusted prediction with error feedback by texture and activity."""

    MOST = 128

    def __init__(self, n: int):
        self.tables = Tables(n, 256)

    def predict(self, n):
        across = np.abs(n["W"] - n["WW"]) + np.abs(n["N"] - n["NW"]) + np.abs(n["NE"] - n["N"])
        down = np.abs(n["W"] - n["NW"]) + np.abs(n["N"] - n["NN"]) + np.abs(n["NE"] - n["NNE"])
        d, w, north = down - across, n["W"], n["N"]
        mid = (w + north) / 2 + (n["NE"] - n["NW"]) / 4
        cases = [(d > 80, w), (d < -80, north), (d > 32, (mid + w) / 2), (d > 8, (3 * mid + w) / 4), (d < -32, (mid + north) / 2), (d < -8, (3 * mid + north) / 4)]
        p = np.select([c for c, _ in cases], [x for _, x in cases], mid)
        texture = total([(n[k] < p).astype(np.int64) << i for i, k in enumerate(("N", "W", "NW", "NE", "NN", "WW"))])
        sums, counts = self.tables.look(texture * 4 + np.minimum(3, (across + down) // 32))
        self.base = np.floor(p).astype(np.int64)
        return inside(self.base + toward_zero(sums, np.maximum(counts, 1)))

    def learn(self, v):
        self.tables.add(v - self.base, self.MOST)


class Bias:
    """T-74: clamped gradient plus the mean error (rounded down) seen in its context of two changes."""

    def __init__(self, n: int):
        self.tables = Tables(n, 64 * 64)

    def predict(self, n):
        self.base = within(n["N"] + n["W"] - n["NW"], n["N"], n["W"])
        sums, counts = self.tables.look(((n["N"] - n["NW"] >> 4) + 32) * 64 + (n["W"] - n["NW"] >> 4) + 32)
        return inside(self.base + sums // np.maximum(counts, 1))

    def learn(self, v):
        self.tables.add(v - self.base)


class Successors:
    """T-92: mean of what last followed each of four neighbours' values."""

    def __init__(self, n: int):
        self.seen, self.each = np.tile(np.arange(-HALF, HALF), (4, n, 1)), np.arange(n)

    def predict(self, n):
        self.keys = [n[k] + HALF for k in ("N", "W", "NE", "NW")]
        return total([self.seen[i, self.each, k] for i, k in enumerate(self.keys)]) >> 2

    def learn(self, v):
        for i, k in enumerate(self.keys):
            self.seen[i, self.each, k] = v


MODELS: dict[str, Callable[[int], object]] = {
    **{name: (lambda n, terms=terms, rest=rest: SignMix(n, terms, *rest)) for name, (terms, *rest) in MIXES.items()},
    "t26_rls": Rls, "t86_ols": Ols, "t87_ols2": RecentOls, "t65_wp": Weighted, "t66_wgrad": SlopeWeighted, "t32_ols8": TwoStageMix, "t67_wgrad3": ErrorMix, "t70_wgrad4": FadedMixOfMore, "t71_wgrad5": FadedMix, "t72_wgrad6": ShiftMix, "t73_wgrad7": CorrectedMix, "t85_angles": Angles, **{name: partial(ParametricMix, channel=k) for k, name in enumerate(("t78_mm", "t78_mm_second", "t78_mm_third"))}, "t93_lwav": LearnedAverage, "t42_calic": Calic, "t74_sse": Bias, "t92_table": Successors,
}


def code(v: np.ndarray, name: str | Callable[[int], object], inverse: bool = False) -> np.ndarray:
    """Residuals of planes (n, h, w) under a model (by name, or what makes one for n planes), or the planes of residuals."""
    n, h, w = v.shape
    model, near, out = (MODELS[name] if isinstance(name, str) else name)(n), Near(n, h, w), np.empty_like(v)
    for near.y in range(h):
        for near.x in range(w):
            p, here = model.predict(near), v[:, near.y, near.x]
            true = wrap(here + p) if inverse else here
            out[:, near.y, near.x] = true if inverse else wrap(here - p)
            near.put(true)
            model.learn(true)
    return out


def code_offset(target: np.ndarray, offset: np.ndarray, model: Callable[[int], object], inverse: bool = False) -> np.ndarray:
    """Residuals of planes of which an offset is known, or the planes: the model sees what the offset leaves, and its
    prediction and the offset together stay within the depth."""
    n, h, w = target.shape
    made, near, out = model(n), Near(n, h, w), np.empty_like(target)
    for near.y in range(h):
        for near.x in range(w):
            here, off = target[:, near.y, near.x], offset[:, near.y, near.x]
            p = inside(made.predict(near) + off)
            true = wrap(here + p) if inverse else here
            out[:, near.y, near.x] = true if inverse else wrap(here - p)
            near.put(true - off)
            made.learn(true - off)
    return out


class Gradient:
    """The clamped gradient."""

    def __init__(self, n: int):
        pass

    def predict(self, n):
        return within(n["N"] + n["W"] - n["NW"], n["N"], n["W"])

    def learn(self, v):
        pass


def mixnc_terms(n):
    """T-24: the terms of T-23, and W and N moved as the channel that is known moved (its change to the west and north)."""
    return [*mixn_terms(n), n["W"] + n["known"] - n["knownW"], n["N"] + n["known"] - n["knownN"]]


class CrossMix(SignMix):
    """T-24: the mix of T-23 with terms of a channel that is known already."""

    def __init__(self, n: int, known: np.ndarray):
        self.known = np.pad(known, ((0, 0), (1, 0), (1, 0)))
        super().__init__(n, lambda near: mixnc_terms(_Beside(near, self.known)), 18, (1 << 18) // 8)


class _Beside:
    def __init__(self, near, known):
        self.near, self.known = near, known

    def __getitem__(self, name):
        if not name.startswith("known"):
            return self.near[name]
        up, left = offset_of(name[5:])
        return self.known[:, self.near.y + 1 - up, self.near.x + 1 - left]


def cross_channels(images: np.ndarray, inverse: bool = False) -> np.ndarray:
    """T-24: green by T-23, red and blue with green's terms; images (n, 3, h, w)."""
    green = code(images[:, 1], "t23_mixn", inverse)
    known = green if inverse else images[:, 1]
    rest = [code(images[:, c], lambda n: CrossMix(n, known), inverse) for c in (0, 2)]
    return np.stack([rest[0], green, rest[1]], axis=1)


def zipper(v: np.ndarray, inverse: bool = False) -> np.ndarray:
    """T-94: from the last sample to the first, the clamped gradient of samples before plus a quarter of the residual to the
    south or east, whichever way residuals change less."""
    n, h, w = v.shape
    # samples not yet coded above and to the left, residuals below and to the right, in one plane
    mixed = np.zeros((n, h + 4, w + 4), dtype=np.int64)
    mixed[:, 2:-2, 2:-2] = v
    places = [(y, x) for y in range(h) for x in range(w)]
    for y, x in places if inverse else reversed(places):
        at = lambda name: mixed[:, y + 2 - offset_of(name)[0], x + 2 - offset_of(name)[1]]  # noqa: B023, E731
        across = np.abs(at("E") - at("EE")) + np.abs(at("S") - at("SE")) + np.abs(at("S") - at("SW"))
        down = np.abs(at("SSW") - at("SW")) + np.abs(at("SS") - at("S")) + np.abs(at("SE") - at("E"))
        p = inside(within(at("N") + at("W") - at("NW"), at("N"), at("W")) + toward_zero(np.where(down > across, at("S"), at("E")), 4))
        here = mixed[:, y + 2, x + 2]
        mixed[:, y + 2, x + 2] = wrap(here + p if inverse else here - p)
    return mixed[:, 2:-2, 2:-2].copy()


def predict_update(images: np.ndarray, inverse: bool = False) -> np.ndarray:
    """T-61: images (n, 3, h, w) as residuals. Green by the clamped gradient plus a quarter of the residual above or to the
    left, whichever way residuals change less; blue and red likewise of what green leaves, green added; and green's residual
    takes a quarter of the others'."""
    n, _, h, w = images.shape
    seen, errors, out = [Near(n, h, w) for _ in range(3)], [Near(n, h, w) for _ in range(3)], np.empty_like(images)
    for y in range(h):
        for x in range(w):
            here = [images[:, c, y, x] for c in range(3)]
            if inverse:
                here[1] = wrap(here[1] - (here[0] + here[2] >> 2))
            got, green = [None] * 3, None
            for c in (1, 2, 0):
                a, e = seen[c], errors[c]
                a.y = e.y = y
                a.x = e.x = x
                across = np.abs(e["W"] - e["WW"]) + np.abs(e["N"] - e["NW"]) + np.abs(e["NE"] - e["N"])
                down = np.abs(e["W"] - e["NW"]) + np.abs(e["N"] - e["NN"]) + np.abs(e["NE"] - e["NNE"])
                p = within(a["N"] + a["W"] - a["NW"], a["N"], a["W"]) + toward_zero(np.where(across < down, e["N"], e["W"]), 4)
                if green is not None:
                    p = inside(p + green)
                true = wrap(here[c] + p) if inverse else here[c]
                error = here[c] if inverse else wrap(here[c] - p)
                a.put(true if green is None else true - green)
                e.put(error)
                got[c] = true if inverse else error
                green = true if green is None else green
            if not inverse:
                got[1] = wrap(got[1] + (got[0] + got[2] >> 2))
            for c in range(3):
                out[:, c, y, x] = got[c]
    return out


def activity(v: np.ndarray) -> np.ndarray:
    """T-28: the running magnitude before each sample, (W + min(W, NE) + 64 |sample| + max(NEE, NEEE)) >> 2 over the
    magnitudes so far, in units of 64; it can't be undone."""
    n, h, w = v.shape
    near, out = Near(n, h, w), np.empty_like(v)
    for near.y in range(h):
        for near.x in range(w):
            e = near["W"]
            out[:, near.y, near.x] = e >> 6
            near.put(e + np.minimum(e, near["NE"]) + (np.abs(v[:, near.y, near.x]) << 6) + np.maximum(near["NEE"], near["NEEE"]) >> 2)
    return out


def halve(v: np.ndarray, inverse: bool = False) -> np.ndarray:
    """T-51: halved toward zero; doubled, and one more in the upper half of the range."""
    if not inverse:
        return toward_zero(v, 2)
    return inside(v << 1 | v + HALF >> DEPTH - 1)


#: T-27: weights of the mix at first and their scale, and the distance in bits.
QUANT_FIRST, QUANT_SHIFT, QUANT_DISTANCE = (1 << 21) // 4, 18, 2


def adaptive_quantiser(v: np.ndarray, distance: int = QUANT_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """T-27: levels of what a mix of four predictors misses over a divisor, and what they restore. The mix sees restored
    samples and moves by signs; the divisor follows the running magnitude of levels, up to 2 ** distance."""
    n, h, w = v.shape
    near, state, levels = Near(n, h, w), Near(n, h, w), np.empty_like(v)
    weights = [np.full(n, QUANT_FIRST, dtype=np.int64) for _ in range(4)]
    for y in range(h):
        for x in range(w):
            near.y = state.y = y
            near.x = state.x = x
            terms = [near["W"] + 0, near["N"] + near["W"] - near["NW"], 2 * near["N"] - near["NN"], near["NE"] + 0]
            free = total([a * t for a, t in zip(weights, terms, strict=True)]) >> QUANT_SHIFT
            p = within(free, near["N"], near["W"], near["NE"], near["NEEE"])
            over = np.minimum(state["W"] + 1, 1 << distance)
            level = toward_zero(v[:, y, x] - p, over)
            back = inside(level * over + p)
            levels[:, y, x] = level
            state.put(2 * state["W"] + (np.where(level < 0, -2 * level - 1, 2 * level) << distance) + state["NEEE"] >> 2)
            near.put(back)
            sign = np.sign(back - free)
            weights = [a + sign * t for a, t in zip(weights, terms, strict=True)]
    return levels, near.px[:, ABOVE:, BESIDE : BESIDE + w].copy()


#: T-59: what each of four polyphases is predicted from; the phases are (odd rows, odd columns), in coding order.
PHASES = ((0, 1), (1, 0), (1, 1), (0, 0))


def phase_prediction(n, phase: tuple[int, int], least, most):
    """The prediction of a phase from neighbours all around; `least` and `most` bound it where that is asked for."""
    cross = n["N"] + n["W"] + n["S"] + n["E"]
    if phase == (0, 1):
        return (3 * cross - (n["NW"] + n["NE"] + n["SW"] + n["SE"]) + 4) >> 3
    if phase == (1, 0):
        around = n["NNW"] + n["NNE"] + n["NWW"] + n["NEE"] + n["SWW"] + n["SEE"] + n["SSW"] + n["SSE"]
        sides = (n["N"], n["W"], n["S"], n["E"])
        return least(most((6 * cross - around + 8) >> 4, least(*sides)), most(*sides))
    if phase == (1, 1):
        return (n["NW"] + n["NE"] + n["SW"] + n["SE"] + 2) >> 2
    return least(most(n["NN"] + n["WW"] - n["NNWW"], least(n["NN"], n["WW"])), most(n["NN"], n["WW"]))


class Around:
    """Neighbours by name of all samples of some places at once, 0 outside."""

    def __init__(self, v: np.ndarray, rows: slice, columns: slice):
        self.px, self.rows, self.columns = np.pad(v, ((0, 0), (2, 2), (2, 2))), rows, columns

    def __getitem__(self, name: str) -> np.ndarray:
        up, left = offset_of(name)
        h, w = self.px.shape[1] - 4, self.px.shape[2] - 4
        return self.px[:, 2 - up : 2 - up + h, 2 - left : 2 - left + w][:, self.rows, self.columns]


def polyphase(v: np.ndarray, inverse: bool = False) -> np.ndarray:
    """T-59: every phase is predicted from the phases that come after it, the last from itself (two rows and columns off)."""
    out, least, most = v.copy(), lambda *a: reduce(np.minimum, a), lambda *a: reduce(np.maximum, a)
    if not inverse:
        for a, b in PHASES:
            out[:, a::2, b::2] = wrap(v[:, a::2, b::2] - phase_prediction(Around(v, slice(a, None, 2), slice(b, None, 2)), (a, b), least, most))
        return out
    for y in range(0, v.shape[1], 2):
        for x in range(0, v.shape[2], 2):
            p = phase_prediction(Around(out, slice(y, y + 1), slice(x, x + 1)), (0, 0), least, most)
            out[:, y, x] = wrap(out[:, y, x] + p[:, 0, 0])
    for a, b in PHASES[2::-1]:
        out[:, a::2, b::2] = wrap(out[:, a::2, b::2] + phase_prediction(Around(out, slice(a, None, 2), slice(b, None, 2)), (a, b), least, most))
    return out


#: T-81: layers of a convolution over five rows and columns: weights in 1/32 by neighbour, and those that bound the result.
LAYERS = (
    ({"N": 12, "W": 12, "S": 6, "E": 6, "NW": -4, "SE": -2, "NN": 1, "WW": 1}, ("N", "W", "S", "E")),
    ({"N": 8, "S": 8, "W": 8, "E": 8, "NNWW": 1, "SSEE": -1}, ()),
)


def convolve(v: np.ndarray, layers=LAYERS) -> np.ndarray:
    """T-81: in each layer a sample gives way to what a bounded weighted mean of its surroundings misses; what is outside
    neither counts nor bounds. It can't be undone."""
    for weights, bounds in layers:
        n, h, w = v.shape
        near, there = Around(v, slice(None), slice(None)), Around(np.ones_like(v), slice(None), slice(None))
        p = total([k * near[name] for name, k in weights.items()]) + 16 >> 5
        low, high = np.full(v.shape, np.iinfo(np.int64).max), np.full(v.shape, np.iinfo(np.int64).min)
        for name in bounds:
            low, high = np.where(there[name] > 0, np.minimum(low, near[name]), low), np.where(there[name] > 0, np.maximum(high, near[name]), high)
        p = np.where(low <= high, np.minimum(np.maximum(p, low), high), inside(p))
        v = wrap(v - np.clip(p, -HALF, HALF))
    return v


def quincunx(v: np.ndarray, inverse: bool = False, levels: int = 2) -> np.ndarray:
    """T-100: an adaptive wavelet on grids of growing step: one colour of the checkerboard less the mean of its four sides,
    the other plus the mean of its sides; odd columns less the mean of their diagonals, even ones plus it. Neighbours outside
    are mirrored, means stay within the depth, results may leave it."""
    out, order = v.copy(), [(level, turn) for level in range(levels) for turn in range(4)]
    for level, turn in reversed(order) if inverse else order:
        g = out[:, :: 1 << level, :: 1 << level]
        n, h, w = g.shape
        up, down = np.abs(np.arange(h) - 1), np.where(np.arange(h) + 1 < h, np.arange(h) + 1, np.arange(h) - 1)
        left, right = np.abs(np.arange(w) - 1), np.where(np.arange(w) + 1 < w, np.arange(w) + 1, np.arange(w) - 1)
        if turn < 2:
            around = g[:, up] + g[:, down] + g[:, :, left] + g[:, :, right]
            mine = np.add.outer(np.arange(h), np.arange(w)) % 2 == 1 - turn
        else:
            around = g[:, up][:, :, right] + g[:, up][:, :, left] + g[:, down][:, :, right] + g[:, down][:, :, left]
            mine = np.broadcast_to(np.arange(w) % 2 == 3 - turn, (h, w))
        mean = np.where(mine, inside(around >> 2), 0)
        out[:, :: 1 << level, :: 1 << level] = g + mean if bool(turn % 2) != inverse else g - mean
    return out


def move_to_front(v: np.ndarray, inverse: bool = False) -> np.ndarray:
    """T-55: ranks in a table of recently used levels, starting from the identity."""
    n, size = len(v), v[0].size
    flat, out = v.reshape(n, size), np.empty((n, size), dtype=np.int64)
    table, each, places = np.tile(np.arange(MASK + 1), (n, 1)), np.arange(n), np.arange(MASK + 1)
    for i in range(size):
        rank = flat[:, i] if inverse else (table == (flat[:, i] + HALF)[:, None]).argmax(1)
        level = table[each, rank]
        out[:, i] = level - HALF if inverse else rank
        moved = np.concatenate([level[:, None], table[:, :-1]], axis=1)
        table = np.where(places <= rank[:, None], moved, table)
    return out.reshape(v.shape)


def lean(before, here, after) -> np.ndarray:
    """T-97: how far a monotone trio leans: a twelfth of the weighted slope (toward zero), within twice the step on either
    side so that the halves stay monotone; 0 where it isn't monotone."""
    falls, rises = before - here, here - after
    down = (falls >= 0) & (rises >= 0)
    a, b = np.where(down, falls, -falls), np.where(down, rises, -rises)
    d = (4 * a + 3 * b + 6) // 12
    d = np.where(d - (d & 1) > 2 * a, 2 * a + 1, d)
    d = np.where(d + (d & 1) > 2 * b, 2 * b, d)
    return np.where(down, d, np.where((falls <= 0) & (rises <= 0), -d, 0))


def squeeze(v: np.ndarray, inverse: bool = False) -> np.ndarray:
    """T-97: means and differences of pairs of a plane's samples in a row; a difference is corrected by the lean of its
    surroundings. An even number of samples."""
    n, half = len(v), v[0].size // 2
    flat = v.reshape(n, 2 * half)
    after = lambda mean, k: mean[:, k + 1] if k + 1 < half else np.zeros(n, dtype=np.int64)
    if not inverse:
        odd = flat[:, 1::2]
        diff = flat[:, ::2] - odd
        mean = odd + (diff >> 1)
        before = np.concatenate([np.zeros((n, 1), dtype=np.int64), odd[:, :-1]], axis=1)
        leans = np.stack([lean(before[:, k], mean[:, k], after(mean, k)) for k in range(half)], axis=1)
        return np.concatenate([mean, diff - leans], axis=1).reshape(v.shape)
    mean, rest, out = flat[:, :half], flat[:, half:], np.zeros((n, 2 * half), dtype=np.int64)
    for k in range(half):
        d = rest[:, k] + lean(out[:, 2 * k - 1] if k else np.zeros(n, dtype=np.int64), mean[:, k], after(mean, k))
        out[:, 2 * k + 1] = mean[:, k] - (d >> 1)
        out[:, 2 * k] = out[:, 2 * k + 1] + d
    return out.reshape(v.shape)


#: Transforms that can be undone: (forward, inverse) of planes.
CODERS: dict[str, tuple[Callable, Callable]] = {name: (partial(code, name=name), partial(code, name=name, inverse=True)) for name in MODELS} | {
    "t55_mtf": (move_to_front, partial(move_to_front, inverse=True)),
    "t59_cgplus": (polyphase, partial(polyphase, inverse=True)),
    "t94_zipper": (zipper, partial(zipper, inverse=True)),
    "t100_awav": (quincunx, partial(quincunx, inverse=True)),
    "t97_squeeze": (squeeze, partial(squeeze, inverse=True)),
}


def _planes(batches, side: int = SIDE):
    for b in batches:
        for i in range(0, b.num_rows, PLANES_AT_ONCE):
            part = b.slice(i, PLANES_AT_ONCE)
            yield part["image_id"], part["px"].flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1, side)


def apply(planes: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, px) -> (image_id, px) by a function of planes (n, h, w)."""

    def run(batches):
        for ids, v in _planes(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(fn(v).reshape(len(v), -1).tolist(), pa.list_(pa.int64()))], ["image_id", "px"])

    return planes.select("image_id", "px").mapInArrow(run, "image_id long, px array<long>")


def roundtrip(planes: DataFrame, name: str) -> DataFrame:
    """(image_id, digest, magnitude, mismatches): what the forward transform gives, weighted by place and as magnitudes,
    and samples that the inverse doesn't restore."""
    forward, inverse = CODERS[name]

    def run(batches):
        for ids, v in _planes(batches):
            out = forward(v)
            flat = out.reshape(len(v), -1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat @ np.arange(1, flat.shape[1] + 1)), pa.array(np.abs(flat).sum(1)), pa.array((inverse(out) != v).sum((1, 2)))], ["image_id", "digest", "magnitude", "mismatches"])

    return planes.select("image_id", "px").mapInArrow(run, "image_id long, digest long, magnitude long, mismatches long")
