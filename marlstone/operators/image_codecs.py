"""Image codecs as compositions of a colour transform, a predictor and an entropy coder; lossy ones of a block transform, a
quantiser and an entropy coder.

A codec turns images (three planes each) into bytes and back. Streams are this library's own. Coders go through the samples
once and work on all images of a batch at every step, so their cost a sample is that of a few numpy operations over images.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks, codecs, color, contexts, sequential
from .analysis import least_change_recipe
from .sequential import within, wrap

SIDE, IMAGES_AT_ONCE = 8, 256
SLOT_BITS, LOWEST = 12, 1 << 23
U32, U64 = np.uint64(0xFFFFFFFF), np.uint64

# --- colour: planes (n, 3, h, w) to planes of wrapped differences and one byte of side information each


def _lift(steps, v: np.ndarray, inverse: bool) -> np.ndarray:
    c = {name: v[:, i] for i, name in enumerate("rgb")}
    for target, amount in reversed(steps) if inverse else steps:
        c[target] = wrap(c[target] + amount(c) if inverse else c[target] - amount(c))
    return np.stack([c["r"], c["g"], c["b"]], axis=1)


_SUBGREEN = [("r", lambda c: c["g"]), ("b", lambda c: c["g"])]
_J2K = [*_SUBGREEN, ("g", lambda c: -(c["r"] + c["b"] >> 2))]


def _recipes(v: np.ndarray, side: np.ndarray, inverse: bool) -> np.ndarray:
    out = np.empty_like(v)
    for k in np.unique(side):
        at = np.flatnonzero(side == k)
        known: dict[str, np.ndarray] = {} if inverse else {name: v[at, i] for i, name in enumerate("rgb")}
        for i, name in enumerate(color.RECIPES[k]):
            target, _, offset = name.partition("-")
            if inverse:
                known[target] = wrap(v[at, i] + known[offset]) if offset else v[at, i]
            else:
                out[at, i] = wrap(known[target] - known[offset]) if offset else known[target]
        if inverse:
            out[at] = np.stack([known[c] for c in "rgb"], axis=1)
    return out


def _choose_recipe(v: np.ndarray) -> np.ndarray:
    return least_change_recipe([v[:, i] for i in range(3)])


def _nothing(v: np.ndarray) -> np.ndarray:
    return np.zeros(len(v), dtype=np.int64)


#: name -> (side information of images, transform of planes by it)
COLOURS: dict[str, tuple[Callable, Callable]] = {
    "none": (_nothing, lambda v, side, inverse: v),
    "subgreen": (_nothing, lambda v, side, inverse: _lift(_SUBGREEN, v, inverse)),
    "jpeg2000": (_nothing, lambda v, side, inverse: _lift(_J2K, v, inverse)),
    "recipe": (_choose_recipe, _recipes),
}

# --- prediction


class _Static:
    def __init__(self, predict):
        self.predict = predict

    def learn(self, v):
        pass


def _west(n):
    return n["W"] if n.x else n["N"]


#: Predictors without memory, next to the models of `sequential`.
SIMPLE: dict[str, Callable] = {
    "zero": lambda n: np.zeros(len(n.px), dtype=np.int64), "west": _west, "north": lambda n: n["N"] if n.y else n["W"], "average": lambda n: n["N"] + n["W"] >> 1,
    "gradient": lambda n: within(n["N"] + n["W"] - n["NW"], n["N"], n["W"]), "slope": lambda n: within(n["W"] + n["NE"] - n["N"], n["N"], n["W"], n["NE"]), "select": lambda n: np.where(np.abs(n["N"] - n["NW"]) > np.abs(n["W"] - n["NW"]), n["N"], n["W"]),
}


def _model(name: str):
    return (lambda n: _Static(SIMPLE[name])) if name in SIMPLE else sequential.MODELS[name]


def predicted(v: np.ndarray, names: tuple[str, ...], side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of planes (m, h, w) and the place of each plane's predictor among `names`; with `side` given, the inverse."""
    if side is None:
        tried = np.stack([sequential.code(v, _model(k)) for k in names])
        side = np.abs(tried).sum((2, 3)).argmin(0)
        return np.take_along_axis(tried, side[None, :, None, None], 0)[0], side
    out = np.empty_like(v)
    for k in np.unique(side):
        out[side == k] = sequential.code(v[side == k], _model(names[k]), True)
    return out, side


# --- entropy coders of symbols 0 .. 255, planes (n, 3, h, w)


class _State:
    """What contexts know when a sample is coded: the running magnitude and the symbol to the west of each image."""

    def __init__(self, n: int, w: int, precision: int):
        self.n, self.w, self.precision = n, w, precision

    def plane(self):
        self.above = np.zeros((self.n, self.w + 3), dtype=np.int64)
        self.other, self.own, self.at = getattr(self, "own", {}), {}, (0, 0)

    def row(self):
        self.run, self.last, self.next = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64), np.zeros_like(self.above) if hasattr(self, "above") else None

    def saw(self, x: int, sym: np.ndarray):
        self.run = (2 * self.run + (sym << self.precision) + np.maximum(self.above[:, x + 2], self.above[:, x + 3])) >> 2
        self.next[:, x], self.last, self.own[self.at] = self.run, sym, sym

    def end(self):
        self.above = self.next

    def beside(self) -> np.ndarray:
        """The symbol of the channel before at this place, 0 in the first."""
        return self.other.get(self.at, np.zeros(self.n, dtype=np.int64))


def _walk(shape, precision: int):
    """Every sample in coding order: (place, state)."""
    n, channels, h, w = shape
    state = _State(n, w, precision)
    for c in range(channels):
        state.plane()
        for y in range(h):
            state.row()
            for x in range(w):
                state.at = (y, x)
                yield (slice(None), c, y, x), state
            state.end()


def _rice_parameter(state: _State) -> np.ndarray:
    return contexts.floor_log2((state.run >> 6) + 1)


def rice_encode(sym: np.ndarray) -> list[bytes]:
    """Golomb-Rice codes whose parameter follows the running magnitude."""
    n = len(sym)
    steps = []
    for at, state in _walk(sym.shape, 6):
        steps.append(_rice_parameter(state))
        state.saw(at[3], sym[at])
    k, s = np.stack(steps, axis=1), sym.reshape(n, -1)
    q = s >> k
    begin = np.cumsum(q + 1 + k, axis=1) - (q + 1 + k)
    sizes = (q + 1 + k).sum(1)
    bits = np.zeros((n, int(sizes.max(initial=0))), dtype=np.uint8)
    rows = np.broadcast_to(np.arange(n)[:, None], s.shape)
    bits[rows, begin + q] = 1
    for b in range(8):
        on = k > b
        bits[rows[on], (begin + q + k - b)[on]] = (s[on] >> b) & 1
    return [np.packbits(bits[i, : sizes[i]]).tobytes() for i in range(n)]


def rice_decode(data: list[bytes], shape) -> np.ndarray:
    n = shape[0]
    longest = 8 * max(map(len, data), default=0) + 16
    bits = np.zeros((n, longest), dtype=np.uint8)
    for i, d in enumerate(data):
        bits[i, : 8 * len(d)] = np.unpackbits(np.frombuffer(d, dtype=np.uint8))
    ones = np.where(bits > 0, np.arange(longest), longest - 1)
    ones = np.minimum.accumulate(ones[:, ::-1], axis=1)[:, ::-1]
    out, p, each = np.zeros(shape, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n)
    for at, state in _walk(shape, 6):
        k = _rice_parameter(state)
        one = ones[each, np.minimum(p, longest - 1)]
        sym, p = one - p, one + 1
        for b in range(int(k.max(initial=0))):
            more = k > b
            sym = np.where(more, sym << 1 | bits[each, np.minimum(p, longest - 1)], sym)
            p = p + more
        out[at] = sym
        state.saw(at[3], sym)
    return out


#: Contexts by name: (how many, of a state).
CONTEXTS: dict[str, tuple[int, Callable[[_State], np.ndarray]]] = {
    "order0": (1, lambda s: np.zeros(s.n, dtype=np.int64)),
    "order1": (16, lambda s: np.minimum(s.last, 15)),
    "magnitude": (contexts.CONTEXTS, lambda s: contexts.by_state(s.run, contexts.CONTEXTS)),
    "channels": (64, lambda s: np.minimum(contexts.floor_log2(s.run * s.run + 1) >> 1, 7) * 8 + np.minimum(contexts.floor_log2(s.beside() + 1), 7)),
}


class _Bytes:
    """Byte strings of all images that grow by steps."""

    def __init__(self, n: int, most: int):
        self.raw, self.size, self.each = np.zeros((n, most), dtype=np.uint8), np.zeros(n, dtype=np.int64), np.arange(n)

    def put(self, which: np.ndarray, value: np.ndarray) -> None:
        self.raw[self.each[which], self.size[which]] = value[which]
        self.size += which


def _slots(hist: np.ndarray) -> np.ndarray:
    """Widths of used symbols in 2 ** SLOT_BITS slots, one at least; the most frequent takes what is left."""
    slots = 1 << SLOT_BITS
    total, used = hist.sum(-1, keepdims=True), (hist > 0).sum(-1, keepdims=True)
    width = np.where(hist > 0, hist * (slots - used) // np.maximum(total, 1) + 1, 0)
    top = hist.argmax(-1)[..., None]
    left = np.where(total > 0, slots - width.sum(-1, keepdims=True), 0)
    np.put_along_axis(width, top, np.take_along_axis(width, top, -1) + left, -1)
    return width


def _rans(starts: list[np.ndarray], widths: list[np.ndarray], n: int) -> list[bytes]:
    """Code the slots of all samples, last first."""
    x, out = np.full(n, LOWEST, dtype=np.int64), _Bytes(n, 2 * len(starts) + 8)
    for start, width in zip(reversed(starts), reversed(widths), strict=True):
        while (full := x >= (LOWEST >> SLOT_BITS << 8) * width).any():
            out.put(full, x & 255)
            x = np.where(full, x >> 8, x)
        x = (x // width << SLOT_BITS) + x % width + start
    return [int(x[i]).to_bytes(4, "big") + out.raw[i, : out.size[i]][::-1].tobytes() for i in range(n)]


class _Unrans:
    def __init__(self, data: list[bytes]):
        self.raw = np.zeros((len(data), max(map(len, data), default=0) + 4), dtype=np.int64)
        for i, d in enumerate(data):
            self.raw[i, : len(d)] = np.frombuffer(d, dtype=np.uint8)
        self.x = self.raw[:, 0] << 24 | self.raw[:, 1] << 16 | self.raw[:, 2] << 8 | self.raw[:, 3]
        self.at, self.each = np.full(len(data), 4), np.arange(len(data))

    def symbol(self, cdf: np.ndarray) -> np.ndarray:
        """The next symbol by cumulative slots (n, 257)."""
        slot = self.x & (1 << SLOT_BITS) - 1
        sym = (cdf[:, 1:] <= slot[:, None]).sum(1)
        start = cdf[self.each, sym]
        self.x = (cdf[self.each, sym + 1] - start) * (self.x >> SLOT_BITS) + slot - start
        while (low := self.x < LOWEST).any() and (low & (self.at < self.raw.shape[1])).any():
            low &= self.at < self.raw.shape[1]
            self.x = np.where(low, self.x << 8 | self.raw[self.each, np.minimum(self.at, self.raw.shape[1] - 1)], self.x)
            self.at = self.at + low
        return sym


def static_encode(sym: np.ndarray, kind: str) -> list[bytes]:
    """rANS with one static table per channel and context."""
    n, channels = sym.shape[:2]
    count, context = CONTEXTS[kind]
    hist, used, each = np.zeros((n, channels, count, 256), dtype=np.int64), [], np.arange(n)
    for at, state in _walk(sym.shape, contexts.PRECISION):
        ctx = context(state)
        used.append((at[1], ctx, sym[at]))
        hist[each, at[1], ctx, sym[at]] += 1
        state.saw(at[3], sym[at])
    width = _slots(hist)
    start = np.cumsum(width, -1) - width
    body = _rans([start[each, c, ctx, s] for c, ctx, s in used], [width[each, c, ctx, s] for c, ctx, s in used], n)
    heads = [zlib.compress(w.astype("<u2").tobytes(), 9) for w in width]
    return [len(h).to_bytes(4, "big") + h + b for h, b in zip(heads, body, strict=True)]


def static_decode(data: list[bytes], shape, kind: str) -> np.ndarray:
    n, channels = shape[:2]
    count, context = CONTEXTS[kind]
    heads = [int.from_bytes(d[:4], "big") for d in data]
    width = np.stack([np.frombuffer(zlib.decompress(d[4 : 4 + k]), dtype="<u2") for d, k in zip(data, heads, strict=True)]).astype(np.int64).reshape(n, channels, count, 256)
    cdf = np.concatenate([np.zeros((n, channels, count, 1), dtype=np.int64), np.cumsum(width, -1)], axis=-1)
    coder, out, each = _Unrans([d[4 + k :] for d, k in zip(data, heads, strict=True)]), np.zeros(shape, dtype=np.int64), np.arange(n)
    for at, state in _walk(shape, contexts.PRECISION):
        out[at] = coder.symbol(cdf[each, at[1], context(state)])
        state.saw(at[3], out[at])
    return out


#: Adaptive tables move by one part in 2 ** RATE toward the symbol that was coded; every symbol keeps one slot.
RATE = 5
_RAMP = np.arange(257)


class _Moving:
    def __init__(self, n: int, channels: int, count: int):
        first = _RAMP * ((1 << SLOT_BITS) // 256)
        self.cdf, self.each = np.tile(first, (n, channels, count, 1)), np.arange(n)

    def learn(self, c: int, ctx: np.ndarray, sym: np.ndarray) -> None:
        now = self.cdf[self.each, c, ctx]
        goal = np.where(_RAMP > sym[:, None], (1 << SLOT_BITS) - 256 + _RAMP, _RAMP)
        self.cdf[self.each, c, ctx] = now + (goal - now >> RATE)


def moving_encode(sym: np.ndarray, kind: str) -> list[bytes]:
    """rANS with adaptive tables: the slots of all samples are noted on the way forward."""
    n, channels = sym.shape[:2]
    count, context = CONTEXTS[kind]
    table, starts, widths = _Moving(n, channels, count), [], []
    for at, state in _walk(sym.shape, contexts.PRECISION):
        ctx, s = context(state), sym[at]
        now = table.cdf[table.each, at[1], ctx]
        starts.append(now[table.each, s])
        widths.append(now[table.each, s + 1] - starts[-1])
        table.learn(at[1], ctx, s)
        state.saw(at[3], s)
    return _rans(starts, widths, n)


def moving_decode(data: list[bytes], shape, kind: str) -> np.ndarray:
    count, context = CONTEXTS[kind]
    table, coder, out = _Moving(shape[0], shape[1], count), _Unrans(data), np.zeros(shape, dtype=np.int64)
    for at, state in _walk(shape, contexts.PRECISION):
        ctx = context(state)
        out[at] = coder.symbol(table.cdf[table.each, at[1], ctx])
        table.learn(at[1], ctx, out[at])
        state.saw(at[3], out[at])
    return out


class _Shift:
    """Probabilities of a zero bit that move by 1 / 128."""

    def __init__(self, shape):
        self.p = np.full(shape, 0x8000, dtype=np.int64)

    def zero(self, at):
        return np.clip(self.p[at], 16, 0x10000 - 16)

    def learn(self, at, zero, bit):
        self.p[at] = zero + ((1 - bit << 16) - zero + 64 >> 7)


class _Counts:
    """Probabilities of a zero bit from plain counts."""

    def __init__(self, shape):
        self.n = np.zeros((2, *shape), dtype=np.int64)

    def zero(self, at):
        return np.clip((self.n[0][at] + 1 << 16) // (self.n[0][at] + self.n[1][at] + 2), 16, 0x10000 - 16)

    def learn(self, at, zero, bit):
        self.n[0][at] += 1 - bit
        self.n[1][at] += bit


def _binary_tables(shape, kind: str, bits):
    n, channels = shape[:2]
    return bits((n, channels, CONTEXTS[kind][0], 256)), CONTEXTS[kind][1], np.arange(n)


def binary_encode(sym: np.ndarray, kind: str, bits=_Shift, sizes: np.ndarray | None = None) -> list[bytes]:
    """A range coder of 32-bit words over the bits of symbols, highest first, with one probability per node of their tree,
    channel and context. sizes: how many symbols each image has, if not all; what follows leaves no trace in its stream."""
    n = len(sym)
    done, ends = np.full(n, sym[0].size if n else 0) if sizes is None else sizes, [(0, 0)] * n
    table, context, each = _binary_tables(sym.shape, kind, bits)
    low, span, words = np.zeros(n, dtype=U64), np.full(n, 0xFFFFFFFF, dtype=U64), [[] for _ in range(n)]
    for seen, (at, state) in enumerate(_walk(sym.shape, contexts.PRECISION), 1):
        ctx, node, s = context(state), np.ones(n, dtype=np.int64), sym[at]
        for k in reversed(range(8)):
            bit, place = s >> k & 1, (each, at[1], ctx, node)
            zero = table.zero(place)
            full = span < U64(0x10000)
            for i in np.flatnonzero(full):
                words[i].append(int(low[i] >> U64(32)))
            low = np.where(full, low << U64(32), low)
            span = np.where(full, np.minimum(span << U64(32) | U32, ~low), span)
            part = span * zero.astype(U64) >> U64(16)
            low, span = np.where(bit > 0, low + part, low), np.where(bit > 0, span - part, part - U64(1))
            table.learn(place, zero, bit)
            node = node * 2 + bit
        state.saw(at[3], s)
        for i in np.flatnonzero(done == seen):
            ends[i] = len(words[i]), int(low[i])
    return [b"".join(w.to_bytes(4, "big") for w in words[i][:k]) + last.to_bytes(8, "big") for i, (k, last) in enumerate(ends)]


def binary_decode(data: list[bytes], shape, kind: str, bits=_Shift) -> np.ndarray:
    n = shape[0]
    table, context, each = _binary_tables(shape, kind, bits)
    raw = np.zeros((n, max(map(len, data), default=0) // 4 + 4), dtype=U64)
    for i, d in enumerate(data):
        raw[i, : len(d) // 4] = np.frombuffer(d, dtype=">u4")
    low, span, value, at_word = np.zeros(n, dtype=U64), np.full(n, 0xFFFFFFFF, dtype=U64), raw[:, 0] << U64(32) | raw[:, 1], np.full(n, 2)
    out = np.zeros(shape, dtype=np.int64)
    for at, state in _walk(shape, contexts.PRECISION):
        ctx, node = context(state), np.ones(n, dtype=np.int64)
        for _ in range(8):
            place = (each, at[1], ctx, node)
            zero = table.zero(place)
            full = span < U64(0x10000)
            value = np.where(full, value << U64(32) | raw[each, np.minimum(at_word, raw.shape[1] - 1)], value)
            at_word = at_word + full
            low = np.where(full, low << U64(32), low)
            span = np.where(full, np.minimum(span << U64(32) | U32, ~low), span)
            part = span * zero.astype(U64) >> U64(16)
            bit = (value - low >= part).astype(np.int64)
            low, span = np.where(bit > 0, low + part, low), np.where(bit > 0, span - part, part - U64(1))
            table.learn(place, zero, bit)
            node = node * 2 + bit
        out[at] = node - 256
        state.saw(at[3], out[at])
    return out


def _by_bytes(encode, decode):
    """A coder of byte strings, image by image."""
    return (
        lambda sym: [encode(s.astype(np.uint8).tobytes()) for s in sym],
        lambda data, shape: np.stack([np.frombuffer(decode(d), dtype=np.uint8) for d in data]).astype(np.int64).reshape(shape),
    )


def lz_binary_encode(sym: np.ndarray) -> list[bytes]:
    """Matches and literals of each image, their bytes through the binary coder, all images at once."""
    raw = [codecs.lz_encode(s.astype(np.uint8).tobytes()) for s in sym]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    padded = np.zeros((len(raw), 1, 1, int(sizes.max(initial=0))), dtype=np.int64)
    for row, r in zip(padded[:, 0, 0], raw, strict=True):
        row[: len(r)] = np.frombuffer(r, dtype=np.uint8)
    return [codecs._varint(len(r)) + d for r, d in zip(raw, binary_encode(padded, "order1", sizes=sizes), strict=True)]


def lz_binary_decode(data: list[bytes], shape) -> np.ndarray:
    heads = [codecs._unvarint(d, 0) for d in data]
    raw = binary_decode([d[at:] for d, (_, at) in zip(data, heads, strict=True)], (len(data), 1, 1, max((n for n, _ in heads), default=0)), "order1").astype(np.uint8)
    return np.stack([np.frombuffer(codecs.lz_decode(r[0, 0, :n].tobytes()), dtype=np.uint8) for r, (n, _) in zip(raw, heads, strict=True)]).astype(np.int64).reshape(shape)


def either_encode(sym: np.ndarray, names: tuple[str, ...]) -> list[bytes]:
    """The shortest of several coders' streams, behind the coder's number."""
    tried = [ENTROPY[name][0](sym) for name in names]
    best = [min(range(len(names)), key=lambda k: (len(tried[k][i]), k)) for i in range(len(sym))]
    return [bytes([k]) + tried[k][i] for i, k in enumerate(best)]


def either_decode(data: list[bytes], shape, names: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(shape, dtype=np.int64)
    for k, name in enumerate(names):
        at = [i for i, d in enumerate(data) if d[0] == k]
        if at:
            out[at] = ENTROPY[name][1]([data[i][1:] for i in at], (len(at), *shape[1:]))
    return out


#: Entropy coders: (symbols to bytes, bytes and shape to symbols).
ENTROPY: dict[str, tuple[Callable, Callable]] = {
    "rice": (rice_encode, rice_decode),
    "lz_rice": _by_bytes(lambda b: codecs.rice_encode(codecs.lz_encode(b)), lambda b: codecs.lz_decode(codecs.rice_decode(b))),
    "rle_rice": _by_bytes(lambda b: codecs.rice_encode(codecs.rle_encode(b)), lambda b: codecs.rle_decode(codecs.rice_decode(b))),
    "huffman": _by_bytes(codecs.huffman_encode, codecs.huffman_decode),
    "lz_binary": (lz_binary_encode, lz_binary_decode),
    "rice_or_ac": (partial(either_encode, names=("rice", "moving_magnitude")), partial(either_decode, names=("rice", "moving_magnitude"))),
}
for _kind in CONTEXTS:
    ENTROPY[f"static_{_kind}"] = partial(static_encode, kind=_kind), partial(static_decode, kind=_kind)
    ENTROPY[f"moving_{_kind}"] = partial(moving_encode, kind=_kind), partial(moving_decode, kind=_kind)
    ENTROPY[f"binary_{_kind}"] = partial(binary_encode, kind=_kind), partial(binary_decode, kind=_kind)
    ENTROPY[f"counts_{_kind}"] = partial(binary_encode, kind=_kind, bits=_Counts), partial(binary_decode, kind=_kind, bits=_Counts)

_FEW, _SEVEN = ("north", "west", "gradient"), ("zero", "north", "west", "average", "gradient", "slope", "select")
#: Lossless codecs by what they are known to be made of: colour, predictors to choose from per plane, entropy coder.
LOSSLESS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "c01_mix_ac": ("recipe", ("t65_wp",), "binary_magnitude"), "c02_binary": ("recipe", _SEVEN, "binary_order1"), "c04_rice_weighted": ("subgreen", ("t65_wp",), "rice"), "c05_rice_simple": ("recipe", _SEVEN, "rice"), "c06_binary": ("subgreen", ("gradient",), "binary_order0"),
    "c07_order0_binary": ("none", ("gradient",), "binary_order0"), "c09_symbol_ans": ("jpeg2000", ("gradient",), "static_order0"), "c10_l1_magnitude": ("recipe", ("t30_ols7",), "binary_magnitude"), "c11_mix_magnitude": ("recipe", ("t67_wgrad3",), "moving_magnitude"),
    "c12_order1_binary": ("recipe", ("gradient",), "binary_order1"), "c16_subgreen_order0": ("subgreen", ("gradient",), "moving_order0"), "c17_previous_rice": ("subgreen", ("west",), "rice"), "c18_subgreen_either": ("subgreen", _FEW, "rice_or_ac"),
    "c20_static_order1": ("subgreen", ("gradient",), "static_order1"), "c22_static_order1_any": ("subgreen", _SEVEN, "static_order1"), "c23_static_blockwise": ("recipe", _SEVEN, "static_order1"), "c26_binary_adaptive": ("none", ("zero",), "binary_order0"),
    "c27_rice": ("subgreen", ("gradient",), "rice"), "c28_magnitude_ac": ("subgreen", ("gradient",), "moving_magnitude"), "c29_static_magnitude": ("recipe", ("t67_wgrad3", "gradient"), "static_magnitude"), "c30_ols": ("recipe", ("t86_ols",), "moving_magnitude"),
    "c33_gradient_only": ("recipe", ("gradient",), "static_magnitude"), "c37_weighted_or_l1": ("recipe", ("t65_wp", "t30_ols7"), "moving_magnitude"), "c41_select_runs": ("recipe", _SEVEN, "rle_rice"), "c42_lz_rice": ("subgreen", ("gradient",), "lz_rice"),
    "c43_lz_rice_plain": ("none", ("zero",), "lz_rice"), "c44_adaptive_order1": ("subgreen", ("gradient",), "moving_order1"), "c45_simple_order1": ("subgreen", ("west",), "static_order1"), "c57_fast_rice": ("none", ("west",), "rice"),
    "c03_binary_weighted": ("recipe", ("t71_wgrad5",), "binary_order1"), "c14_weighted_binary": ("subgreen", ("t71_wgrad5",), "binary_magnitude"), "c15_weighted_binary": ("recipe", ("t71_wgrad5",), "binary_magnitude"), "c24_mix4_ac": ("recipe", ("t65_wp",), "moving_order1"), "c34_rans": ("recipe", _SEVEN, "static_order0"), "t45_calic": ("none", ("t42_calic",), "moving_magnitude"), "c25_mix8_ac": ("recipe", ("t71_wgrad5",), "moving_magnitude"), "c46_rice_or_ac": ("recipe", ("gradient",), "rice_or_ac"), "c52_channels_ac": ("recipe", ("gradient",), "moving_channels"), "c56_lz_ac": ("subgreen", ("west",), "lz_binary"),
    "c58_bit_counts": ("recipe", ("gradient",), "counts_order1"), "huffman_gradient": ("subgreen", ("gradient",), "huffman"), "huffman_plain": ("none", ("zero",), "huffman"), "rans_plain": ("none", ("zero",), "static_order0"), "t54_fast_ac": ("jpeg2000", ("gradient",), "moving_order0"),
}


#: Codecs that take the shorter of two others' streams.
SHORTER = {"c38_synth_or_natural": ("c43_lz_rice_plain", "c10_l1_magnitude")}
NAMES = (*LOSSLESS, *SHORTER)


def encode(v: np.ndarray, name: str) -> list[bytes]:
    """Images (n, 3, h, w) as bytes: colour and predictor choices, then the entropy coder's."""
    if name in SHORTER:
        tried = [encode(v, k) for k in SHORTER[name]]
        return [min((bytes([k]) + t[i] for k, t in enumerate(tried)), key=lambda d: (len(d), d[0])) for i in range(len(v))]
    colour, predictors, coder = LOSSLESS[name]
    choose, turn = COLOURS[colour]
    side = choose(v)
    planes = turn(v, side, False)
    n, channels, h, w = v.shape
    res, used = predicted(planes.reshape(n * channels, h, w), predictors, None)
    body = ENTROPY[coder][0](contexts.zigzag(res).reshape(v.shape))
    used = used.reshape(n, channels)
    return [bytes([int(side[i]), *used[i].tolist()]) + body[i] for i in range(n)]


def decode(data: list[bytes], name: str, shape: tuple[int, ...]) -> np.ndarray:
    if name in SHORTER:
        out = np.zeros(shape, dtype=np.int64)
        for k, of in enumerate(SHORTER[name]):
            if at := [i for i, d in enumerate(data) if d[0] == k]:
                out[at] = decode([data[i][1:] for i in at], of, (len(at), *shape[1:]))
        return out
    colour, predictors, coder = LOSSLESS[name]
    n, channels, h, w = shape
    side = np.array([d[0] for d in data], dtype=np.int64)
    used = np.array([list(d[1 : 1 + channels]) for d in data], dtype=np.int64).reshape(-1)
    sym = ENTROPY[coder][1]([d[1 + channels :] for d in data], shape)
    res = np.where(sym & 1, -(sym + 1 >> 1), sym >> 1).reshape(n * channels, h, w)
    planes, _ = predicted(res, predictors, used)
    return COLOURS[colour][1](planes.reshape(shape), side, True)


#: Lossy codecs: colour, block transform, step of the quantiser, entropy coder.
LOSSY: dict[str, tuple[str, str, int, str]] = {
    "c47_dct4": ("jpeg2000", "t101_dct4", 16, "static_magnitude"), "c48_dct8": ("jpeg2000", "t102_dct8", 16, "binary_magnitude"), "c49_wavelet_ac": ("jpeg2000", "t98_legall53", 8, "binary_magnitude"), "c60_wavelet": ("jpeg2000", "t99_cdf97", 8, "static_magnitude"),
}


def quantised(v: np.ndarray, name: str) -> np.ndarray:
    """Coefficients of images over the step, rounded to the nearest and kept within a byte."""
    colour, transform, step, _ = LOSSY[name]
    planes = COLOURS[colour][1](v, _nothing(v), False)
    return np.clip(blocks.forward2d(planes, transform) + step // 2 >> step.bit_length() - 1, -128, 127)


def coefficients(images: DataFrame, name: str) -> DataFrame:
    """(image_id, px): the quantised coefficients of a lossy codec, channel after channel."""

    def run(batches):
        for ids, v in _images(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(quantised(v, name).reshape(len(v), -1).tolist(), pa.list_(pa.int64()))], ["image_id", "px"])

    return images.mapInArrow(run, "image_id long, px array<long>")


def lossy_encode(v: np.ndarray, name: str) -> list[bytes]:
    return ENTROPY[LOSSY[name][3]][0](contexts.zigzag(quantised(v, name)))


def lossy_decode(data: list[bytes], name: str, shape: tuple[int, ...]) -> np.ndarray:
    colour, transform, step, coder = LOSSY[name]
    sym = ENTROPY[coder][1](data, shape)
    planes = sequential.inside(blocks.inverse2d(np.where(sym & 1, -(sym + 1 >> 1), sym >> 1) * step, transform))
    return COLOURS[colour][1](planes, _nothing(planes), True)


def _images(batches):
    for b in batches:
        for i in range(0, b.num_rows, IMAGES_AT_ONCE):
            part = b.slice(i, IMAGES_AT_ONCE)
            yield part["image_id"], np.stack([part[c].flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1, SIDE) for c in "rgb"], axis=1)


def measure(images: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(image_id, codec, usize, csize, wrong, squared_error): bytes before and after, samples that decoding doesn't restore
    and their squared error."""

    def run(batches):
        for ids, v in _images(batches):
            for name in names:
                data = lossy_encode(v, name) if name in LOSSY else encode(v, name)
                back = lossy_decode(data, name, v.shape) if name in LOSSY else decode(data, name, v.shape)
                n, away = len(v), (back - v).reshape(len(v), -1)
                yield pa.RecordBatch.from_arrays([ids, pa.array([name] * n), pa.array([v[0].size] * n), pa.array([len(d) for d in data]), pa.array((away != 0).sum(1)), pa.array((away * away).sum(1))], ["image_id", "codec", "usize", "csize", "wrong", "squared_error"])

    # a few thousand images are one small partition and many minutes of work
    session = images.sparkSession
    n = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return images.repartition(n, "image_id").mapInArrow(run, "image_id long, codec string, usize long, csize long, wrong long, squared_error long")


def encoded(images: DataFrame, name: str) -> DataFrame:
    """K-07: (image_id, data): the stream of each image, for any sink of binary columns."""

    def run(batches):
        for ids, v in _images(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(lossy_encode(v, name) if name in LOSSY else encode(v, name), pa.binary())], ["image_id", "data"])

    return images.mapInArrow(run, "image_id long, data binary")


def decoded(streams: DataFrame, name: str, rows: int = SIDE) -> DataFrame:
    """(image_id, r, g, b) from (image_id, data) of images of `rows` x SIDE samples."""

    def run(batches):
        for b in batches:
            data = b["data"].to_pylist()
            if data:
                shape = (len(data), 3, rows, SIDE)
                v = lossy_decode(data, name, shape) if name in LOSSY else decode(data, name, shape)
                yield pa.RecordBatch.from_arrays([b["image_id"], *[pa.array(v[:, c].reshape(len(data), -1).tolist(), pa.list_(pa.int64())) for c in range(3)]], ["image_id", "r", "g", "b"])

    return streams.select("image_id", "data").mapInArrow(run, "image_id long, r array<long>, g array<long>, b array<long>")
