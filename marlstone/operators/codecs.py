"""Codecs as pairs of functions bytes -> bytes; the analytic result is sizes, and that decoding restores the input."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections import Counter
from collections.abc import Callable
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def rle_encode(data: bytes) -> bytes:
    """Runs as (length, byte)."""
    out, i = bytearray(), 0
    while i < len(data):
        j = i
        while j < len(data) and data[j] == data[i]:
            j += 1
        out += _varint(j - i)
        out.append(data[i])
        i = j
    return bytes(out)


def rle_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n, at = _unvarint(data, at)
        out += data[at : at + 1] * n
        at += 1
    return bytes(out)


class _Bits:
    def __init__(self):
        self.value, self.count = 0, 0

    def put(self, code: int, width: int) -> None:
        self.value, self.count = self.value << width | code, self.count + width

    def bytes(self) -> bytes:
        return (self.value << -self.count % 8).to_bytes((self.count + 7) // 8, "big")


def _split(data: bytes, size: int = 4096) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def rice_encode(data: bytes) -> bytes:
    """Golomb-Rice codes of byte differences, with one parameter per block."""
    out = bytearray(_varint(len(data)))
    last = 0
    for block in _split(data):
        diffs = []
        for b in block:
            d = (b - last + 128 & 255) - 128
            diffs.append(-2 * d - 1 if d < 0 else 2 * d)
            last = b
        k = max(0, (sum(diffs) // len(diffs) + 1).bit_length() - 1)
        bits = _Bits()
        for s in diffs:
            bits.put((1 << (s >> k)) - 1 << 1, (s >> k) + 1)
            bits.put(s & (1 << k) - 1, k)
        body = bits.bytes()
        out += bytes([k]) + _varint(len(body)) + body
    return bytes(out)


def rice_decode(data: bytes) -> bytes:
    n, at = _unvarint(data, 0)
    out, last = bytearray(), 0
    while len(out) < n:
        k = data[at]
        size, at = _unvarint(data, at + 1)
        text = bin(int.from_bytes(b"\x01" + data[at : at + size], "big"))[3:]
        at, i = at + size, 0
        for _ in range(min(4096, n - len(out))):
            j = text.index("0", i)
            s = (j - i << k) + (int(text[j + 1 : j + 1 + k], 2) if k else 0)
            i = j + 1 + k
            last = last + (-(s + 1 >> 1) if s & 1 else s >> 1) & 255
            out.append(last)
    return bytes(out)


def _lengths(freq: dict[int, int]) -> dict[int, int]:
    """Code lengths: the two least frequent trees meet, among equals those with the smallest symbol."""
    if len(freq) < 2:
        return dict.fromkeys(freq, 1)
    heap, node, parent = [f << 8 | s for s, f in freq.items()], list(range(256)), [0] * 256
    heapify(heap)
    for new in range(256, 255 + len(freq)):
        a = heappop(heap)
        b = heap[0]
        i, j = a & 255, b & 255
        parent[node[i]] = parent[node[j]] = new
        if j < i:
            i = j
        node[i] = new
        heapreplace(heap, ((a >> 8) + (b >> 8)) << 8 | i)
        parent.append(0)
    depth = [0] * len(parent)
    for k in range(len(parent) - 2, 255, -1):
        depth[k] = depth[parent[k]] + 1
    return {s: depth[parent[s]] + 1 for s in freq}


def _canonical(depth: dict[int, int]) -> dict[int, tuple[int, int]]:
    code, width, out = 0, 0, {}
    for s in sorted(depth, key=lambda s: (depth[s], s)):
        code <<= depth[s] - width
        width = depth[s]
        out[s] = code, width
        code += 1
    return out


def huffman_encode(data: bytes) -> bytes:
    """Canonical Huffman codes, one table for the whole input."""
    depth = _lengths(Counter(data)) if data else {}
    codes = _canonical(depth)
    out = bytearray(_varint(len(data)) + bytes(depth.get(s, 0) for s in range(256)))
    for block in _split(data):
        bits = _Bits()
        for b in block:
            bits.put(*codes[b])
        body = bits.bytes()
        out += _varint(len(body)) + body
    return bytes(out)


def huffman_decode(data: bytes) -> bytes:
    n, at = _unvarint(data, 0)
    codes = {(w, c): s for s, (c, w) in _canonical({s: d for s, d in enumerate(data[at : at + 256]) if d}).items()}
    at, out = at + 256, bytearray()
    while len(out) < n:
        size, at = _unvarint(data, at)
        bits, left = int.from_bytes(b"\x01" + data[at : at + size], "big"), min(4096, n - len(out))
        at, code, width = at + size, 0, 0
        for c in bin(bits)[3:]:
            code, width = code << 1 | (c == "1"), width + 1
            if (width, code) in codes:
                out.append(codes[width, code])
                code = width = 0
                left -= 1
                if not left:
                    break
    return bytes(out)


_SCALE = 12


def _slots(freq: Counter) -> dict[int, tuple[int, int]]:
    """Start and width of every used symbol in 2 ** _SCALE slots; each keeps one at least."""
    n, used, total, at, out = sum(freq.values()), sorted(freq), 1 << _SCALE, 0, {}
    widths = {s: freq[s] * (total - len(used)) // n + 1 for s in used}
    widths[max(used, key=lambda s: (freq[s], s))] += total - sum(widths.values())
    for s in used:
        out[s] = at, widths[s]
        at += widths[s]
    return out


def _rans_push(x: int, data: bytes, slots) -> tuple[bytes, int]:
    """Code `data`, last byte first; slots: by byte, where the state is too large, width and start."""
    body = bytearray()
    for most, width, start in map(slots.__getitem__, reversed(data)):
        while x >= most:
            body.append(x & 255)
            x >>= 8
        x += x // width * ((1 << _SCALE) - width) + start
    return bytes(body), x


def _rans_pull(x: int, data: bytes, at: int, n: int, where: list[tuple[int, int, int]]) -> bytes:
    """The next n bytes; where: by slot, byte, start and width."""
    out, mask = bytearray(), (1 << _SCALE) - 1
    for _ in range(n):
        s, begin, width = where[x & mask]
        out.append(s)
        x = width * (x >> _SCALE) + (x & mask) - begin
        while x < 1 << 23 and at < len(data):
            x = x << 8 | data[at]
            at += 1
    return bytes(out)


def rans_encode(data: bytes) -> bytes:
    """Static order-0 rANS with 32-bit state and byte output."""
    if not data:
        return _varint(0)
    slots = _slots(Counter(data))
    body, x = _rans_push(1 << 23, data, {s: ((1 << 31 - _SCALE) * width, width, start) for s, (start, width) in slots.items()})
    table = b"".join(bytes([s]) + _varint(w) for s, (_, w) in slots.items())
    return _varint(len(data)) + bytes([len(slots) - 1]) + table + x.to_bytes(4, "big") + body[::-1]


def rans_decode(data: bytes) -> bytes:
    n, at = _unvarint(data, 0)
    if not n:
        return b""
    count, at, where, start = data[at] + 1, at + 1, [], 0
    for _ in range(count):
        s = data[at]
        width, at = _unvarint(data, at + 1)
        where += [(s, start, width)] * width
        start += width
    return _rans_pull(int.from_bytes(data[at : at + 4], "big"), data, at + 4, n, where)


def lz_encode(data: bytes, least: int = 5) -> bytes:
    """Literal runs and matches found through a table of the last place of each `least` bytes."""
    out, last, i, begin, size = bytearray(_varint(len(data))), {}, 0, 0, len(data)
    while i + least <= size:
        key = data[i : i + least]
        j = last.get(key)
        last[key] = i
        if j is None:
            i += 1
            continue
        p, q, step = j + least, i + least, 16
        while (more := data[q : q + step]) and more == data[p : p + len(more)]:
            p, q, step = p + len(more), q + len(more), 2 * step
        for a, b in zip(data[p : p + step], more):
            if a != b:
                break
            q += 1
        out += _varint(i - begin) + data[begin:i] + _varint(q - i) + _varint(i - j)
        begin = i = q
    return bytes(out + _varint(size - begin) + data[begin:])


def lz_decode(data: bytes) -> bytes:
    n, at = _unvarint(data, 0)
    out, made = bytearray(), 0
    while made < n:
        lit = data[at]
        at += 1
        if lit > 127:
            lit, at = _unvarint(data, at - 1)
        out += data[at : at + lit]
        at += lit
        made += lit
        if made < n:
            size = data[at]
            at += 1
            if size > 127:
                size, at = _unvarint(data, at - 1)
            back = data[at]
            at += 1
            if back > 127:
                more = data[at]
                if more < 128:
                    back += (more - 1) << 7
                    at += 1
                else:
                    back, at = _unvarint(data, at - 1)
            copy = out[made - back : made - back + size]
            out += copy if size <= back else (copy * (size // back + 1))[:size]
            made += size
    return bytes(out)


def lzma_encode(data: bytes) -> bytes:
    """xz at preset 6. Its window of 8 MiB is cut to what `data` can use, 1 MiB at least: clearing tables for the rest of it
    takes longer than coding a short text."""
    window = min(1 << 23, max(1 << 20, 1 << len(data).bit_length()))
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": window}])


Codec = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]
#: The codecs that queries can name; more are added by assignment.
CODECS: dict[str, Codec] = {
    "store": (bytes, bytes), "rle": (rle_encode, rle_decode), "rice": (rice_encode, rice_decode), "huffman": (huffman_encode, huffman_decode), "rans0": (rans_encode, rans_decode), "lz": (lz_encode, lz_decode),
    "zlib": (lambda b: zlib.compress(b, 6), zlib.decompress), "bz2": (bz2.compress, bz2.decompress), "lzma": (lzma_encode, lzma.decompress),
}


#: Bytes of blobs that are coded together.
TOGETHER = 32_000_000


def _groups(batches):
    """Ids and data of blobs, about TOGETHER bytes at a time; null data counts as empty."""
    ids, blobs, size = [], [], 0
    for b in batches:
        for i, data in zip(b["blob_id"].to_pylist(), b["data"], strict=True):
            raw = data.as_py() or b""
            if blobs and size + len(raw) > TOGETHER:
                yield ids, blobs
                ids, blobs, size = [], [], 0
            ids.append(i)
            blobs.append(raw)
            size += len(raw)
    if blobs:
        yield ids, blobs


def measure(blobs: DataFrame, names: tuple[str, ...], restore: bool = True) -> DataFrame:
    """(blob_id, codec, usize, csize, lossless) for every blob and codec; null data counts as empty. Without `restore` nothing
    is decoded and lossless is null."""

    def run(batches):
        from .batched import pair

        for ids, raw in _groups(batches):
            usize = pa.array([len(r) for r in raw], pa.int64())
            for name in names:
                encode, decode = pair(CODECS[name])
                small = encode(raw)
                same = [a == b for a, b in zip(decode(small), raw, strict=True)] if restore else [None] * len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(raw)), usize, pa.array([len(s) for s in small], pa.int64()), pa.array(same, pa.bool_())], ["blob_id", "codec", "usize", "csize", "lossless"])

    return blobs.select("blob_id", "data").mapInArrow(run, "blob_id long, codec string, usize long, csize long, lossless boolean")
