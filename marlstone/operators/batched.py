"""The byte codecs of `codecs` over many blobs at once: the same streams, made and read by arrays.

Run lengths and bit fields are computed for all bytes of a chunk; what only goes forward step by step (reading variable codes,
the state of rANS) takes one step for all blocks or blobs together. Where few blobs are left, their rest is coded one by one.
"""

from __future__ import annotations

import numpy as np

from . import codecs

#: Bytes of blobs whose arrays are made together; a longer blob is a chunk of its own.
CHUNK = 1 << 21
#: With fewer blobs left than this, a plain loop is faster than steps of arrays.
FEW = 32
BLOCK, TABLE_BITS = 4096, 12


def chunks(blobs: list[bytes], most: int = CHUNK):
    """Runs of blobs of about `most` bytes."""
    part, size = [], 0
    for b in blobs:
        if part and size + len(b) > most:
            yield part
            part, size = [], 0
        part.append(b)
        size += len(b)
    if part:
        yield part


def _by_chunk(f, most: int = CHUNK):
    return lambda blobs: [x for part in chunks(blobs, most) for x in f(part)]


def _flat(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each blob begins (and the end), and sizes."""
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    return np.frombuffer(b"".join(blobs), dtype=np.uint8), np.concatenate(([0], np.cumsum(size))), size


def _cut(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw, at = data.tobytes(), at.tolist()
    return [raw[i:j] for i, j in zip(at, at[1:])]


# --- run lengths


def _rle_encode(blobs: list[bytes]) -> list[bytes]:
    raw, off, size = _flat(blobs)
    fresh = np.ones(len(raw), dtype=bool)
    np.not_equal(raw[1:], raw[:-1], out=fresh[1:])
    fresh[off[:-1][size > 0]] = True
    start = np.flatnonzero(fresh)
    run = np.diff(start, append=len(raw))
    width, most = np.ones(len(run), dtype=np.int64), int(run.max(initial=0))
    for b in range(7, most.bit_length(), 7):
        width += run >> b > 0
    at = np.concatenate(([0], np.cumsum(width + 1)))
    out = np.empty(at[-1], dtype=np.uint8)
    for b in range(int(width.max(initial=1))):
        on = width > b
        out[at[:-1][on] + b] = run[on] >> 7 * b & 127 | (width[on] > b + 1) << 7
    out[at[1:] - 1] = raw[start]
    return _cut(out, at[np.searchsorted(start, off)])


def _rle_decode(blobs: list[bytes]) -> list[bytes]:
    """All streams are one sequence of records; between runs over 127 they are pairs of bytes."""
    raw, off, _ = _flat(blobs)
    long = np.flatnonzero(raw > 127)
    long, at, starts, runs, syms = [long[long % 2 == p] for p in (0, 1)], 0, [], [], []
    while at < len(raw):
        hits = long[at % 2]
        k = int(np.searchsorted(hits, at))
        end = int(hits[k]) if k < len(hits) else len(raw)
        starts.append(np.arange(at, end, 2))
        runs.append(raw[at:end:2])
        syms.append(raw[at + 1 : end : 2])
        at = end
        if at < len(raw):
            n, after = codecs._unvarint(raw[at : at + 10].tolist(), 0)
            starts.append([at])
            runs.append([n])
            syms.append(raw[at + after : at + after + 1])
            at += after + 1
    if not starts:
        return [b""] * len(blobs)
    run = np.concatenate(runs).astype(np.int64)
    return _cut(np.repeat(np.concatenate(syms), run), np.concatenate(([0], np.cumsum(run)))[np.searchsorted(np.concatenate(starts), off)])


# --- bit fields in blocks that begin at bytes


def _blocks(off: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where blocks of blobs begin among all bytes, their sizes, and how many each blob has."""
    n = -(-size // BLOCK)
    first = np.cumsum(n) - n
    begin = (np.arange(n.sum()) - np.repeat(first, n)) * BLOCK
    return begin + np.repeat(off[:-1], n), np.minimum(BLOCK, np.repeat(size, n) - begin), n


def _places(width: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit at which each field ends, bits of blocks, and the byte at which each block begins (and the end)."""
    end = np.cumsum(width, dtype=np.int64)
    last = end[begin + count - 1]
    bits = np.diff(last, prepend=0)
    at = np.concatenate(([0], np.cumsum(bits + 7 >> 3)))
    end += np.repeat(8 * at[:-1] - (last - bits), count)
    return end, bits, at


def _pack(value: np.ndarray, width: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Bytes with fields of at most 16 bits that end at given bits and don't overlap."""
    start = end - width
    unit = start >> 4
    value = value.astype(np.uint32) << (32 - width - (start & 15)).astype(np.uint32)
    out = np.bincount(unit, value >> np.uint32(16), (size + 1) // 2 + 2)
    out[1:] += np.bincount(unit, value & np.uint32(0xFFFF), len(out))[:-1]
    return out.astype(">u2").view(np.uint8)[:size]


def _bodies(heads: list[bytes], data: np.ndarray, at: np.ndarray, n: np.ndarray, first: list[bytes]) -> list[bytes]:
    """Blobs of what stands first and of blocks, each behind its head and its size."""
    raw, at, out, b = data.tobytes(), at.tolist(), [], 0
    small = [codecs._varint(k) for k in range(BLOCK * 2)]
    for head, count in zip(first, n.tolist()):
        parts = [head]
        for k in range(b, b + count):
            size = at[k + 1] - at[k]
            parts += (heads[k], small[size] if size < len(small) else codecs._varint(size), raw[at[k] : at[k + 1]])
        b += count
        out.append(b"".join(parts))
    return out


def _rice_encode(blobs: list[bytes]) -> list[bytes]:
    raw, off, size = _flat(blobs)
    if not len(raw):
        return [codecs.rice_encode(b) for b in blobs]
    d = raw.copy()
    d[1:] -= raw[:-1]
    first = off[:-1][size > 0]
    d[first] = raw[first]
    s = d << 1 ^ (d.view(np.int8) >> 7).view(np.uint8)
    begin, count, n = _blocks(off, size)
    k = np.log2(np.add.reduceat(s, begin, dtype=np.int64) // count + 1).astype(np.uint8)
    each = np.repeat(k, count)
    wide = s.astype(np.uint16)
    width = (wide >> each) + each + np.uint16(1)
    end, bits, at = _places(width, begin, count)
    # the complement: zeros for the ones in front, a one, the complement of the low bits, ones for what fills the last byte
    one = np.uint16(1) << each.astype(np.uint16)
    field = one | (~wide & one - np.uint16(1))
    packed = _pack(field, each.astype(np.int64) + 1, end, int(at[-1]))
    packed[at[1:] - 1] |= ((1 << (-bits & 7)) - 1).astype(np.uint8)
    return _bodies([bytes([x]) for x in k.tolist()], ~packed, at, n, [codecs._varint(x) for x in size.tolist()])


def _windows(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the two that follow."""
    d = np.concatenate((data, np.zeros(3, dtype=np.uint8))).astype(np.uint32)
    return d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]


def _stepwise(body: list[bytes], count: np.ndarray, table: np.ndarray, base: np.ndarray, bits: int, slow) -> np.ndarray:
    """Symbols of all blocks, block after block. table: of `bits` bits from a block's base, width << 8 | symbol, or 0 where `slow`
    (block, the bits from there on as a number of 64) tells (width, symbol)."""
    order = np.argsort(-count, kind="stable")
    raw, off, _ = _flat(body)
    words, tail = _windows(raw), raw.tobytes() + bytes(72)
    p, base = 8 * off[:-1][order], base[order]
    active = len(count) - np.searchsorted(count[order][::-1], np.arange(int(count.max())), side="right")
    out = np.empty((len(active), len(count)), dtype=np.uint8)
    mask, shift = (1 << bits) - 1, 24 - bits
    for t, a in enumerate(active.tolist()):
        here = p[:a]
        got = table[(words[here >> 3] >> (shift - (here & 7)) & mask) + base[:a]]
        if not got.all():
            got = got.astype(np.int64)
            for i in np.flatnonzero(got == 0).tolist():
                at = int(here[i])
                width, sym = slow(int(order[i]), tail, at)
                out[t, i], got[i] = sym, width << 8
                got[i] |= sym
        out[t, :a] = got
        here += got >> 8
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    rows = np.ascontiguousarray(out.T)[back]
    return rows[np.arange(rows.shape[1]) < count[:, None]]


def _rice_table() -> np.ndarray:
    """For each parameter, width << 8 | symbol of codes that begin a window of 16 bits, 0 where it doesn't hold one."""
    w = np.arange(1 << 16)
    ones = 16 - np.ceil(np.log2((w ^ 0xFFFF) + 1)).astype(np.int64)
    out = []
    for k in range(9):
        width = ones + 1 + k
        low = w >> np.maximum(16 - width, 0) & (1 << k) - 1
        sym = (ones << k) + low
        out.append(np.where((width <= 16) & (sym < 256), width << 8 | sym & 255, 0))
    return np.concatenate(out).astype(np.int32)


_RICE: list[np.ndarray] = []


def _rice_decode(blobs: list[bytes]) -> list[bytes]:
    ks, body, count, sizes = [], [], [], []
    for d in blobs:
        n, at = codecs._unvarint(d, 0)
        sizes.append(n)
        for left in range(n, 0, -BLOCK):
            ks.append(d[at])
            size, at = codecs._unvarint(d, at + 1)
            body.append(d[at : at + size])
            at += size
            count.append(min(BLOCK, left))
    if not body:
        return [b""] * len(blobs)
    if not _RICE:
        _RICE.append(_rice_table())

    def slow(block, raw, at):
        k, q = ks[block], 0
        while raw[at + q >> 3] >> (7 - (at + q & 7)) & 1:
            q += 1
        p = at + q + 1
        low = int.from_bytes(raw[p >> 3 : (p >> 3) + 3], "big") >> (24 - (p & 7) - k) & (1 << k) - 1
        return q + 1 + k, q << k | low

    s = _stepwise(body, np.array(count), _RICE[0], np.array(ks) << 16, 16, slow)
    d = s >> 1 ^ -(s & 1)
    off = np.concatenate(([0], np.cumsum(sizes)))
    total = np.cumsum(d, dtype=np.uint8)
    total -= np.repeat(np.concatenate((np.zeros(1, dtype=np.uint8), total))[off[:-1]], sizes)
    return _cut(total, off)


def _huffman_encode(blobs: list[bytes]) -> list[bytes]:
    raw, off, size = _flat(blobs)
    if not len(raw):
        return [codecs.huffman_encode(b) for b in blobs]
    which = np.repeat(np.arange(len(blobs)) << 8, size) + raw
    hist = np.bincount(which, minlength=len(blobs) << 8).reshape(-1, 256)
    code, width, first, deep = np.zeros((len(blobs), 256), dtype=np.uint16), np.zeros((len(blobs), 256), dtype=np.uint8), [], []
    for i, h in enumerate(hist):
        used = np.flatnonzero(h)
        depth = codecs._lengths(dict(zip(used.tolist(), h[used].tolist())))
        head = bytearray(256)
        for s, (c, w) in codecs._canonical(depth).items():
            head[s] = w
            if w > 16:
                c = 0
                deep.append(i)
            code[i, s] = c
        width[i] = np.frombuffer(head, dtype=np.uint8)
        first.append(codecs._varint(len(blobs[i])) + bytes(head))
    begin, count, n = _blocks(off, size)
    wide = np.minimum(width, 16).ravel()[which]
    end, _, at = _places(wide, begin, count)
    packed = _pack(code.ravel()[which], wide.astype(np.int64), end, int(at[-1]))
    out = _bodies([b""] * len(begin), packed, at, n, first)
    for i in set(deep):  # codes over 16 bits
        out[i] = codecs.huffman_encode(blobs[i])
    return out


def _huffman_decode(blobs: list[bytes]) -> list[bytes]:
    body, count, sizes, of, tables, long = [], [], [], [], [], []
    for i, d in enumerate(blobs):
        n, at = codecs._unvarint(d, 0)
        sizes.append(n)
        codes = codecs._canonical({s: w for s, w in enumerate(d[at : at + 256]) if w})
        at += 256
        short = [(w << 8 | s, 1 << TABLE_BITS - w) for s, (_, w) in codes.items() if w <= TABLE_BITS]
        table = np.zeros(1 << TABLE_BITS, dtype=np.uint16)
        if short:
            full = np.repeat(*np.array(short).T)
            table[: len(full)] = full
        tables.append(table)
        long.append({(w, c): s for s, (c, w) in codes.items() if w > TABLE_BITS})
        for left in range(n, 0, -BLOCK):
            size, at = codecs._unvarint(d, at)
            body.append(d[at : at + size])
            at += size
            count.append(min(BLOCK, left))
            of.append(i)
    if not body:
        return [b""] * len(blobs)

    def slow(block, raw, at):
        codes, ahead = long[of[block]], int.from_bytes(raw[at >> 3 : (at >> 3) + 64], "big")
        for w in range(TABLE_BITS + 1, 257):
            if (s := codes.get((w, ahead >> 512 - (at & 7) - w & (1 << w) - 1))) is not None:
                return w, s
        raise ValueError("no such code")

    out = _stepwise(body, np.array(count), np.concatenate(tables).astype(np.int32), np.array(of) << TABLE_BITS, TABLE_BITS, slow)
    return _cut(out, np.concatenate(([0], np.cumsum(sizes))))


# --- rANS


def _slot_table(slots: dict[int, tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint32)
    out[list(slots)] = [start << 13 | width for start, width in slots.values()]
    return out


def _rans_encode(blobs: list[bytes]) -> list[bytes]:
    order = sorted((i for i, b in enumerate(blobs) if b), key=lambda i: -len(blobs[i]))
    out = [codecs._varint(0)] * len(blobs)
    if not order:
        return out
    raw, off, size = _flat([blobs[i] for i in order])
    heads, tables = [], []
    for i, a, n in zip(order, off.tolist(), size.tolist()):
        hist = np.bincount(raw[a : a + n])
        used = np.flatnonzero(hist)
        slots = codecs._slots(dict(zip(used.tolist(), hist[used].tolist())))
        tables.append(_slot_table(slots))
        heads.append(codecs._varint(n) + bytes([len(slots) - 1]) + b"".join([bytes([s]) + codecs._varint(w) for s, (_, w) in slots.items()]))
    table, base = np.concatenate(tables), np.arange(len(order)) << 8
    x, body, first = np.full(len(order), 1 << 23, dtype=np.uint32), np.empty(2 * len(raw) + 8 * len(order), dtype=np.uint8), 2 * off[:-1] + 8 * np.arange(len(order))
    to, ptr = first.copy(), off[1:].copy()
    active = len(size) - np.searchsorted(size[::-1], np.arange(int(size[min(FEW, len(size)) - 1]) if len(size) >= FEW else 0), side="right")
    for a in active.tolist():
        p = ptr[:a]
        p -= 1
        got, v, o = table[base[:a] + raw[p]], x[:a], to[:a]
        width, limit = got & np.uint32(8191), (got & np.uint32(8191)) << np.uint32(19)
        full = v >= limit
        while full.any():
            body[o] = v.astype(np.uint8)
            o += full
            v >>= full.astype(np.uint32) << np.uint32(3)
            full = v >= limit
        v += v // width * (np.uint32(4096) - width) + (got >> np.uint32(13))
    for k, i in enumerate(order):
        done, v = body[first[k] : to[k]].tobytes(), int(x[k])
        if left := int(ptr[k] - off[k]):
            more, v = codecs._rans_push(v, blobs[i][:left], [(w << 19, w, s) for s, w in zip((tables[k] >> 13).tolist(), (tables[k] & 8191).tolist())])
            done += more
        out[i] = heads[k] + v.to_bytes(4, "big") + done[::-1]
    return out


def _rans_decode(blobs: list[bytes]) -> list[bytes]:
    sizes = [codecs._unvarint(b, 0)[0] for b in blobs]
    order = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: -sizes[i])
    out = [b""] * len(blobs)
    if len(order) < FEW:
        for i in order:
            out[i] = codecs.rans_decode(blobs[i])
        return out
    tables, wheres, x, at = [], [], [], []
    for i in order:
        d = blobs[i]
        _, p = codecs._unvarint(d, 0)
        slots, start = {}, 0
        n, p = d[p] + 1, p + 1
        for _ in range(n):
            s = d[p]
            width, p = codecs._unvarint(d, p + 1)
            slots[s] = start, width
            start += width
        tables.append(_slot_table(slots))
        wheres.append(np.repeat(np.array(list(slots), dtype=np.uint8), [w for _, w in slots.values()]))
        x.append(int.from_bytes(d[p : p + 4], "big"))
        at.append(p + 4)
    raw, off, _ = _flat([blobs[i] for i in order])
    raw = np.concatenate((raw, np.zeros(1, dtype=np.uint8)))
    table, where, x, p, end = np.concatenate(tables), np.concatenate(wheres), np.array(x, dtype=np.uint32), off[:-1] + at, off[1:]
    size = np.array([sizes[i] for i in order])
    to = np.cumsum(size) - size
    made, base, base12 = np.empty(int(size.sum()), dtype=np.uint8), np.arange(len(order)) << 8, np.arange(len(order)) << 12
    steps = int(size[FEW - 1])
    active = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
    for t, a in enumerate(active.tolist()):
        v, q = x[:a], p[:a]
        slot = v & np.uint32(4095)
        sym = where[base12[:a] + slot]
        got = table[base[:a] + sym]
        made[to[:a] + t] = sym
        v >>= np.uint32(12)
        v *= got & np.uint32(8191)
        v += slot - (got >> np.uint32(13))
        low = (v < 1 << 23) & (q < end[:a])
        while low.any():
            np.copyto(v, v << np.uint32(8) | raw[q], where=low)
            q += low
            low = (v < 1 << 23) & (q < end[:a])
    for k, i in enumerate(order):
        n = min(sizes[i], steps)
        out[i] = made[to[k] : to[k] + n].tobytes()
        if n < sizes[i]:
            starts, widths, symbols = tables[k] >> 13, tables[k] & 8191, wheres[k]
            out[i] += codecs._rans_pull(int(x[k]), blobs[i], int(p[k] - off[k]), sizes[i] - n, list(zip(symbols.tolist(), starts[symbols].tolist(), widths[symbols].tolist())))
    return out


# --- matches

_LEAST, _PLACE = 5, 24


def _before(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """At each place, the last one before in its blob with the same 5 bytes, or -1."""
    key = np.zeros(max(0, len(raw) - _LEAST + 1), dtype=np.uint64)
    for k in range(_LEAST):
        key <<= np.uint64(8)
        key |= raw[k : len(key) + k]
    key <<= np.uint64(_PLACE)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    place = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int32)
    key >>= np.uint64(_PLACE)
    same = np.flatnonzero(key[1:] == key[:-1])
    here, before = place[same + 1], place[same]
    ok = (before >= begin[here]) & (here + _LEAST <= end[here])
    prev = np.full(len(raw), -1, dtype=np.int32)
    prev[here[ok]] = before[ok]
    return prev


def _match_rest(raw, prev, following, inside, places: list[int], ends: list[int]) -> tuple[np.ndarray, ...]:
    """What `_matches` finds from some places on, one after the other."""
    data, last, after, hidden = raw.tobytes() + bytes(64), memoryview(prev), memoryview(following), memoryview(inside.view(np.uint8))
    ones, place, until, back = b"\1" * 256, [], [], []
    for c, stop in zip(places, ends):
        while c < stop:
            j = last[c]
            while j >= 0 and hidden[j]:
                up = last[j]
                if up >= 0 and hidden[up]:
                    last[j] = up = last[up]
                j = up
            if j < 0:
                c = after[c + 1]
                continue
            p, q = j + _LEAST, c + _LEAST
            while (a := data[q : q + 16]) == (b := data[p : p + 16]) and q < stop:
                p += 16
                q += 16
            if x := int.from_bytes(a, "little") ^ int.from_bytes(b, "little"):
                q += (x & -x).bit_length() - 1 >> 3
            if q > stop:
                q = stop
            place.append(c)
            until.append(q)
            back.append(c - j)
            n = q - c - 1
            hidden[c + 1 : q] = ones[:n] if n <= 256 else b"\1" * n
            c = after[q]
    return np.array(place, dtype=np.int64), np.array(until, dtype=np.int64), np.array(back, dtype=np.int64)


def _matches(raw: np.ndarray, off: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, end, distance) of the matches in order, and which bytes they cover; each step takes a match of every blob."""
    n, known = len(raw), prev >= 0
    following = np.where(known, np.arange(n, dtype=np.int32), np.int32(n))
    following = np.append(np.minimum.accumulate(following[::-1])[::-1], np.int32(n))
    padded = np.concatenate((raw, np.zeros(16, dtype=np.uint8)))
    words = np.ndarray((n + 9,), dtype="<u8", buffer=padded, strides=(1,))
    inside, found = np.zeros(n, dtype=bool), []
    at, end = following[off[:-1]].astype(np.int64), off[1:]
    on = at < end
    c, stop = at[on], end[on]
    while len(c) > 2 * FEW:
        j = prev[c].astype(np.int64)
        hidden = np.flatnonzero(inside[j] & (j >= 0))
        while len(hidden):  # not looked at when it was passed; links over such places get shorter
            k = j[hidden]
            up = prev[k]
            skip = (up >= 0) & inside[up]
            up[skip] = prev[up[skip]]
            prev[k] = up
            j[hidden] = up
            hidden = hidden[(up >= 0) & inside[up]]
        hit = np.flatnonzero(j >= 0)
        q = c + 1
        if len(hit):
            cm, jm, last = c[hit], j[hit], stop[hit]
            size = np.full(len(hit), _LEAST)
            open_ = np.arange(len(hit))
            while len(open_):
                x = words[np.minimum(cm[open_] + size[open_], n)] ^ words[jm[open_] + size[open_]]
                low = x & (~x + np.uint64(1))
                size[open_] += np.where(x == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64) >> 3)
                open_ = open_[(x == 0) & (cm[open_] + size[open_] < last[open_])]
            qm = np.minimum(cm + size, last)
            q[hit] = qm
            found.append((cm, qm, cm - jm))
            more = qm - cm - 1
            ends = np.cumsum(more)
            inside[np.arange(ends[-1]) + np.repeat(cm + 1 - (ends - more), more)] = True
        c = following[q].astype(np.int64)
        on = c < stop
        c, stop = c[on], stop[on]
    if len(c):
        found.append(_match_rest(raw, prev, following, inside, c.tolist(), stop.tolist()))
    if not found:
        return *[np.zeros(0, dtype=np.int64)] * 3, inside
    place, until, back = map(np.concatenate, zip(*found))
    order = np.argsort(place)
    inside[place] = True
    return place[order], until[order], back[order], inside


def _width(v: np.ndarray) -> np.ndarray:
    out = np.ones(len(v), dtype=np.int64)
    for b in range(7, int(v.max(initial=0)).bit_length(), 7):
        out += v >> b > 0
    return out


def _put(out: np.ndarray, at: np.ndarray, v: np.ndarray, width: np.ndarray) -> None:
    for b in range(int(width.max(initial=0))):
        on = width > b
        out[at[on] + b] = v[on] >> 7 * b & 127 | (width[on] > b + 1) << 7


def _lz_encode(blobs: list[bytes]) -> list[bytes]:
    raw, off, size = _flat(blobs)
    if len(raw) >= 1 << _PLACE or len(raw) < 4 * _LEAST:
        return [codecs.lz_encode(b) for b in blobs]
    prev, a = np.full(len(raw), -1, dtype=np.int32), 0
    for b in (*np.searchsorted(off, np.arange(CHUNK // 2, len(raw), CHUNK // 2)).tolist(), len(blobs)):
        if off[b] > off[a]:
            here = _before(raw[off[a] : off[b]], np.repeat(off[a:b] - off[a], size[a:b]).astype(np.int32), np.repeat(off[a + 1 : b + 1] - off[a], size[a:b]).astype(np.int32))
            prev[off[a] : off[b]] = np.where(here >= 0, here + np.int32(off[a]), np.int32(-1))
            a = b
    place, until, back, covered = _matches(raw, off, prev)
    # a last run of literals, which no match follows, ends each blob
    n = np.searchsorted(place, off[1:])
    where = n + np.arange(len(blobs))
    is_match = np.ones(len(place) + len(blobs), dtype=bool)
    is_match[where] = False
    start, stop, dist = np.empty(len(is_match), dtype=np.int64), np.empty(len(is_match), dtype=np.int64), np.ones(len(is_match), dtype=np.int64)
    start[is_match], stop[is_match], dist[is_match] = place, until, back
    start[where] = stop[where] = off[1:]
    literals = start - np.concatenate(([0], stop[:-1]))
    w = [_width(literals), _width(stop - start), _width(dist)]
    w[1][where] = w[2][where] = 0
    whole = w[0] + literals + w[1] + w[2]
    to = np.cumsum(whole) - whole
    out = np.empty(int(whole.sum()), dtype=np.uint8)
    _put(out, to, literals, w[0])
    _put(out, to + w[0] + literals, stop - start, w[1])
    _put(out, to + w[0] + literals + w[1], dist, w[2])
    shift = to + w[0] - (np.cumsum(literals) - literals)
    out[np.arange(int(literals.sum())) + np.repeat(shift, literals)] = raw[~covered]
    bodies = _cut(out, np.append(np.concatenate(([0], (to + whole)[where[:-1]])), len(out)))
    return [codecs._varint(k) + b for k, b in zip(size.tolist(), bodies)]


#: By the codec's own pair of functions: the pair over lists of blobs.
PAIRS = {
    (codecs.rle_encode, codecs.rle_decode): (_by_chunk(_rle_encode), _by_chunk(_rle_decode)),
    (codecs.rice_encode, codecs.rice_decode): (_by_chunk(_rice_encode), _by_chunk(_rice_decode, 4 * CHUNK)),
    (codecs.huffman_encode, codecs.huffman_decode): (_by_chunk(_huffman_encode), _by_chunk(_huffman_decode, 4 * CHUNK)),
    (codecs.rans_encode, codecs.rans_decode): (_rans_encode, _rans_decode),
    (codecs.lz_encode, codecs.lz_decode): (_by_chunk(_lz_encode, 4 * CHUNK - 1), lambda blobs: [codecs.lz_decode(b) for b in blobs]),
}


def pair(codec):
    """A codec's functions over lists of blobs."""
    encode, decode = codec
    return PAIRS.get(codec) or (lambda blobs: [encode(b) for b in blobs], lambda blobs: [decode(b) for b in blobs])
