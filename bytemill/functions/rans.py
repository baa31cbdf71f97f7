"""rANS entropy coding of many byte strings side by side: each is a lane, all lanes take a step at once.

Order 0 has one frequency table a string; order 1 has one for each byte that comes before. Tables add up to
4096, the state stays at or above 2^23, and bytes leave and enter it eight bits at a time.
"""

from __future__ import annotations

import struct

import numpy as np

from bytemill.functions.codecs import CorruptData
from bytemill.functions.hashing import flat_view

SCALE_BITS = 12
SCALE = 1 << SCALE_BITS
FLOOR = 1 << 23
#: Strings up to this length are never tried with order 1.
ORDER1_FROM = 4096
#: Lanes up to which plain integers beat array steps, and bytes (tables counted in) that are worked on together.
FEW, BLOCK = 24, 1 << 23


def quantise(counts: np.ndarray) -> np.ndarray:
    """Rows of 256 counts to rows of frequencies that add up to SCALE; no seen symbol falls to 0."""
    counts = counts.astype(np.int64)
    total = counts.sum(1, keepdims=True)
    f = np.where(counts > 0, np.maximum(1, (counts * SCALE + total // 2) // np.maximum(total, 1)), 0)
    f[total[:, 0] == 0] = SCALE // 256
    off = SCALE - f.sum(1)
    while (todo := np.flatnonzero(off)).size:  # one at a time, always on the first of the largest
        top = f[todo].argmax(1)
        step = np.sign(off[todo])
        f[todo, top] += step
        off[todo] -= step
    return f


def _below(f: np.ndarray) -> np.ndarray:
    return np.cumsum(f, axis=-1) - f


class _Lanes:
    """Strings by falling length in one flat array, so that those still running are always the first."""

    def __init__(self, blobs: list[bytes]):
        self.order = sorted(range(len(blobs)), key=lambda k: -len(blobs[k]))
        self.blobs = [blobs[k] for k in self.order]
        self.flat, self.start, self.length = flat_view(self.blobs)

    def contexts(self) -> np.ndarray:
        """The byte before each; zero before the first."""
        out = np.zeros(len(self.flat), np.uint8)
        out[1:] = self.flat[:-1]
        out[self.start[self.length > 0]] = 0
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.blobs)), self.length)


def _running(length: np.ndarray, few: int) -> list[tuple[int, int, int]]:
    """(from, to, lanes) of the stretches of steps while more than ``few`` lanes run; lengths are falling."""
    out, at = [], 0
    if len(length) > few:
        for end in np.unique(np.minimum(length, length[few])).tolist():
            if end > at:
                out.append((at, end, int(np.searchsorted(-length, -at, side="left"))))
                at = end
    return out


def _push(lanes: _Lanes, freq: np.ndarray, row: np.ndarray) -> list[bytes]:
    """The coded bytes of every lane; row gives the table of each position of the flat array.

    All lanes take a step at once, from each one's last byte to its first. The long ones, while only FEW of them
    run, are coded one by one: that is the end of their strings, which comes first.
    """
    n = len(lanes.blobs)
    below = _below(freq)
    cell = row.astype(np.int64) * 256 + lanes.flat
    of, under = freq.ravel().astype(np.int64)[cell], below.ravel().astype(np.int64)[cell]
    stretches = _running(lanes.length, FEW)
    floor = stretches[-1][1] if stretches else 0
    state = np.full(n, FLOOR, np.int64)
    early = [b""] * n
    for k in range(n):
        if lanes.length[k] <= floor:
            break
        a, b = int(lanes.start[k]) + floor, int(lanes.start[k] + lanes.length[k])
        out, x = bytearray(), FLOOR
        for f, c in zip(of[a:b][::-1].tolist(), under[a:b][::-1].tolist(), strict=True):
            high = f << 19
            while x >= high:
                out.append(x & 255)
                x >>= 8
            q, r = divmod(x, f)
            x = (q << SCALE_BITS) + r + c
        early[k], state[k] = bytes(out), x
    room = 2 * np.minimum(lanes.length, floor) + 8
    base = np.cumsum(room) - room
    out, used = np.zeros(int(room.sum()), np.uint8), base.copy()
    for lo, hi, k in reversed(stretches):
        s, u, first = state[:k].copy(), used[:k].copy(), lanes.start[:k]
        for at in range(hi - 1, lo - 1, -1):
            pos = first + at
            f = of[pos]
            high = f << 19
            for _ in range(2):  # a state below 2^31 is brought under any bound of 2^19 and more in two steps
                over = s >= high
                if not over.any():
                    break
                out[u[over]] = s[over] & 255
                u += over
                s = np.where(over, s >> 8, s)
            q = s // f
            s = (q << SCALE_BITS) + (s - q * f) + under[pos]
        state[:k], used[:k] = s, u
    for shift in (0, 8, 16, 24):
        out[used] = state >> shift & 255
        used += 1
    raw = out.tobytes()
    return [e + raw[a:b] for e, a, b in zip(early, base.tolist(), used.tolist(), strict=True)]


def _pull(coded: list[bytes], sizes: list[int], freq: np.ndarray, row0: np.ndarray, chain: np.ndarray | None) -> list[bytes]:
    """Decode lanes; row0 is the first table of each lane, chain[lane, byte] the table after that byte."""
    order = np.argsort(-np.array(sizes, np.int64), kind="stable")
    size = np.array(sizes, np.int64)[order]
    n = len(order)
    flat, start, length = flat_view([coded[k] for k in order])
    flat = np.append(flat, np.uint8(0)).astype(np.int64)
    left = start + length
    state = np.zeros(n, np.int64)
    for _ in range(4):
        left -= 1
        state = state << 8 | flat[left]
    symbol_of = np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(freq)), freq.ravel())
    below = _below(freq)
    wide, low = freq.ravel(), below.ravel()
    table = row0[order].copy()
    own = chain[order] if chain is not None else None
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    stretches = _running(size, FEW)
    every = np.arange(n)
    for lo, hi, k in stretches:
        s, t, at_byte, first, lane, floor = state[:k].copy(), table[:k].copy(), left[:k].copy(), begin[:k], every[:k], start[:k]
        for at in range(lo, hi):
            slot = s & (SCALE - 1)
            symbol = symbol_of[(t << SCALE_BITS) + slot]
            out[first + at] = symbol
            cell = (t << 8) + symbol
            s = wide[cell] * (s >> SCALE_BITS) + slot - low[cell]
            for _ in range(2):
                under = (s < FLOOR) & (at_byte > floor)
                if not under.any():
                    break
                at_byte -= under
                s = np.where(under, s << 8 | flat[at_byte], s)
            if own is not None:
                t = own[lane, symbol]
                if t.min() < 0:  # allowed behind a lane's last byte only
                    if (t[size[:k] > at + 1] < 0).any():
                        raise CorruptData("context without a table")
                    t = np.maximum(t, 0)
        state[:k], table[:k], left[:k] = s, t, at_byte
    done = stretches[-1][1] if stretches else 0
    for k in range(n):
        if size[k] <= done:
            break
        x, t, at, floor = int(state[k]), int(table[k]), int(left[k]), int(start[k])
        raw, got = coded[order[k]], bytearray()
        next_ = own[k].tolist() if own is not None else None
        parts: dict[int, tuple] = {}
        for _ in range(int(size[k]) - done):
            if t not in parts:
                if t < 0:
                    raise CorruptData("context without a table")
                parts[t] = (symbol_of[t << SCALE_BITS : (t + 1) << SCALE_BITS].tobytes(), freq[t].tolist(), below[t].tolist())
            symbols, f, c = parts[t]
            slot = x & 4095
            symbol = symbols[slot]
            got.append(symbol)
            x = f[symbol] * (x >> SCALE_BITS) + slot - c[symbol]
            while x < FLOOR and at > floor:
                at -= 1
                x = x << 8 | raw[at - floor]
            if next_ is not None:
                t = next_[symbol]
        out[begin[k] + done : begin[k] + size[k]] = np.frombuffer(bytes(got), np.uint8)
    back, whole = [b""] * n, out.tobytes()
    for j, k in enumerate(order.tolist()):
        back[k] = whole[begin[j] : begin[j] + size[j]]
    return back


def _in_blocks(run, blobs: list, weight) -> list:
    """``run`` over runs of like length, with at most BLOCK of the summed weights at a time."""
    out: list = [None] * len(blobs)
    order = sorted(range(len(blobs)), key=lambda k: -len(blobs[k]))
    held, size = [], 0

    def put() -> None:
        for k, x in zip(held, run([blobs[k] for k in held]), strict=True):
            out[k] = x

    for k in order:
        held.append(k)
        size += weight(blobs[k])
        if size > BLOCK:
            put()
            held, size = [], 0
    if held:
        put()
    return out


def encode0_many(blobs: list[bytes]) -> list[bytes]:
    """size(4) frequencies(512) n(4) bytes; four zero bytes for the empty string."""

    def run(part: list[bytes]) -> list[bytes]:
        lanes = _Lanes(part)
        owner = lanes.owner()
        counts = np.bincount(owner * 256 + lanes.flat, minlength=256 * len(part)).reshape(-1, 256)
        freq = quantise(counts)
        coded = _push(lanes, freq, owner)
        back = [b""] * len(part)
        for j, k in enumerate(lanes.order):
            b = lanes.blobs[j]
            back[k] = struct.pack("<I", len(b)) + freq[j].astype("<u2").tobytes() + struct.pack("<I", len(coded[j])) + coded[j] if b else bytes(4)
        return back

    return _in_blocks(run, blobs, lambda b: len(b) + 4096)


def encode1_many(blobs: list[bytes]) -> list[bytes]:
    """size(4) tables(2), then for each context its byte and 512 bytes of frequencies, n(4) bytes."""

    def run(part: list[bytes]) -> list[bytes]:
        lanes = _Lanes(part)
        n = len(part)
        context = lanes.owner() * 256 + lanes.contexts()
        keys, times = np.unique(context * 256 + lanes.flat, return_counts=True)
        tables, row = np.unique(keys >> 8, return_inverse=True)
        counts = np.zeros((len(tables), 256), np.int64)
        counts[row, keys & 255] = times
        freq = quantise(counts)
        coded = _push(lanes, freq, np.searchsorted(tables, context))
        first = np.searchsorted(tables, np.arange(n + 1) * 256)
        back = [b""] * n
        for j, k in enumerate(lanes.order):
            own = range(first[j], first[j + 1])
            body = b"".join(bytes((int(tables[t]) & 255,)) + freq[t].astype("<u2").tobytes() for t in own)
            back[k] = struct.pack("<IH", len(lanes.blobs[j]), len(own)) + body + struct.pack("<I", len(coded[j])) + coded[j]
        return back

    return _in_blocks(run, blobs, lambda b: len(b) + 65536)


def _table(raw: bytes, at: int) -> np.ndarray:
    f = np.frombuffer(raw, "<u2", 256, at).astype(np.int64)
    if f.sum() != SCALE:
        raise CorruptData("frequencies do not add up")
    return f


def _tail(raw: bytes, at: int) -> bytes:
    if at + 4 > len(raw):
        raise CorruptData("header ends early")
    (n,) = struct.unpack_from("<I", raw, at)
    if n < 4 or at + 4 + n > len(raw):
        raise CorruptData("coded bytes end early")
    return raw[at + 4 : at + 4 + n]


def _claimed(raw: bytes) -> int:
    return struct.unpack_from("<I", raw)[0] if len(raw) >= 4 else 0


def decode0_many(raws: list[bytes]) -> list[bytes]:
    def run(part: list[bytes]) -> list[bytes]:
        sizes = [struct.unpack_from("<I", r)[0] if len(r) >= 4 else 0 for r in part]
        some = [k for k, n in enumerate(sizes) if n]
        if any(len(part[k]) < 520 for k in some):
            raise CorruptData("header ends early")
        back = [b""] * len(part)
        if some:
            freq = np.stack([_table(part[k], 4) for k in some])
            got = _pull([_tail(part[k], 516) for k in some], [sizes[k] for k in some], freq, np.arange(len(some)), None)
            for k, b in zip(some, got, strict=True):
                back[k] = b
        return back

    return _in_blocks(run, raws, lambda r: _claimed(r) + 4096)


def decode1_many(raws: list[bytes]) -> list[bytes]:
    def run(part: list[bytes]) -> list[bytes]:
        sizes, coded, tables = [], [], []
        chain = np.full((len(part), 256), -1, np.int64)
        for j, r in enumerate(part):
            if len(r) < 6:
                raise CorruptData("header ends early")
            size, n = struct.unpack_from("<IH", r)
            if n > 256 or len(r) < 6 + 513 * n:
                raise CorruptData("context tables end early")
            for t in range(n):
                at = 6 + 513 * t
                chain[j, r[at]] = len(tables)
                tables.append(_table(r, at + 1))
            sizes.append(size)
            coded.append(_tail(r, 6 + 513 * n))
        if not tables:
            raise CorruptData("no context table")
        if (chain[np.array(sizes) > 0, 0] < 0).any():
            raise CorruptData("context without a table")
        return _pull(coded, sizes, np.stack(tables), np.maximum(chain[:, 0], 0), chain)

    return _in_blocks(run, raws, lambda r: _claimed(r) + 10 * len(r))


def encode_many(blobs: list[bytes]) -> list[bytes]:
    """A flag and the shorter of the two orders; order 1 only for strings over ORDER1_FROM bytes."""
    best = [b"\x00" + x for x in encode0_many(blobs)]
    long = [k for k, b in enumerate(blobs) if len(b) > ORDER1_FROM]
    for k, x in zip(long, encode1_many([blobs[k] for k in long]), strict=True):
        if len(x) + 1 < len(best[k]):
            best[k] = b"\x01" + x
    return best


def decode_many(raws: list[bytes]) -> list[bytes]:
    out = [b""] * len(raws)
    for flag, run in ((0, decode0_many), (1, decode1_many)):
        own = [k for k, r in enumerate(raws) if r and (r[0] != 0) == bool(flag)]
        for k, b in zip(own, run([raws[k][1:] for k in own]), strict=True):
            out[k] = b
    return out
