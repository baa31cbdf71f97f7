"""Lossless byte codecs that work on whole arrays: bit packing, planes, cells, difference runs, codebooks."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from bytemill.functions.hashing import flat_view


class CorruptData(ValueError):
    """Bytes that no encoder wrote."""


def bits_needed(data: bytes) -> int:
    """1, 2, 4 or 6 bits a value where that saves space, else 8."""
    d = len(set(data))
    bits = next((b for most, b in ((2, 1), (4, 2), (16, 4), (64, 6)) if d <= most), 8)
    return bits if data and 6 + d + -(-len(data) * bits // 8) < len(data) else 8


def bitpack(data: bytes) -> bytes:
    bits = bits_needed(data)
    if bits == 8:
        return b"\x08" + data
    values, codes = np.unique(np.frombuffer(data, np.uint8), return_inverse=True)
    stream = codes[:, None] >> np.arange(bits) & 1
    packed = np.packbits(stream.astype(np.uint8).ravel(), bitorder="little")
    return struct.pack("<BIB", bits, len(data), len(values)) + values.tobytes() + packed.tobytes()


def bitunpack(data: bytes) -> bytes:
    if data[:1] == b"\x08":
        return data[1:]
    if len(data) < 6:
        return b""
    bits, n, distinct = struct.unpack_from("<BIB", data)
    if bits not in (1, 2, 4, 6):
        raise CorruptData(f"{bits} bits a value")
    if len(data) < 6 + distinct:
        return b""
    stream = np.unpackbits(np.frombuffer(data, np.uint8, offset=6 + distinct), bitorder="little")
    if len(stream) < n * bits:
        raise CorruptData("bit stream ends early")
    codes = stream[: n * bits].reshape(n, bits) @ (1 << np.arange(bits))
    table = np.zeros(256, np.uint8)
    table[:distinct] = np.frombuffer(data, np.uint8, distinct, 6)
    return table[codes].tobytes()


def shuffle(data: bytes, size: int) -> bytes:
    """Byte planes of elements of ``size`` bytes, one after the other; what is left over stays behind."""
    n = len(data) // size if size > 1 else 0
    if not n:
        return data
    return np.frombuffer(data, np.uint8, n * size).reshape(n, size).T.tobytes() + data[n * size :]


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size if size > 1 else 0
    if not n:
        return data
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]


def order0_entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def element_size_by_histogram(data: bytes) -> int:
    """Always 1: moving bytes about leaves their histogram, and with it this measure, as it was."""
    return 1


def element_size_by_planes(data: bytes, sample: int = 16384, gain: float = 0.5) -> int:
    """2, 4 or 8 where the mean entropy of the byte planes is lower by more than ``gain`` bits."""
    b = np.frombuffer(data[:sample], np.uint8)
    best, size = order0_entropy(np.bincount(b, minlength=256)) - gain, 1
    for s in (2, 4, 8):
        if len(b) >= 512 * s:  # fewer values a plane would look too regular
            mean = float(np.mean([order0_entropy(np.bincount(b[k::s], minlength=256)) for k in range(s)]))
            if mean < best:
                best, size = mean, s
    return size


def recommended(data: bytes, sample: int = 65536) -> int:
    """The stage mask of one content, by the rules that ``columns`` has for tables."""
    if not data:
        return 0xFF
    counts = np.bincount(np.frombuffer(data[:sample], np.uint8), minlength=256)
    entropy, distinct = order0_entropy(counts), int((counts > 0).sum())
    if (counts[32:127].sum() + counts[[9, 10, 13]].sum()) / counts.sum() > 0.90:
        mask = 0x3F
    elif entropy > 7.9 and distinct > 250:
        return 0x03
    else:
        mask = 0x33 if entropy > 7.5 else 0x7F
    return mask | 0x80 if distinct <= 16 else mask


@dataclass(frozen=True)
class Cells:
    cells: bytes
    count: int
    bits: int
    original_bits: int

    @property
    def density(self) -> float:
        stored = self.count * self.bits
        return self.original_bits / stored if stored else 0.0


def cell_pack(data: bytes, bits: int) -> Cells:
    if not 1 <= bits <= 16:
        raise ValueError(f"unsupported bits per cell: {bits}")
    total = 8 * len(data)
    if bits == 8:
        return Cells(data, len(data), 8, total)
    n = -(-total // bits)
    stream = np.zeros(n * bits, np.uint8)
    stream[:total] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    values = stream.reshape(n, bits) @ (1 << np.arange(bits))
    return Cells(values.astype("<u1" if bits < 8 else "<u2").tobytes(), n, bits, total)


def cell_unpack(block: Cells) -> bytes:
    if block.bits == 8:
        return block.cells[: block.original_bits // 8]
    values = np.frombuffer(block.cells, "<u1" if block.bits < 8 else "<u2")
    stream = (values[:, None] >> np.arange(block.bits) & 1).astype(np.uint8).ravel()[: block.original_bits]
    return np.packbits(stream, bitorder="little").tobytes()


def difference_runs(base: bytes, target: bytes) -> bytes:
    """Runs of at most 255 equal bytes as (n, 0), of others as (n, 1, differences); equal lengths."""
    diff = np.frombuffer(base, np.uint8) ^ np.frombuffer(target, np.uint8)
    same = diff == 0
    edges = np.concatenate([[0], np.flatnonzero(same[1:] != same[:-1]) + 1, [len(diff)]]) if len(diff) else [0]
    out = bytearray()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for at in range(a, b, 255):
            n = min(255, b - at)
            out += bytes((n, 0)) if same[a] else bytes((n, 1)) + diff[at : at + n].tobytes()
    return bytes(out)


def apply_runs(base: bytes, runs: bytes) -> bytes:
    out = np.frombuffer(base, np.uint8).copy()
    at, k = 0, 0
    while k + 1 < len(runs) and at < len(out):
        n, kind = runs[k], runs[k + 1]
        k += 2
        if kind:
            part = np.frombuffer(runs[k : k + n], np.uint8)[: len(out) - at]
            out[at : at + len(part)] ^= part
            k += n
        at += n
    return out.tobytes()


def pad(data: bytes, size: int) -> bytes:
    return data + bytes(size - len(data))


def delta_against(reference: bytes, target: bytes) -> bytes | None:
    """Difference runs of the padded pair, if the sizes lie within a tenth and a fifth is saved."""
    big, small = max(len(reference), len(target)), min(len(reference), len(target))
    if small * 10 < big * 9:
        return None
    runs = difference_runs(pad(reference, big), pad(target, big))
    return runs if len(runs) < len(target) * 4 // 5 else None


def delta_restore(reference: bytes, runs: bytes, original_size: int) -> bytes:
    return apply_runs(pad(reference, max(len(reference), original_size)), runs)[:original_size]


@dataclass
class Genome:
    """A codebook: pattern by code, and the byte that announces a code."""

    escape: int = 0
    patterns: dict[int, bytes] = field(default_factory=dict)

    def serialize(self) -> bytes:
        body = b"".join(bytes((len(p),)) + p + bytes((c,)) for c, p in self.patterns.items())
        return struct.pack("<BH", self.escape, len(self.patterns)) + body

    @classmethod
    def deserialize(cls, data: bytes) -> Genome:
        if len(data) < 3:
            return cls()
        escape, n = struct.unpack_from("<BH", data)
        if n > 256:
            raise CorruptData(f"{n} codebook entries")
        at, found = 3, {}
        for _ in range(n):
            size = data[at] if at < len(data) else 0
            if not 1 <= size <= 8 or at + size + 2 > len(data):
                raise CorruptData("codebook entry")
            found[data[at + size + 1]] = data[at + 1 : at + 1 + size]
            at += size + 2
        return cls(escape, found)


SAMPLED = 256 * 1024
MOST_PATTERNS = 255
#: Bytes whose patterns are counted together.
TOGETHER = 1 << 21


def least_frequent(data: bytes) -> int:
    return int(np.bincount(np.frombuffer(data, np.uint8), minlength=256).argmin())


def pattern_key(p: bytes) -> int:
    """A pattern as a number, its first byte the highest."""
    return int.from_bytes(p, "big")


def _counted(blobs: list[bytes], most: int):
    """(blob, length, pattern number, times) of strings of 3 to ``most`` bytes that a blob's first part holds four times or more.

    Only places whose shorter string is that frequent are looked at again, so the longer lengths cost little.
    """
    flat, starts, lengths = flat_view([b[:SAMPLED] for b in blobs])
    owner = np.repeat(np.arange(len(blobs)), lengths)
    end = np.repeat(starts + lengths, lengths)
    at, group = np.arange(len(flat)), owner * 256 + flat  # the string so far, as a number that is the same for equal ones
    key = flat.astype(np.uint64)
    for n in range(2, most + 1):
        inside = at + n <= end[at]
        at, group, key = at[inside], group[inside], key[inside]
        if not len(at):
            return
        more = flat[at + n - 1]
        key = key << np.uint64(8) | more
        whole = group << 8 | more
        order = np.argsort(whole)
        ranked = whole[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(ranked)))
        often = times >= 4
        if n > 2:
            own = order[first[often]]
            yield owner[at[own]], np.full(len(own), n), key[own], times[often]
        kept = np.repeat(often, times)
        order, group = order[kept], (np.cumsum(new) - 1)[kept]
        at, key = at[order], key[order]


def choose_patterns(blob: np.ndarray, size: np.ndarray, key: np.ndarray, times: np.ndarray) -> dict[int, list[bytes]]:
    """By blob, up to 255 patterns by what they save; ties: longer first, then by bytes."""
    left = key << (np.uint64(8) * (8 - size).astype(np.uint64))
    order = np.lexsort((left, -size, -(times * (size - 2)), blob))
    blob, size, key = blob[order], size[order], key[order]
    first = np.searchsorted(blob, blob)
    kept = np.arange(len(blob)) - first < MOST_PATTERNS
    out: dict[int, list[bytes]] = {}
    for b, n, k in zip(blob[kept].tolist(), size[kept].tolist(), key[kept].tolist(), strict=True):
        out.setdefault(b, []).append(k.to_bytes(n, "big"))
    return out


def build_genomes(blobs: list[bytes], most: int = 8) -> list[Genome]:
    """A codebook for each blob; none for blobs under four bytes."""
    out: list[Genome] = []
    held: list[bytes] = []

    def put() -> None:
        parts = list(_counted(held, most))
        found = choose_patterns(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else {}
        out.extend(Genome(least_frequent(b), dict(enumerate(found.get(k, [])))) if len(b) >= 4 else Genome() for k, b in enumerate(held))
        held.clear()

    size = 0
    for b in blobs:
        held.append(b)
        size += min(len(b), SAMPLED)
        if size > TOGETHER:
            put()
            size = 0
    put()
    return out


def build_genome(data: bytes) -> Genome:
    return build_genomes([data])[0]


@lru_cache(8)
def _searched(patterns: tuple[tuple[int, bytes], ...]) -> tuple[np.ndarray | None, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Which values of _mixed begin a pattern, None if some have under three bytes; and by falling length the sorted pattern numbers and their codes. Of equal patterns the last code counts."""
    by_size: dict[int, dict[int, int]] = {}
    for code, p in patterns:
        by_size.setdefault(len(p), {})[pattern_key(p)] = code
    begins = None
    if min(by_size, default=3) > 2:
        begins = np.zeros(1 << 16, bool)
        begins[_mixed(np.array([pattern_key(p[:3]) for _, p in patterns], np.uint32))] = True
    return begins, [(n, np.array(sorted(t), np.uint64), np.array([t[k] for k in sorted(t)], np.uint8)) for n, t in sorted(by_size.items(), reverse=True)]


def _mixed(three: np.ndarray) -> np.ndarray:
    """16 bits of three bytes."""
    return three * np.uint32(0x9E3779B1) >> np.uint32(16)


def pattern_encode(data: bytes, genome: Genome) -> bytes:
    """Longest pattern first from the left; the escape byte itself becomes escape, 255."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if not n:
        return data
    code, step = np.full(n, 255, np.uint8), np.zeros(n, np.uint8)
    begins, searched = _searched(tuple(genome.patterns.items()))
    window = np.frombuffer(data + bytes(7), np.uint8).astype(np.uint64)
    for k in (1, 2, 4):
        window = window[:-k] << np.uint64(8 * k) | window[k:]
    at = np.arange(n) if begins is None else np.flatnonzero(begins[_mixed((window >> np.uint64(40)).astype(np.uint32))])
    window = window[at]
    for size, known, codes in searched:
        own = window >> np.uint64(8 * (8 - size))
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = (known[place] == own) & (at + size <= n)
        step[at[hit]], code[at[hit]] = size, codes[place[hit]]
        at, window = at[~hit], window[~hit]
    hits = step > 0
    if hits.any():
        reached = _taken(np.flatnonzero(hits), step)
        lengths = step[reached].astype(np.int64)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, reached, 1)
        np.add.at(cover, reached + lengths, -1)
        inside = np.cumsum(cover[:n]) > 0
    else:
        reached, inside = np.zeros(0, np.int64), np.zeros(n, bool)
    special = ~inside & (b == genome.escape)
    special[reached] = True
    code[~inside] = 255
    keep = ~inside
    keep[reached] = True
    at = np.flatnonzero(keep)
    two = special[at]
    end = np.cumsum(1 + two)
    out = np.empty(int(end[-1]), np.uint8)
    out[end - 1] = np.where(two, code[at], b[at])
    out[end[two] - 2] = genome.escape
    return out.tobytes()


def _taken(hits: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The hits that are used: the first, then always the first that begins behind the one before."""
    ends = (hits + step[hits]).tolist()
    out, past = [], 0
    for k, at in enumerate(hits.tolist()):
        if at >= past:
            out.append(at)
            past = ends[k]
    return np.array(out, np.int64)


def _marks(b: np.ndarray, escape: int) -> np.ndarray:
    """Places of the escape bytes that announce a code: of escape bytes in a row, every other one is a code itself."""
    marks = np.flatnonzero(b == escape)
    if not len(marks):
        return marks
    run = np.append(True, np.diff(marks) > 1)
    begin = np.maximum.accumulate(np.where(run, np.arange(len(marks)), 0))
    return marks[(np.arange(len(marks)) - begin) % 2 == 0]


@lru_cache(8)
def _pool(escape: int, patterns: tuple[tuple[int, bytes], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each code stands for, one behind the other, with its start and size."""
    known = dict(patterns)
    table = [known.get(c, bytes((escape, c))) for c in range(256)]
    table[255] = bytes((escape,))
    return flat_view(table)


def pattern_decode(data: bytes, genome: Genome) -> bytes:
    """An escape byte and the one behind it stand for a pattern; unknown codes stay, a last escape byte alone goes."""
    b = np.frombuffer(data, np.uint8)
    marks = _marks(b, genome.escape)
    if not len(marks):
        return data
    pool, start, size = _pool(genome.escape, tuple(genome.patterns.items()))
    length, source = np.ones(len(b), np.int64), np.arange(len(b))
    whole = marks[marks + 1 < len(b)]
    length[marks] = 0
    codes = b[whole + 1]
    length[whole], source[whole] = size[codes], len(b) + start[codes]
    length[whole + 1] = 0
    at = np.repeat(source - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return np.concatenate([b, pool])[at].tobytes()


#: How a coded blob was made, in its first byte.
AS_IT_IS, SHARED, OWN, NARROW = range(4)
#: The byte values of UTF-8, all but 13 of them; BLOCK of them are a number that has four bytes less.
UTF8 = np.array([v for v in range(245) if v not in (0xC0, 0xC1)], np.uint8)
BLOCK = 512
_RANK = np.full(256, 255, np.uint8)
_RANK[UTF8] = np.arange(len(UTF8))


def own_genome(data: bytes) -> Genome:
    """The codebook of one blob, with the patterns that save more than their entry costs."""
    genome = build_genome(data)
    coded = np.frombuffer(pattern_encode(data, genome), np.uint8)
    marks = _marks(coded, genome.escape)
    used = np.bincount(coded[marks + 1], minlength=256)
    return Genome(genome.escape, {c: p for c, p in genome.patterns.items() if used[c] * (len(p) - 2) > len(p) + 2})


def narrow(data: bytes) -> bytes | None:
    """Bytes of UTF-8 as digits of numbers to base 243, which is shorter by two bytes at least from 500 bytes on; None for others.

    A block of 512 digits takes 508 bytes; a one in front of the digits of the last, shorter block keeps its zeros.
    """
    digits = _RANK[np.frombuffer(data, np.uint8)]
    if (digits == 255).any():
        return None
    out = []
    for lo in range(0, len(digits) + 1, BLOCK):
        some = digits[lo : lo + BLOCK].tolist()
        whole = len(some) == BLOCK
        number = 0 if whole else 1
        for d in some:
            number = number * len(UTF8) + d
        out.append(number.to_bytes(BLOCK - 4 if whole else -(-number.bit_length() // 8), "big"))
    return b"".join(out)


def widen(data: bytes) -> bytes:
    out = bytearray()
    for lo in range(0, len(data), BLOCK - 4):
        some = data[lo : lo + BLOCK - 4]
        last = lo + BLOCK - 4 >= len(data)
        number, digits = int.from_bytes(some, "big"), []
        while number > 1 if last else len(digits) < BLOCK:
            number, d = divmod(number, len(UTF8))
            digits.append(d)
        if number != last:
            raise CorruptData("block of digits")
        out += UTF8[digits[::-1]].tobytes()
    return bytes(out)


def shorten(data: bytes, genome: Genome) -> bytes:
    """By the shared codebook; by one of the blob's own, put in front, where that leaves no less than the blob; else narrow, or as it is."""
    if len(coded := pattern_encode(data, genome)) + 1 < len(data):
        return bytes((SHARED,)) + coded
    own = own_genome(data)
    coded = own.serialize() + pattern_encode(data, own)
    if own.patterns and len(coded) + 1 < len(data):
        return bytes((OWN,)) + coded
    coded = narrow(data)
    return bytes((NARROW,)) + coded if coded is not None and len(coded) + 1 < len(data) else bytes((AS_IT_IS,)) + data


def restore(data: bytes, genome: Genome) -> bytes:
    kind, rest = data[:1], data[1:]
    if kind == bytes((SHARED,)):
        return pattern_decode(rest, genome)
    if kind == bytes((OWN,)):
        own = Genome.deserialize(rest)
        return pattern_decode(rest[len(own.serialize()) :], own)
    if kind == bytes((NARROW,)):
        return widen(rest)
    if kind != bytes((AS_IT_IS,)):
        raise CorruptData(f"kind {kind.hex()} of coded blob")
    return rest
