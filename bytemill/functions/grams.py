"""Counted strings of bytes: windows of blobs, dealt into buckets by their first bytes, and merged by bucket.

A window is the string of ``most`` bytes from a place on, or what the blob still has, as a number of eight bytes:
its first byte the highest, zeros behind. Every shorter string begins exactly one window, so windows are all that
is counted and moved; the strings are read off the merged windows of a bucket, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Places of blobs that a task gathers before it hands their windows on, 8 bytes each.
GATHERED = 1 << 23
#: Places of a blob that are looked at together.
PIECE = 1 << 20
#: Buckets of the strings from four bytes on, and of the shorter ones behind those.
BUCKETS, FEW = 1024, 16
#: Counted windows of a bucket that wait to be merged.
WAITING = 1 << 20
#: Rows that go back to Spark together.
ROWS = 1 << 16
#: The shortest string whose bucket depends on four bytes.
LONG = 4

Counted = tuple[np.ndarray, np.ndarray]


def _mask(n: int) -> np.uint64:
    """Keeps the first n bytes of a window."""
    return np.uint64((1 << 64) - (1 << 8 * (8 - n)))


def windows(values: pa.Array, most: int) -> Iterator[Counted]:
    """Pieces (window, bytes that it has) of every place of binary values; nulls have none."""
    values = values.drop_null().cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    if offsets[0] == offsets[-1]:
        return
    flat = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    for lo in range(0, len(flat), PIECE):
        n = min(PIECE, len(flat) - lo)
        b = np.zeros(n + most - 1, np.uint64)
        some = flat[lo : lo + len(b)]
        b[: len(some)] = some
        key = b[:n].copy()
        for k in range(1, most):
            key <<= np.uint64(8)
            key |= b[k : k + n]
        key <<= np.uint64(8 * (8 - most))
        size = np.full(n, most, np.uint8)
        near = slice(*np.searchsorted(ends, [lo + 1, lo + n + most]))  # blobs that end where a window of the piece may
        for s in range(1, most):
            at = ends[near] - s
            at = at[(at >= begins[near]) & (at >= lo) & (at < lo + n)] - lo
            size[at] = s
            key[at] &= _mask(s)
        yield key, size


def counted(keys: np.ndarray) -> Counted:
    """Distinct keys in order, with their numbers; sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)


def _summed(keys: np.ndarray, times: np.ndarray) -> Counted:
    """Equal neighbours as one."""
    if not len(keys):
        return keys, times
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times, first, dtype=times.dtype)


def merged(parts: list[Counted]) -> Counted:
    parts = [p for p in parts if len(p[0])]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    return _summed(keys[order], times[order])


def _cut(some: Counted, n: int) -> Counted:
    return _summed(some[0] & _mask(n), some[1])


def _families(least: int, most: int) -> list[tuple[int, int, int, int]]:
    """(longest, shortest, buckets, first bucket): strings that share a bucket have equal first bytes, as many as the shortest has."""
    short = [(min(most, LONG - 1), 2, FEW, BUCKETS)] if least < LONG else []
    return short + ([(most, LONG, BUCKETS, 0)] if most >= LONG else [])


def _packed(parts: list[Counted]) -> tuple[int, bytes]:
    """Numbers of windows by size, then all windows and times, each byte of them apart; and the bytes of that before it is compressed."""
    keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    head = np.array([len(k) for k, _ in parts], np.int64)
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T) for a in (keys, times.astype(np.uint32, copy=False))]
    raw = b"".join(a.tobytes() for a in (head, *planes))
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: int, block: bytes, sizes: int) -> list[Counted]:
    b = np.frombuffer(pa.decompress(block, raw, codec="zstd"), np.uint8)
    n = b[: 8 * sizes].view(np.int64)
    planes, total = b[8 * sizes :], int(n.sum())
    keys = np.ascontiguousarray(planes[: 8 * total].reshape(8, -1).T).view(np.uint64).ravel()
    times = np.ascontiguousarray(planes[8 * total :].reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
    cuts = np.cumsum(n)[:-1]
    return list(zip(np.split(keys, cuts), np.split(times, cuts), strict=True))


def deal(batches, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, block): the counted windows of batches with one binary column."""
    held, used = np.empty(GATHERED + PIECE, np.uint64), 0
    tails: dict[int, list] = {s: [] for s in range(2, most)}
    waiting = 0

    def flush():
        nonlocal tails
        by_size = {s: counted(np.concatenate(t)) for s, t in tails.items() if t} | {most: counted(held[:used])}
        tails = {s: [] for s in tails}
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        for longest, shortest, buckets, base in _families(least, most):
            dealt = []
            for s in range(shortest, longest + 1):
                some = by_size.get(s, none)
                if s == longest < most:
                    some = merged([_cut(x, s) for size, x in by_size.items() if size >= s])
                bucket = ((some[0] & _mask(shortest)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16) % np.uint16(buckets)
                order = np.argsort(bucket, kind="stable")
                dealt.append((some[0][order], some[1][order], np.searchsorted(bucket[order], np.arange(buckets + 1))))
            rows = []
            for b in range(buckets):
                parts = [(keys[at[b] : at[b + 1]], times[at[b] : at[b + 1]]) for keys, times, at in dealt]
                if any(len(k) for k, _ in parts):
                    rows.append((base + b, *_packed(parts)))
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256], strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "raw", "block"])

    for batch in batches:
        for key, size in windows(batch.column(0), most):
            whole = key[size == most]
            held[used : used + len(whole)] = whole
            used += len(whole)
            if len(whole) < len(key):
                for s, some in tails.items():
                    if len(part := key[size == s]):
                        some.append(part)
                        waiting += len(part)
            if used + waiting > GATHERED:
                yield from flush()
                used = waiting = 0
    yield from flush()


def best(parts: list[tuple[int, Counted]], k: int) -> list[tuple[int, Counted]]:
    """Of (size, strings) the k strings that save most, if seen four times and longer than two; ties: longer first, then by bytes."""
    parts = [(s, keys[times >= 4], times[times >= 4]) for s, (keys, times) in parts if s > 2]
    if not parts:
        return []
    size = np.repeat([s for s, _, _ in parts], [len(x) for _, x, _ in parts])
    keys, times = np.concatenate([x for _, x, _ in parts]), np.concatenate([t for _, _, t in parts])
    saved = times * (size - 2)
    if len(saved) > k:
        near = np.flatnonzero(saved >= np.partition(saved, -k)[-k])
        near = near[np.lexsort((keys[near], -size[near], -saved[near]))[:k]]
        size, keys, times = size[near], keys[near], times[near]
    return [(int(s), (keys[size == s], times[size == s])) for s in np.unique(size)]


def count(batches, least: int, most: int, k: int | None = None) -> Iterator[pa.RecordBatch]:
    """(pattern, n, freq) from rows (bucket, raw, block) in order of bucket; with ``k`` only the best k strings of each bucket."""
    families = {base: (longest, shortest) for longest, shortest, _, base in _families(least, most)}
    now, held, waiting = None, [], 0

    def out():
        longest, shortest = families[BUCKETS if now >= BUCKETS else 0]
        carry, found = merged([]), []
        for s, parts in zip(range(longest, shortest - 1, -1), reversed(held), strict=True):
            carry = merged([_cut(carry, s), *parts])
            if s >= least:
                found.append((s, carry))
        for n, (keys, times) in found if k is None else best(found, k):
            for lo in range(0, len(keys), ROWS):
                some = keys[lo : lo + ROWS]
                raw = some.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :n].copy()
                pattern = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(some), [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pattern, pa.array(np.full(len(some), n, np.int32)), pa.array(times[lo : lo + ROWS])], ["pattern", "n", "freq"])

    for batch in batches:
        for bucket, raw, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                if now is not None:
                    yield from out()
                longest, shortest = families[BUCKETS if bucket >= BUCKETS else 0]
                now, held, waiting = bucket, [[] for _ in range(shortest, longest + 1)], 0
            for mine, part in zip(held, _unpacked(raw, block, len(held)), strict=True):
                mine.append(part)
                waiting += len(part[0])
            if waiting > WAITING:
                held = [[merged(parts)] for parts in held]
                waiting = -sum(len(p[0]) for parts in held for p in parts)  # as many again may come before the next merge
    if now is not None:
        yield from out()
