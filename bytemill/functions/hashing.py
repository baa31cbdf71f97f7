"""Checksums and rolling hashes over many byte strings at once."""

from __future__ import annotations

import numpy as np

# The 64-bit FNV-1a parameters and the variations of the 128-bit form.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
FNV_HIGH_SEED = FNV_OFFSET ^ 0x6C62272E07BB0142
FNV_HIGH_PRIME = 0x10001000020
_M64 = (1 << 64) - 1
#: Lanes below which plain integers beat array steps.
FEW = 12


def flat_view(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in one array, with each blob's start and length."""
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    starts = np.cumsum(lengths) - lengths
    return np.frombuffer(b"".join(blobs), np.uint8), starts, lengths


def fnv_many(blobs: list[bytes], seed: int = FNV_OFFSET, prime: int = FNV_PRIME) -> np.ndarray:
    """FNV-1a of every blob; all lanes advance one byte a step, the longest first."""
    flat, starts, lengths = flat_view(blobs)
    order = np.argsort(-lengths, kind="stable")
    start, length = starts[order], lengths[order]
    h = np.full(len(blobs), seed, np.uint64)
    mult = np.uint64(prime)
    at, n = 0, len(blobs)
    while n > FEW:
        n = int(np.searchsorted(-length, -at, side="left"))  # lanes longer than ``at``
        if n <= FEW:
            break
        h[:n] = (h[:n] ^ flat[start[:n] + at]) * mult
        at += 1
    for k in range(n):
        x = int(h[k])
        for b in blobs[order[k]][at:]:
            x = (x ^ b) * prime & _M64
        h[k] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv64_hex(blobs: list[bytes]) -> list[str]:
    return [f"{x:016x}" for x in fnv_many(blobs).tolist()]


def fnv128_hex(blobs: list[bytes]) -> list[str]:
    """High half first, so that the order of the strings is the order of the hashes."""
    high = fnv_many(blobs, FNV_HIGH_SEED, FNV_HIGH_PRIME).tolist()
    return [f"{a:016x}{b:016x}" for a, b in zip(high, fnv_many(blobs).tolist(), strict=True)]


def similarity_sample(blob: bytes) -> bytes:
    """Every fourth byte of the first 128 and, beyond 256 bytes, of 64 from the middle."""
    middle = blob[len(blob) // 2 :][:64:4] if len(blob) > 256 else b""
    return blob[:128:4] + middle


def similarity_hex(blobs: list[bytes]) -> list[str]:
    return fnv64_hex([similarity_sample(b) for b in blobs])


def rolling_table() -> np.ndarray:
    """256 values of a linear congruential generator modulo 2^32."""
    out, x = np.empty(256, np.uint32), 0x12345678
    for k in range(256):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out[k] = x
    return out
