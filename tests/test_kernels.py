"""Byte kernels against fixed values, against step-by-step definitions, and over round trips."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytemill.functions import archive, chunkcodec, chunker, codecs, hashing, lz, rans

PANGRAM = b"The quick brown fox jumps over the lazy dog. "


def mt(seed: int, n: int) -> list[int]:
    g = np.random.MT19937()
    g._legacy_seeding(seed)
    return g.random_raw(n).tolist()


def fixtures() -> dict[str, bytes]:
    ctx = []
    for i in range(8000):
        ctx.append(97 + (i // 100) % 10 if i % 2 == 0 else ctx[-1] + 1)
    far = bytes((11 * i + 3) & 255 for i in range(100))
    return {
        "empty": b"", "one": b"\x2a", "hello": b"Hello, World!", "text": PANGRAM * 20, "zeros": bytes(100_000),
        "random": bytes(x & 255 for x in mt(42, 1000)), "long": bytes((3 * i + 7) & 255 for i in range(200)) * 10,
        "far": far + bytes(x & 255 for x in mt(99, 8192)) + far, "context": bytes(ctx),
        "four": bytes(x % 16 for x in mt(33, 1000)), "two": bytes((0, 10, 200, 255)[x % 4] for x in mt(44, 1000)), "binary": bytes(x % 2 for x in mt(22, 1000)),
        "six": bytes(x % 60 for x in mt(5, 3000)), "noise": bytes(x & 255 for x in mt(12345, 50_000)), "struct": b"".join(struct.pack("<HBB", i, 0, 255) for i in range(5000)),
        "blocks": bytes((17 * i + 5) & 255 for i in range(4096)) * 50, "patterns": b"ABCDEFGHxx" * 100, "escape": bytes(range(256)) * 3,
    }


FIXTURES = fixtures()


def test_generator_matches_the_standard():
    assert mt(5489, 10_000)[-1] == 4123659995


def test_golden_hashes():
    assert zlib.crc32(b"Hello, World!") == 0xEC4AC3D0
    assert hashing.fnv64_hex([b"", b"hi"]) == ["cbf29ce484222325", "08ba5f07b55ec3da"]
    assert hashing.fnv128_hex([b"", b"hi"]) == ["a790bbca83992267cbf29ce484222325", "4e67db91cd88312008ba5f07b55ec3da"]
    assert hashing.fnv128_hex([bytes([1, 2, 3, 4, 5]), bytes([1, 2, 3, 4, 6])]) == ["85101b69d12190a00f66dcbf4f6b7d88", "85101c69d22190c00f66dfbf4f6b82a1"]
    assert hashing.rolling_table()[:3].tolist() == [0x75432777, 0xCD305E6A, 0x25DBFAC1]


def test_high_half_depends_on_the_last_twelve_bytes_only():
    a, b = b"A" * 20 + b"same twelve!", b"B" * 33 + b"same twelve!"
    high = [h[:16] for h in hashing.fnv128_hex([a, b])]
    assert high[0] == high[1] and int(high[0], 16) % 32 == 0


@given(st.lists(st.binary(max_size=80), max_size=40))
@settings(max_examples=40, deadline=None)
def test_lanes_equal_one_by_one(blobs):
    def one(b):
        h = hashing.FNV_OFFSET
        for x in b:
            h = (h ^ x) * hashing.FNV_PRIME % 2**64
        return h

    assert hashing.fnv_many(blobs).tolist() == [one(b) for b in blobs]


def scalar_cuts(d: bytes, cfg: chunker.ChunkerConfig) -> list[int]:
    t, out, pos = hashing.rolling_table().tolist(), [], 0
    while pos < len(d):
        left = len(d) - pos
        if left <= cfg.smallest:
            out.append(left)
            break
        h = 0
        for w in range(32):
            if pos + cfg.smallest + w < len(d):
                h ^= t[d[pos + cfg.smallest + w]] << (31 - w) & 0xFFFFFFFF
        limit = min(left, cfg.largest)
        n = limit
        for i in range(cfg.smallest, limit):
            if not h & cfg.mask:
                n = i
                break
            h ^= t[d[pos + i]] << 31 & 0xFFFFFFFF
            h = (h << 1 | h >> 31) & 0xFFFFFFFF
            if pos + i + 32 < len(d):
                h ^= t[d[pos + i + 32]]
        out.append(n)
        pos += n
    return out


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 1056, 16383, 16384, 16385, 60_000])
@pytest.mark.parametrize("cfg", [chunker.ChunkerConfig(), chunker.ChunkerConfig(512, 1024, 2048)])
def test_cuts_equal_the_recurrence(n, cfg):
    d = random.Random(n).randbytes(n)
    assert chunker.cuts(d, cfg) == scalar_cuts(d, cfg)
    text = (PANGRAM * (n // 45 + 1))[:n]
    assert chunker.cuts(text, cfg) == scalar_cuts(text, cfg)


def test_cuts_come_back_after_an_insertion():
    d = random.Random(8).randbytes(200_000)
    ends = lambda x: set(np.cumsum(chunker.cuts(x)).tolist())
    moved = ends(d[:50] + b"!" + d[50:])
    assert sum(chunker.cuts(d)) == len(d) and all(1024 <= c <= 16384 for c in chunker.cuts(d)[:-1])
    assert {e + 1 for e in ends(d)} & moved  # the end at least


@pytest.mark.parametrize("piece", [1, 37, 1500, 5000])
def test_incremental_cuts_equal_whole(piece):
    d, held, out = random.Random(3).randbytes(40_000), b"", []
    for k in range(0, len(d), piece):
        held += d[k : k + piece]
        while held and (n := chunker.next_cut(np.frombuffer(held, np.uint8), chunker.ChunkerConfig(), False)) is not None:
            out.append(n)
            held = held[n:]
    assert out + chunker.cuts(held) == chunker.cuts(d)


@pytest.mark.parametrize("name", FIXTURES)
def test_round_trips(name):
    d = FIXTURES[name]
    assert codecs.bitunpack(codecs.bitpack(d)) == d
    for size in (1, 2, 4, 8):
        assert codecs.unshuffle(codecs.shuffle(d, size), size) == d
    for bits in (1, 3, 4, 7, 8, 9, 12, 16):
        assert codecs.cell_unpack(codecs.cell_pack(d[:3000], bits)) == d[:3000]
    genome = codecs.build_genome(d)
    assert codecs.Genome.deserialize(genome.serialize()) == genome
    assert codecs.pattern_decode(codecs.pattern_encode(d, genome), genome) == d
    assert lz.decompress(lz.compress(d)) == d == lz.decompress(lz.compress(d, lazy=False))
    assert rans.decode0_many(rans.encode0_many([d])) == [d]
    assert rans.decode_many(rans.encode_many([d])) == [d]
    if d:
        assert rans.decode1_many(rans.encode1_many([d])) == [d]
    for stages in (0xFF, 0x3F, 0x7F, 0x33, 0x03):
        assert archive.decompress(archive.compress(d, stages).to_bytes()) == d


@given(st.binary(max_size=400), st.integers(1, 256))
@settings(max_examples=60, deadline=None)
def test_any_bytes_round_trip(d, alphabet):
    d = bytes(x % alphabet for x in d) * 3
    assert codecs.bitunpack(codecs.bitpack(d)) == d
    assert lz.decompress(lz.compress(d)) == d
    assert rans.decode_many(rans.encode_many([d, d[:7]])) == [d, d[:7]]
    genome = codecs.build_genome(d)
    assert chunkcodec.decode_chunks(chunkcodec.encode_chunks([d], [0xFF], [genome]), [0xFF], [genome]) == [d]


OTHER = codecs.build_genome(PANGRAM * 20)


@pytest.mark.parametrize("name", list(FIXTURES))
def test_shortened_comes_back(name):
    d = FIXTURES[name]
    coded = codecs.shorten(d, OTHER)
    assert codecs.restore(coded, OTHER) == d and len(coded) <= len(d) + 1


def test_kinds_of_shortening():
    rng = random.Random(8)
    noise = "".join(rng.choices([chr(k) for k in range(33, 127)], k=3000)).encode()
    kinds = ((PANGRAM * 12, codecs.SHARED), (b"Su " * 200, codecs.OWN), (noise[:500], codecs.NARROW), (noise, codecs.NARROW), (FIXTURES["noise"], codecs.AS_IT_IS), (b"", codecs.AS_IT_IS))
    for d, kind in kinds:
        coded = codecs.shorten(d, OTHER)
        assert coded[0] == kind and codecs.restore(coded, OTHER) == d
    assert len(codecs.shorten(b"Su " * 200, OTHER)) < 200
    assert len(codecs.UTF8) == 243 and not {0xC0, 0xC1, *range(0xF5, 256)} & {*codecs.UTF8.tolist()}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=1200), st.integers(0, 1200))
def test_texts_are_shortened(some, more):
    d = some.encode() + bytes(random.Random(more).choices(range(33, 127), k=more))
    wide = codecs.narrow(d)
    assert codecs.widen(wide) == d and (len(d) < 500 or len(wide) + 1 < len(d))
    coded = codecs.shorten(d, OTHER)
    assert codecs.restore(coded, OTHER) == d and (len(d) < 500 or len(coded) < len(d))


def test_lengths_of_narrow_texts():
    """The byte value with the highest digit, at every length about the ends of blocks."""
    for n in (*range(20), *range(495, 520), *range(1020, 1030), 4096):
        for v in (0, 0xF4):
            narrow = codecs.narrow(bytes((v,)) * n)
            assert codecs.widen(narrow) == bytes((v,)) * n and (n < 500 or len(narrow) + 1 < n)
    assert codecs.narrow(b"\xff" * 500) is None


def test_sizes():
    assert [len(codecs.bitpack(FIXTURES[k])) for k in ("four", "two", "binary", "random")] == [522, 260, 133, 1001]
    assert [codecs.bits_needed(FIXTURES[k]) for k in ("four", "two", "binary", "six", "random", "empty")] == [4, 2, 1, 6, 8, 8]
    assert len(lz.compress(FIXTURES["text"])) < 900 and len(lz.compress(FIXTURES["long"])) < 1000
    assert len(lz.compress(FIXTURES["far"])) < 8392 + 8392 // 8 + 6
    assert rans.encode_many([b"hello world"])[0][0] == 0 and rans.encode_many([FIXTURES["context"] * 5])[0][0] == 1
    assert any(len(p) > 4 for p in codecs.build_genome(FIXTURES["patterns"]).patterns.values())
    assert len(archive.compress(b"", 0xFF).to_bytes()) == 44


def published() -> dict[str, tuple[bytes, float]]:
    """Inputs and the ratios that are published for them, which have three digits."""
    text = (PANGRAM + b"Pack my box with five dozen liquor jugs. ") * 100
    draws = iter(mt(999, 3 * 5000))
    floats = b"".join(bytes((0x3F, 0x80 + next(draws) % 10, next(draws) % 100, next(draws) % 200)) for _ in range(5000))
    return {
        "text": (text, 0.309), "zeros": (bytes(100_000), 0.01), "blocks": (FIXTURES["blocks"], 0.121), "structured": (FIXTURES["struct"], 0.722),
        "floats": (floats, 0.946), "four bits": (bytes(x % 16 for x in mt(777, 20_000)), 0.579), "random": (FIXTURES["noise"], 1.01),
    }


@pytest.mark.parametrize("name", ["text", "zeros", "blocks", "structured", "floats", "four bits", "random"])
def test_published_ratios(name):
    d, most = published()[name]
    ratio = len(archive.compress(d, codecs.recommended(d)).to_bytes()) / len(d)
    print(name, len(d), codecs.recommended(d), ratio)
    assert ratio < most + 0.0005  # as rounded


def test_quantised_frequencies_add_up():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 1000, (50, 256)) * (rng.random((50, 256)) < rng.random((50, 1)))
    counts[:, 7] += 1
    counts[0] = 0
    f = rans.quantise(counts)
    assert (f.sum(1) == 4096).all() and ((f[1:] > 0) == (counts[1:] > 0)).all() and (f[0] == 16).all()


def test_element_size_detectors_differ():
    floats = b"".join(bytes((0x3F, 0x80 + x % 20, x >> 8 & 255, x >> 16 & 255)) for x in mt(55, 1000))
    assert codecs.element_size_by_histogram(floats) == 1 and codecs.element_size_by_planes(floats) in (2, 4, 8)
    assert codecs.element_size_by_planes(FIXTURES["random"]) == 1


def test_cells():
    block = codecs.cell_pack(b"\x01\x02\x03\xff", 4)
    assert block.cells == bytes([1, 0, 2, 0, 3, 0, 15, 15]) and block.count == 8 and block.density == 1.0
    assert codecs.cell_pack(b"", 4).density == 0.0
    for bits in (0, 17):
        with pytest.raises(ValueError):
            codecs.cell_pack(b"x", bits)


@pytest.mark.parametrize(("a", "b"), [(5000, 5000), (5000, 5250), (5000, 4750), (5000, 4250), (63, 63), (70, 70)])
def test_deltas(a, b):
    ref = random.Random(1).randbytes(a)
    target = (ref + random.Random(2).randbytes(b))[:b]
    target = target[:10] + b"#" + target[11:]
    runs = codecs.delta_against(ref, target)
    assert (runs is None) == (min(a, b) * 10 < max(a, b) * 9)
    if runs is not None:
        assert codecs.delta_restore(ref, runs, b) == target
    assert codecs.apply_runs(ref, codecs.difference_runs(ref, bytes(a))) == bytes(a)


def test_older_lz_form_and_distances():
    assert lz.decompress(struct.pack("<I", 9) + bytes([0b00001000]) + b"abc" + bytes([3, 0x30])) == b"abcabcabc"
    base = random.Random(4).randbytes(65535)
    assert lz.decompress(lz.compress(base + base[:50])) == base + base[:50]


def test_broken_bytes_are_reported():
    raw = archive.compress(PANGRAM * 100, 0x3F).to_bytes()
    for k in range(len(raw)):
        with pytest.raises(codecs.CorruptData):
            archive.decompress(raw[:k])
    rng = random.Random(6)
    for _ in range(200):
        x = bytearray(raw)
        x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
        try:
            assert archive.decompress(bytes(x)) == PANGRAM * 100
        except codecs.CorruptData:
            pass
    for bad in (b"XELL" + raw[4:], raw[:4] + b"\x03\x00" + raw[6:]):
        with pytest.raises(codecs.CorruptData):
            archive.Archive.header(bad)
    with pytest.raises(archive.ChecksumMismatch):
        archive.decompress(raw[:-1] + bytes([raw[-1] ^ 1]))
    with pytest.raises(codecs.CorruptData):
        codecs.Genome.deserialize(struct.pack("<BH", 0, 300) + bytes(900))
    for bad in (b"\x05" + bytes(20), struct.pack("<BIB", 4, 100, 2) + b"abc"):
        with pytest.raises(codecs.CorruptData):
            codecs.bitunpack(bad)
    for bad in (struct.pack("<IB", 10, 2) + b"\x01\x09\x00\x00", struct.pack("<IB", 10, 2) + b"\x00ab"):
        with pytest.raises(codecs.CorruptData):
            lz.decompress(bad)
    for run, bad in ((rans.decode0_many, struct.pack("<I", 5) + bytes(516)), (rans.decode1_many, struct.pack("<IH", 5, 900)), (rans.decode1_many, b"ab")):
        with pytest.raises(codecs.CorruptData):
            run([bad])


def test_error_codes():
    assert [archive.error_code(e) for e in (archive.ChecksumMismatch(), codecs.CorruptData(), OSError(), KeyError())] == [-4, -3, -2, -7]
