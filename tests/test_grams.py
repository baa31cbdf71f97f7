"""Counted strings against brute force, and what a task holds while it counts them."""

import random
import tracemalloc
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from bytemill.functions import grams as G
from bytemill.operators import analysis as A
from bytemill.operators import coding


def rows(batches):
    return [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def found(blobs, least, most, k=None):
    """What three tasks hand on, put in order of bucket and counted."""
    dealt = []
    for i in range(3):
        mine = blobs[i::3]
        dealt += rows(G.deal((pa.RecordBatch.from_arrays([pa.array(mine[j : j + 7], pa.binary())], ["content"]) for j in range(0, len(mine), 7)), least, most))
    dealt.sort(key=lambda r: r[0])
    types = (pa.int32(), pa.int32(), pa.binary())
    if not dealt:
        return []
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*dealt[j : j + 50], strict=True), types, strict=True)], ["bucket", "raw", "block"]) for j in range(0, len(dealt), 50)]
    return rows(G.count(iter(batches), least, most, k))


@pytest.mark.parametrize("seed", range(20))
def test_counts_equal_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    for name, sizes in (("GATHERED", (50, 300, 1 << 20)), ("PIECE", (1, 3, 16, 100)), ("WAITING", (5, 1000)), ("ROWS", (3, 1000))):
        monkeypatch.setattr(G, name, rng.choice(sizes))
    letters = rng.choice([b"ab", bytes(range(256)), b"\0\xff", b"abc \0"])
    blobs = [None if rng.random() < 0.1 else bytes(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 5, 8, 9, 40, 200]))) for _ in range(30)]
    least = rng.randint(2, 8)
    most = rng.randint(least, 8)
    want = Counter((b[p : p + n], n) for b in blobs if b for n in range(least, most + 1) for p in range(len(b) - n + 1))
    got = found(blobs, least, most)
    assert len(got) == len(want) and {(p, n): f for p, n, f in got} == want
    by_savings = lambda r: (-r[2] * (r[1] - 2), -r[1], r[0])
    top = sorted(((p, n, f) for (p, n), f in want.items() if f >= 4 and n > 2), key=by_savings)
    for k in (1, 5, 255):
        assert sorted(found(blobs, least, most, k), key=by_savings)[:k] == top[:k]


def test_shorter_than_a_window():
    assert sorted(found([b"ab", b"", None, b"ab", b"c"], 2, 8)) == [(b"ab", 2, 2)]
    assert found([b"", None], 2, 8) == []


def test_long_batch_is_not_held_as_strings(spark):
    """One Arrow batch of 4 MB: strings of seven lengths would be 28 million numbers."""
    text = np.random.default_rng(1).integers(97, 123, 4_000_000, np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([text[k : k + 2000] for k in range(0, len(text), 2000)])], ["content"])
    df = MagicMock()
    A.ngrams(df)
    run = df.select.return_value.mapInArrow.call_args.args[0]
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
    finally:
        tracemalloc.stop()


def patterned(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(300)]
    return spark.createDataFrame([(k, " ".join(rng.choices(words, k=60)).encode()) for k in range(40)] + [(40, None), (41, b"")], "blob_id long, content binary")


def test_few_strings_leave_a_bucket(spark):
    df = patterned(spark)
    few = A.ngrams(df, 3, 8, 5)
    assert few.count() <= 5 * (G.BUCKETS + G.FEW) < A.ngrams(df, 3, 8).count()
    assert A.best_patterns(few, 5).collect() == A.best_patterns(A.ngrams(df, 3, 8), 5).collect()


def test_genome_takes_few_strings(spark, monkeypatch):
    """The codebook of c5 to c8 equals the one from all strings, and few of them come out of their buckets."""
    df, best, seen = patterned(spark), A.best_patterns, []
    every = A.ngrams(df, 3, 8)
    monkeypatch.setattr(A, "best_patterns", lambda grams, *k: seen.append(grams.count()) or best(grams, *k))
    genome = coding.corpus_genome(df)
    assert seen[0] < every.count()
    assert list(genome.patterns.values()) == [bytes(r["pattern"]) for r in best(every).orderBy("code").collect()]
    assert genome.escape == 0 and len(genome.patterns) == 255
