"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every text. Expectation-maximisation estimates each
one's accuracies (the chances of its votes given the unseen quality) from the counts of vote patterns
over all documents, of which there are at most three to the number of heuristics. The posterior
probability of good quality then labels a sample of about ``SAMPLE`` documents (two times as many at
most), drawn by the hash of id and text, on which a linear scorer over hashed byte trigrams and hashed
heuristics is fitted. Every document is scored; one is kept from ``KEEP_FROM`` on.

Defined cases: a null text is empty, all heuristics abstain on it and it has score and posterior 0; a
table in which no votes differ falls back to the prior; a null id hashes as the word null; repeated rows
score alike and are drawn once; patterns that cast as many votes either way start as good, and the order
of rows never matters; very long texts are measured whole and counted in blocks; an empty table gives an
empty result; clashing columns are replaced.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.llm.langid import DIMS, _batches, counts
from bytemill.llm.quality_rules import STOP_WORDS
from bytemill.llm.rows import drawn

SAMPLE = 3000
KEEP_FROM = 0.4
ABSTAIN = 2
EXTRA = 512

_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS = b"#*$%&|<>{}[]\\^~_="
_FOLD = np.full(256, 32, np.uint32)
_FOLD[33:] = np.arange(33, 256)
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[ord("A") : ord("Z") + 1] = ord("A")


def measures(text: bytes) -> tuple[float, ...]:
    """Words, words equal to the one before, symbols a word, upper case, stop words, distinct words, repeated lines, plain words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 8
    letters = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    kept = len(text.translate(None, _SYMBOLS))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    plain = sum(w.rstrip(".,;:?").isalpha() for w in text.decode().split())
    stops = sum(map(_STOPS.__contains__, words))
    return (float(n), sum(map(eq, words, words[1:])) / n, (len(text) - kept) / n, upper / letters, stops / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines), plain / n)


def votes(m: tuple[float, ...]) -> tuple[int, ...]:
    """1 good, 0 bad, ABSTAIN; the heuristics overlap, and none is right alone."""
    n, doubled, symbols, upper, stops, distinct, lines, plain = m

    def vote(bad: bool, good: bool) -> int:
        return 0 if bad else 1 if good else ABSTAIN

    return (
        vote(n >= 20 and doubled > 0.2, False), vote(symbols > 0.15, False), vote(n >= 5 and upper > 0.35, False),
        vote(n >= 20 and stops < 0.06, n >= 5 and stops > 0.12 and distinct > 0.25), vote(n >= 20 and distinct < 0.25, False),
        vote(n >= 20 and lines > 0.55, False), vote(n >= 5 and plain < 0.6, n >= 5 and plain > 0.9 and distinct > 0.25),
    )


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of good quality by vote pattern; a heuristic has its own rate of either vote in either class."""
    keys = sorted(patterns)
    v, n = np.array(keys).reshape(len(keys), -1), np.array([patterns[k] for k in keys], float)
    good = np.array([0.05 if sum(x == 0 for x in k) > sum(x == 1 for x in k) else 0.95 for k in keys])
    for _ in range(rounds):
        prior = min(0.95, max(0.05, (n @ good + 1) / (n.sum() + 2)))
        odds = np.full(len(keys), np.log(prior / (1 - prior)))
        for j in range(v.shape[1]):
            for vote, same, other in ((0, 1 - good, good), (1, good, 1 - good)):
                cast = v[:, j] == vote
                rate = [(n * cast @ share + 0.5) / (n @ share + 1) for share in (same, other)]
                odds += (2 * vote - 1) * max(0.0, np.log(rate[0] / rate[1])) * cast  # never worse than a coin
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(keys, good.tolist(), strict=True))


def _vectors(texts: pa.Array):
    """(first row, vectors, measures) per run of texts: trigrams of length one, then hashed heuristics."""
    for k, flat, starts in _batches(texts):
        tf = np.sqrt(counts(flat, starts, _FOLD))
        tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-9)
        x = np.zeros((len(tf), DIMS + EXTRA), np.float32)
        x[:, :DIMS] = tf
        raw = flat.tobytes()
        found = [measures(raw[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for row, m in enumerate(found):
            for j, value in enumerate(m):
                level = min(15, int(np.log2(value + 1)) if j == 0 else int(value * 10))
                x[row, DIMS + (j * 16 + level) * 2654435761 % EXTRA] += 0.5
        yield k, x, found


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes weighing alike; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    mass = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - 2.0 * ((mass * (p - y)).astype(np.float32) @ x + decay * w)
        w = (w + speed).astype(np.float32)
    return w


def score(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Adds posterior, score and kept; other columns stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")

    def tally(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0):
                k = "".join(map(str, votes(measures(t.as_py()))))
                seen[k] = seen.get(k, 0) + 1
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select(text.alias("t")).mapInArrow(tally, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 3^7 rows at most
    posterior = estimate({tuple(map(int, r["k"])): r["n"] for r in rows}) if rows else {}
    share = min(1.0, sample / max(1, sum(r["n"] for r in rows)))

    def pick(batches):
        for batch in batches:
            for k, x, found in _vectors(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"u": batch.column(1)[k : k + len(x)], "x": pa.array([v.tobytes() for v in x], pa.binary()), "y": pa.array([posterior.get(votes(m), 0.5) for m in found])})

    few = drawn(docs.select("doc_id", "text"), "quality", F.lit(share)).select(text.alias("t"), "_u")
    few = few.mapInArrow(pick, "u double, x binary, y double").orderBy("u").limit(2 * sample).collect()
    few = sorted(few, key=lambda r: r["x"])
    some = np.frombuffer(b"".join(r["x"] for r in few), np.float32).reshape(-1, DIMS + EXTRA)
    weights = fit_linear(some, np.array([r["y"] for r in few])) if few else np.zeros(DIMS + EXTRA + 1)

    @F.arrow_udf("struct<p: double, s: double>")
    def rate(texts: pa.Array) -> pa.Array:
        p, s = np.zeros(len(texts)), np.zeros(len(texts))
        for k, x, found in _vectors(texts):
            some = np.array([m[0] > 0 for m in found])
            p[k : k + len(x)] = np.array([posterior.get(votes(m), 0.5) for m in found]) * some
            s[k : k + len(x)] = some / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        return pa.StructArray.from_arrays([pa.array(p), pa.array(s)], names=["p", "s"])

    out = docs.drop("posterior", "score", "kept").withColumn("_r", rate(text))
    out = out.withColumns({"posterior": F.col("_r.p"), "score": F.col("_r.s")})
    return out.withColumn("kept", F.col("score") >= KEEP_FROM).drop("_r")
