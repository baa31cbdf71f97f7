"""Language identification by nearest centroid.

A text becomes a vector of ``DIMS`` hashed byte trigrams over lower-cased letters (all else counts as a
blank), weighted by the square root of the count times the inverse document frequency, of length one.
Document frequencies cover every training row; several centroids per language come from spherical
k-means over a sample of about ``SAMPLE`` labelled rows, drawn by the hash of id and text. The
prediction is the language of the centroid with the largest cosine, and the score is that cosine. A
text is rejected if its cosine is below ``SLACK`` times the ``QUANTILE`` of the cosines of all training
rows of its length (by powers of two of the trigrams; lengths with fewer than ``POOL`` rows take the
shorter ones in, whose cosines are lower, and texts shorter than all training rows are not rejected).

Defined cases: a null text and a text without a letter get ``und`` and score 0 and are rejected; a tie
goes to the first language by name; with no labelled row every text is ``und``; a null id is held out as
the empty string is, and drawn by its text; rows that repeat are predicted alike and drawn once; only the
``LANGUAGES`` most frequent languages are learned; very long texts are counted in blocks; an empty table
gives an empty result; columns that clash with the result's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytemill.llm.rows import drawn
from bytemill.llm.text import whole

DIMS = 4096
#: Rows that the centroids are fitted on, about, and two times as many at most; languages that are learned at most.
SAMPLE, LANGUAGES = 2400, 1000
CENTROIDS = 3
QUANTILE = 0.001
SLACK = 0.75
POOL = 500
GRADES = 32
STEPS = 1000
BLOCK = 1 << 21

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def counts(flat: np.ndarray, starts: np.ndarray, fold: np.ndarray = _FOLD) -> np.ndarray:
    """Trigram counts per text; text k is flat[starts[k]:starts[k + 1]]."""
    n = len(starts) - 1
    out = np.zeros((n, DIMS), np.float32)
    for lo in range(0, len(flat), BLOCK):
        hi = min(len(flat), lo + BLOCK)
        b = np.full(hi - lo + 2, 32, np.uint32)  # with the bytes before and behind
        b[1 - (lo > 0) : hi - lo + 1 + (hi < len(flat))] = fold[flat[max(0, lo - 1) : hi + 1]]
        mid = b[1:-1]
        at = np.flatnonzero(mid != 32)
        doc = np.searchsorted(starts, at + lo, side="right") - 1
        before = np.where(at + lo > starts[doc], b[at], 32)
        behind = np.where(at + lo + 1 < starts[doc + 1], b[at + 2], 32)
        key = ((before | mid[at] << 8 | behind << 16).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
        if len(doc):
            first, last = doc[0], doc[-1]
            out[first : last + 1] += np.bincount((doc - first) * DIMS + key, minlength=(last - first + 1) * DIMS).reshape(-1, DIMS)
    return out


def _batches(texts: pa.Array):
    """(first row, bytes, starts) of runs of texts, about BLOCK bytes each."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(texts):
        end = min(k + 128, max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, side="right")) - 1), len(texts))
        yield k, data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
        k = end


def _weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(tf) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0)


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; no random numbers."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _grade(tf: np.ndarray) -> np.ndarray:
    """Power of two of the number of trigrams."""
    return np.log2(np.maximum(tf.sum(1), 1)).astype(np.int64).clip(0, GRADES - 1)


def _least(seen: np.ndarray) -> np.ndarray:
    """Smallest cosine that is not rejected, by grade; seen holds rows by grade and step of the cosine."""
    least = np.zeros(GRADES)
    for g in range(GRADES):
        low = g
        while low and seen[low : g + 1].sum() < POOL:
            low -= 1
        upto = seen[low : g + 1].sum(0).cumsum()
        if upto[-1]:
            least[g] = SLACK * np.searchsorted(upto, max(1, QUANTILE * upto[-1])) / STEPS
    return least


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """From columns doc_id, text and lang; rows without a language take no part."""
    rows = labelled.filter("lang is not null").select("doc_id", "text", "lang")
    per = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    per = {r["lang"]: r["count"] for r in per}
    most = max(20, sample // max(1, len(per)))

    def frequencies(batches):
        seen = np.zeros(DIMS, np.int64)
        for batch in batches:
            for _, flat, starts in _batches(batch.column(0)):
                seen += (counts(flat, starts) > 0).sum(0)
        yield pa.RecordBatch.from_pydict({"f": pa.array(np.arange(DIMS, dtype=np.int32)), "n": pa.array(seen)})

    df = np.zeros(DIMS)
    for r in rows.select("text").mapInArrow(frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # DIMS rows
        df[r["f"]] = r["n"]
    idf = (np.log((1 + rows.count()) / (1 + df)) + 0.05).astype(np.float32)

    def vectors(batches):
        for batch in batches:
            for k, flat, starts in _batches(batch.column(0)):
                tf = counts(flat, starts)
                some = slice(k, k + len(tf))
                yield pa.RecordBatch.from_pydict({"lang": batch.column(1)[some], "u": batch.column(2)[some], "tf": pa.array([x.astype(np.float32).tobytes() for x in tf], pa.binary())})

    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, most / n)) for k, n in per.items()], "lang string, share double")
    some = drawn(rows.join(F.broadcast(shares), "lang"), "langid", F.col("share")).select("text", "lang", "_u")
    first = some.mapInArrow(vectors, "lang string, u double, tf binary").orderBy("u").limit(2 * max(sample, 20 * len(per)))
    of: dict[str, list] = {}
    for r in sorted(first.collect(), key=lambda r: (r["lang"], r["tf"])):
        of.setdefault(r["lang"], []).append(np.frombuffer(r["tf"], np.float32))
    names, found = [], []
    for lang, tfs in sorted(of.items()):
        x = _weigh(np.stack(tfs), idf)
        if len(x := x[np.linalg.norm(x, axis=1) > 0]):
            c = _cluster(x, centroids)
            names += [lang] * len(c)
            found.append(c)
    centers = np.concatenate(found).astype(np.float32) if found else np.zeros((0, DIMS), np.float32)

    def cosines(batches):
        seen = np.zeros((GRADES, STEPS), np.int64)
        for batch in batches:
            for _, flat, starts in _batches(batch.column(0)):
                tf = counts(flat, starts)
                step = ((_weigh(tf, idf) @ centers.T).max(1) * STEPS).astype(np.int64).clip(0, STEPS - 1)
                some = tf.any(1)
                np.add.at(seen, (_grade(tf)[some], step[some]), 1)
        grade, step = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({"grade": pa.array(grade.astype(np.int32)), "step": pa.array(step.astype(np.int32)), "n": pa.array(seen[grade, step])})

    seen = np.zeros((GRADES, STEPS), np.int64)
    if names:
        for r in rows.select("text").mapInArrow(cosines, "grade int, step int, n long").groupBy("grade", "step").agg(F.sum("n").alias("n")).collect():  # GRADES * STEPS rows
            seen[r["grade"], r["step"]] = r["n"]
    return Model(idf, names, centers, _least(seen))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and rejected; other columns stay, clashing ones are replaced."""
    idf, langs, centroids, least = model.idf, np.array(model.langs or ["und"]), model.centroids, model.least
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("far", pa.bool_())])

    @F.arrow_udf("struct<lang: string, score: double, far: boolean>")
    def nearest(texts: pa.Array) -> pa.Array:
        best, score, far = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for k, flat, starts in _batches(texts):
            if len(centroids):
                tf = counts(flat, starts)
                cos = _weigh(tf, idf) @ centroids.T
                best[k : k + len(cos)], score[k : k + len(cos)], far[k : k + len(cos)] = cos.argmax(1), cos.max(1), cos.max(1) < least[_grade(tf)]
        return pa.StructArray.from_arrays([pa.array(langs[best], pa.string()), pa.array(score.clip(0, 1)), pa.array(far)], fields=list(kind))

    lettered = F.col("text").isNotNull() & whole(F.col("text")).rlike(r"\p{L}") & F.lit(bool(model.langs))
    out = docs.drop("lang_pred", "score", "rejected").withColumn("_p", nearest(whole(F.col("text"))))
    out = out.withColumns({"lang_pred": F.when(lettered, F.col("_p.lang")).otherwise("und"), "score": F.when(lettered, F.col("_p.score")).otherwise(0.0)})
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | F.col("_p.far")).drop("_p")
