"""Best-fit packing of tokenised documents into sequences.

Lengths are at most the capacity, so the exact histogram of lengths has at most ``capacity`` rows; the
driver packs the histogram, not the documents. Large-item matching: lengths over a third of the
capacity pair greedily, longest first, each with the longest that still fits; shorter ones then go,
longest first, to the smallest gap that takes them. Equal bins stay one entry of the plan, so its size
depends on the capacity and not on the data. A piece finds its place by its rank among the pieces of
its length: ranks within hash buckets of ids plus the counts of the buckets before, so a length that
a third of all rows share is spread over all buckets.

Defined cases: a null text is empty and becomes the end id alone; equal rows are interchangeable and
each gets a place; an empty table gives no sequences; a null id is a bucket like any other; a very long
text becomes as many pieces as it needs; other columns of the input are left behind.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytemill.plans.scratch import stage

CAPACITY = 2048
END_ID = 0
#: Bytes of words and their ids that a worker keeps, in two halves by age, and what a word costs beside.
REMEMBERED, WORD_COST = 128 << 20, 160
#: Texts and pieces that a worker holds as objects at a time, in bytes.
HELD = 4 << 20
#: A word of lower-case ASCII letters and those of U+00C0 to U+00FF, and the ASCII signs behind it.
PLAIN = re.compile(rb"(?=.{1,80}\Z)((?:[a-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)([!-/:-@\[-`{-~]*)").fullmatch
BUCKET_ROWS = 100_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, by way of its words.

    The vocabulary's rules never join what ASCII white space separates, so a text's ids are those of
    its words in a row, and each distinct one is encoded once. The rules compose before they
    lower the case, and an ASCII letter only ever composes with U+0300 to U+0338, so in a text without these
    words that differ in the case of ASCII letters alone have the same ids and are learned once. A text that
    holds the start of a special token is encoded as a whole.

    Most words are plain: letters of Latin-1, then ASCII signs or nothing. Nothing in them composes, and the rules
    part them where the signs begin, so the ids are those of the letters, which the tokenizer's model gets
    as the rules would spell them, and those of the signs, which are a word like any other. What else there
    is, and what is long, is normalised, parted and encoded by the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older, self.held = Tokenizer.from_file(path), {}, {}, 0
        self.model, table = self.tokenizer.model, list(map(chr, range(256)))
        for k in {*range(0x80, 0xC0)} - {0x97, 0xB7}:  # U+00D7 and U+00F7 are no letters
            letter = self.tokenizer.normalizer.normalize_str(bytes([0xC3, k]).decode())
            table[0xC3], table[k] = self.tokenizer.pre_tokenizer.pre_tokenize_str(letter)[0][0]
        self.spelled = "".join(table)
        self.bytes_of = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    @classmethod
    @cache
    def at(cls, path: str) -> Encoder:
        """The worker's own, which serves all partitions that the worker gets."""
        return cls(path)

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:
            return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        if b"\xcc" not in text:  # the first byte of U+0300 to U+033F
            text = text.lower()
        words = text.split()
        ids = list(map(self.known.get, words))
        if None in ids:
            missing = set(compress(words, map(is_, ids, repeat(None))))
            if self.held > REMEMBERED // 2:  # words that come again move over from the older half, all others go
                self.older, self.known, self.held, missing = self.known, {}, 0, set(words)
            self.learn(missing)
            ids = map(self.known.__getitem__, words)
        return b"".join(ids)

    def learn(self, new: set[bytes]) -> None:
        known, older = self.known, self.older
        again = {w: older[w] for w in new & older.keys()}
        known |= again
        todo, all_signs = list(new - again.keys()), set()
        for lo in range(0, len(todo), 4096):
            plain, other = [], []
            for w in todo[lo : lo + 4096]:
                if m := PLAIN(w):
                    plain.append((w, *m.groups()))
                else:
                    other.append(w)
            signs = {tail for _, _, tail in plain if tail and tail not in known}
            other += signs
            all_signs |= signs
            made = self.tokenizer.encode_batch_fast(list(map(bytes.decode, other)), add_special_tokens=False)
            known.update(zip(other, [array("I", e.ids).tobytes() for e in made], strict=True))
            for w, stem, tail in plain:
                ids = known.get(stem) or older.get(stem) or self.ids_of(stem)
                known[w] = ids + known[tail] if tail else ids
        for words in (new, all_signs - new):
            self.held += sum(map(len, words)) * 3 + WORD_COST * len(words)  # about half a token a byte

    def ids_of(self, stem: bytes) -> bytes:
        letters = stem.decode("latin-1")
        if not letters.isascii():
            letters = letters.translate(self.spelled)
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(letters)])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; with ``keep_ids`` the ids themselves too (binary)."""

    def cut(batches):
        encoder = Encoder.at(tokenizer)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]

        def made(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or b"") + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else ())))
                held += len(ids) if keep_ids else 100
                if held > HELD:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    text = F.col("text").cast("string").cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(cut, SCHEMA + ", ids binary" * keep_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces go: rows (length, first rank, pieces per bin, first sequence, offset), sorted.

    The piece of a length with rank r in a row's range, j = r - first rank, goes to sequence
    first + j // per_bin, at offset + (j % per_bin) * length.
    """
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    gaps: list[int] = []  # distinct, ascending
    by_gap: dict[int, list[tuple[int, list]]] = {}  # gap -> (bins, [(length, rank, per bin, offset)])

    def put(gap: int, bins: int, items: list) -> None:
        if bins:
            if gap not in by_gap:
                insort(gaps, gap)
            by_gap.setdefault(gap, []).append((bins, items))

    def take(length: int, n: int) -> int:
        used[length] += n
        left[length] -= n
        return used[length] - n

    def part(items: list, skip: int) -> list:
        return [(size, rank + skip * per, per, off) for size, rank, per, off in items]

    large = sorted(x for x in left if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, min(a, capacity - a) + 1) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == a else 1):
                k -= 1
            if k < 0:
                n = left[a]
                put(capacity - a, n, [(a, take(a, n), 1, 0)])
            elif (b := large[k]) == a:
                n = left[a] // 2
                put(capacity - 2 * a, n, [(a, take(a, 2 * n), 2, 0)])
            else:
                n = min(left[a], left[b])
                put(capacity - a - b, n, [(a, take(a, n), 1, 0), (b, take(b, n), 1, a)])
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while n := left[s]:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                put(capacity, -(-n // (capacity // s)), [])
                continue
            gap = gaps[k]
            bins, items = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[k]
            per = gap // s
            full, more = min(bins, n // per), 0
            if full:
                put(gap - per * s, full, [*items, (s, take(s, full * per), per, capacity - gap)])
            if full < bins and (more := left[s] if left[s] < per else 0):
                put(gap - more * s, 1, [*part(items, full), (s, take(s, more), more, capacity - gap)])
            put(gap, bins - full - bool(more), part(items, full + bool(more)))
    rows, sequence = [], 0
    for gap in gaps:
        for bins, items in by_gap[gap]:
            rows += [(size, rank, per, sequence, off) for size, rank, per, off in items]
            sequence += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "per", "sequence", "offset"), table.T, strict=True))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.searchsorted((table["length"] << 44) | table["rank"], (length << 44) | rank, side="right") - 1
    j = rank - table["rank"][k]
    per = table["per"][k]
    return table["sequence"][k] + j // per, table["offset"][k] + j % per * length


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``, which must be a stored table."""
    n = cut.count()
    buckets = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = stage(dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    table = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_rank", inside).join(ahead.hint("merge"), (F.col("_bucket") == F.col("_b")) & (F.col("length") == F.col("_l")))

    @F.arrow_udf("struct<s: long, o: long>")
    def spot(length: pa.Array, rank: pa.Array) -> pa.Array:
        s, o = place(table, length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(s), pa.array(o)], names=["s", "o"])

    out = ranked.withColumn("_p", spot(F.col("length"), (F.col("_ahead") + F.col("_rank")).cast("long")))
    return out.withColumns({"sequence_id": F.col("_p.s"), "offset": F.col("_p.o")}).drop("_p", "_rank", "_ahead", "_bucket", "_b", "_l")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; texts are encoded once, as the pieces are written to the shared folder."""
    return pack(stage(pieces(docs, tokenizer, capacity, keep_ids), "pieces"), capacity)
