"""Language-model scoring by prediction by partial matching.

A trie of byte contexts up to ``ORDER`` bytes is counted over all training texts (ASCII lower-cased,
begun by ORDER marks and closed by one). A symbol that a context has seen gets count / (total +
distinct); otherwise the escape distinct / (total + distinct) leads to the next shorter context, in
which all symbols of the longer ones are excluded, and at last to the bytes never seen at all. Contexts of
up to ``DENSE`` bytes have a row of log10 probabilities for every symbol; longer ones hold the symbols that
they have seen and two factors for all others, one for those that the next shorter context has seen and
one for the rest, so most bytes of a text cost one look-up.

The counts are broadcast and the trie is built once a worker while its size stays within ``CELLS``. Beyond
that, the counts of the most frequent contexts, as many as fit, are broadcast and score all windows that begin
with one of them where the text is read. Only the other windows move: they are dealt into buckets by their nearest
bytes, each task builds the trie of its own bucket, and a bucket that has many windows is dealt to several tasks,
at ``ROWS`` or so each, its counts going to each of those. Results are equal. The word model beside it keeps its
``TOP`` most frequent words in a broadcast table and joins all rarer ones with the counted vocabulary.

Defined cases: a null text is empty and scores its end alone; with no training rows every byte is
equally likely and every word unknown; a null id hashes as the empty string; repeated rows score
alike; very long texts are cut into blocks of windows; an empty table gives an empty result; other columns are
left behind, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytemill.llm.langid import _batches, held_out
from bytemill.plans.scratch import finish, forget, stage

ORDER = 5
DENSE = 3
MARK = 0xFF  # no UTF-8 text holds it
CELLS = 3 << 23
ROWS = 1 << 22
TOP = 1 << 17
BLOCK = 1 << 19
#: Distinct entries that a task gathers before it hands them on.
GATHERED = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def marked(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with their marks, one after the other, and where each begins."""
    begin = starts + (ORDER + 1) * np.arange(len(starts))
    out = np.full(begin[-1], MARK, np.uint8)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out[np.arange(len(flat)) + (ORDER + 1) * doc + ORDER] = _LOWER[flat]
    return out, begin


def windows(line: np.ndarray, begin: np.ndarray):
    """(document, window) in blocks; a window is ORDER bytes of context and the symbol, as a number."""
    doc = np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin))
    good = np.ones(len(line), bool)
    for k in range(1, ORDER + 1):
        good[begin[1:] - k] = False  # windows that would reach into the next document
    for lo in range(0, len(line) - ORDER, BLOCK):
        b = line[lo : lo + BLOCK + ORDER].astype(np.uint64)
        key = np.zeros(len(b) - ORDER, np.uint64)
        for k in range(ORDER + 1):
            key = key << np.uint64(8) | b[k : k + len(key)]
        own = good[lo : lo + len(key)]
        yield doc[lo : lo + len(key)][own], key[own]


def gather(docs: DataFrame) -> DataFrame:
    """(key, n_train, n_all): words as they are, windows behind a mark; docs has held_out and text (binary)."""

    def count(batches):
        trained, other, grams = Counter(), Counter(), []

        def flush():
            keys, n = _merged(grams)
            raw = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 7 - ORDER - 1 :].copy()  # a byte more in front
            raw[:, 0] = MARK
            offsets = np.arange(0, (ORDER + 2) * len(keys) + 1, ORDER + 2, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([packed, pa.array(n), pa.array(n)], ["key", "n_train", "n_all"])
            some = list(trained.keys() | other.keys())
            for k in range(0, len(some), 1 << 16):
                part = some[k : k + (1 << 16)]
                n = np.array([trained[w] for w in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(n), pa.array(n + np.array([other[w] for w in part], np.int64))], ["key", "n_train", "n_all"])

        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for text, out in zip(batch.column(1), held, strict=True):
                (other if out else trained).update(text.as_py().lower().split())
            for _, flat, starts in _batches(batch.column(1).filter(pa.array(~held))):
                for _, key in windows(*marked(flat, starts)):
                    grams.append(np.unique(key, return_counts=True))
                if sum(len(k) for k, _ in grams) > 2 * GATHERED:
                    grams = [_merged(grams)]
            if len(trained) + len(other) > GATHERED or grams and len(grams[0][0]) > GATHERED:
                yield from flush()
                trained, other, grams = Counter(), Counter(), []
        yield from flush()

    rows = docs.select("held_out", "text").mapInArrow(count, "key binary, n_train long, n_all long")
    return stage(rows.groupBy("key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "counts")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def tails(keys: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes of context and the symbol."""
    return keys & np.uint64((1 << 8 * (k + 1)) - 1)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


def rows_of(keys: np.ndarray, n: np.ndarray, contexts: np.ndarray, code: np.ndarray, a: int) -> np.ndarray:
    """Counts (context, symbol) from windows (context, symbol) whose contexts are all given, in order."""
    at = np.searchsorted(contexts, keys >> np.uint64(8))
    flat = np.bincount(at * a + code[(keys & np.uint64(255)).astype(np.int64)], n, len(contexts) * a)
    return flat.reshape(len(contexts), a)


class Hashed:
    """Numbers by 64-bit key: open addressing, all keys of an array looked up side by side."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.size = max(16, 2 * len(keys))
        self.slots = np.zeros(self.size, np.uint64)  # key + 1, or 0
        self.values = [np.zeros(self.size, np.float32) for _ in values]
        for lo in range(0, len(keys), BLOCK):  # a block at a time, as the places of all would take more than the slots
            self._put(keys[lo : lo + BLOCK], [v[lo : lo + BLOCK] for v in values])

    def _put(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        todo, at = np.arange(len(keys)), self._at(keys)
        while len(todo):
            free = self.slots[at] == 0
            first = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.slots[at[put]] = keys[todo[put]] + np.uint64(1)
            for mine, v in zip(self.values, values, strict=True):
                mine[at[put]] = v[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], self._next(at[rest])

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(self.size) >> np.uint64(32)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        at = at + 1
        at[at == self.size] = 0
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 where it is not there."""
        out = np.full(len(keys), -1, np.int64)
        at, wanted = self._at(keys), keys + np.uint64(1)
        seen = self.slots[at]
        hit = seen == wanted
        out[hit] = at[hit]
        todo = np.flatnonzero(~hit & (seen != 0))
        at = at[todo]
        while len(todo):
            at = self._next(at)
            seen = self.slots[at]
            hit = seen == wanted[todo]
            out[todo[hit]] = at[hit]
            on = ~hit & (seen != 0)
            todo, at = todo[on], at[on]
        return out


def chances(levels: list[np.ndarray], symbols: int) -> np.ndarray:
    """log10 probabilities, one row a context: counts from the longest context to the empty one.

    One more column holds each of the bytes that training never saw.
    """
    rows = levels[0].shape[0]
    p = np.zeros((rows, symbols + 1))
    escape, out = np.ones(rows), np.zeros((rows, symbols), bool)
    for level in levels:
        c = np.where(out, 0, level)
        seen = c > 0
        total, distinct = c.sum(1), seen.sum(1)
        whole = np.maximum(total + distinct, 1)
        p[:, :symbols] += escape[:, None] * c / whole[:, None]
        escape = np.where(distinct > 0, escape * distinct / whole, escape)
        out |= seen
    p[:, symbols] = escape / max(1, 256 - symbols)
    return np.log10(np.maximum(p, 1e-300)).astype(np.float32)


def counts_by_length(keys: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Windows cut to each context length from DENSE on, in order, each from the longer one."""
    found = {ORDER: summed(keys, n)}
    for k in range(ORDER - 1, DENSE - 1, -1):
        found[k] = summed(tails(found[k + 1][0], k), found[k + 1][1])
    return found


class Trie:
    """Chances of a symbol after ORDER bytes, from counted windows.

    Given windows of some buckets only, it needs ``low``: the counts of all windows cut to DENSE - 1 bytes. ``upper``
    has the counts by context length from DENSE on instead of windows, whole for each context that is there, which
    with a context are all its shorter ones.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None, upper: dict | None = None):
        self._build(dict(upper) if upper else counts_by_length(keys, n), low or summed(tails(keys, DENSE - 1), n))

    @classmethod
    def taking(cls, levels: dict, short: tuple[np.ndarray, np.ndarray]) -> Trie:
        """From counts by context length, which are used up: each goes as soon as its tables are there."""
        out = cls.__new__(cls)
        out._build(levels, short)
        return out

    def _build(self, levels: dict, short: tuple[np.ndarray, np.ndarray]) -> None:
        self.sparse = []
        for k in range(ORDER, DENSE, -1):
            self.sparse.insert(0, self._level(k, levels[k], levels[k - 1]))
            del levels[k]
        self.symbols = np.unique(short[0] & np.uint64(255)).astype(np.int64)
        a = len(self.symbols)
        self.code = np.full(256, a, np.uint8)
        self.code[self.symbols] = np.arange(a)
        code = self.code.astype(np.int64)
        levels |= {k: summed(tails(short[0], k), short[1]) for k in range(DENSE)}
        found = {k: np.unique(levels[k][0] >> np.uint64(8)) for k in range(DENSE + 1)}
        if not a:
            found[0] = np.zeros(1, np.uint64)
        dense = [rows_of(*levels[k], found[k], code, a) for k in range(DENSE)]
        parts, base, w = [], 0, a + 1
        slot = np.zeros((w,) * DENSE, np.int32)
        for k in range(DENSE + 1):
            contexts = found[k]
            for lo in range(0, len(contexts), 4096):
                some = contexts[lo : lo + 4096]
                counts = [dense[j][np.searchsorted(found[j], some & np.uint64((1 << 8 * j) - 1))] for j in range(min(k, DENSE - 1), -1, -1)]
                if k == DENSE:
                    own = slice(*np.searchsorted(levels[k][0], [some[0] << np.uint64(8), some[-1] + np.uint64(1) << np.uint64(8)]))
                    counts.insert(0, rows_of(levels[k][0][own], levels[k][1][own], some, code, a))
                parts.append(chances(counts, a))
            spots = tuple(code[(contexts >> np.uint64(8 * j) & np.uint64(255)).astype(np.int64)] for j in range(k - 1, -1, -1))
            slot[(Ellipsis, *spots)] = np.arange(base, base + len(contexts))  # longer contexts later, over the shorter
            base += len(contexts)
        self.slot, self.rows = slot.ravel(), np.concatenate(parts)
        self.third = Hashed(levels[DENSE][0])

    @staticmethod
    def _level(k: int, own: tuple[np.ndarray, np.ndarray], below: tuple[np.ndarray, np.ndarray]) -> tuple[Hashed, Hashed]:
        """Of one context length: log10 chances of seen symbols, and the two factors for the others by context."""
        keys, n = own
        if not len(keys):
            return Hashed(keys, n), Hashed(keys, n, n)
        contexts, begin = np.unique(keys >> np.uint64(8), return_index=True)
        total, distinct = np.add.reduceat(n, begin), np.diff(np.append(begin, len(keys)))
        whole = (total + distinct).astype(float)
        chance = np.log10(n / np.repeat(whole, distinct))
        # What the next shorter context has, in all and without the symbols seen here.
        shorter, at = np.unique(below[0] >> np.uint64(8), return_index=True)
        all_n, all_d = np.add.reduceat(below[1], at), np.diff(np.append(at, len(below[0])))
        of = np.searchsorted(shorter, contexts & np.uint64((1 << 8 * (k - 1)) - 1))
        same = np.add.reduceat(below[1][np.searchsorted(below[0], tails(keys, k - 1))], begin)
        rest_n, rest_d = all_n[of] - same, all_d[of] - distinct
        escape = np.log10(distinct / whole)
        rest = np.maximum(rest_n + rest_d, 1)
        seen = escape + np.log10((all_n[of] + all_d[of]) / rest)
        on = np.where(rest_d > 0, np.log10(np.maximum(rest_d, 1) / rest), 0.0)
        other = escape + on - np.log10(all_d[of] / (all_n[of] + all_d[of]))
        return Hashed(keys, chance), Hashed(contexts, seen, other)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Whether the whole context of a window is there, and with it all that its chance depends on."""
        return self.sparse[-1][1].find(keys >> np.uint64(8)) >= 0

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """log10 chance of each window's symbol after its context."""
        out = np.empty(len(keys), np.float32)
        self._cost(keys, ORDER, np.arange(len(keys)), out)
        return out

    def _cost(self, keys: np.ndarray, k: int, where: np.ndarray, out: np.ndarray) -> None:
        """Fill out[where] with the chances by contexts of up to k bytes."""
        if k == DENSE:
            w = len(self.symbols) + 1
            c = [self.code[(keys[where] >> np.uint64(8 * j) & np.uint64(255)).astype(np.int64)].astype(np.int32) for j in (3, 2, 1, 0)]
            out[where] = self.rows[self.slot[(c[0] * w + c[1]) * w + c[2]], c[3]]
            return
        chance, factors = self.sparse[k - DENSE - 1]
        at = chance.find(tails(keys[where], k))
        hit = at >= 0
        out[where[hit]] = chance.values[0][at[hit]]
        left = where[~hit]
        if not len(left):
            return
        self._cost(keys, k - 1, left, out)
        at = factors.find(tails(keys[left], k) >> np.uint64(8))
        known = at >= 0
        left, at = left[known], at[known]
        seen = self._seen(keys[left], k - 1)
        out[left] += np.where(seen, factors.values[0][at], factors.values[1][at])

    def _seen(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Whether the symbol has followed the last k bytes."""
        if k > DENSE:
            return self.sparse[k - DENSE - 1][0].find(tails(keys, k)) >= 0
        return self.third.find(tails(keys, k)) >= 0

    def score(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        line, begin = marked(flat, starts)
        total = np.zeros(len(starts) - 1)
        for doc, key in windows(line, begin):
            if len(doc):
                total[doc[0] : doc[-1] + 1] += np.bincount(doc - doc[0], self.cost(key))
        return total

    def score_known(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the windows whose context is there, and (windows, times, bounds by text) of all others."""
        line, begin = marked(flat, starts)
        total, docs, keys = np.zeros(len(starts) - 1), [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
        for doc, key in windows(line, begin):
            sure = self.known(key)
            own, some = doc[sure], key[sure]
            if len(own):
                total[own[0] : own[-1] + 1] += np.bincount(own - own[0], self.cost(some))
            docs.append(doc[~sure])
            keys.append(key[~sure])
        doc, key = np.concatenate(docs), np.concatenate(keys)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        return total, key[first], np.diff(np.append(first, len(key))), np.searchsorted(doc[first], np.arange(len(starts)))


class Shared:
    """What every worker needs; the trie is built where it is first asked for, and stays there."""

    def __init__(self, kept: dict[bytes, float], *parts):
        self.kept, self.parts, self._trie = kept, parts, None

    @property
    def trie(self) -> Trie:
        if self._trie is None:
            keys, n, *rest = self.parts
            self.parts = None  # the tables are larger than the counts, and both in every worker too much
            low, levels = rest or (summed(tails(keys, DENSE - 1), n), counts_by_length(keys, n))
            del keys, n, rest
            self._trie = Trie.taking(levels, low)
        return self._trie


def _grams(counts: DataFrame) -> DataFrame:
    mark = F.unhex(F.lit("FF"))
    number = F.conv(F.hex(F.substring("key", 2, ORDER + 1)), 16, 10).cast("long")
    return counts.filter((F.substring("key", 1, 1) == mark) & (F.col("n_train") > 0)).select(number.alias("w"), F.col("n_train").alias("n"))


def _columns(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.toArrow()
    return got["w"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.int64)


def _nearest() -> Column:
    return F.expr(f"shiftright(w, 8) & {(1 << 8 * DENSE) - 1}")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(_nearest()), F.lit(buckets))


def _level(grams: DataFrame, k: int) -> DataFrame:
    """Windows cut to the last k bytes of context."""
    if k == ORDER:
        return grams
    return grams.groupBy(F.expr(f"w & {(1 << 8 * (k + 1)) - 1}").alias("w")).agg(F.sum("n").alias("n"))


def frequent(grams: DataFrame, symbols: int, cells: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts by context length of all contexts that were seen so often that these counts stay within ``cells`` numbers.

    A histogram by power of two says where to draw the line; a context is never more frequent than a shorter one
    that ends it, so with a context all its shorter ones are there.
    """
    levels, above = {}, grams
    for k in range(ORDER, DENSE - 1, -1):  # each from the longer one, which is smaller than all windows
        levels[k] = above = stage(_level(above.select("w", "n"), k).withColumn("t", F.sum("n").over(Window.partitionBy(F.expr("shiftright(w, 8)")))), "level")
    grade, cost = F.floor(F.log2("t")).cast("int"), {}
    for k, level in levels.items():
        one = level.groupBy(F.expr("shiftright(w, 8)").alias("c")).agg(F.count(F.lit(1)).alias("e"), F.first("t").alias("t"))
        for r in one.groupBy(grade.alias("g")).agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("c")).collect():  # 64 rows at most
            cost[r["g"]] = cost.get(r["g"], 0) + 8 * r["e"] + (k == DENSE) * (symbols + 1) * r["c"]
    left, least = cells, 64
    for g in range(63, -1, -1):
        left -= cost.get(g, 0)
        if left < 0:
            break
        least = g
    found = {}
    for k, level in levels.items():
        keys, n = _columns(level.filter(grade >= least).select("w", "n"))
        found[k] = summed(keys, n)
    forget(*levels.values())
    return found


def deal(need: DataFrame, buckets: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, at, w, n) with b and part: buckets by the nearest bytes, cut to about ``rows`` each; and (b, parts)."""
    need = need.withColumn("b", _bucket(buckets))
    parts = stage(need.groupBy("b").count().select("b", F.ceil(F.col("count") / rows).alias("parts")), "parts")  # a row a bucket
    return need.join(F.broadcast(parts), "b").withColumn("part", F.pmod(F.xxhash64("uid", "at"), F.col("parts"))).drop("at", "parts"), parts


def score_dealt(need: DataFrame, grams: DataFrame, low: tuple[np.ndarray, np.ndarray], buckets: int, rows: int = ROWS) -> DataFrame:
    """(uid, more) from rows (uid, at, w, n): every window is scored in one of its bucket's tasks."""
    shared = need.sparkSession.sparkContext.broadcast(low)

    def solve(need, own):
        if not need.num_rows:
            return pa.table({"uid": pa.array([], pa.int64()), "more": pa.array([], pa.float64())})
        trie = Trie(own["w"].to_numpy().astype(np.uint64), own["n"].to_numpy(), shared.value)
        w = need["w"].to_numpy().astype(np.uint64)
        costs = [trie.cost(w[k : k + BLOCK]) for k in range(0, len(w), BLOCK)]
        got = np.concatenate(costs).astype(np.float64) * need["n"].to_numpy()
        return pa.table({"uid": need["uid"], "more": pa.array(got)}).group_by("uid").aggregate([("more", "sum")]).rename_columns(["uid", "more"])

    need, parts = deal(need, buckets, rows)
    own = grams.withColumn("b", _bucket(buckets)).join(F.broadcast(parts), "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    solved = need.groupBy("b", "part").cogroup(own.groupBy("b", "part")).applyInArrow(solve, "uid long, more double")
    return solved.groupBy("uid").agg(F.sum("more").alias("dealt"))


def _frequent(words: DataFrame, top: int) -> list:
    """All words from some count on, at most ``top``: a histogram of counts says where to draw the line."""
    grade = F.floor(F.log2("n_all") * 8)
    left, least = top, None
    for r in words.groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect():  # 8 rows for each doubling
        left -= r["count"]
        if left < 0:
            break
        least = r["g"]
    return words.filter(grade >= least).collect() if least is not None else []


def lm_scores(docs: DataFrame, cells: int = CELLS, top: int = TOP, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), text.alias("text"))
    counts = gather(base)
    grams = _grams(counts)
    words = counts.filter(F.substring("key", 1, 1) != F.unhex(F.lit("FF")))
    sums = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.when(F.col("n_train") > 0, 1))).first()
    ends = base.filter("not held_out").count()
    n, v = sums[0] + ends, sums[1] + (ends > 0)
    unknown, end = math.log10(1 / (n + v + 1)), math.log10((ends + 1) / (n + v + 1))
    common = _frequent(words, top)
    kept = {bytes(r["key"]): math.log10((r["n_train"] + 1) / (n + v + 1)) for r in common}
    found, symbols, entries = grams.agg(F.countDistinct(_nearest()), F.countDistinct(F.expr("w & 255")), F.count(F.lit(1))).first()
    size = found * (symbols + 1) + 8 * entries  # numbers that the trie holds
    dealt = size > cells
    if dealt:
        grams = stage(grams, "grams")
        low = _columns(_level(grams, DENSE - 1))  # at most 2^24 rows
        parts = (np.zeros(0, np.uint64), np.zeros(0, np.int64), low, frequent(grams, symbols, cells))
    else:
        parts = _columns(grams)
    shared = docs.sparkSession.sparkContext.broadcast(Shared(kept, *parts))

    def tokens(batches):
        kept, trie = shared.value.kept, shared.value.trie
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()))
        for batch in batches:
            for at, flat, starts in _batches(batch.column(2)):
                some, out = batch.slice(at, len(starts) - 1), []
                for one in some.column(2):
                    each = one.as_py().lower().split()
                    values = list(map(kept.get, each))
                    rare = [w for w, x in zip(each, values, strict=True) if x is None]
                    sure = np.array([x for x in values if x is not None])
                    out.append((len(each) + 1, int((sure > unknown + 0.1).sum()) + (ends > 0), end + float(sure.sum()), rare))
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                if dealt:
                    score, w, times, bounds = trie.score_known(flat, starts)
                else:
                    score, w, times, bounds = trie.score(flat, starts), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int64))) for x in (w, times)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *made, pa.array(score), *lists], ["doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "score", "ws", "ns"])

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, base double, rare array<binary>, score double, ws array<long>, ns array<long>"
    told = stage(base.mapInArrow(tokens, kind).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    value = F.when(F.col("n_train") > 0, F.log10((F.col("n_train") + 1) / F.lit(float(n + v + 1)))).otherwise(F.lit(unknown))
    rare = told.select("uid", F.explode("rare").alias("key")).join(words, "key", "left")
    rare = rare.groupBy("uid").agg(F.sum(value).alias("more"), F.count(F.when(F.col("n_train") > 0, 1)).alias("also"))
    out = told.drop("rare", "ws", "ns").join(rare, "uid", "left")
    score = F.col("score")
    if dealt:
        need = told.select("uid", F.posexplode(F.arrays_zip("ws", "ns")).alias("at", "x")).select("uid", "at", F.col("x.ws").alias("w"), F.col("x.ns").alias("n"))
        out = out.join(score_dealt(need, grams, low, -(-size // max(1, cells)), rows), "uid", "left")
        score = (F.col("score") + F.coalesce("dealt", F.lit(0.0))).alias("score")
    out = out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score)
    out = finish(out, "scores", counts, told, *([grams] if dealt else []))
    shared.destroy()
    return out
