"""SimHash near-dedup by anchor-point covering.

The fingerprint's first 46 bits are two blocks of 23; the binary Golay code covers 23 bits perfectly
with radius 3, so its 4096 x 4096 pairs of code words are the anchors. A fingerprint's home is its
nearest anchor, and it is replicated to every anchor within the radius plus the threshold, where the
threshold's ``BITS`` are shared out over the blocks. Of two fingerprints that differ in at most
``BITS`` bits each is replicated to the other's home, so homes compared with replicas, anchor by
anchor, find every link. Where more than ``CROWD`` homes meet at one anchor, the 15 bits after the blocks are a
third one under the perfect Hamming code of radius 1, which splits that anchor 2048-fold. With more than
``CROWDS`` such anchors, all anchors have the third block: 2^35 of them. Links are the same in each case.

Only distinct fingerprints are compared, and each anchor reports a spanning forest of its links.
Components come from alternating large-star and small-star rounds over written tables.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; rows with a
null ``doc_id`` get a component but never name it (null if all ids of it are null); repeated rows share
a fingerprint and a component, and ``near_dedup`` keeps one of them; rows of one id with different texts are
rows of their own; very long texts are hashed as a whole; of an empty table the result is empty; other
columns are left behind by ``near_groups`` and pass through ``near_dedup`` under any name.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytemill.llm.graph import components
from bytemill.llm.rows import KEY, one_of_equals, row_key, small
from bytemill.plans.scratch import finish, forget, stage

BITS = 2
SEED = 42
#: Homes at one anchor from which it is split by the third block, and how many such anchors are listed at most.
CROWD, CROWDS = 512, 4096
#: Fingerprints that many rows share, whose component is broadcast.
HEAVY = 512
#: Pairs up to which an anchor is compared outright; beyond, variants of every home are looked up.
OUTRIGHT = 1 << 24


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    m = max(1, n - width + 1)
    up, total = np.zeros(64, np.int64), m
    digest = xxhash.xxh64_intdigest
    lo, hi = starts[:m].tolist(), ends[n - m :].tolist()
    for k in range(0, m, 1 << 16):
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(lo[k : k + (1 << 16)], hi[k : k + (1 << 16)], strict=True)), "<u8")
        up += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * up > total, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    @F.arrow_udf("long")
    def each(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return each(text.cast("string").cast("binary"))


class Block:
    """A perfect code of one block: by syndrome, the error patterns of weight up to radius + BITS."""

    def __init__(self, low: int, n: int, poly: int, radius: int):
        self.low, self.mask = low, (1 << n) - 1
        degree = poly.bit_length() - 1
        column = []  # syndrome of each single bit: x^k modulo the generator polynomial
        for k in range(n):
            r = 1 << k
            for b in range(k, degree - 1, -1):
                if r >> b & 1:
                    r ^= poly << (b - degree)
            column.append(r)
        patterns, syndromes, weights = [0], [0], [0]
        level = [(0, 0, 0)]
        for w in range(1, radius + BITS + 1):
            level = [(p | 1 << k, s ^ column[k], k + 1) for p, s, first in level for k in range(first, n)]
            patterns += [x[0] for x in level]
            syndromes += [x[1] for x in level]
            weights += [w] * len(level)
        p, s, e = np.array(patterns, np.uint64), np.array(syndromes), np.maximum(0, np.array(weights) - radius)
        self.tables = []  # for each excess 0..BITS: patterns in order of syndrome, and where a syndrome's begin
        for x in range(BITS + 1):
            order = np.argsort(s[e == x], kind="stable")
            self.tables.append((p[e == x][order], np.searchsorted(s[e == x][order], np.arange((1 << degree) + 1))))
        self.columns = np.array(column, np.int64)

    def of(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = fps >> np.uint64(self.low) & np.uint64(self.mask)
        syndrome = np.zeros(len(fps), np.int64)
        for k, c in enumerate(self.columns):
            syndrome ^= np.where(part >> np.uint64(k) & np.uint64(1), c, 0)
        return part, syndrome

    def words(self, part: np.ndarray, syndrome: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, code word) for the code words at radius + excess, at most radius for excess 0."""
        patterns, begin = self.tables[excess]
        n = begin[syndrome + 1] - begin[syndrome]
        row = np.repeat(np.arange(len(part)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[syndrome], n)
        return row, part[row] ^ patterns[at]


@cache
def blocks() -> tuple[Block, Block, Block]:
    golay, hamming = 0b101011100011, 0b10011
    return Block(0, 23, golay, 3), Block(23, 23, golay, 3), Block(46, 15, hamming, 1)


def homes(fps: np.ndarray) -> np.ndarray:
    a, b, _ = blocks()
    return a.words(*a.of(fps), 0)[1] | b.words(*b.of(fps), 0)[1] << np.uint64(23)


def replicas(fps: np.ndarray, crowded: np.ndarray | None):
    """(anchor, cell, row, is home): cell is the third code word at crowded anchors (None: at all), elsewhere 0."""
    a, b, c = blocks()
    (pa_, sa), (pb, sb), (pc, sc) = a.of(fps), b.of(fps), c.of(fps)
    for x in range(BITS + 1):
        for y in range(BITS + 1 - x):
            row, first = a.words(pa_, sa, x)
            again, second = b.words(pb[row], sb[row], y)
            row, anchor = row[again], first[again] | second << np.uint64(23)
            dense = np.isin(anchor, crowded) if crowded is not None else np.ones(len(anchor), bool)
            yield anchor[~dense], np.zeros(int((~dense).sum()), np.uint64), row[~dense], np.full(int((~dense).sum()), x + y == 0)
            if dense.any():
                row, anchor = row[dense], anchor[dense]
                for z in range(BITS + 1 - x - y):
                    more, third = c.words(pc[row], sc[row], z)
                    yield anchor[more], third + np.uint64(1), row[more], np.full(len(more), x + y + z == 0)


def links(home: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y), x of home and y of every, x < y, that differ in at most BITS bits."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(home) * len(every) <= OUTRIGHT:
        step = max(1, (1 << 20) // len(every))
        for k in range(0, len(home), step):
            h = home[k : k + step, None]
            i, j = np.nonzero((np.bitwise_count(h ^ every[None]) <= BITS) & (h < every[None]))
            found.append((home[k + i], every[j]))
    else:
        every = np.unique(every)
        masks = np.array([m for m in _masks()], np.uint64)
        for x in home:
            y = x ^ masks
            at = np.searchsorted(every, y)
            y = y[(every[np.minimum(at, len(every) - 1)] == y) & (y > x)]
            found.append((np.full(len(y), x), y))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (home[:0], home[:0])


def _masks() -> list[int]:
    level, out = [(0, 0)], []
    for _ in range(BITS):
        level = [(m | 1 << k, k + 1) for m, first in level for k in range(first, 64)]
        out += [m for m, _ in level]
    return out


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs that join the same fingerprints: every one with the least that its links reach."""
    nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    if len(x) < len(nodes):
        return x, y
    i, j = flat[: len(x)], flat[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    kid = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[kid]], nodes[kid]


def _compare(batches):
    """Links of every (anchor, cell); the rows come sorted by both, and a group may span batches."""
    tail: list[np.ndarray] = []

    def solve(key: np.ndarray, fp: np.ndarray, home: np.ndarray):
        cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        size = np.diff(cut)
        some = np.add.reduceat(home.astype(np.int64), cut[:-1]) if len(key) else size
        xs, ys = [], []
        for k in np.flatnonzero((size > 1) & (some > 0)):
            f, h = fp[cut[k] : cut[k + 1]], home[cut[k] : cut[k + 1]]
            x, y = links(np.unique(f[h]), np.unique(f))
            if len(x):
                x, y = forest(x, y)
                xs.append(x)
                ys.append(y)
        if xs:
            u, v = np.concatenate(xs).view(np.int64), np.concatenate(ys).view(np.int64)
            return pa.RecordBatch.from_pydict({"u": np.minimum(u, v), "v": np.maximum(u, v)})
        return None

    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
        fp = batch.column(2).to_numpy().view(np.uint64)
        home = batch.column(3).to_numpy(zero_copy_only=False)
        tail.append((key, fp, home))
        if (key[0] == key[-1]).all() and (held is None or (held == key[0]).all()):
            held = key[-1]
            continue  # the group goes on
        key, fp, home = (np.concatenate(z) for z in zip(*tail, strict=True))
        last = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1
        if (out := solve(key[:last], fp[:last], home[:last])) is not None:
            yield out
        tail, held = [(key[last:], fp[last:], home[last:])], key[-1]
    if tail and (out := solve(*(np.concatenate(z) for z in zip(*tail, strict=True)))) is not None:
        yield out


def linked(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of distinct values of the column fp that join exactly those that links join."""

    def home_rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"home": homes(batch.column(0).to_numpy().view(np.uint64)).view(np.int64)})

    at = distinct.select("fp").mapInArrow(home_rows, "home long").groupBy("home").count()
    found = [r["home"] for r in at.filter(F.col("count") > CROWD).select("home").limit(CROWDS + 1).collect()]
    # With more crowded anchors than may be listed, all are split: the code grows with the fingerprints.
    crowds = np.array(found, np.int64).view(np.uint64) if len(found) <= CROWDS else None

    def copies(batches):
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(every), 4096):
                fps = every[k : k + 4096]
                for anchor, cell, row, home in replicas(fps, crowds):
                    yield pa.RecordBatch.from_pydict({"anchor": anchor.view(np.int64), "cell": cell.astype(np.int64), "fp": fps[row].view(np.int64), "home": home})

    spread = distinct.select("fp").mapInArrow(copies, "anchor long, cell long, fp long, home boolean")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(_compare, "u long, v long")


def _grouped(fps: DataFrame, *best) -> DataFrame:
    """(fp, n, least and more), stored: every distinct fingerprint with the best of ``best`` in its component."""
    names = [f"_{k}" for k in range(len(best))]
    distinct = stage(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), *[b.alias(c) for b, c in zip(best, names, strict=True)]), "distinct")
    joined = components(linked(distinct))  # v, u: fingerprint and the least one that it reaches
    member = joined.select(F.col("v").alias("fp"), F.col("u").alias("root")).unionByName(joined.select(F.col("u").alias("fp"), F.col("u").alias("root")).distinct())
    member = stage(member.join(distinct, "fp"), "members")
    roots = member.groupBy("root").agg(F.sum("n").alias("_n"), *[F.min(c).alias(f"{c}r") for c in names])
    own = member.select("fp", "root").join(roots, "root").drop("root")
    out = distinct.join(own, "fp", "left").select("fp", F.col("n").alias("copies"), F.coalesce("_n", "n").alias("n"), *[F.coalesce(f"{c}r", c).alias(c) for c in names])
    return finish(out, "found", distinct, joined, member)


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every row; texts are left behind."""
    fps = stage(docs.select("doc_id", fingerprints(F.col("text"), width).alias("fp")), "fingerprints")
    found = _grouped(fps, F.min("doc_id")).withColumnRenamed("_0", "component_id")
    heavy = F.broadcast(stage(found.orderBy(F.desc("copies"), "fp").limit(HEAVY).select("fp", "component_id"), "heavy", few=True))
    frequent = fps.join(heavy, "fp")
    rest = fps.join(heavy, "fp", "left_anti").join(found.select("fp", "component_id"), "fp")
    return frequent.unionByName(rest).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each component, as it came: the one of the smallest id (null last), then by a key of id and text."""
    key = row_key(F.col("doc_id"), F.col("text"))
    fps = stage(docs.select("doc_id", key.alias(KEY), fingerprints(F.col("text"), width).alias("fp")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col(KEY).alias("k"))
    found = _grouped(fps, F.min(order)).filter("n > 1").select("fp", F.col("_0.k").alias("_stays"))
    rivals = stage(fps.join(small(stage(found, "crowded")), "fp").select(KEY, (F.col(KEY) == F.col("_stays")).alias("stays")), "rivals")
    gone = stage(rivals.filter("not stays").select(KEY).distinct(), "gone")
    twice = stage(rivals.filter("stays").groupBy(KEY).count().filter("count > 1").select(KEY), "twice")
    packed = docs.select(key.alias(KEY), F.struct("*").alias("_row"))
    forget(fps, found, rivals)
    if not gone.isEmpty():
        packed = packed.join(small(gone), KEY, "left_anti")
    if twice.isEmpty():
        return packed.select("_row.*")
    twice = small(twice)
    once = packed.join(twice, KEY, "left_anti").select("_row.*")
    return once.unionByName(one_of_equals(packed.join(twice, KEY, "left_semi"), KEY, "_row").select("_row.*"))
