"""The byte codecs as functions of columns: each one takes whole Arrow batches of binary values."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytemill.functions import batches, chunkcodec, codecs, hashing, lz, rans
from bytemill.operators.analysis import ngrams
from bytemill.plans.scratch import stage


def binary(run: Callable[[bytes], bytes], *columns: Column, kind: str = "binary") -> Column:
    """``run`` over the values of the columns; null where any of them is."""
    type_ = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}[kind]

    @F.arrow_udf(kind)
    def each(*arrays: pa.Array) -> pa.Array:
        out = []
        for some in batches.runs(arrays[0]):
            rows = zip(*(a[some].to_pylist() for a in arrays), strict=True)
            out.append(pa.array([None if any(x is None for x in r) else run(*r) for r in rows], type_))
        return batches.joined(out, type_)

    return each(*columns)


def batched(run: Callable[[list[bytes]], list], column: Column, kind: str = "binary") -> Column:
    """``run`` over the values of a batch, many at once; nulls stay null."""
    type_ = {"binary": pa.binary(), "string": pa.string()}[kind]

    @F.arrow_udf(kind)
    def each(values: pa.Array) -> pa.Array:
        out = []
        for some in batches.runs(values):
            rows = values[some].to_pylist()
            got = iter(run([r for r in rows if r is not None]))
            out.append(pa.array([None if r is None else next(got) for r in rows], type_))
        return batches.joined(out, type_)

    return each(column)


def fnv64(c: Column) -> Column:
    return batched(hashing.fnv64_hex, c, "string")


def fnv128(c: Column) -> Column:
    return batched(hashing.fnv128_hex, c, "string")


def similarity_hash(c: Column) -> Column:
    return batched(hashing.similarity_hex, c, "string")


def bitpack(c: Column) -> Column:
    return binary(codecs.bitpack, c)


def bitunpack(c: Column) -> Column:
    return binary(codecs.bitunpack, c)


def shuffle(c: Column, size: int) -> Column:
    return binary(lambda b: codecs.shuffle(b, size), c)


def unshuffle(c: Column, size: int) -> Column:
    return binary(lambda b: codecs.unshuffle(b, size), c)


def cell_pack(c: Column, bits: int) -> Column:
    return binary(lambda b: codecs.cell_pack(b, bits).cells, c)


def cell_round_trip(c: Column, bits: int) -> Column:
    return binary(lambda b: codecs.cell_unpack(codecs.cell_pack(b, bits)), c)


def lz_compress(c: Column) -> Column:
    return batched(lz.compress_many, c)


def lz_decompress(c: Column) -> Column:
    return batched(lz.decompress_many, c)


def rans0_encode(c: Column) -> Column:
    return batched(rans.encode0_many, c)


def rans0_decode(c: Column) -> Column:
    return batched(rans.decode0_many, c)


def rans1_encode(c: Column) -> Column:
    """Contents must not be empty."""
    return batched(rans.encode1_many, c)


def rans1_decode(c: Column) -> Column:
    return batched(rans.decode1_many, c)


def rans_encode(c: Column) -> Column:
    return batched(rans.encode_many, c)


def rans_decode(c: Column) -> Column:
    return batched(rans.decode_many, c)


def difference_runs(base: Column, target: Column) -> Column:
    """Difference runs of two contents, the shorter padded with zeros."""

    def run(a: bytes, b: bytes) -> bytes:
        n = max(len(a), len(b))
        return codecs.difference_runs(codecs.pad(a, n), codecs.pad(b, n))

    return binary(run, base, target)


def delta_restore(base: Column, runs: Column, size: Column) -> Column:
    return binary(codecs.delta_restore, base, runs, size)


def corpus_genome(df: DataFrame, most: int = 8) -> codecs.Genome:
    """A codebook over all blobs: at most 255 patterns and 256 byte counts come to the driver."""
    from bytemill.operators.analysis import best_patterns, byte_histogram

    hist = {r["byte"]: r["n"] for r in byte_histogram(df, None).groupBy("byte").agg(F.sum("cnt").alias("n")).collect()}
    patterns = {r["code"]: bytes(r["pattern"]) for r in best_patterns(ngrams(df, 3, most, codecs.MOST_PATTERNS)).collect()}
    return codecs.Genome(min(range(256), key=lambda b: (hist.get(b, 0), b)), patterns)


def pattern_encode(c: Column, genome: codecs.Genome) -> Column:
    return binary(lambda b: codecs.pattern_encode(b, genome), c)


def pattern_decode(c: Column, genome: codecs.Genome) -> Column:
    return binary(lambda b: codecs.pattern_decode(b, genome), c)


def shorten(c: Column, genome: codecs.Genome) -> Column:
    """By the codebook where that leaves less; by one of the blob's own, or by the byte values of UTF-8, where it does not."""
    return binary(lambda b: codecs.shorten(b, genome), c)


def restore(c: Column, genome: codecs.Genome) -> Column:
    return binary(lambda b: codecs.restore(b, genome), c)


def encode_chunks(content: Column, stages: Column, genome: codecs.Genome | None = None) -> Column:
    """All stages of a chunk in one pass; ``stages`` is the mask of each row."""
    genome = genome or codecs.Genome()

    @F.arrow_udf("binary")
    def each(data: pa.Array, masks: pa.Array) -> pa.Array:
        out = []
        for some in batches.runs(data):
            rows = data[some].to_pylist()
            out.append(pa.array(chunkcodec.encode_chunks(rows, masks[some].to_pylist(), [genome] * len(rows)), pa.binary()))
        return batches.joined(out, pa.binary())

    return each(content, stages)


def decode_chunks(coded: Column, stages: Column, genome: codecs.Genome | None = None) -> Column:
    genome = genome or codecs.Genome()

    @F.arrow_udf("binary")
    def each(data: pa.Array, masks: pa.Array) -> pa.Array:
        out = []
        for some in batches.runs(data):
            rows = data[some].to_pylist()
            out.append(pa.array(chunkcodec.decode_chunks(rows, masks[some].to_pylist(), [genome] * len(rows)), pa.binary()))
        return batches.joined(out, pa.binary())

    return each(coded, stages)


#: Chunks that a delta group holds in a task, or so; larger groups are worked through in rounds, as below.
GROUP = 20_000


def _deltas(table: pa.Table, best: dict) -> pa.Table:
    """Chunks of a group by uid, each against the full ones before it; ``best`` has what earlier blocks offer."""
    table = table.sort_by("uid")
    uids, data = table["uid"].to_pylist(), table["data"].to_pylist()
    out, whole = [], []
    for uid, target in zip(uids, data, strict=True):
        runs = [(len(d), k, ref_uid, d) for k, (ref_uid, ref) in enumerate(whole) if (d := codecs.delta_against(ref, target)) is not None]
        if uid in best:
            runs.append((len(best[uid][1]), -1, *best[uid]))
        if runs:
            _, _, ref_uid, d = min(runs, key=lambda x: x[:2])
            out.append(("DELTA", ref_uid, len(target), d))
        else:
            whole.append((uid, target))
            out.append(("FULL", None, len(target), target))
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({"blob_id": table["blob_id"], "uid": table["uid"], "kind": pa.array(cols[0], pa.string()), "ref_uid": pa.array(cols[1], pa.int64()), "original_size": pa.array(cols[2], pa.int32()), "data": pa.array(cols[3], pa.binary())})


def _in_rounds(rows: DataFrame, kind: str) -> DataFrame:
    """Groups ``g`` in blocks of about GROUP by uid: a block meets the full chunks of each earlier block, then itself."""
    most = rows.groupBy("g").count().agg(F.max("count")).first()[0]
    blocks = -(-most // GROUP)
    cuts = rows.groupBy("g").agg(F.percentile_approx("uid", [k / blocks for k in range(1, blocks)], 100_000).alias("cuts"))
    rows = stage(rows.join(cuts, "g").withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col("uid")))).drop("cuts"), "blocks")

    def against(targets, whole):
        whole = whole.sort_by("uid")
        refs = list(zip(whole["uid"].to_pylist(), whole["data"].to_pylist(), strict=True))
        found = []
        for uid, target in zip(targets["uid"].to_pylist(), targets["data"].to_pylist(), strict=True):
            runs = [(len(d), ref_uid, d) for ref_uid, ref in refs if (d := codecs.delta_against(ref, target)) is not None]
            if runs:
                found.append((targets["g"][0].as_py(), uid, *min(runs, key=lambda x: x[:2])))
        cols = list(zip(*found, strict=True)) or [()] * 5
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["g", "uid", "size", "ref_uid", "run"])

    def settle(targets, best):
        return _deltas(targets, dict(zip(best["uid"].to_pylist(), zip(best["ref_uid"].to_pylist(), best["run"].to_pylist(), strict=True), strict=True))).append_column("g", targets["g"])

    done = None
    for block in range(blocks):
        now = rows.filter(F.col("block") == block)
        if done is None:
            made = now.groupBy("g").applyInArrow(lambda t: _deltas(t, {}).append_column("g", t["g"]), f"{kind}, g string")
        else:
            whole = done.filter("kind = 'FULL'").select(F.col("g").alias("of"), "uid", "data", F.col("block").alias("at"))
            asked = now.drop("block").join(whole.select(F.col("of").alias("g"), F.col("at").alias("to")).distinct(), "g")
            offers = asked.groupBy("g", "to").cogroup(whole.groupBy("of", "at")).applyInArrow(against, "g string, uid long, size int, ref_uid long, run binary")
            best = offers.groupBy("g", "uid").agg(F.min(F.struct("size", "ref_uid", "run")).alias("b")).select("g", "uid", "b.ref_uid", "b.run")
            made = now.groupBy("g").cogroup(best.groupBy("g")).applyInArrow(settle, f"{kind}, g string")
        made = stage(made.withColumn("block", F.lit(block)), "round")
        done = made if done is None else done.unionByName(made)
    return done.drop("g", "block")


def delta_encode(chunks: DataFrame) -> DataFrame:
    """(blob_id, uid, kind, ref_uid, original_size, data): differences to an earlier similar chunk, or all of it.

    Candidates share the similarity hash, so a group never looks beyond its own hash and groups run in
    parallel. Short chunks are stored whole and skip the shuffle. A group with more chunks than GROUP is
    worked through in blocks by uid, each compared with all full chunks before; results are the same.
    """
    kind = f"blob_id {dict(chunks.dtypes)['blob_id']}, uid long, kind string, ref_uid long, original_size int, data binary"
    chunks = chunks.select("blob_id", F.col("uid").cast("long").alias("uid"), "data")
    short = chunks.filter(F.octet_length("data") < 64)
    key = F.to_json(F.struct("blob_id", similarity_hash(F.col("data")).alias("sim"))).alias("g")
    rest = stage(chunks.filter(F.octet_length("data") >= 64).select("blob_id", "uid", "data", key), "similar")
    large = stage(rest.groupBy("g").count().filter(F.col("count") > GROUP).select("g"), "large")  # one in GROUP rows at most
    some = not large.isEmpty()
    usual = rest.join(F.broadcast(large), "g", "left_anti") if some else rest
    made = usual.groupBy("g").applyInArrow(lambda t: _deltas(t, {}), kind)
    if some:
        made = made.unionByName(_in_rounds(rest.join(F.broadcast(large), "g"), kind))
    full = short.select("blob_id", "uid", F.lit("FULL").alias("kind"), F.lit(None).cast("long").alias("ref_uid"), F.octet_length("data").alias("original_size"), "data")
    return made.unionByName(full)


def delta_decode(deltas: DataFrame) -> DataFrame:
    """(blob_id, uid, data): references are whole chunks, so one join restores all."""
    whole = deltas.filter("kind = 'FULL'").select("blob_id", "uid", "data")
    base = whole.select(F.col("blob_id"), F.col("uid").alias("ref_uid"), F.col("data").alias("base"))
    diff = deltas.filter("kind = 'DELTA'").join(base, ["blob_id", "ref_uid"])
    made = diff.select("blob_id", "uid", delta_restore(F.col("base"), F.col("data"), F.col("original_size")).alias("data"))
    return whole.unionByName(made)
