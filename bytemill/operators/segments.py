"""Chunks, dedup, restore and layout as DataFrame operations.

Chunks are rows (blob_id, chunk_idx, offset, length, hash, data); the hash is SHA-256, as the 128-bit
hash of the archive format is too weak to decide equality on. Byte strings stay out of windows and
shuffles: the plan ranks (blob_id, chunk_idx, hash) and fetches data for first occurrences only.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytemill.functions.chunker import ChunkerConfig, cuts

#: Consecutive positions that are ranked or summed in one task.
RUN = 65536


def chunk(df: DataFrame, cfg: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Content-defined chunks of every blob; a null or empty content has none."""

    def run(batches):
        for batch in batches:
            for one, b in zip(batch.column(0), batch.column(1), strict=True):
                content = b.as_py() or b""
                lengths = cuts(content, cfg)
                offsets = [sum(lengths[:k]) for k in range(len(lengths))] if len(lengths) < 8 else _sums(lengths)
                for lo in range(0, len(lengths), 1024):
                    some = range(lo, min(lo + 1024, len(lengths)))
                    data = [content[offsets[k] : offsets[k] + lengths[k]] for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([one.as_py()] * len(data), batch.column(0).type), pa.array(list(some), pa.int32()),
                            pa.array([offsets[k] for k in some], pa.int64()), pa.array([lengths[k] for k in some], pa.int32()),
                            pa.array([hashlib.sha256(d).digest() for d in data], pa.binary()), pa.array(data, pa.binary()),
                        ],
                        ["blob_id", "chunk_idx", "offset", "length", "hash", "data"],
                    )

    kind = dict(df.dtypes)["blob_id"]
    return df.select("blob_id", "content").mapInArrow(run, f"blob_id {kind}, chunk_idx int, offset long, length int, hash binary, data binary")


def _sums(lengths: list[int]) -> list[int]:
    out, total = [], 0
    for n in lengths:
        out.append(total)
        total += n
    return out


def dedup(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, uniques): refs map every chunk to a uid, its hash's rank by first occurrence in the blob.

    Ranks are taken within runs of RUN positions and carried on from the counts of the runs before, so
    that one blob with very many chunks does not end up in one task.
    """
    first = chunks.groupBy("blob_id", "hash").agg(F.min("chunk_idx").alias("first"))
    first = first.withColumn("run", F.floor(F.col("first") / RUN))
    inside = F.row_number().over(Window.partitionBy("blob_id", "run").orderBy("first")) - 1
    before = Window.partitionBy("blob_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = first.groupBy("blob_id", "run").agg(F.count(F.lit(1)).alias("n")).select("blob_id", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = first.withColumn("inside", inside).join(runs, ["blob_id", "run"])
    ranked = ranked.select("blob_id", "hash", "first", (F.col("ahead") + F.col("inside")).alias("uid"))
    refs = chunks.drop("data").join(ranked.select("blob_id", "hash", "uid"), ["blob_id", "hash"]).select("blob_id", "chunk_idx", "uid")
    kept = ranked.withColumnRenamed("first", "chunk_idx")
    uniques = chunks.drop("hash").join(kept, ["blob_id", "chunk_idx"]).select("blob_id", "uid", "hash", "length", "data")
    return refs, uniques


def restore(refs: DataFrame, uniques: DataFrame) -> DataFrame:
    """Chunk rows (blob_id, chunk_idx, data) from references and distinct chunks."""
    return refs.join(uniques.select("blob_id", "uid", "data"), ["blob_id", "uid"]).select("blob_id", "chunk_idx", "data")


def reassemble(chunks: DataFrame) -> DataFrame:
    """(blob_id, content): the chunks of each blob in order. A blob is one value, so it fits a task."""
    ordered = F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY chunk_idx)")
    return chunks.groupBy("blob_id").agg(ordered.alias("content"))


def checked(restored: DataFrame, crc: DataFrame) -> DataFrame:
    """The restored blobs; a blob whose CRC-32 differs from (blob_id, crc) raises an error."""
    found = restored.join(crc, "blob_id")
    wrong = F.raise_error(F.concat(F.lit("CRC32 mismatch in blob "), F.col("blob_id").cast("string")))
    return found.select("blob_id", F.when(F.crc32("content") == F.col("crc"), F.col("content")).otherwise(wrong.cast("binary")).alias("content"))


def layout(sizes: DataFrame) -> DataFrame:
    """Adds ``offset`` to rows (blob_id, uid, size): the sizes of all smaller uids of the blob, run by run."""
    cut = sizes.withColumn("run", F.floor(F.col("uid") / RUN))
    within = Window.partitionBy("blob_id", "run").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("blob_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut.groupBy("blob_id", "run").agg(F.sum("size").alias("s")).select("blob_id", "run", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))
    out = cut.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(runs, ["blob_id", "run"])
    return out.withColumn("offset", F.col("ahead") + F.col("_in")).drop("run", "_in", "ahead")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per blob: total bytes, chunks, distinct chunks, duplicates and the bytes that dedup leaves."""
    per = chunks.groupBy("blob_id", "hash").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("length").cast("long")).alias("b"), F.first("length").cast("long").alias("one"))
    return per.groupBy("blob_id").agg(
        F.sum("b").alias("total_size"), F.sum("c").alias("chunks"), F.count(F.lit(1)).alias("uniques"),
        F.sum(F.col("c") - 1).alias("duplicates"), F.sum("one").alias("unique_size"),
    )
