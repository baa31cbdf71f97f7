"""Operators on hand-made rows: nulls, empty values, ties, and the same results for any partitioning."""

import pytest
from pyspark.sql import functions as F

from bytemill.functions import codecs
from bytemill.functions import columns as C
from bytemill.functions.chunker import ChunkerConfig
from bytemill.operators import analysis as A
from bytemill.operators import coding as K
from bytemill.operators import segments as R
from bytemill.plans import engine
from bytemill.streaming import chunks as streams

ROWS = [(1, b""), (2, None), (3, b"aab"), (4, bytes(range(256)) * 40), (5, b"ababab" * 900)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "blob_id long, content binary")


def test_nulls_and_empty_blobs(rows):
    got = {r["blob_id"]: r for r in A.analyze(rows).collect()}
    assert got[1]["entropy"] == 0 and got[1]["stages"] == 255 and got[1]["predicted_ratio"] == 0.001
    assert got[2]["entropy"] is None and got[2]["stages"] is None and got[2]["class"] is None
    assert got[4]["class"] == C.COMPRESSED and got[5]["class"] == C.TEXT
    back = {r["blob_id"]: r["content"] for r in engine.decompress(engine.compress(rows)).collect()}
    assert back == dict(ROWS)
    assert A.byte_histogram(rows).filter("blob_id in (1, 2)").isEmpty() and R.chunk(rows).filter("blob_id in (1, 2)").isEmpty()


def test_empty_table(rows):
    none = rows.filter("false")
    for made in (A.analyze(none), A.ngrams(none), engine.compress(none), R.chunk(none), A.best_patterns(A.ngrams(none))):
        assert made.isEmpty()


def test_ties_go_by_byte(spark):
    two = spark.createDataFrame([(1, b"bbaacd")], "blob_id long, content binary")
    top = A.top_bytes(A.byte_histogram(two), 3).orderBy("rank").collect()
    assert [r["byte"] for r in top] == [97, 98, 99]
    assert A.escape_byte(A.byte_histogram(two)).first()["escape"] == 0
    full = spark.createDataFrame([(1, bytes(range(256)) * 2 + b"\x00")], "blob_id long, content binary")
    assert A.escape_byte(A.byte_histogram(full)).first()["escape"] == 1


def test_stage_masks(spark):
    cases = [(C.TEXT, 100, 9, 0x3F), (C.TEXT, 16, 9, 0xBF), (C.STRUCTURED, 17, 9, 0x7F), (C.RANDOM, 256, 9, 0x33), (C.COMPRESSED, 3, 9, 0x03), (C.TEXT, 0, 0, 0xFF)]
    df = spark.createDataFrame(cases, "kind string, d int, n int, wanted int")
    assert df.filter(C.stage_mask(F.col("kind"), F.col("d"), F.col("n")) != F.col("wanted")).isEmpty()
    exact = spark.createDataFrame([(0.9, 1.0, 3), (0.0, 7.9, 256), (0.0, 7.5, 256), (0.0, 7.95, 250)], "p double, e double, d int")
    assert [r[0] for r in exact.select(C.content_class(F.col("p"), F.col("e"), F.col("d"))).collect()] == [C.STRUCTURED, C.RANDOM, C.STRUCTURED, C.RANDOM]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_any_partitioning_gives_the_same(spark, rows, parts):
    some = rows.repartition(parts)
    chunks = R.chunk(some, ChunkerConfig(64, 128, 256))
    refs, uniques = R.dedup(chunks)
    found = {(r["blob_id"], r["chunk_idx"]): r["uid"] for r in refs.collect()}
    order: dict = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["blob_id"], r["chunk_idx"])):
        uids = order.setdefault(r["blob_id"], {})
        assert found[r["blob_id"], r["chunk_idx"]] == uids.setdefault(bytes(r["hash"]), len(uids))
    whole = {r["blob_id"]: bytes(r["content"]) for r in R.reassemble(R.restore(refs, uniques)).collect()}
    assert whole == {k: b for k, b in ROWS if b}
    top = [(bytes(r["pattern"]), r["freq"]) for r in A.best_patterns(A.ngrams(some)).orderBy("code").collect()]
    assert top == [(bytes(r["pattern"]), r["freq"]) for r in A.best_patterns(A.ngrams(rows)).orderBy("code").collect()]


def test_layout_crosses_runs(spark, monkeypatch):
    monkeypatch.setattr(R, "RUN", 10)
    sizes = spark.range(95).select(F.lit(1).alias("blob_id"), F.col("id").alias("uid"), (F.col("id") % 7).alias("size"))
    got = [r["offset"] for r in R.layout(sizes).orderBy("uid").collect()]
    assert got == [sum(k % 7 for k in range(n)) for n in range(95)]
    chunks = spark.range(95).select(F.lit(1).alias("blob_id"), F.col("id").alias("chunk_idx"), F.sha2((F.col("id") % 40).cast("string"), 256).alias("hash"), F.lit(b"x").alias("data"), F.lit(1).alias("length"))
    assert [r["uid"] for r in R.dedup(chunks)[0].orderBy("chunk_idx").collect()] == [k % 40 for k in range(95)]


def test_checksum_of_restored_blobs(spark):
    good = spark.createDataFrame([(1, b"abc")], "blob_id long, content binary")
    assert R.checked(good, good.select("blob_id", F.crc32("content").alias("crc"))).first()["content"] == b"abc"
    with pytest.raises(Exception, match="CRC32 mismatch in blob 1"):
        R.checked(good, good.select("blob_id", F.lit(5).cast("long").alias("crc"))).collect()


def test_deltas(spark):
    import random

    base = random.Random(1).randbytes(4000)
    chunks = [(1, k, base[:-1] + bytes([k])) for k in range(5)] + [(1, 5, b"short"), (2, 0, base)]
    df = spark.createDataFrame(chunks, "blob_id long, uid long, data binary")
    made = K.delta_encode(df).collect()
    assert sorted((r["blob_id"], r["uid"]) for r in made if r["kind"] == "FULL") == [(1, 0), (1, 5), (2, 0)]
    assert all(r["ref_uid"] == 0 and len(r["data"]) < 100 for r in made if r["kind"] == "DELTA")
    back = {(r["blob_id"], r["uid"]): bytes(r["data"]) for r in K.delta_decode(K.delta_encode(df)).collect()}
    assert back == {(b, u): d for b, u, d in chunks}


@pytest.mark.parametrize("group", [K.GROUP, 3])
def test_deltas_look_at_all_earlier_chunks(spark, monkeypatch, group):
    import random

    monkeypatch.setattr(K, "GROUP", group)
    monkeypatch.setattr(K, "similarity_hash", lambda c: F.lit("same"))
    rng = random.Random(2)
    bases = [rng.randbytes(600) for _ in range(3)]
    chunks = [(b, 15_001 * k, bases[(k * 7) % 3 if k > 2 else k // 2][:-2] + bytes([k, k])) for b in (1, None) for k in range(12)]
    want, whole = {}, {}
    for b, u, d in chunks:
        runs = [(len(x), v, x) for v, w in whole.get(b, []) if (x := codecs.delta_against(w, d)) is not None]
        want[b, u] = ("DELTA", min(runs)[1], min(runs)[2]) if runs else ("FULL", None, d)
        if not runs:
            whole.setdefault(b, []).append((u, d))
    made = K.delta_encode(spark.createDataFrame(chunks, "blob_id long, uid long, data binary")).collect()
    assert {(r["blob_id"], r["uid"]): (r["kind"], r["ref_uid"], bytes(r["data"])) for r in made} == want


def test_escape_byte_of_the_whole_corpus(spark):
    body = bytes(b for b in range(256) if b != 7) * 300  # 7 comes behind the first 64 KB only, more often than others
    df = spark.createDataFrame([(1, body + bytes([7]) * 400)], "blob_id long, content binary")
    assert K.corpus_genome(df, 3).escape == 0


def test_permissive_decompression(spark, rows):
    made = engine.compress(rows.filter("blob_id = 5")).first()["archive"]
    bad = spark.createDataFrame([(1, bytes(made)), (2, b"no archive"), (3, b""), (4, None), (5, bytes(made)[:-1] + b"?")], "blob_id long, archive binary")
    got = {r["blob_id"]: r["error_code"] for r in engine.decompress(bad, permissive=True).collect()}
    assert got == {1: 0, 2: -3, 3: -1, 4: None, 5: -4}
    with pytest.raises(Exception, match="CorruptData|Checksum|header|magic"):
        engine.decompress(bad).collect()


def test_header_reads_little(spark, rows):
    h = engine.compress(rows).select("blob_id", engine.header(F.col("archive")).alias("h")).select("blob_id", "h.*")
    got = {r["blob_id"]: r for r in h.collect()}
    assert got[5]["original_size"] == 5400 and got[5]["version"] == 2 and got[2]["version"] is None and got[1]["chunk_count"] == 0


@pytest.mark.parametrize("late", [False, True])
def test_streams_equal_whole_blobs(spark, tmp_path, late):
    import random

    from bytemill.functions import archive

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    data = {k: random.Random(k).randbytes(9000) for k in ("a", "b")}
    pieces = [(k, seq, d[at : at + 2500], at + 2500 >= len(d)) for k, d in data.items() for seq, at in enumerate(range(0, len(d), 2500))]
    schema = "stream_id string, seq long, bytes binary, ended boolean"
    for n in (2, 0, 3, 0, 1) if late else range(4):  # a file, and so a micro-batch, for each round of pieces; late: out of turn and twice
        spark.createDataFrame([p for p in pieces if p[1] == n], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    cfg = ChunkerConfig(256, 512, 1024)
    sink = streams.chunk_stream(source, cfg).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    chunks = spark.read.parquet(f"{tmp_path}/out")
    whole = R.chunk(spark.createDataFrame(list(data.items()), "blob_id string, content binary"), cfg)
    key = lambda rows: sorted((r[0], r["chunk_idx"], r["offset"], r["length"], bytes(r["hash"])) for r in rows)
    assert key(chunks.collect()) == key(whole.collect())
    assert b"".join(streams.read_stream(chunks, "a")) == data["a"]
    sink = streams.archive_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/cells").option("checkpointLocation", f"{tmp_path}/state2")
    sink.trigger(availableNow=True).start().awaitTermination()
    made = {r["stream_id"]: bytes(r["archive"]) for r in spark.read.parquet(f"{tmp_path}/cells").collect()}
    assert {k: archive.decompress(raw) for k, raw in made.items()} == data


def test_stage_mask_of_one_content(spark):
    import random

    cases = [b"", b"aab", b"some text here, and there", bytes(range(256)) * 40, random.Random(1).randbytes(70_000), bytes(range(200)) * 9, bytes(x % 190 for x in random.Random(2).randbytes(5000))]
    df = spark.createDataFrame(list(enumerate(cases)), "blob_id long, content binary")
    assert {r["blob_id"]: r["stages"] for r in A.analyze(df).collect()} == {k: codecs.recommended(c) for k, c in enumerate(cases)}
