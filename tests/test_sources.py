"""The archive source and the registry."""

import os

import pytest
from pyspark.sql import functions as F

from bytemill.functions import archive
from bytemill.sources import cell, registry

ROWS = [("a/b c", b"hello " * 500), ("empty", b""), ("bin", bytes(range(256)) * 30)]


@pytest.fixture
def stored(spark, tmp_path):
    cell.register(spark)
    path = f"{tmp_path}/cells"
    spark.createDataFrame(ROWS, "blob_id string, content binary").write.format("cell").mode("append").save(path)
    return path


def test_round_trip_and_headers(spark, stored):
    assert {r["blob_id"]: bytes(r["content"]) for r in spark.read.format("cell").load(stored).collect()} == dict(ROWS)
    head = {r["blob_id"]: r for r in spark.read.format("cell").option("mode", "header").load(stored).collect()}
    assert {k: r["original_size"] for k, r in head.items()} == {k: len(b) for k, b in ROWS}
    assert os.path.exists(f"{stored}/_SUCCESS") and not [f for f in os.listdir(stored) if f.startswith("_temp")]


def test_overwrite(spark, stored):
    spark.createDataFrame(ROWS[:1], "blob_id string, content binary").write.format("cell").mode("overwrite").save(stored)
    assert spark.read.format("cell").load(stored).count() == 1


def test_pushdown_on_demand(spark, stored):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = spark.read.format("cell").option("pushdown", "true").load(stored).filter(F.col("blob_id") == "bin")
        assert [bytes(r["content"]) for r in found.collect()] == [ROWS[2][1]]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_corrupt_file_fails_the_read(spark, stored):
    with open(f"{stored}/bin.cell", "r+b") as f:
        f.seek(archive.HEADER.size + 5)
        f.write(b"\xff\xff\xff\xff")
    os.path.exists(f"{stored}/.bin.cell.crc") and os.remove(f"{stored}/.bin.cell.crc")
    with pytest.raises(Exception, match="Corrupt|Checksum|reference"):
        spark.read.format("cell").load(stored).collect()


def rows(spark, *names, start=0):
    data = [(n, f"{n}.cell", "kind", 10 + start + k, 5, 100, 1, start + k) for k, n in enumerate(names)]
    return spark.createDataFrame(data, registry.SCHEMA)


def test_registry(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    empty = registry.load(spark, path)
    assert empty.isEmpty()
    some = registry.add(empty, rows(spark, "x", "y", "z"))
    some = registry.add(some, rows(spark, "y", "w", start=10))
    assert [(r["name"], r["original_size"]) for r in some.orderBy("seq").collect()] == [("x", 10), ("y", 20), ("z", 12), ("w", 21)]
    assert registry.find(some, "y").first()["original_size"] == 20 and registry.find(some, "q").isEmpty()
    assert [r["name"] for r in registry.remove(some, "x").orderBy("seq").collect()] == ["y", "z", "w"]
    listed = registry.entries(some, 2).collect()
    assert len(listed) == 2 and {r["total"] for r in listed} == {4}
    registry.save(some, path)
    registry.save(registry.remove(registry.load(spark, path), "z"), path)  # reads what it replaces
    assert [r["name"] for r in registry.load(spark, path).orderBy("seq").collect()] == ["x", "y", "w"]
    with pytest.raises(ValueError):
        registry.save(rows(spark, "a|b"), path)


def test_registry_lines(spark):
    lines = ["# c", "", "short|x", "n|p|t|1|2|3|4|more", "m|p||x|-1| 7 |", "|p|t|1|2|3|4"]
    got = registry.parse(spark.createDataFrame([(v, k) for k, v in enumerate(lines)], "value string, seq long")).orderBy("seq").collect()
    assert [(r["name"], r["original_size"], r["compressed_size"], r["ts"], r["version"]) for r in got] == [("n", 1, 2, 3, 4), ("m", 0, 0, 7, 0), ("", 1, 2, 3, 4)]


def test_command_line(spark, tmp_path, capsys):
    from bytemill.__main__ import main

    (tmp_path / "f.txt").write_bytes(b"hello world " * 50)
    assert main(["compress", str(tmp_path / "f.txt"), "-o", str(tmp_path / "out")]) == 0
    assert "f.txt.cell" in capsys.readouterr().out
    cell_file = tmp_path / "out" / "f.txt.cell"
    assert archive.decompress(cell_file.read_bytes()) == b"hello world " * 50
    for command in ("info", "analyze"):
        assert main([command, str(cell_file)]) == 0
    assert main(["decompress", str(cell_file), "-o", str(tmp_path / "back")]) == 0
    assert (tmp_path / "back" / "f.txt").read_bytes() == b"hello world " * 50
    assert main(["compress", str(tmp_path / "f.txt")]) == 0 and (tmp_path / "f.txt.cell").exists()
    assert main(["info", str(tmp_path / "f.txt")]) == 1


@pytest.mark.parametrize("rows_", [[("a", b"one"), ("a", b"two")], [(None, b"x")], [("a", None)]])
def test_no_archive_is_lost(spark, tmp_path, rows_):
    cell.register(spark)
    df = spark.createDataFrame(rows_, "blob_id string, content binary").repartition(2)
    with pytest.raises(Exception, match="more than once|null"):
        df.write.format("cell").mode("append").save(f"{tmp_path}/cells")
    assert not [f for f in os.listdir(tmp_path / "cells") if f.endswith(".cell")] if (tmp_path / "cells").exists() else True


def test_stored_ids_are_not_replaced(spark, stored):
    with pytest.raises(Exception, match="stored already"):
        spark.createDataFrame([("bin", b"other")], "blob_id string, content binary").write.format("cell").mode("append").save(stored)
    assert {r["blob_id"]: bytes(r["content"]) for r in spark.read.format("cell").load(stored).collect()} == dict(ROWS)


def test_registry_keeps_its_order_over_files(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    names = [f"n{k}" + "x" * (k % 37) for k in range(4000)]
    data = [(n, f"{n}.cell", "kind", k, 5, 100, 1, k) for k, n in enumerate(names)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        registry.save(spark.createDataFrame(data, registry.SCHEMA).repartition(5), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len([f for f in os.listdir(tmp_path / "registry") if f.startswith("part")]) > 1
    assert [r["name"] for r in registry.load(spark, path).orderBy("seq").collect()] == names
    assert [r["name"] for r in registry.entries(registry.load(spark, path), 3).orderBy("seq").collect()] == names[:3]
