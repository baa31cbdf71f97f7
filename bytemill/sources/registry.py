"""The registry of stored artifacts: a table with upsert, find, remove and list, and its text form.

Rows are (name, path, model_type, original_size, compressed_size, ts, version); ``seq`` keeps their order.
The text form has one line a row, fields parted by a bar, and comment lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("name", "path", "model_type", "original_size", "compressed_size", "ts", "version")
SCHEMA = "name string, path string, model_type string, original_size long, compressed_size long, ts long, version long, seq long"
HEAD = ("# artifact registry", "# " + "|".join(FIELDS))


def parse(lines: DataFrame) -> DataFrame:
    """Rows from lines (value, seq): blank, comment and short lines are skipped, further fields ignored."""
    parts = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("p", F.split("value", "[|]", -1))
    parts = parts.filter(F.size("p") >= 7)
    text = [F.col("p")[k].alias(n) for k, n in enumerate(FIELDS[:3])]
    numbers = [F.coalesce(F.regexp_extract(F.col("p")[k + 3], r"^\s*(\d{1,18})", 1).try_cast("long"), F.lit(0).cast("long")).alias(n) for k, n in enumerate(FIELDS[3:])]
    return parts.select(*text, *numbers, "seq")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The registry at ``path``, empty if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    lines_ = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    ahead, seen = [], 0
    for r in lines_.groupBy("_file").count().orderBy("_file").collect():  # a row for each file; save() names them in order
        ahead.append((r["_file"], seen))
        seen += r["count"]
    before = F.broadcast(spark.createDataFrame(ahead, "_file string, _ahead long"))
    inside = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return parse(lines_.withColumn("_nth", inside).join(before, "_file").select("value", (F.col("_ahead") + F.col("_nth")).alias("seq")))


def lines(registry: DataFrame) -> DataFrame:
    """(seq, value): the text form's rows in order, without the comment lines."""
    return registry.select("seq", F.concat_ws("|", *FIELDS).alias("value"))


def save(registry: DataFrame, path: str) -> None:
    """Write beside ``path`` and swap, so that what is being read is never overwritten."""
    spark = registry.sparkSession
    bad = registry.filter(F.concat("name", "path", "model_type").rlike(r"[|\n\r]") | (F.octet_length("name") > 255)).limit(1).collect()
    if bad:
        raise ValueError(f"a field holds a bar or a line break, or its name is too long: {bad[0]['name']!r}")
    head = spark.createDataFrame([(k - len(HEAD), v) for k, v in enumerate(HEAD)], "seq long, value string")
    fresh = f"{path}.{uuid.uuid4().hex}"
    head.unionByName(lines(registry)).repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop.Path(f"{fresh}.old")
    if store.exists(hadoop.Path(path)):
        store.rename(hadoop.Path(path), old)
    store.rename(hadoop.Path(fresh), hadoop.Path(path))
    store.delete(old, True)


def add(registry: DataFrame, more: DataFrame) -> DataFrame:
    """Upsert by name: the newest values at the place of the first; a later ``seq`` is newer."""
    rows = registry.unionByName(more)
    newest = F.max_by(F.struct(*FIELDS[1:]), "seq")
    return rows.groupBy("name").agg(newest.alias("v"), F.min("seq").alias("seq")).select("name", "v.*", "seq")


def find(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.col("name") == name).limit(1)


def remove(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(~F.col("name").eqNullSafe(F.lit(name)))


def entries(registry: DataFrame, most: int) -> DataFrame:
    """The first ``most`` in order, each with the total number."""
    total = registry.agg(F.count(F.lit(1)).alias("total"))
    return registry.orderBy("seq").limit(most).join(F.broadcast(total))
