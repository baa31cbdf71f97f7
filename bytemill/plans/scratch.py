"""Tables written to the cluster's shared folder, which cut lineage and outlive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "bytemill-scratch")).rstrip("/")


def stage(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written; ``few``: rows that fit one file by a proven bound."""
    path = f"{shared_dir(df.sparkSession)}/bytemill/{tag}-{uuid.uuid4().hex}"
    (df.repartition(1) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files behind staged tables that no later job will read."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if "/bytemill/" in str(path):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finish(df: DataFrame, tag: str, *used: DataFrame) -> DataFrame:
    """Stage a small result and forget the staged tables that it was made from."""
    out = stage(df, tag)
    forget(*used)
    return out


#: Bytes a core up to which an input counts as small.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores: a file of one row group is one task otherwise. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL * cores else df


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let a batch that goes to Python have ``rows`` whole texts, a few MB, where the session has Spark's own 10,000 rows.

    A plan reads this when it runs, so it stays set for the session; a value of the user's own is left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def put_on_path(spark: SparkSession) -> None:
    """Let Python workers started from here on import this package from its own folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
