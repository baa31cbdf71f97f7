"""python -m bytemill compress|decompress|analyze|info FILE... [-o FOLDER]

compress writes FILE.cell and decompress the restored file, each beside its source or into FOLDER.
"""

from __future__ import annotations

import argparse
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.functions import columns as C
from bytemill.operators import analysis
from bytemill.plans import engine
from bytemill.plans.scratch import put_on_path, stage
from bytemill.sources.cell import open_store


def write_files(df: DataFrame, name: str, content: str) -> DataFrame:
    """Write each row's bytes to the file that it names, and return the other columns."""
    shown = [c for c in df.columns if c != content]

    def put(batches):
        for batch in batches:
            for path, raw in zip(batch.column(name), batch.column(content), strict=True):
                store, at = open_store(path.as_py())
                store.create_dir(at.rpartition("/")[0] or ".", recursive=True)
                with store.open_output_stream(at) as f:
                    f.write(raw.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in shown], shown)

    return stage(df.mapInArrow(put, df.select(*shown).schema), "written")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="bytemill", description=__doc__)
    p.add_argument("command", choices=("compress", "decompress", "analyze", "info"))
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--output", help="folder for the files that are written")
    asked = p.parse_args(args)
    spark = SparkSession.builder.appName("bytemill").getOrCreate()
    put_on_path(spark)

    def placed(path: Column) -> Column:
        if not asked.output:
            return path
        return F.concat(F.lit(asked.output.rstrip("/") + "/"), F.element_at(F.split(path, "/"), -1))

    try:
        files = spark.read.format("binaryFile").load(asked.files).select(F.col("path").alias("blob_id"), "content")
        if asked.command == "compress":
            out = engine.compress(files).withColumn("name", placed(C.archive_name(F.col("blob_id"))))
            shown = out.select("name", "archive", "class", "stages", C.size_text(F.col("original_size")).alias("original"), C.size_text(F.col("compressed_size")).alias("compressed"), "ratio", "chunk_count", "unique_count")
            shown = write_files(shown, "name", "archive")
        elif asked.command == "decompress":
            out = engine.decompress(files, "content").withColumn("name", placed(C.restored_name(F.col("blob_id"))))
            shown = write_files(out.select("name", F.octet_length("content").alias("bytes"), "content"), "name", "content")
        elif asked.command == "analyze":
            shown = analysis.analyze(files)
        else:
            shown = files.select("blob_id", engine.header(F.col("content")).alias("h")).select("blob_id", "h.*")
        shown.show(100, False)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
