"""A data source for folders of .cell archives: ``spark.read.format("cell")`` and ``df.write.format("cell")``.

Files go through pyarrow's file systems, so a path may name any store that those reach and that all
executors share. Reading lists the files on the driver and deals them out, large ones first; with option
``mode`` = ``header`` only the first 40 bytes of each are read. With option ``pushdown`` = ``true`` and
spark.sql.python.filterPushdown.enabled, equality on blob_id prunes files. Writing goes to one temporary
folder and is moved into place on commit; _SUCCESS marks the end. Null ids or contents, ids that come twice,
and in append mode ids that are stored already are errors, and nothing is written then.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from bytemill.functions import archive
from bytemill.functions import columns as C

#: Bytes of contents that are coded at a time.
TOGETHER = 8 << 20
CONTENT = "blob_id string, content binary"
HEADER = "blob_id string, version int, flags int, stages int, original_size long, payload_size long, chunk_count long, unique_count long, genome_size long, original_crc32 long"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is local to the process that opens it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


class CellReader(DataSourceReader):
    #: Bytes of archives that one task takes.
    SHARE = 64 << 20

    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "content")
        self.only: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        store, top = open_store(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(top)) if f.is_file and f.base_name.endswith(".cell")]
        if self.only is not None:
            found = [f for f in found if unquote(f.base_name[:-5]) in self.only]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: -f.size):
            held.append(f.path)
            size += f.size if self.mode == "content" else 4096
            if size >= self.SHARE:
                out.append(Files(held))
                held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = open_store(self.path)
        raws: list[tuple[str, bytes]] = []
        for name in partition.value:
            blob_id = unquote(name.rpartition("/")[2][:-5])
            with store.open_input_file(name) as f:
                if self.mode == "header":
                    a = archive.Archive.header(f.read(archive.HEADER.size))
                    yield (blob_id, a.version, a.flags, a.stages, a.original_size, a.payload_size, *a.counts, a.genome_size, a.original_crc)
                else:
                    raws.append((blob_id, f.read()))
            if sum(len(r) for _, r in raws) > TOGETHER:
                yield from self._restored(raws)
                raws = []
        yield from self._restored(raws)

    def _restored(self, raws: list[tuple[str, bytes]]) -> Iterator[tuple]:
        yield from zip([b for b, _ in raws], archive.decompress_many([r for _, r in raws]), strict=True)


class PruningCellReader(CellReader):
    """Only used on demand: Spark rejects a reader with pushFilters while its own setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("blob_id",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            yield f  # Spark checks again


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class CellWriter(DataSourceWriter):
    """Columns blob_id and content, and stages if there is one; otherwise all stages are tried."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite, self.run = options["path"], schema.names, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, top = open_store(self.path)
        store.create_dir(f"{top}/_temporary-{self.run}", recursive=True)
        made, held, size = [], [], 0

        def put() -> None:
            contents = [bytes(r["content"]) for r in held]
            masks = [r["stages"] if "stages" in self.names else C.ALL_STAGES for r in held]
            for row, a in zip(held, archive.compress_many(contents, masks), strict=True):
                name = quote(str(row["blob_id"]), safe="")
                part = f"_temporary-{self.run}/{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(f"{top}/{part}") as f:
                    f.write(a.to_bytes())
                made.append((name, part))

        for row in rows:
            if row["blob_id"] is None or row["content"] is None:
                raise ValueError("an archive needs an id and a content; a row has a null there")
            held.append(row)
            size += len(row["content"])
            if size > TOGETHER:
                put()
                held, size = [], 0
        put()
        return Written(made)

    def commit(self, messages: list) -> None:
        store, top = open_store(self.path)
        names = [name for m in messages if m for name, _ in m.names]
        if twice := [n for n, k in Counter(names).items() if k > 1]:
            raise ValueError(f"{len(twice)} ids come more than once, {unquote(twice[0])!r} is one")
        if not self.overwrite:
            there = {f.base_name[:-5] for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.is_file and f.base_name.endswith(".cell")}
            if there & set(names):
                raise FileExistsError(f"{unquote(min(there & set(names)))!r} is stored already")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if f.is_file and f.base_name.endswith(".cell"):
                    store.delete_file(f.path)
        store.create_dir(top, recursive=True)
        for m in messages:
            for name, part in m.names if m else ():
                store.move(f"{top}/{part}", f"{top}/{name}.cell")
        self._clear(store, top)
        store.open_output_stream(f"{top}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        self._clear(*open_store(self.path))

    def _clear(self, store: fs.FileSystem, top: str) -> None:
        if store.get_file_info(f"{top}/_temporary-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/_temporary-{self.run}")


class CellSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cell"

    def schema(self) -> str:
        return HEADER if self.options.get("mode") == "header" else CONTENT

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PruningCellReader if self.options.get("pushdown", "false").lower() == "true" else CellReader
        return kind(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return CellWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CellSource)
