"""Incremental chunking of byte streams: rows (stream_id, seq, bytes, ended) to the chunks of each stream.

The state of a stream is the tail that no cut has taken yet, at most one largest chunk and a window, so
memory does not grow with the stream. A chunk is emitted as soon as the bytes at hand decide its cut, and
cuts equal those of the whole stream. Pieces count from seq 0; those that come early wait in state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bytemill.functions import archive, codecs
from bytemill.functions.chunker import ChunkerConfig, next_cut

OUTPUT = "stream_id string, chunk_idx long, offset long, length int, hash binary, data binary"


class InOrder(StatefulProcessor):
    """Hands on the pieces of a stream by seq, from 0 without a gap, whichever way they come.

    Pieces ahead of their turn wait in state; those whose turn has passed are repeats and are left out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "bytes binary, ended boolean")

    def due(self, rows) -> tuple[list[bytes], bool]:
        """The pieces whose turn it is, and whether the last of the stream is among them."""
        turn = self.turn.get()[0] if self.turn.exists() else 0
        come = {int(r.seq): (r.bytes or b"", bool(r.ended)) for frame in rows for r in frame.itertuples(index=False)}
        out, ended = [], False
        while True:
            if turn in come:
                piece, ended = come.pop(turn)
            elif self.waiting.containsKey((turn,)):
                piece, ended = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            else:
                break
            out.append(bytes(piece))
            turn += 1
        for seq, piece in come.items():
            if seq > turn:
                self.waiting.updateValue((seq,), piece)
        self.turn.update((turn,))
        return out, ended

    def close(self) -> None:
        pass


class ChunkProcessor(InOrder):
    def __init__(self, cfg: ChunkerConfig = ChunkerConfig()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tail = handle.getValueState("tail", "data binary, idx long, offset long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.tail.get() if self.tail.exists() else (b"", 0, 0)
        buffer, idx, offset = bytearray(held[0]), held[1], held[2]
        pieces, ended = self.due(rows)
        out = []
        for piece in pieces:
            buffer += piece
            idx, offset = self._cut(buffer, idx, offset, False, out)
        if ended:
            idx, offset = self._cut(buffer, idx, offset, True, out)
        self.tail.update((bytes(buffer), idx, offset))
        if not out:
            return
        data = [d for _, _, d in out]
        yield pd.DataFrame({
            "stream_id": [key[0]] * len(out), "chunk_idx": [k for k, _, _ in out], "offset": [o for _, o, _ in out],
            "length": np.array([len(d) for d in data], np.int32), "hash": [hashlib.sha256(d).digest() for d in data], "data": data,
        })

    def _cut(self, buffer: bytearray, idx: int, offset: int, ended: bool, out: list) -> tuple[int, int]:
        at = 0
        view = bytes(buffer)
        while at < len(view):
            n = next_cut(np.frombuffer(view, np.uint8, offset=at), self.cfg, ended)
            if n is None:
                break
            out.append((idx, offset, view[at : at + n]))
            idx, offset, at = idx + 1, offset + n, at + n
        del buffer[:at]
        return idx, offset


class ArchiveProcessor(InOrder):
    """One archive a stream, at its end; until then its pieces wait in state, one entry each."""

    def __init__(self, cfg: ChunkerConfig = ChunkerConfig()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pieces, ended = self.due(rows)
        if pieces:
            self.held.appendList([(p,) for p in pieces])
        if not ended:
            return
        content = b"".join(bytes(x[0]) for x in self.held.get())
        self.held.clear()
        yield pd.DataFrame({"stream_id": [key[0]], "archive": [archive.compress(content, codecs.recommended(content), self.cfg).to_bytes()]})


def archive_stream(rows: DataFrame, cfg: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """(stream_id, archive) of a streaming DataFrame (stream_id, seq, bytes, ended), a row when a stream ends."""
    return rows.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=ArchiveProcessor(cfg), outputStructType="stream_id string, archive binary", outputMode="Append", timeMode="None"
    )


def chunk_stream(rows: DataFrame, cfg: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Chunks of a streaming DataFrame (stream_id, seq, bytes, ended); needs the RocksDB state store."""
    return rows.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=ChunkProcessor(cfg), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def read_stream(chunks: DataFrame, stream_id: str) -> Iterator[bytes]:
    """The bytes of a stream in order, a chunk at a time, without gathering them on the driver."""
    ordered = chunks.filter(chunks["stream_id"] == stream_id).orderBy("chunk_idx").select("data")
    for row in ordered.toLocalIterator():
        yield bytes(row["data"])
