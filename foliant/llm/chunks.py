"""Chunks: a table of documents by the slice, packed, that several passes read; and the exchange of keys between them.

A pass that needs something about every key of its chunk from all other chunks sends each key once a chunk, however
often it occurs there, so no key is hot: a bucket of the exchange gets at most as many copies of a key as there are
chunks. What the bucket finds goes back in the order of the keys sent.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, release, slices, stored

CHUNK_BYTES = 8 << 20


def packed_batch(batch: pa.RecordBatch, level: int = 3) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as w:
        w.write_batch(batch)
    return out.getvalue()


def chunk_rows(most: int = CHUNK_BYTES, level: int = 3):
    """A map of batches to chunk (distinct), size (bytes of text), body (all columns of a slice, packed)."""

    def run(batches):
        number = TaskContext.get().partitionId() << 16
        for whole in batches:
            for piece in slices(whole, "text", most):
                size = piece.column("text").nbytes
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([packed_batch(piece, level)], pa.binary())], names=["chunk", "size", "body"])
                number += 1
            del whole, piece
            release()

    return run


def chunk_table(docs: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of docs, written once."""
    return stored(docs.mapInArrow(chunk_rows(most), "chunk long, size long, body binary"), packed=True)


def unpack(body) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.BufferReader(body)).read_next_batch()


def buckets(chunks: DataFrame, each: int = 32 << 20) -> int:
    """How many buckets keep each at about what that many bytes of text give."""
    return int(max(1, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // each)))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Sorted 64-bit keys to n ranges of equal width."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack_array(blob, dtype, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(blob, n * np.dtype(dtype).itemsize, codec="zstd"), dtype)


def split(keys: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """(bucket, where) of sorted keys."""
    at = bucket_of(keys, n)
    edges = np.searchsorted(at, np.arange(n + 1))
    return [(b, slice(int(edges[b]), int(edges[b + 1]))) for b in range(n) if edges[b + 1] > edges[b]]
