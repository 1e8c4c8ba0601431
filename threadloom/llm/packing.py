"""Compact binary columns: several numpy arrays in one compressed value."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays with their types and lengths, compressed."""
    head = ";".join(f"{a.dtype.str},{a.size}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(";"):
        kind, size = part.split(",")
        out.append(np.frombuffer(raw, np.dtype(kind), int(size), at))
        at += out[-1].nbytes
    return out


def smallest(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the narrowest type that holds them."""
    top = int(values.max()) if values.size else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def table_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """A record batch as bytes, to be packed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def table_of(raw: np.ndarray) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(raw.tobytes())).read_all()


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indexes start .. start + count - 1, one range after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``limit`` bytes, one row at least."""
    for batch in batches:
        sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(batch[column]).to_pylist()])
        group = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def rows(schema: pa.Schema, columns: Sequence[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
