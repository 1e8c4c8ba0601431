"""Byte-level BPE: each distinct word of the corpus is encoded once, ids are joined back.

Pre-tokens are exploded with their positions inside chunks of documents: a chunk
keeps the positions as a stream of numbers into its own word list, and the word
lists go through one global shuffle by word. A word meets all chunks that hold it
in one partition, is encoded there once, and its ids return to the chunks, where
the position stream puts them in order.

A chunk numbers its words by falling frequency, those that occur once in the order
of their occurrence. Most positions then are one small byte, and a word that
occurs once needs no number: it is the next of its kind.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.packing import pack, rows, slices, smallest, spans, table_bytes, table_of, unpack
from threadloom.session import staging_path

# Bytes of text in a chunk, whose word list and positions are held in memory, and
# in each of its bodies, whose texts and ids are.
CHUNK_BYTES = 32 << 20
BODY_BYTES = 1 << 20
# Rows of a chunk: its words (later their ids) by bucket, the buckets of its words
# in order, and its bodies in order.
_IDS, _HEAD, _BODY = 0, 1, 2
_ONCE, _MORE = 254, 255  # marks in a position stream: the next word that occurs once; a larger number
_PARTS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("kind", T.IntegerType()),
    ]
)
_ARROW = pa.schema(
    [("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("kind", pa.int32())]
)


def read_vocabulary(path: str) -> bytes:
    """The file of base64 tokens and ranks, about 50,000 lines."""
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def _ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> tiktoken.Encoding:
    """Merges by rank. The pattern takes any text whole: words come already cut."""
    return tiktoken.Encoding("words", pat_str="[\\s\\S]+", mergeable_ranks=_ranks(vocabulary), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes in a row, and the start and length of each id."""
    ranks = _ranks(vocabulary)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


class _Chunk:
    """Words and positions of one chunk while its texts are read."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.bodies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, keys: np.ndarray, texts: list[str | None], find: Callable[[str], list[str]]) -> None:
        place = self.place
        streams = []
        for text in texts:
            found = find(text) if text else []
            for word in found:
                if word not in place:
                    place[word] = len(place)
            streams.append(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)))
        counts = np.array([s.size for s in streams], np.int64)
        self.bodies.append((keys, counts, np.concatenate(streams)))

    def rows(self, chunk: int, buckets: int) -> Iterator[tuple[int, int, bytes, int]]:
        times = sum((np.bincount(s, minlength=len(self.place)) for _, _, s in self.bodies), np.zeros(len(self.place), int))
        once = times == 1
        often = np.flatnonzero(~once)
        order = np.concatenate([often[np.argsort(-times[often], kind="stable")], np.flatnonzero(once)])
        number = np.empty(order.size, np.uint32)
        number[order] = np.arange(order.size)
        words = list(self.place)
        self.place = {}
        words = [words[i].encode() for i in order.tolist()]
        bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        lengths = np.array([len(w) for w in words], np.uint32)
        grouped = np.argsort(bucket, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(bucket[grouped])) + 1).tolist(), grouped.size]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                mine = grouped[a:b]
                letters = np.frombuffer(b"".join([words[i] for i in mine.tolist()]), np.uint8)
                yield chunk, int(bucket[mine[0]]), pack(smallest(lengths[mine]), letters), _IDS
        yield chunk, 0, pack(smallest(bucket), np.array([often.size])), _HEAD
        del words, grouped
        for i, (keys, counts, stream) in enumerate(self.bodies):
            n = number[stream]
            single = n >= often.size
            marks = np.where(single, _ONCE, np.minimum(n, _MORE)).astype(np.uint8)
            marks[~single & (n == _ONCE)] = _MORE
            large = n[marks == _MORE]
            body = pack(keys, smallest(counts), marks, (large & 0xFFFF).astype(np.uint16), smallest(large >> 16))
            yield chunk, i, body, _BODY


def _explode(pattern: str, keys: Sequence[str], buckets: int, chunk_bytes: int, body_bytes: int):
    """Chunks of documents: their words by bucket and their position streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk()
        for batch in slices(batches, "_text", body_bytes):
            chunk.add(table_bytes(batch.select(keys)), batch["_text"].to_pylist(), find)
            chunk.bytes += batch["_text"].nbytes
            if chunk.bytes >= chunk_bytes:
                yield from _out(chunk.rows(number, buckets))
                chunk, number = _Chunk(), number + 1
        if chunk.bodies:
            yield from _out(chunk.rows(number, buckets))

    return run


def _out(found: Iterator[tuple[int, int, bytes, int]]) -> Iterator[pa.RecordBatch]:
    for row in found:
        yield rows(_ARROW, [[x] for x in row])


def _encode_words(vocabulary: bytes):
    """Replace the words of each chunk by their ids; a word's ids are found once per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode_ordinary
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            out = []
            for chunk, bucket, payload, kind in zip(*batch.to_pydict().values(), strict=True):
                lengths, letters = unpack(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = letters.tobytes()
                ids = []
                for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                    word = raw[a:b]
                    if (got := known.get(word)) is None:
                        got = known[word] = np.array(encode(word.decode()), np.uint32)
                    ids.append(got)
                counts = np.array([x.size for x in ids], np.uint32)
                out.append((chunk, bucket, pack(smallest(counts), smallest(np.concatenate(ids))), kind))
            yield rows(_ARROW, list(zip(*out, strict=True)))

    return run


def _assemble(schema: pa.Schema):
    """Put the ids of each chunk in order; its words come before its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            for payload, kind in zip(batch["payload"].to_pylist(), batch["kind"].to_pylist(), strict=True):
                if kind == _IDS:
                    parts.append(unpack(payload))
                elif kind == _HEAD:
                    bucket, (often,) = unpack(payload)
                    counts, starts = np.zeros(bucket.size, np.int64), np.zeros(bucket.size, np.int64)
                    flat = np.zeros(0, "<u4")
                    if parts:
                        # The ids of a bucket are in the order of the chunk's words.
                        order = np.argsort(bucket, kind="stable")
                        sizes = np.concatenate([p[0] for p in parts]).astype(np.int64)
                        counts[order], starts[order] = sizes, np.cumsum(sizes) - sizes
                        flat = np.concatenate([p[1].astype("<u4") for p in parts])
                    parts, single = [], int(often)
                else:
                    keys, docs, marks, low, high = unpack(payload)
                    stream = marks.astype(np.int64)
                    stream[marks == _MORE] = low.astype(np.int64) | high.astype(np.int64) << 16
                    once = np.flatnonzero(marks == _ONCE)
                    stream[once] = single + np.arange(once.size)
                    single += once.size
                    yield whole(table_of(keys), docs, starts[stream], counts[stream], flat)

    def whole(keys: pa.Table, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        raw = flat[spans(starts, sizes)].tobytes()
        total = np.concatenate([[0], np.cumsum(sizes)])
        bounds = total[np.concatenate([[0], np.cumsum(docs, dtype=np.int64)])]
        edges = bounds.tolist()
        tokens = pa.array([raw[4 * a : 4 * b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [*[keys[c].combine_chunks() for c in schema.names], pa.array(np.diff(bounds), pa.int64()), tokens],
            names=[*schema.names, "n_tokens", "token_ids"],
        )

    return run


def encode(
    docs: DataFrame, vocabulary: bytes, pattern: str, keys: Sequence[str] = ("doc_id",), text: str = "text",
    buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES, body_bytes: int = BODY_BYTES,
) -> DataFrame:
    """Token ids of every text: ``keys``, ``n_tokens`` and ``token_ids``.

    ``token_ids`` holds unsigned 32-bit little-endian numbers. Every match of
    ``pattern`` is encoded on its own, without special tokens. A null or empty
    text has no tokens. Repeated rows are encoded each; an empty table gives an
    empty one. Words are dealt into ``buckets`` partitions (the session's number
    of shuffle partitions), so no word or source is a hot key: a word arrives once
    per chunk. A text longer than ``body_bytes`` is a body of its own.
    """
    spark = docs.sparkSession
    deal = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("_text"))
    path = staging_path(spark, "words")
    parts = slim.mapInArrow(_explode(pattern, list(keys), deal, chunk_bytes, body_bytes), _PARTS)
    # Chunk numbers depend on how the input was split, so they are written once.
    parts.write.partitionBy("kind").parquet(path)
    kept = spark.read.schema(_PARTS).parquet(path).select(*_PARTS.names)
    words = kept.filter(F.col("kind") == _IDS).repartition(deal, "bucket")
    ids = words.mapInArrow(_encode_words(vocabulary), _PARTS)
    whole = ids.unionByName(kept.filter(F.col("kind") != _IDS))
    ordered = whole.repartition(deal, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    columns = [slim.schema[k] for k in keys]
    out = T.StructType([*columns, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])
    names = pa.schema([(k, pa.null()) for k in keys])
    return ordered.mapInArrow(_assemble(names), out)


def decode(tokens: DataFrame, vocabulary: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Replace the ids by the bytes they stand for.

    The token-byte table has the size of the vocabulary and is joined in memory.
    Null ids give null, no ids give no bytes, unknown ids raise an error.
    """
    at = tokens.columns.index(ids)
    schema = T.StructType(
        [f if i != at else T.StructField(out, T.BinaryType()) for i, f in enumerate(tokens.schema.fields)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, starts, lengths = _token_bytes(vocabulary)
        for batch in slices(batches, ids, BODY_BYTES):
            values = batch[ids].to_pylist()
            flat = np.frombuffer(b"".join(v or b"" for v in values), "<u4").astype(np.int64)
            sizes = lengths[flat]
            raw = letters[spans(starts[flat], sizes)].tobytes()
            total = np.concatenate([[0], np.cumsum(sizes)])
            ends = np.cumsum([len(v or b"") // 4 for v in values])
            edges = total[np.concatenate([[0], ends]).astype(np.int64)].tolist()
            pairs = zip(values, edges, edges[1:], strict=False)
            got = [None if v is None else raw[a:b] for v, a, b in pairs]
            columns = [c if i != at else pa.array(got, pa.binary()) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return tokens.mapInArrow(run, schema)
