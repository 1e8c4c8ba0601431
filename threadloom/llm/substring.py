"""Repeated passages: compressed FM-indexes over shards of first occurrences.

A window is ``size`` consecutive words. Its anchor is the smallest hash among its
runs of ``grain`` words, so equal windows have equal anchors, and neighbouring
windows mostly share theirs. One shuffle by anchor finds, for every anchor that
more than one document holds, the first of them. Only windows with such an anchor
go on: those of the anchor's first document are indexed, those of later documents
are streamed against the one shard that holds that document. Backward search
gives for every streamed word the longest run that occurs in the index, and runs
of ``size`` words and more are the repeats.

A window of a later document may still have its first occurrence elsewhere, if
the first document holds its anchor in other surroundings. Windows that were not
found go through the same steps once more with the whole window as the anchor,
which leaves no such case. So every document meets one shard per passage, not
all shards, and the work is in proportion to the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom.llm.common import without
from threadloom.llm.fm_index import FMIndex
from threadloom.llm.hashing import WordHashes, run_hashes, split_words
from threadloom.llm.packing import pack, rows, slices, smallest, table_bytes, table_of, unpack
from threadloom.session import staging_path

CHUNK_BYTES = 4 << 20  # text in a chunk of documents
SHARD_WORDS = 4 << 20  # words of the corpus for each shard; what is indexed is less
STREAM_WORDS = 1 << 20  # streamed words searched at a time
PIECE_WINDOWS = 64  # windows in a streamed piece
HOT_SHARE = 1000  # a shard with more than this part of the streamed words is copied

# Every table of the steps has these columns: what the row is, the chunk of
# documents it came from, where it is dealt to, its words, and packed arrays.
BODY, ANCHORS, SHARED, SOURCE, QUERY, FOUND, LEFT = range(7)
_ROW = T.StructType(
    [
        T.StructField("chunk", T.LongType()), T.StructField("part", T.LongType()),
        T.StructField("deal", T.LongType()), T.StructField("words", T.LongType()),
        T.StructField("payload", T.BinaryType()), T.StructField("kind", T.IntegerType()),
    ]
)
_ARROW = pa.schema(
    [("chunk", pa.int64()), ("part", pa.int64()), ("deal", pa.int64()), ("words", pa.int64()),
     ("payload", pa.binary()), ("kind", pa.int32())]
)
Row = tuple[int, int, int, int, bytes, int]


@dataclass
class Segments:
    """Runs of words: the document's id, its row in the chunk, the first word's place, lengths, word hashes."""

    ids: np.ndarray
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    words: np.ndarray

    def packed(self) -> bytes:
        # Within a few thousand words many repeat, so words are numbers into a list.
        vocabulary, index = np.unique(self.words, return_inverse=True)
        return pack(self.ids, smallest(self.row), smallest(self.start), smallest(self.length), vocabulary, smallest(index))

    @staticmethod
    def of(payload: bytes) -> Segments:
        ids, row, start, length, vocabulary, index = unpack(payload)
        wide = [x.astype(np.int64) for x in (row, start, length)]
        return Segments(ids, *wide, vocabulary[index])

    @staticmethod
    def joined(parts: list[Segments]) -> Segments:
        names = ("ids", "row", "start", "length", "words")
        return Segments(*[np.concatenate([getattr(p, n) for p in parts]) for n in names])

    def cut(self, segment: np.ndarray, offset: np.ndarray, length: np.ndarray) -> Segments:
        """Sub-runs: of which segment, from which of its words, how long."""
        first = np.cumsum(self.length) - self.length
        at = first[segment] + offset
        total = np.cumsum(length)
        index = np.repeat(at - (total - length), length) + np.arange(total[-1] if total.size else 0)
        return Segments(self.ids[segment], self.row[segment], self.start[segment] + offset, length, self.words[index])


def _windows(s: Segments, size: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, offset and anchor of every window; none crosses two segments."""
    runs = run_hashes(s.words, grain)
    count = size - grain + 1
    width = 1
    while width < count:  # the minimum of ``count`` successive runs, from doubled widths
        step = min(width, count - width)
        runs = np.minimum(runs[:-step], runs[step:]) if runs.size > step else runs[:0]
        width += step
    segment = np.repeat(np.arange(s.length.size), s.length)
    offset = np.arange(s.words.size) - np.repeat(np.cumsum(s.length) - s.length, s.length)
    whole = np.flatnonzero(offset + size <= np.repeat(s.length, s.length))
    return segment[whole], offset[whole], runs[whole]


def _deal(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _shard(ids: np.ndarray, n: int) -> np.ndarray:
    mixed = run_hashes(ids.astype(np.int64).view(np.uint64), 1)
    return _deal(mixed, n)


def _anchor_rows(load: Callable[[bytes], Segments], size: int, grain: int, deal: int):
    """The distinct anchors of each chunk with the smallest and largest id that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part, payload in _values(batches):
            s = load(payload)
            segment, _, anchor = _windows(s, size, grain)
            change = np.ones(anchor.size, bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
            anchor, ids = anchor[change], s.ids[segment[change]]
            if not anchor.size:
                continue
            order = np.argsort(anchor, kind="stable")
            anchor, ids = anchor[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
            anchor = anchor[first]
            bucket = _deal(anchor, deal)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), anchor.size]
            base = int(low.min())
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                body = pack(np.diff(anchor[a:b], prepend=np.uint64(0)), np.array([base]), _near(low[a:b] - base), _near(high[a:b] - low[a:b]))
                out.append((chunk, part, int(bucket[a]), b - a, body, ANCHORS))
            yield _batch(out)

    return run


def _near(values: np.ndarray) -> np.ndarray:
    return smallest(values) if not values.size or int(values.max()) < 1 << 32 else values


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for value in zip(*[batch[c].to_pylist() for c in ("chunk", "part", "payload")], strict=True):
            yield value


def _batch(out: list[Row]) -> pa.RecordBatch:
    return rows(_ARROW, list(zip(*out, strict=True)) if out else [[] for _ in _ARROW])


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, Iterator]]:
    """Rows of sorted batches, one group of equal columns after the other, as they come."""

    def each() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield {c: batch[c][i].as_py() for c in batch.schema.names}

    return groupby(each(), key=lambda r: tuple(r[c] for c in columns))


def _share_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: the anchors that several documents hold, returned to their chunks with the first id."""
    for (deal,), members in _groups(batches, "deal"):
        chunks, parts, anchors, lows, highs, sizes = [], [], [], [], [], []
        for r in members:
            steps, base, low, more = unpack(r["payload"])
            chunks.append(r["chunk"])
            parts.append(r["part"])
            anchors.append(np.cumsum(steps, dtype=np.uint64))
            lows.append(low.astype(np.int64) + base[0])
            highs.append(lows[-1] + more.astype(np.int64))
            sizes.append(steps.size)
        anchor, low, high = (np.concatenate(x) for x in (anchors, lows, highs))
        order = np.argsort(anchor, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(anchor[order]) != 0]))
        least = np.minimum.reduceat(low[order], first)
        shared = least != np.maximum.reduceat(high[order], first)
        of = np.empty(anchor.size, np.int64)
        of[order] = np.repeat(np.arange(first.size), np.diff(np.concatenate([first, [anchor.size]])))
        keep, least = shared[of], least[of]
        out, at = [], 0
        for chunk, part, n in zip(chunks, parts, sizes, strict=True):
            mine = keep[at : at + n]
            if mine.any():
                a, m = anchor[at : at + n][mine], least[at : at + n][mine]
                out.append((chunk, part, deal, a.size, pack(np.diff(a, prepend=np.uint64(0)), m), SHARED))
            at += n
        if out:
            yield _batch(out)


def _piece_rows(load: Callable[[bytes], Segments], size: int, grain: int, shards: int):
    """Windows with a shared anchor: runs to index, and pieces to stream, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _), members in _groups(batches, "chunk", "part"):
            anchors, firsts = [], []
            for r in members:
                if r["kind"] == SHARED:
                    steps, first = unpack(r["payload"])
                    anchors.append(np.cumsum(steps, dtype=np.uint64))
                    firsts.append(first)
                elif anchors:
                    yield _batch(list(pieces(r, np.concatenate(anchors), np.concatenate(firsts))))

    def pieces(r: dict, anchors: np.ndarray, firsts: np.ndarray) -> Iterator[Row]:
        order = np.argsort(anchors)
        anchors, firsts = anchors[order], firsts[order]
        s = load(r["payload"])
        segment, offset, anchor = _windows(s, size, grain)
        at = np.minimum(np.searchsorted(anchors, anchor), anchors.size - 1)
        hit = anchors[at] == anchor
        segment, offset, first = segment[hit], offset[hit], firsts[at[hit]]
        own = s.ids[segment] == first
        yield from by_shard(r, s, segment[own], offset[own], first[own], SOURCE, None)
        yield from by_shard(r, s, segment[~own], offset[~own], first[~own], QUERY, PIECE_WINDOWS)

    def by_shard(r, s, segment, offset, first, kind: int, limit: int | None) -> Iterator[Row]:
        if not segment.size:
            return
        new = np.ones(segment.size, bool)
        new[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1) | (first[1:] != first[:-1])
        if limit:
            start = np.flatnonzero(new)
            place = np.arange(segment.size) - np.repeat(start, np.diff(np.concatenate([start, [segment.size]])))
            new |= place % limit == 0
        start = np.flatnonzero(new)
        windows = np.diff(np.concatenate([start, [segment.size]]))
        cut = s.cut(segment[start], offset[start], windows + size - 1)
        shard = _shard(first[start], shards)
        begin = np.cumsum(cut.length) - cut.length
        for x in np.unique(shard):
            mine = np.flatnonzero(shard == x)
            index = np.repeat(begin[mine] - (np.cumsum(cut.length[mine]) - cut.length[mine]), cut.length[mine])
            words = cut.words[index + np.arange(index.size)]
            some = Segments(cut.ids[mine], cut.row[mine], cut.start[mine], cut.length[mine], words)
            yield (r["chunk"], 0, int(x), words.size, some.packed(), kind)

    return run


def _search_rows(size: int):
    """Index the sources of each shard, then stream its pieces: repeats, and windows not found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for (_, _), members in _groups(batches, "deal", "part"):
            sources, stream, index, held = [], [], None, 0
            for r in members:
                if r["kind"] == SOURCE:
                    sources.append(Segments.of(r["payload"]))
                    continue
                if index is None and sources:
                    joined = Segments.joined(sources)
                    index, sources = FMIndex(joined.words, joined.length), []
                stream.append((r["chunk"], Segments.of(r["payload"])))
                held += r["words"]
                if held >= STREAM_WORDS:
                    part, out = search(index, stream, part)
                    yield _batch(out)
                    stream, held = [], 0
            if stream:
                part, out = search(index, stream, part)
                yield _batch(out)

    def search(index: FMIndex | None, stream: list, part: int) -> tuple[int, list[Row]]:
        whole = Segments.joined([s for _, s in stream])
        found = index.matches(whole.words, whole.length, size) if index else np.zeros(whole.words.size, bool)
        out: list[Row] = []
        at = 0
        for chunk, s in stream:
            mine = found[at : at + s.words.size]
            at += s.words.size
            segment = np.repeat(np.arange(s.length.size), s.length)
            offset = np.arange(s.words.size) - np.repeat(np.cumsum(s.length) - s.length, s.length)
            valid = offset + size <= np.repeat(s.length, s.length)
            for kind, flags in ((FOUND, mine), (LEFT, valid & ~mine)):
                hits = np.flatnonzero(flags)
                if not hits.size:
                    continue
                new = np.ones(hits.size, bool)
                new[1:] = (np.diff(hits) != 1) | (segment[hits[1:]] != segment[hits[:-1]])
                first = np.flatnonzero(new)
                windows = np.diff(np.concatenate([first, [hits.size]]))
                of, begin = segment[hits[first]], offset[hits[first]]
                part += 1
                if kind == FOUND:
                    body = pack(smallest(s.row[of]), smallest(s.start[of] + begin), smallest(windows + size - 1))
                else:
                    body = s.cut(of, begin, windows + size - 1).packed()
                out.append((chunk, part, 0, int(windows.sum()), body, kind))
        return part, out

    return run


def _chunk_rows(names: list[str], key: str, text: str, limit: int):
    """Chunks of whole rows, with the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, text, limit):
            n = sum(len(split_words(t)) for t in batch[text].to_pylist())
            yield _batch([(chunk, 0, 0, n, pack(table_bytes(batch)), BODY)])
            chunk += 1

    return run


def _loader(key: str, text: str) -> Callable[[bytes], Segments]:
    """Whole texts of a chunk as segments; rows without a key take no part."""
    hashes = WordHashes()

    def load(payload: bytes) -> Segments:
        table = table_of(unpack(payload)[0])
        keys = table[key].to_pylist()
        used = [i for i, k in enumerate(keys) if k is not None]
        texts = table[text].to_pylist()
        words = [hashes.of(split_words(texts[i])) for i in used]
        return Segments(
            np.array([keys[i] for i in used], np.int64), np.array(used, np.int64), np.zeros(len(used), np.int64),
            np.array([w.size for w in words], np.int64),
            np.concatenate(words) if words else np.zeros(0, np.uint64),
        )

    return load


def _removal(key: str, text: str, schema: pa.Schema):
    """Put the repeats of each chunk together and take the words out of the texts."""
    word = regex.compile(rb"[^\x20\x09-\x0D]+")

    def without_words(raw: bytes, drop: np.ndarray) -> bytes:
        starts = [m.start() for m in word.finditer(raw)] + [len(raw)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
        kept, at = [], 0
        for a, b in edges.reshape(-1, 2).tolist():
            kept.append(raw[at : starts[a]])
            at = starts[b]
        return b"".join([*kept, raw[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_,), members in _groups(batches, "chunk"):
            rowed, starts, lengths = [], [], []
            for r in members:
                if r["kind"] == FOUND:
                    row, start, length = (x.astype(np.int64) for x in unpack(r["payload"]))
                    rowed.append(row)
                    starts.append(start)
                    lengths.append(length)
                    continue
                table = table_of(unpack(r["payload"])[0])
                texts = table[text].to_pylist()
                counts = [len(split_words(t)) for t in texts]
                removed = [0] * len(texts)
                if rowed:
                    row, start, length = (np.concatenate(x) for x in (rowed, starts, lengths))
                    order = np.argsort(row, kind="stable")
                    row, start, length = row[order], start[order], length[order]
                    firsts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    for a, b in zip(firsts, [*firsts[1:], row.size], strict=True):
                        i = int(row[a])
                        steps = np.zeros(counts[i] + 1, np.int64)
                        np.add.at(steps, start[a:b], 1)
                        np.add.at(steps, start[a:b] + length[a:b], -1)
                        drop = np.cumsum(steps)[:-1] > 0
                        removed[i] = int(drop.sum())
                        texts[i] = without_words(texts[i].encode(), drop).decode()
                    rowed, starts, lengths = [], [], []
                columns = [
                    pa.array(texts, f.type) if f.name == text else table[f.name].combine_chunks() for f in schema
                ]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                    names=[*schema.names, "n_words", "n_removed"],
                )

    return run


def _write(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(_ROW).parquet(path).select(*_ROW.names)


def _round(segments: DataFrame, load: Callable[[bytes], Segments], size: int, grain: int, shards: int, deal: int) -> DataFrame:
    """One pass of anchors, index and search over rows of packed segments."""
    anchors = segments.mapInArrow(_anchor_rows(load, size, grain, deal), _ROW)
    anchors = anchors.repartition(deal, "deal").sortWithinPartitions("deal")
    shared = anchors.mapInArrow(_share_rows, _ROW)
    # Both kinds of rows of a chunk meet; the shared anchors come before the words.
    both = shared.unionByName(segments.withColumn("kind", F.lit(QUERY)))
    both = both.repartition(deal, "chunk", "part").sortWithinPartitions("chunk", "part", "kind")
    pieces = _write(both.mapInArrow(_piece_rows(load, size, grain, shards), _ROW), "pieces")
    streamed = pieces.filter(F.col("kind") == QUERY)
    total = streamed.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    # Shards that many passages point to: fewer than HOT_SHARE, copied so that each
    # copy gets a thousandth of the streamed words.
    share = max(1, total // HOT_SHARE)
    hot = streamed.groupBy("deal").agg(F.sum("words").alias("n")).filter(F.col("n") > share)
    hot = hot.select("deal", F.ceil(F.col("n") / F.lit(max(share, STREAM_WORDS))).alias("copies"))
    spread = pieces.join(F.broadcast(hot), "deal", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    copies = F.when(F.col("kind") == SOURCE, F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("chunk", "words"), F.col("copies")))
    )
    dealt = spread.withColumn("part", F.explode(copies)).select(*_ROW.names)
    dealt = dealt.repartition(deal, "deal", "part").sortWithinPartitions("deal", "part", "kind")
    return _write(dealt.mapInArrow(_search_rows(size), _ROW), "found")


def remove_repeats(
    docs: DataFrame, size: int = 13, grain: int = 6, key: str = "doc_id", text: str = "text",
    shard_words: int = SHARD_WORDS, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Remove every word covered by a window that also starts in a document of smaller key.

    Returns the documents with all their columns, the words taken out of the text
    with the space that follows them, and ``n_words`` (before) and ``n_removed``.
    Other spaces stay as they are. Keys are integers. Windows are judged on the
    input. Rows of equal key count as one document, so they keep what they share
    with each other. Rows with a null key neither lose words nor stand for an
    earlier occurrence. A null text stays null with no words; texts of fewer than
    ``size`` words stay whole. Columns named ``n_words`` or ``n_removed`` are replaced,
    all others stay; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = without(docs, ["n_words", "n_removed"])
    names = docs.columns
    bodies = _write(docs.mapInArrow(_chunk_rows(names, key, text, chunk_bytes), _ROW), "chunks")
    total = bodies.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shards = total // shard_words + 1
    first = _round(bodies, _loader(key, text), size, grain, shards, deal)
    rest = first.filter(F.col("kind") == LEFT)
    second = _round(rest, Segments.of, size, size, shards, deal)
    found = first.unionByName(second).filter(F.col("kind") == FOUND)
    # FOUND sorts after BODY, and has to come before it.
    both = found.unionByName(bodies.withColumn("kind", F.lit(FOUND + 1)))
    ordered = both.repartition(deal, "chunk").sortWithinPartitions("chunk", "kind")
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return ordered.mapInArrow(_removal(key, text, to_arrow_schema(docs.schema)), out)

