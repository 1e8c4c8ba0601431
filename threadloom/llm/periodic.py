"""Periodic runs of words by string synchronising sets.

A run is a longest stretch of words with smallest period q. At every dyadic
scale t a few positions are selected by hashes: position i belongs to the set if
the smallest hash of the t-word blocks that start in i .. i+t is that of the
first or of the last of them. Membership depends on the 2t words from i only, so
equal contexts are selected alike, and blocks that are themselves highly
periodic (period at most t/3) are left out, so that ties stay rare. Outside such
regions, any t positions in a row hold a selected one.

A run of period q of at least 3q words, with t <= q/3, has two selected
positions i and i+q with equal contexts of 2t words. So all pairs of equal
contexts at a distance of 3t .. 6t propose their distance as a period, and the
scales 1, 2, 4 .. together propose every period from 3 on. Periods 1 and 2,
which no scale reaches, are detected directly as highly periodic regions. The
highly periodic blocks of a scale are those covered by runs already found.

Proposals are extended to both sides by equal blocks, largest first. The words
of many documents are handled as one array, with a separator of its own after
each document that no block can match across.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import fresh, without
from threadloom.llm.hashing import mix
from threadloom.llm.packing import slices

_BATCH_BYTES = 1 << 20
_BUCKETS = 1 << 18
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

RUN = T.StructType(
    [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]
)


def _block_hashes(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the blocks of 1, 2, 4 .. words from each position, up to ``longest`` words."""
    levels = [mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))]
    size = 1
    while 2 * size <= longest:
        last = levels[-1]
        levels.append(mix(last[: last.size - size] * np.uint64(0xD1342543DE82EF95) + mix(last[size:])))
        size *= 2
    return levels


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """Number of equal words from positions a and b on (b > a), or before them.

    The largest block is over half of any document, so each size is needed once.
    """
    done = np.zeros(a.size, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, size = levels[k], 1 << k
        one, two = (a + done, b + done) if forward else (a - done - size, b - done - size)
        inside = (one >= 0) & (two < level.size)
        equal = np.zeros(a.size, bool)
        equal[inside] = level[one[inside]] == level[two[inside]]
        done += equal * size
    return done


def _selected(block: np.ndarray, periodic: np.ndarray, size: int) -> np.ndarray:
    """Positions of the synchronising set of a scale."""
    value = np.where(periodic[: block.size], _NONE, block)
    n = value.size - size
    if n <= 0:
        return np.zeros(0, np.int64)
    # Smallest of size successive values by doubling, then of the last one, too.
    lowest, width = value, 1
    while width < size:
        lowest = np.minimum(lowest[: lowest.size - width], lowest[width:])
        width *= 2
    lowest = np.minimum(lowest[:n], value[size : size + n])
    return np.flatnonzero((lowest != _NONE) & ((lowest == value[:n]) | (lowest == value[size : size + n])))


def _proposals(at: np.ndarray, context: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, distance) of equal contexts 3 to 6 sizes apart."""
    at = at[at < context.size]
    # Most contexts occur once; only those whose bucket has several need sorting.
    bucket = (context[at] & np.uint64(_BUCKETS - 1)).astype(np.int64)
    at = at[np.bincount(bucket, minlength=_BUCKETS)[bucket] > 1]
    order = np.lexsort((at, context[at]))
    at, key = at[order], context[at[order]]
    starts, periods = [], []
    step = 1
    while step < at.size:
        distance = at[step:] - at[:-step]
        near = (key[step:] == key[:-step]) & (distance < 6 * size)
        if not near.any():
            break
        hit = near & (distance >= 3 * size)
        starts.append(at[:-step][hit])
        periods.append(distance[hit])
        step += 1
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def _extended(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Distinct longest stretches (start, end, period) around the proposals, of three periods or more."""
    right = _common(levels, at, at + period, True)
    left = _common(levels, at, at + period, False)
    found = np.stack([at - left, at + period + right, period], axis=1)
    return np.unique(found[found[:, 1] - found[:, 0] >= 3 * period], axis=0)


def _covered(found: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether the block of ``size`` words from each position has a period of at most a third of it."""
    marks = np.zeros(n + 1, np.int64)
    some = found[(3 * found[:, 2] <= size) & (found[:, 1] - found[:, 0] >= size)]
    np.add.at(marks, some[:, 0], 1)
    np.add.at(marks, some[:, 1] - size + 1, -1)
    return np.cumsum(marks[:n]) > 0


def runs_of(ids: np.ndarray, longest: int) -> np.ndarray:
    """All runs (start, end, smallest period) of three periods or more.

    ``ids`` are word numbers; equal ones are equal words. No stretch reaches over
    a number that occurs once, which separates documents. ``longest`` is the
    length of the longest document.
    """
    none = np.zeros((0, 3), np.int64)
    if ids.size < 3:
        return none
    levels = _block_hashes(ids, max(longest, 1))
    found = none
    for period in (1, 2):
        start, end = _stretches(ids[period:] == ids[:-period])
        keep = end - start >= 2 * period
        new = np.stack([start[keep], end[keep] + period, np.full(keep.sum(), period)], axis=1)
        found = _new_runs(found, new)
    size, k = 1, 0
    while 9 * size <= longest and k + 1 < len(levels):
        periodic = _covered(found, ids.size, size)
        at, period = _proposals(_selected(levels[k], periodic, size), levels[k + 1], size)
        found = _new_runs(found, _extended(levels, at, period))
        size, k = 2 * size, k + 1
    return found


def _new_runs(found: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The runs with the new ones; a stretch that has a smaller period already is no new run."""
    if not new.size:
        return found
    both = np.concatenate([found, new])
    both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
    repeated = np.zeros(len(both), bool)
    repeated[1:] = (both[1:, :2] == both[:-1, :2]).all(axis=1)
    return both[~repeated]


def _numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all documents with a separator after each, and where each document starts."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in documents], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    ids = np.empty(int((sizes + 1).sum()), np.int64)
    ends = starts + sizes
    inside = np.ones(ids.size, bool)
    inside[ends] = False
    ids[inside] = np.fromiter(map(known.__getitem__, chain.from_iterable(documents)), np.int64, int(sizes.sum()))
    ids[ends] = len(known) + np.arange(ends.size)
    return ids, starts


def find_runs(
    docs: DataFrame, min_length: int = 6, min_periods: int = 4, text: str = "text"
) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed_text``.

    Words lie between the six spaces and are numbered from 0. A run is a stretch
    of words with smallest period q, of at least ``min_length`` words and
    ``min_periods`` (3 or more) times q, that no neighbouring word extends. In
    the collapsed text a word is left out if a run holds it after its first q
    words; the others are joined by one space.

    A null or empty text has no words, no runs and an empty collapsed text. Texts
    of any length are taken whole, and repeated rows get equal results. Columns
    of these three names are replaced, all others kept. An empty table gives an
    empty result. One pass without a shuffle.
    """
    if min_periods < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    names = ["n_words", "runs", "collapsed_text"]
    read = fresh(docs, "_read")
    rest = without(docs, names)
    kept = rest.columns
    schema = T.StructType(
        [
            *rest.schema.fields, T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed_text", T.StringType()),
        ]
    )
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, read, _BATCH_BYTES):
            documents = [(x or "").encode().split() for x in batch[read].to_pylist()]
            ids, starts = _numbered(documents)
            found = runs_of(ids, max(map(len, documents), default=0))
            length = found[:, 1] - found[:, 0]
            found = found[(length >= min_length) & (length >= min_periods * found[:, 2])]
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
            gone = np.zeros(ids.size + 1, np.int64)
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.add.at(gone, found[:, 1], -1)
            stays = np.cumsum(gone)[:-1] == 0
            owner = np.searchsorted(starts, found[:, 0], "right") - 1
            edges = np.searchsorted(owner, np.arange(len(documents) + 1))
            flat = pa.StructArray.from_arrays(
                [
                    pa.array(found[:, 0] - starts[owner]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2]),
                ],
                names=["start", "length", "period"],
            )
            collapsed = []
            for i, (start, w) in enumerate(zip(starts.tolist(), documents, strict=True)):
                if edges[i] < edges[i + 1]:
                    w = [w[j] for j in np.flatnonzero(stays[start : start + len(w)])]
                collapsed.append(b" ".join(w).decode())
            columns = [batch[c] for c in kept]
            columns += [
                pa.array([len(w) for w in documents], pa.int64()),
                pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), flat).cast(run_type),
                pa.array(collapsed, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    slim = docs.withColumn(read, F.col(f"`{text}`")).select(*[f"`{c}`" for c in kept], read)
    return slim.mapInArrow(run, schema)
