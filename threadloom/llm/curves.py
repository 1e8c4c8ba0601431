"""Nearest neighbours by inner product over shifted space-filling curves.

Every record is a point on several Hilbert curves, each through its own random
projection with its own random shift. Range-partitioned sorts give each point
its place on each curve. A query is compared with the records whose place is
within a window of its own, on every curve; the results of all windows merge and
the best by the exact inner product stay.

How wide a window must be depends on the vectors: a few hundred places for
clustered ones, a large part of the table for vectors without structure. So the
width is measured: for a bounded sample of queries the true neighbours are found
by comparing with all records, and the window is as wide as it takes to reach
the wanted share of them. Every record is on every curve; none is left out.

The largest inner product is the smallest distance once records have a further
coordinate that gives all the same length (and queries a zero there).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.distributed import first_n, lookup_by_key, positions
from threadloom.session import staging_path


@dataclass(frozen=True)
class Curves:
    """The curves, the sample that sets the window, and the size of blocks."""

    curves: int = 8
    dimensions: int = 8  # projected coordinates of a curve
    bits: int = 4  # of each coordinate
    seed: int = 13
    recall: float = 0.95  # wanted share of the sample's true neighbours
    probes: int = 128  # sampled queries
    block: int = 4096  # records in a task, of successive places
    query_block: int = 32768  # places whose queries share a task


def usable(vector: Column) -> Column:
    """Whether a vector is there and not zero, with finite entries only."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(value, lambda c: c != 0), F.lit(False))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (row of coordinates below 2**bits) on the Hilbert curve, as bytes that sort.

    From the highest bit down, the sub-cube of each coordinate says how the
    lower bits of the others are mirrored or exchanged with the first one; a
    Gray code then orders the sub-cubes.
    """
    n, d = cells.shape
    x = cells.astype(np.uint32).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for i in range(d):
            set_ = (x[i] >> np.uint32(bit)) & np.uint32(1) == 1
            exchanged = np.where(set_, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, exchanged)
            x[i] ^= exchanged
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    # The highest bits of all coordinates first.
    planes = (x[None, :, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & np.uint32(1)
    return np.packbits(planes.reshape(bits * d, n).astype(np.uint8).T, axis=1)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _vectors(column: pa.Array) -> np.ndarray:
    """The packed vectors as rows of doubles."""
    kinds = {v[:1] for v in column.to_pylist()}
    kind = np.float32 if kinds == {b"f"} else np.float64
    return np.frombuffer(b"".join(v[1:] for v in column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)


def _packed(vector: Column) -> Column:
    """A vector as bytes, made in Arrow batches: a letter for float or double, then its entries."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: (b"f" if v.dtype == np.float32 else b"d") + v.tobytes())

    return pack(vector)


class _Places:
    """Projections, shifts and scales of all curves."""

    def __init__(self, rule: Curves, dimension: int, longest: float, mean: np.ndarray, spread: np.ndarray) -> None:
        self.rule, self.longest, self.mean, self.spread = rule, longest, mean, spread
        draw = np.random.default_rng(rule.seed)
        self.width = min(rule.dimensions, dimension + 1)
        # Successive curves look along different directions until all are used up.
        blocks = []
        while sum(b.shape[1] for b in blocks) < rule.curves * self.width:
            blocks.append(np.linalg.qr(draw.normal(size=(dimension + 1, dimension + 1)))[0])
        self.axes = np.concatenate(blocks, axis=1)[:, : rule.curves * self.width]
        self.shift = draw.uniform(0, 1, rule.curves * self.width)

    def projected(self, vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Coordinates on all curves; queries are scaled to length 1, records filled up to it."""
        length = np.linalg.norm(vectors, axis=1)
        scaled = vectors / np.where(query, length, self.longest)[:, None]
        last = np.where(query, 0.0, np.sqrt(np.clip(1 - (length / self.longest) ** 2, 0, None)))
        return np.concatenate([scaled, last[:, None]], axis=1) @ self.axes

    def keys(self, vectors: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
        cells_a_side = 1 << self.rule.bits
        # Three deviations to each side, and as much again to shift the grid in; the rest is in the border cells.
        at = (self.projected(vectors, query) - self.mean) / np.where(self.spread > 0, self.spread, 1)
        grid = np.clip(((at + 3) / 12 + self.shift / 2) * cells_a_side, 0, cells_a_side - 1).astype(np.uint32)
        return [
            hilbert_keys(grid[:, c * self.width : (c + 1) * self.width], self.rule.bits) for c in range(self.rule.curves)
        ]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fitted(groups: DataFrame, rule: Curves) -> _Places | None:
    """Scales of all coordinates, from sums over all records; None if there are none."""
    head = groups.agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"),
        F.min(F.octet_length("vec") - 1).alias("low"), F.max(F.octet_length("vec") - 1).alias("high"),
        F.bool_and(F.substring("vec", 1, 1) == F.lit("f").cast("binary")).alias("single"),
    ).first()
    if not head.n:
        return None
    if head.low != head.high:
        raise ValueError("the vectors differ in length")
    dimension = head.low // 4 if head.single else head.low // 8
    width = rule.curves * min(rule.dimensions, dimension + 1)
    blank = _Places(rule, dimension, head.longest, np.zeros(width), np.ones(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            if batch.num_rows:
                z = blank.projected(_vectors(batch["vec"]), np.zeros(batch.num_rows, bool))
                total += [z.sum(axis=0), (z**2).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *map(pa.array, total)], names=["j", "s", "ss"])

    parts = groups.select("vec").mapInArrow(run, "j int, s double, ss double")
    sums = parts.groupBy("j").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("j").collect()  # one row per coordinate
    mean = np.array([r.s for r in sums]) / head.n
    spread = np.sqrt(np.clip(np.array([r.ss for r in sums]) / head.n - mean**2, 0, None))
    return _Places(rule, dimension, head.longest, mean, spread)


def _on_curves(groups: DataFrame, places: _Places) -> DataFrame:
    """(gid, query, place): the places of each record, and of each query, on all curves."""
    curves = places.rule.curves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, gid = _vectors(batch["vec"]), batch["gid"]
            asked = np.flatnonzero(batch["asked"].to_numpy(zero_copy_only=False))
            for query, rows in ((False, np.arange(len(vectors))), (True, asked)):
                if rows.size:
                    keys = places.keys(vectors[rows], np.full(rows.size, query))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.arange(curves, dtype=np.int32), rows.size)),
                            pa.array([k.tobytes() for curve in keys for k in curve], pa.binary()),
                            pa.concat_arrays([gid.take(pa.array(rows))] * curves),
                            pa.array(np.full(rows.size * curves, query)),
                        ],
                        names=["curve", "key", "gid", "query"],
                    )

    keyed = groups.select("gid", "vec", (F.col("n_asked") > 0).alias("asked")).mapInArrow(
        run, "curve int, key binary, gid string, query boolean"
    )
    order = [F.asc("key"), F.asc("gid"), F.asc("query")]
    placed = positions(keyed, ["curve"], order, "place")
    pairs = placed.groupBy("gid", "query").agg(F.collect_list(F.struct("curve", "place")).alias("at"))
    return pairs.select("gid", "query", F.transform(F.array_sort("at"), lambda x: x.place).alias("place"))


def _best_of(scored: DataFrame, k: int) -> DataFrame:
    """The k best records of each query; a pair that several tasks found counts once."""
    once = scored.groupBy("query", "gid").agg(F.max("score").alias("score"), F.first("first_id").alias("first_id"))
    return first_n(once, ["query"], [F.desc("score"), F.asc("first_id")], k).drop("rank")


def _scores(queries: np.ndarray, records: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best records of each query, ties to the smaller id."""
    found: list[tuple] = []
    for at in range(0, len(queries), 512):
        part = queries[at : at + 512]
        rough = part @ records.T
        if rough.shape[1] > k:
            least = np.partition(rough, -k, axis=1)[:, -k]
            row, col = np.nonzero(rough >= (least - 1e-9 * np.abs(least))[:, None])
        else:
            row, col = np.indices(rough.shape).reshape(2, -1)
        # One order of additions, whatever the shape of the block.
        score = (part[row] * records[col]).sum(axis=1)
        order = np.lexsort((first[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(row.size) - np.searchsorted(row, row) < k
        found.append((row[keep] + at, col[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_FOUND = "query string, gid string, first_id {kind}, score double"


def _true_neighbours(groups: DataFrame, rule: Curves, k: int, kind: str) -> DataFrame:
    """(query, gid): the k best records of the sampled queries, by comparison with all of them."""
    sample = groups.filter("n_asked > 0").orderBy("gid").limit(rule.probes).select("gid", "vec").collect()
    names = np.array([r.gid for r in sample], object)
    probes = _vectors(pa.array([bytes(r.vec) for r in sample], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                records = _vectors(batch["vec"])
                first = batch["first_id"].to_numpy(zero_copy_only=False)
                row, col, score = _scores(probes, records, first, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[row]), batch["gid"].take(pa.array(col)), batch["first_id"].take(pa.array(col)), pa.array(score)],
                    names=["query", "gid", "first_id", "score"],
                )

    scored = groups.select("gid", "vec", "first_id").mapInArrow(run, _FOUND.format(kind=kind))
    return _best_of(scored, k).filter("query != gid")


def _window(groups: DataFrame, placed: DataFrame, rule: Curves, k: int, kind: str) -> int:
    """Places to look at on both sides of a query, so that the sample's recall is as wanted."""
    true = _true_neighbours(groups, rule, k, kind)
    records = placed.filter("not query").select("gid", F.col("place").alias("there"))
    queries = placed.filter("query").select(F.col("gid").alias("query"), F.col("place").alias("here"))
    gap = F.array_min(F.zip_with("here", "there", lambda a, b: F.abs(a - b)))
    gaps = true.join(records, "gid").join(queries, "query").select(gap.alias("gap"))
    # At most probes * k rows.
    seen = sorted(r.gap for r in gaps.collect())
    return seen[min(len(seen) - 1, math.ceil(rule.recall * len(seen)) - 1)] if seen else 1


def _in_windows(groups: DataFrame, placed: DataFrame, window: int, rule: Curves, k: int, kind: str) -> DataFrame:
    """(query, gid, first_id, score): the best records of each task's block for each of its queries.

    A task holds one block of successive records and the queries of one block of
    places whose windows reach into it.
    """
    records = groups.select("gid", "vec", "first_id").join(placed.filter("not query").drop("query"), "gid")
    queries = groups.filter("n_asked > 0").select("gid", "vec").join(placed.filter("query").drop("query"), "gid")

    def blocks(low: Column, high: Column, size: int) -> Column:
        first = F.greatest(F.lit(0).cast("bigint"), F.floor(low / size))
        return F.sequence(first, F.floor(high / size))

    def dealt(df: DataFrame, own: str, own_size: int, other: str, other_size: int) -> DataFrame:
        each = df.select("*", F.posexplode("place").alias("curve", "at")).drop("place")
        mine = F.floor(F.col("at") / own_size).alias(own)
        # Everything that shares a block is compared, so a window ends with its last block.
        low = F.floor(F.col("at") / own_size) * own_size if own == "block" else F.col("at")
        high = low + (own_size - 1 if own == "block" else 0)
        return each.select("*", mine, F.explode(blocks(low - window, high + window, other_size)).alias(other))

    left = dealt(queries, "part", rule.query_block, "block", rule.block).select(
        "curve", "block", "part", F.col("gid").alias("query"), F.col("vec").alias("asked")
    )
    right = dealt(records, "block", rule.block, "part", rule.query_block).select(
        "curve", "block", "part", "gid", "first_id", "vec"
    )

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query", "gid", "first_id", "score"]
        if not asked.num_rows or not held.num_rows:
            nothing = [pa.array([], pa.string())] * 2 + [pa.array([], held["first_id"].type), pa.array([], pa.float64())]
            return pa.Table.from_arrays(nothing, names=names)
        one, many = asked.combine_chunks(), held.combine_chunks()
        first = many["first_id"].to_numpy()
        row, col, score = _scores(_vectors(_flat(one["asked"])), _vectors(_flat(many["vec"])), first, k)
        at, to = pa.array(row), pa.array(col)
        return pa.Table.from_arrays(
            [one["query"].take(at), many["gid"].take(to), many["first_id"].take(to), pa.array(score)], names=names
        )

    keys = ["curve", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, _FOUND.format(kind=kind))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, rule: Curves = Curves(), key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The k records of largest inner product found for each query: ``query_id``, ``rank``, ``key``, ``score``.

    Queries are the rows for which ``is_query`` (over the key) holds; each is
    compared with all rows but its own, all on every curve. Ranks start at 1,
    nearest first, ties to the smaller key. The window is measured in the same way at
    every size. Where all places of a curve (records and queries) fill one block of
    ``rule.block``, a query meets all records and the result is exact.

    Null, empty or zero vectors, vectors with null or non-finite entries, and
    rows with a null key take no part. Equal vectors are one point with its k + 1
    smallest keys, all that a result can show, so copies cost nothing and are
    found together. A repeated row counts once; of different vectors with one
    key the one of smallest fingerprint counts. Fewer than k candidates give all
    of them; a table without queries or records gives no rows. Other columns are
    not read. Vectors of different lengths are an error.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, rank int, `{key}` {kind}, score double"
    slim = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    slim = slim.filter(F.col("id").isNotNull() & usable(F.col("v")))
    print_ = F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), F.col("v"))) for seed in (1, 2)])
    marked = slim.select("id", "v", print_.alias("gid"))
    members = _written(marked.groupBy("id").agg(F.min("gid").alias("gid")), "members")
    asked = F.coalesce(is_query, F.lit(False))
    counted = members.withColumnRenamed("id", key).withColumn("_asked", asked).withColumnRenamed(key, "id")
    sizes = counted.groupBy("gid").agg(F.sum(F.col("_asked").cast("bigint")).alias("n_asked"), F.min("id").alias("first_id"))
    distinct = marked.groupBy("gid").agg(F.first("v").alias("v"))
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    groups = _written(
        distinct.join(sizes, "gid").select("gid", _packed(F.col("v")).alias("vec"), F.sqrt(square).alias("length"), "n_asked", "first_id"),
        "groups",
    )
    places = _fitted(groups, rule)
    if places is None or groups.filter("n_asked > 0").isEmpty():
        return spark.createDataFrame([], schema)
    # Of k + 1 records at most one is the query's own.
    placed = _written(_on_curves(groups, places), "places")
    window = _window(groups, placed, rule, k + 1, kind)
    best = _written(_best_of(_in_windows(groups, placed, window, rule, k + 1, kind), k + 1), "best")

    copies = first_n(members, ["gid"], [F.asc("id")], k + 1).drop("rank")
    listed = first_n(best.select("query", "gid", "score").join(copies, "gid"), ["query"], [F.desc("score"), F.asc("id")], k + 1)
    lists = listed.groupBy(F.col("query").alias("gid")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found")
    )
    weighted = lists.join(sizes.select("gid", "n_asked"), "gid")
    asking = counted.filter("_asked").select(F.col("id").alias("query_id"), "gid")
    joined = lookup_by_key(asking, weighted, "gid", "n_asked", asking.count())
    others = F.slice(F.filter("found", lambda x: x.id != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias(key), F.col("hit.score").alias("score")
    )
