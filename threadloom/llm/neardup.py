"""Near-duplicate documents: MinHash tables keyed by pairs of small hash collections.

Each of ``collections`` holds ``rows`` MinHash values. A table is keyed by two
collections, so c collections give c(c-1)/2 tables from c * rows values instead
of c(c-1) * rows. At a similarity s a pair shares a table if two collections
agree, each with probability s**rows; with 12 collections of 2 rows a pair of
similarity 0.8 is missed once in 9,000, one of 0.85 once in 150,000.

Documents with equal shingle sets are one class. The smallest class of a bucket
is its centre, and every class is compared on full sets with the smallest centre
of its buckets, which links most of a group without emitting its pairs. Buckets
chained together form a candidate cluster. Where the links leave a cluster in
several components, those outside the largest are compared with all others in
blocks inside the tasks, so no pair is lost, and only links between components
come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from threadloom.llm.common import fresh
from threadloom.llm.hashing import WordHashes, as_longs, fold, minhashes, seeds, shingle_set, split_words
from threadloom.llm.packing import slices, spans
from threadloom.operators.distributed import by_shuffle, lookup_by_key
from threadloom.operators.graph import connected_components
from threadloom.session import staging_path

_BATCH_BYTES = 8 << 20
_MEMBERS = 1024  # texts compared with one centre in a task
_FOREST = 1 << 20  # links reduced in a task


@dataclass(frozen=True)
class Similarity:
    """What counts as a near duplicate, and the tables that find candidates."""

    shingle_words: int = 5
    percent: int = 80  # 100 * intersection >= percent * union
    collections: int = 12
    rows: int = 2
    seed: int = 20
    block_chars: int = 1 << 20  # text in a block of a candidate cluster; a task holds two


def signatures(docs: DataFrame, rule: Similarity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``set_id`` (128-bit hash of the shingle set) and ``parts``,
    one hash per collection. Null or empty texts have no shingles and null parts."""
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind), T.StructField("n_shingles", T.LongType()),
            T.StructField("set_id", T.BinaryType()), T.StructField("parts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        functions = seeds(rule.collections * rule.rows, rule.seed)
        for batch in slices(batches, "_text", _BATCH_BYTES):
            sizes, sets, parts = [], [], []
            for value in batch["_text"].to_pylist():
                shingles = shingle_set(hashes.of(split_words(value, lower=True)), rule.shingle_words)
                sizes.append(shingles.size)
                sets.append(blake2b(shingles.tobytes(), digest_size=16).digest() if shingles.size else None)
                parts.append(
                    as_longs(fold(minhashes(shingles, functions), rule.rows)).tolist() if shingles.size else None
                )
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(parts, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "set_id", "parts"],
            )

    slim = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("_text"))
    return slim.mapInArrow(run, schema)


def table_keys(parts: Column, collections: int) -> Column:
    """The key of every table: a hash of two collections, which know their places."""
    return F.array(*[F.xxhash64(parts[i], parts[j]) for i, j in combinations(range(collections), 2)])


def _similar(pairs: DataFrame, texts: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs (a, b), one for each b, whose full shingle sets are similar enough.

    The texts that share a centre a follow it into one task, or into several if they
    are many, so each text moves once and a centre once for each of its tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        centre, sets = None, []
        for batch in batches:
            good = []
            columns = [batch[c].to_pylist() for c in ("a", "part", "member", "text")]
            for a, part, member, value in zip(*columns, strict=True):
                if centre != (a, part):
                    centre, sets = (a, part), []
                y = shingle_set(hashes.of(split_words(value, lower=True)), rule.shingle_words)
                if not member:
                    sets.append(y)
                shared = (np.intersect1d(x, y, assume_unique=True).size for x in sets) if member else ()
                good.append(any(100 * n >= rule.percent * (x.size + y.size - n) for x, n in zip(sets, shared)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("parts", F.ceil(F.col("n") / _MEMBERS))
    spread = lookup_by_key(pairs, counts, "a", "n", pairs.count())
    placed = spread.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    members = placed.join(by_shuffle(texts.withColumnRenamed("id", "b")), "b").select("a", "part", F.lit(True).alias("member"), "b", "text")
    tasks = counts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    centres = tasks.join(by_shuffle(texts.withColumnRenamed("id", "a")), "a").select(
        "a", "part", F.lit(False).alias("member"), F.col("a").alias("b"), "text"
    )
    rows = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", "member")
    return rows.mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"]])).distinct()


def _written(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _across(rule: Similarity, kind: T.DataType):
    """Links (as pairs of components) between the texts of each task, one or two blocks of a cluster.

    Two texts of different components are not both in the largest one, so only texts
    outside it are looked up, in an inverted index of all. Links that close no gap
    between components are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        labels: list = []
        sets: list[np.ndarray] = []
        last = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("cluster", "low", "high", "component", "text")]
            for cluster, low, high, component, text in zip(*columns, strict=True):
                if last is not None and last != (cluster, low, high):
                    yield links(labels, sets)
                    labels, sets = [], []
                last = (cluster, low, high)
                labels.append(component)
                sets.append(shingle_set(hashes.of(split_words(text, lower=True)), rule.shingle_words))
        yield links(labels, sets)

    def links(labels: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        found: list[tuple] = []
        names, label = np.unique(np.array(labels), return_inverse=True) if labels else ([], np.zeros(0, np.int64))
        if len(names) > 1:
            sizes = np.array([x.size for x in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(sizes.size), sizes)[order]
            for probe in np.flatnonzero(label != np.bincount(label).argmax()):
                start = np.searchsorted(flat, sets[probe], "left")
                count = np.searchsorted(flat, sets[probe], "right") - start
                shared = np.bincount(owner[spans(start, count)], minlength=sizes.size)
                near = 100 * shared >= rule.percent * (sizes + sizes[probe] - shared)
                for other in np.flatnonzero(near & (label != label[probe])):
                    if label[other] != label[probe]:
                        label[label == label[other]] = label[probe]
                        found.append((labels[probe], labels[other]))
        columns = list(zip(*found, strict=True)) if found else [[], []]
        arrow = to_arrow_type(kind)
        return pa.RecordBatch.from_arrays([pa.array(c, arrow) for c in columns], names=["a", "b"])

    return run


def _links_across(pairs: DataFrame, parts: DataFrame, texts: DataFrame, rule: Similarity) -> DataFrame:
    """Links (a, b) between components that candidate pairs chain together in one cluster.

    The largest component of a cluster is compared with the others only, which
    are compared with everything: every pair of texts of different components
    meets in a task, and the work follows what lies outside the largest one.
    """
    labels = by_shuffle(parts.withColumnRenamed("component", "label"))
    # Members first: those of one component leave one row for each centre.
    ends = pairs.join(labels.withColumnRenamed("id", "b"), "b", "left").select("a", F.coalesce("label", "b").alias("b")).distinct()
    starts = ends.join(labels.withColumnRenamed("id", "a"), "a", "left").select(F.coalesce("label", "a").alias("a"), "b")
    crossing = _written(starts.filter("a != b").distinct(), "crossing")
    clusters = _components(crossing).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    sized = texts.select("id", F.length("text").alias("chars")).join(labels, "id", "left")
    sized = sized.select("id", "chars", F.coalesce("label", "id").alias("component"))
    sizes = sized.groupBy("component").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n")).join(by_shuffle(clusters), "component")
    sizes = _written(sizes, "sizes")

    def blocks(chars: str) -> Column:
        return F.ceil(F.col(chars) / F.lit(rule.block_chars))

    plan = sizes.groupBy("cluster").agg(
        F.max(F.struct("chars", "component")).alias("main"), F.sum("chars").alias("chars")
    ).select("cluster", "main.component", F.col("main.chars").alias("inside"), (F.col("chars") - F.col("main.chars")).alias("outside"))
    plan = plan.select("cluster", F.col("component").alias("main"), blocks("inside").alias("mains"), blocks("outside").alias("others"))
    dealing = sizes.select("component", "n", "cluster").join(by_shuffle(plan), "cluster")
    member = lookup_by_key(sized.drop("chars"), dealing, "component", "n", texts.count())
    draw, is_main = F.xxhash64("id"), F.col("component") == F.col("main")
    block = F.when(is_main, F.col("others") + F.pmod(draw, F.col("mains"))).otherwise(F.pmod(draw, F.col("others")))
    last = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    tasks = F.transform(
        F.sequence(F.lit(0).cast("bigint"), last),
        lambda j: F.struct(F.least(F.col("block"), j).alias("low"), F.greatest(F.col("block"), j).alias("high")),
    )
    dealt = member.withColumn("block", block).join(by_shuffle(texts), "id").select("cluster", "component", "text", F.explode(tasks).alias("t"))
    dealt = dealt.select("cluster", "t.low", "t.high", "component", "text")
    keys = ["cluster", "low", "high"]
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_across(rule, kind), schema)


def _centre_pairs(classes: DataFrame, rule: Similarity) -> DataFrame:
    """(a, b): each class b with the smallest class a of every bucket that it shares."""
    keyed = classes.select("id", F.explode(table_keys(F.col("parts"), rule.collections)).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("id").alias("center"), F.max("id").alias("last"))
    shared = shared.filter("center != last").drop("last")
    # Spark takes the exploded keys for one row of each class.
    left = keyed.join(by_shuffle(shared), "bucket").filter("id != center")
    return left.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()


def similar_classes(classes: DataFrame, docs: DataFrame, rule: Similarity, key: str, text: str) -> DataFrame:
    """(id, component) of every class that is linked with another.

    Each class is compared with one centre, the smallest of those of its buckets.
    What the links leave apart is compared in blocks, see ``_links_across``.
    """
    pairs = _written(_centre_pairs(classes, rule), "pairs")
    involved = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # Texts move by their id at every size of the input.
    texts = _written(slim.join(by_shuffle(involved), "id", "left_semi").distinct(), "texts")
    links = _written(_similar(pairs.groupBy("b").agg(F.min("a").alias("a")), texts, rule), "links")
    parts = _components(links)
    roots = _components(_written(_links_across(pairs, parts, texts, rule), "across"))
    nodes = parts.unionByName(roots.select("id", F.col("id").alias("component"))).distinct()
    roots = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
    return nodes.join(by_shuffle(roots), "component", "left").select("id", F.coalesce("root", "component").alias("component"))


def _forest(kind: T.DataType):
    """For each node of the task's edges, the smallest one that they connect it with."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(node):
            while (up := parent.setdefault(node, node)) != node:
                parent[node] = parent[up]
                node = parent[node]
            return node

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        pairs = [(r, node) for node in list(parent) if (r := root(node)) != node]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], arrow) for i in (0, 1)], names=["src", "dst"])

    return run


def _components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of a written table of links (a, b).

    Each task first reduces its links, a bounded number, to a forest; the rounds
    over all of them then find the components of what is left.
    """
    n = links.count()
    if n == 0:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    kind = links.schema["a"].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])
    forest = links.coalesce(1 + n // _FOREST).mapInArrow(_forest(kind), schema)
    return connected_components(forest).checkpoint()


def near_duplicates(
    docs: DataFrame, rule: Similarity = Similarity(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Near-duplicate class of every document: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    A document's set holds the distinct shingles of its whole text, words lower-cased
    in A-Z. ``component_id`` is the smallest key that can be reached over links;
    one document of each component has ``kept``. Texts without words are linked
    with nothing. Rows that share a key are one document whose texts belong
    together. A null key is linked with nothing: its component is null, and it is
    kept. An empty table gives an empty result.
    """
    found = _written(signatures(docs, rule, key, text), "signatures")
    usable = found.filter(F.col("id").isNotNull() & F.col("set_id").isNotNull())
    classes = usable.groupBy("set_id").agg(F.min("id").alias("id"), F.first("parts").alias("parts"))
    classes = _written(classes, "classes")
    components = similar_classes(classes.select("id", "parts"), docs, rule, key, text)
    labels = classes.join(components, "id", "left").select(
        "set_id", F.coalesce("component", "id").alias("component_id")
    )
    rows = found.select("id", "n_shingles", "set_id").join(labels, "set_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, rule: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each near-duplicate class: that of smallest key.

    Repeated rows of that key are cut to one; rows with a null key all stay.
    """
    one = fresh(docs, "_kept")
    kept = near_duplicates(docs, rule, key, text).filter(F.col("kept")).select(F.col(key).alias(one))
    chosen = docs.join(by_shuffle(kept.distinct()), F.col(f"`{key}`") == F.col(one), "left_semi")
    nulls = docs.filter(F.col(f"`{key}`").isNull())
    return chosen.dropDuplicates([key]).unionByName(nulls)
