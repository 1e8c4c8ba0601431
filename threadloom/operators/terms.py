"""Weighted terms of texts: a model that is kept up to date, and an exact cosine join.

A term is a word between blanks, in lower case, by its 64-bit hash. The model is
the table (term, df) of document frequencies, in which the row without a term
counts the texts. A term weighs tf * ln((n + 1) / (df + 1)); vectors have length 1
and are sorted by document frequency, rarest first, which is the one global order
that the join relies on.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import text_words
from threadloom.operators.distributed import checkpoint_with, first_n
from threadloom.operators.similarity import THRESHOLD, TOP_K, add_models, fingerprint, neighbour_lists
from threadloom.session import release

_DIGITS = 9  # of scores, so that equal texts tie whatever the order of additions
_SLACK = 1e-9


def _term_hashes(text: str) -> Column:
    return F.transform(text_words(F.col(text)), lambda w: F.xxhash64(w))


def fit_terms(texts: DataFrame, text: str = "text") -> DataFrame:
    """The model (term, df) of a table of texts; a null term counts them."""
    distinct = F.array_append(F.array_distinct(_term_hashes(text)), F.lit(None).cast("bigint"))
    each = texts.filter(F.col(text).isNotNull()).select(F.explode(distinct).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def update_terms(model: DataFrame, added: DataFrame, removed: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The model after texts came and went (a changed text does both), without a read of the others."""
    return add_models(model, fit_terms(added, text), None if removed is None else fit_terms(removed, text))


def _counts(hashed: DataFrame) -> DataFrame:
    """(id, term, tf), one row for each term of a row's ``terms``."""
    schema = T.StructType([hashed.schema["id"], T.StructField("term", T.LongType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                found = [np.unique(x.values.to_numpy(), return_counts=True) for x in batch["terms"]]
                owner = np.repeat(np.arange(len(found)), [t.size for t, _ in found])
                term, tf = (np.concatenate(x).astype(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(owner)), pa.array(term), pa.array(tf)], names=["id", "term", "tf"])

    return hashed.mapInArrow(run, schema)


def term_vectors(texts: DataFrame, model: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, terms) of all texts that have a weight; ``terms`` holds (df, term, weight) by df and term.

    A term that the model does not know counts as one of no text. ``id`` is unique (the terms of
    texts that share one are added up). Terms are counted where the texts are.
    """
    n = model.filter("term is null").agg(F.coalesce(F.max("df"), F.lit(0)).alias("df")).first()["df"]
    counts = _counts(texts.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), _term_hashes(text).alias("terms")))
    # One row per text and term, so that no term has more rows than there are texts.
    known = counts.join(model.filter("term is not null"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("bigint")))
    # They lie by term already.
    known = known.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.first("df").alias("df"))

    def weight(tf: Column, df: Column) -> Column:
        return tf * F.log(F.lit(n + 1.0) / (df + 1))

    # Terms move with their counts, which take less room than weights.
    kept = known.filter(weight(F.col("tf"), F.col("df")) > 0)
    grouped = kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "term", "tf"))).alias("terms"))

    def unit(terms: Column) -> Column:
        square = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x.weight * x.weight)
        # As the variable of a lambda the length is computed once for a text, not again for each of its terms.
        return F.transform(F.array(F.sqrt(square)), lambda norm: F.transform(
            terms, lambda x: F.struct(x.df.alias("df"), x.term.alias("term"), (x.weight / norm).alias("weight"))
        ))[0]

    weighted = F.transform("terms", lambda x: F.struct(x.df.alias("df"), x.term.alias("term"), weight(x.tf, x.df).alias("weight")))
    return grouped.select("id", F.transform(F.array(weighted), unit)[0].alias("terms"))


def _vectors(df: DataFrame) -> DataFrame:
    """Terms as two plain arrays, which move faster than one of structs."""
    return df.withColumns({"keys": F.col("terms.term"), "weights": F.col("terms.weight")}).drop("terms")


# Vectors travel in blocks of about so many terms, and of at most so many vectors.
_TERMS, _VECTORS = 1 << 21, 1 << 16
_MEETINGS, _CELLS = 1 << 20, 1 << 18  # shared terms, and pairs of vectors, looked at together
_BLOCK = "block int, data binary"


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indexes start .. start + count - 1, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class _Block:
    """Vectors of one task: terms as places in a sorted vocabulary, in the global order within a vector.

    ``at`` lists the terms that a vector cannot do without, with the length after each
    (``after``) and after them all (``end``). Two vectors of the threshold's cosine share one of
    both lists: if the rarest term they share came later in one of them, all they share would lie
    in its rest, whose length is below the threshold.
    """

    def __init__(self, rows: list, asks: np.ndarray, firsts: list, keys: list, weights: list, threshold: float) -> None:
        terms, codes = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
        weights = np.concatenate([*weights, np.zeros(0)])
        self.__setstate__((rows, asks, firsts, np.array([k.size for k in keys], np.int64), terms, codes.astype(np.int32), weights, threshold))

    def __getstate__(self) -> tuple:
        return self.rows, self.asks, self.firsts, self.sizes, self.terms, self.codes, self.weights, self.threshold

    def __setstate__(self, state: tuple) -> None:
        self.rows, self.asks, self.firsts, self.sizes, self.terms, self.codes, self.weights, self.threshold = state
        self.answers = np.array([x is not None for x in self.firsts], bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        slack = 1e-10  # lengths are upper bounds: squares are differences of sums over the whole block
        square = np.concatenate([[0.0], np.cumsum(self.weights**2)])
        last = square[self.starts + self.sizes]
        owner = np.repeat(np.arange(self.sizes.size), self.sizes)
        self.at = np.flatnonzero(last[owner] - square[:-1] >= self.threshold**2 - _SLACK)
        self.owner = owner[self.at]
        taken = np.bincount(self.owner, minlength=self.sizes.size)  # a leading run
        self.after = np.sqrt(np.maximum(last[self.owner] - square[1:][self.at], 0) + slack)
        self.end = np.sqrt(np.maximum(last - square[self.starts + taken], 0) + slack)

    def places_in(self, other: _Block) -> np.ndarray:
        """Where the other block has the terms of this one; the number of its terms where it has not."""
        found = np.searchsorted(other.terms, self.terms)
        same = np.append(other.terms, 0)[found] == self.terms
        return np.where(same & (found < other.terms.size), found, other.terms.size)


def _blocks(held: DataFrame, parts: int, threshold: float) -> DataFrame:
    """(block, data): the vectors dealt by ``row`` into as many blocks, one in a task.

    ``held`` has (row, asks, first, keys, weights). The rows of a vector come together: whether it
    asks, its smallest id if it answers, and its terms, once or more, may be in different ones.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            # Copies in a task are put together before they move.
            held, rows = batch["keys"].is_valid().to_pylist(), batch["row"].to_pylist()
            new = [not (h and r in seen or h and seen.add(r)) for h, r in zip(held, rows, strict=True)]
            yield batch.filter(pa.array(new, pa.bool_()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: dict = {}
        firsts: dict = {}
        vectors: dict = {}
        number = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("row", "asks", "first")]
            edges = batch["keys"].offsets.to_numpy()
            term, weight = batch["keys"].values.to_numpy(), batch["weights"].values.to_numpy()
            places = batch["weights"].offsets.to_numpy()
            valid = batch["keys"].is_valid().to_pylist()
            for k, (row, ask, first) in enumerate(zip(*columns, strict=True)):
                if ask:
                    asks[row] = True
                if first is not None:
                    firsts[row] = first
                if valid[k] and row not in vectors:
                    n = edges[k + 1] - edges[k]
                    vectors[row] = (term[edges[k] : edges[k + 1]].copy(), weight[places[k] : places[k] + n].copy())
            if batch.num_rows:
                number = batch["part"][0].as_py()
        if vectors:
            rows = list(vectors)
            block = _Block(
                rows, np.array([r in asks for r in rows], bool), [firsts.get(r) for r in rows],
                [vectors[r][0] for r in rows], [vectors[r][1] for r in rows], threshold,
            )
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps(block)], pa.binary())], names=["block", "data"])

    slim = held.select("row", "asks", "first", "keys", "weights")
    slim = slim.mapInArrow(once, slim.schema).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    blocks = slim.repartitionById(parts, "part").mapInArrow(pack, _BLOCK).checkpoint()
    release(held.sparkSession)
    return blocks


def _likely(one: _Block, other: _Block, place: np.ndarray, threshold: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors i of one block that ask and j of the other that answer, that can reach the threshold; by i.

    All terms in both prefixes are met here, so what a pair has besides lies after the
    prefix of one and, in the other, after the last term met.
    """
    bound, n = threshold - _SLACK, other.sizes.size
    theirs = np.flatnonzero(other.answers[other.owner])
    theirs = theirs[np.argsort(other.codes[other.at[theirs]], kind="stable")]
    counts = np.bincount(other.codes[other.at[theirs]], minlength=other.terms.size + 1)
    starts = np.cumsum(counts) - counts
    mine = np.flatnonzero(one.asks[one.owner])
    term = place[one.codes[one.at[mine]]]
    mine, term = mine[counts[term] > 0], term[counts[term] > 0]
    if not mine.size:
        return
    row, upto = one.owner[mine], np.cumsum(counts[term])
    step = max(1, min(block, _CELLS // n))
    best_rest = np.empty(step * n)
    first = 0
    while first < mine.size:
        # Whole vectors of as many meetings, one at least.
        low = row[first]
        most = row[min(np.searchsorted(upto, upto[first] + _MEETINGS), mine.size - 1)]
        last = np.searchsorted(row, min(low + step, max(most, low + 1)))
        a, t = mine[first:last], term[first:last]
        many = counts[t]
        a, b = np.repeat(a, many), theirs[_spans(starts[t], many)]
        i, j = one.owner[a], other.owner[b]
        cell = (i - low) * n + j
        met = np.bincount(cell, one.weights[one.at[a]] * other.weights[other.at[b]])
        # Terms come in their order, so the value that stays is that of the last one.
        best_rest[cell] = np.maximum(one.end[i] * other.after[b], other.end[j] * one.after[a])
        pairs = np.unique(cell[met[cell] + best_rest[cell] >= bound])
        if pairs.size:
            yield low + pairs // n, pairs % n
        first = last


def _pairs_of(blocks: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over every pair of blocks. A task reads its two from where they are stored, so none moves again."""
    other = blocks.select(F.col("data").alias("other"))
    both = blocks.select("data").hint("shuffle_replicate_nl").crossJoin(other.hint("shuffle_replicate_nl"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch["data"], batch["other"], strict=True):
                yield from run(pickle.loads(one.as_py()), pickle.loads(two.as_py()))

    return both.mapInArrow(each, schema)


def _candidate_pairs(held: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b), numbers of vectors of which a asks and b answers, that can reach the threshold; a != b."""
    first = F.when(F.size("ids") > 0, F.col("ids")[0])
    blocks = _blocks(held.select("row", (F.col("copies") > 0).alias("asks"), first.alias("first"), "keys", "weights"), 3, threshold)

    def run(one: _Block, other: _Block) -> Iterator[pa.RecordBatch]:
        for i, j in _likely(one, other, one.places_in(other), threshold, block):
            a, b = np.array(one.rows)[i], np.array(other.rows)[j]
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return _pairs_of(blocks, run, "a bigint, b bigint")


def _compared(keep: int, threshold: float, block: int):
    """Best ``keep`` vectors of the other block for each one that asks."""

    def run(one: _Block, other: _Block) -> Iterator[pa.RecordBatch]:
        place, weights = one.places_in(other), np.zeros(other.terms.size + 1)
        firsts = np.array([x or "" for x in other.firsts], dtype=str)
        for rows, found in _likely(one, other, place, threshold, block):
            out: list[tuple] = []
            edges = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), rows.size]
            for low, high in zip(edges, edges[1:]):
                i, j = rows[low], found[low:high]
                own = slice(one.starts[i], one.starts[i] + one.sizes[i])
                mine = place[one.codes[own]]
                weights[mine] = one.weights[own]
                weights[-1] = 0  # terms that the other block lacks
                at, sizes = _spans(other.starts[j], other.sizes[j]), other.sizes[j]
                score = np.add.reduceat(weights[other.codes[at]] * other.weights[at], np.cumsum(sizes) - sizes)
                weights[mine] = 0
                score = np.round(score, _DIGITS)
                j, score = j[score >= threshold], score[score >= threshold]
                top = np.lexsort((firsts[j], -score))[:keep]
                out += [(one.rows[i], other.rows[x], other.firsts[x], v) for x, v in zip(j[top], score[top])]
            if out:
                anchor, gid, first, value = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.string()), pa.array(gid, pa.string()), pa.array(first, pa.string()), pa.array(value, pa.float64())],
                    names=["anchor", "gid", "first_id", "score"],
                )

    return run


def sparse_knn_join(
    anchors: DataFrame, candidates: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, block: int = 1024
) -> DataFrame:
    """Exact near neighbours (anchor_id, neighbour_id, score) of term vectors (id, terms).

    Each anchor takes its k + 1 best candidates at or above the threshold (above
    0), ties by id, and then drops itself. Equal vectors are compared once. Vectors are packed into blocks of
    bounded size, which are stored; a task reads two of them and looks up the terms that each vector
    cannot do without, ``block`` anchors at a time. Only of pairs that can reach the threshold by
    the terms that both prefixes hold are the vectors multiplied, where they are. No pair is stored or
    moved unless it is one of an anchor's best: vectors move once, and the work, not the disk, grows with the
    pairs. Ids are unique; null ids take no part. Anchors that have ids only are the candidates of these ids.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be above 0")
    keep = k + 1

    def named(df: DataFrame) -> DataFrame:
        kept = df.filter("id is not null").select(F.col("id").cast("string").alias("id"), fingerprint("terms").alias("gid"), "terms")
        return _vectors(kept)

    theirs = named(candidates)
    if "terms" in anchors.columns:
        mine = named(anchors)
    else:  # Only what tells vectors apart meets the ids.
        wanted = anchors.select(F.col("id").cast("string").alias("id"))
        mine = theirs.select("id", "gid").join(wanted, "id", "left_semi")
    pool = first_n(theirs.select("id", "gid"), ["gid"], [F.asc("id")], keep).groupBy("gid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = mine.groupBy("gid").agg(F.count(F.lit(1)).alias("copies"))
    held = pool.join(asked, "gid", "full").select(
        "gid", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids")
    )
    release(candidates.sparkSession)  # what made the vectors
    held, seen = checkpoint_with(held, total=F.sum("copies"), alone=F.count_if(F.size("ids") == 0), n=F.count(F.lit(1)))
    # The anchors' vectors move only if the candidates lack some of them.
    full = theirs.unionByName(mine) if seen["alone"] else theirs
    n_terms = full.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = max(1, math.ceil(n_terms / _TERMS), math.ceil((seen["n"] or 0) / _VECTORS))
    none = [F.lit(None).cast(full.schema[c].dataType).alias(c) for c in ("keys", "weights")]
    facts = held.select(F.col("gid").alias("row"), (F.col("copies") > 0).alias("asks"), F.get("ids", F.lit(0)).alias("first"), *none)
    vectors = full.select(F.col("gid").alias("row"), F.lit(False).alias("asks"), F.lit(None).cast("string").alias("first"), "keys", "weights")
    blocks = _blocks(vectors.unionAll(facts), parts, threshold)
    found = _pairs_of(blocks, _compared(keep, threshold, block), "anchor string, gid string, first_id string, score double")
    asked = held.filter("copies > 0").select("gid", "copies", "ids")
    copied = asked.filter(F.size("ids") > 0)
    found = found.unionByName(copied.select(F.col("gid").alias("anchor"), "gid", F.col("ids")[0].alias("first_id"), F.lit(1.0).alias("score")))
    # An anchor's own vector is among what it was compared with.
    once = found.groupBy("anchor", "gid").agg(F.max("score").alias("score"), F.min("first_id").alias("first_id"))
    best = first_n(once, ["anchor"], [F.desc("score"), F.asc("first_id")], keep).select("anchor", "gid", "score")
    scored = best.join(held.select("gid", "ids"), "gid").select(F.col("anchor").alias("gid"), "ids", "score")
    return neighbour_lists(scored, mine.select("id", "gid"), asked.drop("ids"), keep, seen["total"] or 0)
