"""Embedding, nearest neighbours and semantic search."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import blank_to_null, cut, slot_of, tags_from_json, text_words
from threadloom.operators.distributed import checkpoint_with, first_n, lookup_by_key
from threadloom.operators.maintenance import upsert

# Similarity from which two issues are near-duplicates, neighbours
# looked at per issue, characters of text that a model with a context window reads.
THRESHOLD = 0.86
TOP_K = 6
MODEL_TEXT = 8000

# Takes (id, text, ...) rows and adds ``values``, a float array.
Embedder = Callable[[DataFrame], DataFrame]

_WHITESPACE = " \t\n\r\f\v"


def embed_text(issues: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Issues with ``text``: name, body and tags. Tags may be a JSON string.

    The whole text, unless the model that is to read it takes ``max_chars`` only.
    """
    tags = F.col("applied_tags")
    if isinstance(issues.schema["applied_tags"].dataType, T.StringType):
        tags = tags_from_json(tags)
    joined = blank_to_null(F.array_join(tags, " "))
    text = F.concat_ws(
        "\n\n",
        blank_to_null(F.col("name")),
        blank_to_null(F.col("first_message_content")),
        F.concat(F.lit("Tags: "), joined),
    )
    trimmed = F.btrim(text, F.lit(_WHITESPACE))
    return issues.withColumn("text", trimmed if max_chars is None else cut(trimmed, max_chars))


def fit_slots(texts: DataFrame, dimension: int = 512, text: str = "text") -> DataFrame:
    """The model (term, df) of hashed vectors: in how many texts each place occurs; a null term counts them.

    Models of parts of the texts add up, see ``add_models``.
    """
    slots = F.array_distinct(F.transform(F.array_distinct(text_words(F.col(text))), lambda w: slot_of(w, dimension)))
    each = texts.filter(F.col(text).isNotNull())
    each = each.select(F.explode(F.array_append(slots, F.lit(None).cast("int"))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def add_models(model: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Document frequencies (term, df) after the texts of two other models came and went."""
    total = model.select("term", "df").unionByName(added)
    if removed is not None:
        total = total.unionByName(removed.withColumn("df", -F.col("df")))
    total = total.groupBy("term").agg(F.sum("df").alias("df"))
    return total.filter((F.col("df") > 0) | F.col("term").isNull())


def slot_weights(model: DataFrame, dimension: int) -> np.ndarray:
    """Weight of each place; the model has one row for each."""
    rows = model.limit(dimension + 1).collect()
    n = next((r.df for r in rows if r.term is None), 0)
    known = {r.term: r.df for r in rows}
    return np.array([math.log((n + 1) / (known.get(i, 0) + 1)) for i in range(dimension)])


def hashing_embedder(dimension: int = 512, model: DataFrame | None = None) -> Embedder:
    """Term-frequency vectors weighted by rarity, hashed to ``dimension`` and normalised.

    ``model`` is a table by ``fit_slots``; with it a text has the same vector
    whatever texts it is embedded with. Without it each call fits its own texts.
    """
    def embed(df: DataFrame) -> DataFrame:
        weights = slot_weights(fit_slots(df, dimension) if model is None else model, dimension)

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            slots: dict[str, int] = {}

            def slot(word: str) -> int:
                if (found := slots.get(word)) is None:
                    if len(slots) > 1 << 20:
                        slots.clear()
                    found = slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension
                return found

            def vector(text: str | None) -> np.ndarray:
                words = re.split("[ \t-\r]+", (text or "").lower())
                at = np.fromiter((slot(w) for w in words if w), np.int64)
                values = np.bincount(at, minlength=dimension) * weights
                return (values / (math.sqrt((values**2).sum()) or 1)).astype("float32")

            return texts.map(vector)

        return df.withColumn("values", vectors("text"))

    return embed


def model_embedder(encode: Callable[[list[str]], np.ndarray]) -> Embedder:
    """Any model that maps a list of texts to a matrix, run in Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        matrix = np.asarray(encode(texts.tolist()), dtype="float32")
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        return pd.Series(list(matrix / np.where(norm == 0, 1, norm)))

    return lambda df: df.withColumn("values", vectors("text"))


def embed_issues(
    issues: DataFrame, embedder: Embedder | None = None, max_chars: int | None = None
) -> DataFrame:
    """Vector records of all issues with text; ``max_chars`` as in ``embed_text``."""
    texts = embed_text(issues, max_chars).filter("text != ''").select("id", "text", "channel_id", "sentiment")
    embedded = (embedder or hashing_embedder())(texts)
    blank = F.lit("")
    return embedded.select(
        F.concat(F.lit("issue:"), "id").alias("id"),
        "values",
        F.struct(
            F.col("id").alias("issueId"),
            F.coalesce("channel_id", blank).alias("channelId"),
            F.coalesce("sentiment", blank).alias("sentiment"),
        ).alias("metadata"),
    )


def vector_upsert(index: DataFrame, records: DataFrame) -> DataFrame:
    """Replace vectors by id."""
    return upsert(index, records, "id")


def embedding_cache_delta(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Compare issue ids with cached ids: counts and what to do with the cache."""
    def rows(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)))

    now, old = current.select("id").distinct(), cached.select("id").distinct()
    missing, extra = now.join(old, "id", "left_anti"), old.join(now, "id", "left_anti")
    few = F.greatest(F.lit(10), F.col("current") * 0.01)
    return rows(now).toDF("current").select(
        "current",
        rows(missing).scalar().alias("missing"),
        rows(extra).scalar().alias("extra"),
    ).withColumn(
        "policy",
        F.when((F.col("missing") == 0) & (F.col("extra") == 0), "reuse")
        .when(F.col("missing") <= few, "partial")
        .otherwise("stale"),
    )


def refresh_embeddings(texts: DataFrame, cached: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors (id, values) of all current texts, encoding only what the cache lacks.

    Follows the policy of ``embedding_cache_delta``: a stale cache is not used.
    """
    if embedding_cache_delta(texts, cached).first()["policy"] == "stale":
        return embedder(texts).select("id", "values")
    known = cached.select("id", "values").join(texts.select("id"), "id", "left_semi")
    fresh = embedder(texts.join(cached.select("id"), "id", "left_anti")).select("id", "values")
    return known.unionByName(fresh)


def _unit_rows(values: pd.Series) -> np.ndarray:
    matrix = np.stack(values.to_numpy()).astype("float64")
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1, norm)


def semantic_search(
    queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 8192, query_block: int = 1024
) -> DataFrame:
    """The k most similar records per query vector (query_id, values).

    Queries and records are dealt into blocks, and one task multiplies two of
    them and keeps k records per query, so both tables may have any size. Up to
    ``query_block`` queries the records are shuffled once.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "values")
    held = vectors.select(
        "values", F.col("metadata.issueId").alias("issue_id"), F.col("metadata.channelId").alias("channel_id")
    )
    n, m = max(1, math.ceil(asked.count() / query_block)), max(1, math.ceil(held.count() / block))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
        return df.select("*", mine.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def best(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        if one.empty or many.empty:
            none = pd.DataFrame({c: np.array([], object) for c in ("query_id", "issue_id", "channel_id")})
            return none.assign(score=np.array([], "float64"))
        scores = _unit_rows(one["values"]) @ _unit_rows(many["values"]).T
        ids = many["issue_id"].to_numpy(dtype=str)
        tops = [np.lexsort((ids, -row))[:k] for row in scores]
        top = np.concatenate(tops)
        query = np.repeat(np.arange(len(one)), [len(t) for t in tops])
        return pd.DataFrame(
            {
                "query_id": one["query_id"].to_numpy(dtype=object)[query],
                "issue_id": many["issue_id"].to_numpy(dtype=object)[top],
                "channel_id": many["channel_id"].to_numpy(dtype=object)[top],
                "score": scores[query, top],
            }
        )

    found = (
        dealt(asked, "query_id", "_q", n, "_v", m)
        .groupBy("_q", "_v")
        .cogroup(dealt(held, "issue_id", "_v", m, "_q", n).groupBy("_q", "_v"))
        .applyInPandas(best, "query_id string, issue_id string, channel_id string, score double")
    )
    return first_n(found, ["query_id"], [F.desc("score"), F.asc("issue_id")], k)


def fingerprint(values: str) -> Column:
    """Text that tells vectors apart: two 64-bit hashes with different seeds."""
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), F.col(values))) for seed in (1, 2)])


_VISIT = "gid string, values array<float>, tile int, cells array<int>"

# Rows that a task of the neighbour join works on at once, and cells that travel together.
_ROWS = 512
_TILE = 8


def _nearest_cell(pivots: np.ndarray):
    """Each vector with its nearest pivot and the angle to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.iloc[at : at + _ROWS]
                angles = np.arccos(np.clip(_unit_rows(batch["values"]) @ pivots.T, -1, 1))
                home = angles.argmin(axis=1)
                yield batch.assign(cell=home.astype("int32"), angle=angles[np.arange(len(batch)), home])

    return assign


def _reachable_cells(pivots: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, reach: float):
    """Each vector once per tile of cells that can hold a partner, with these cells.

    A partner is within the angle ``reach``. By the triangle inequality its
    angle to a pivot differs from ours by at most that, and it lies in the cell
    of its own nearest pivot.
    """
    slack = 1e-6

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.iloc[at : at + _ROWS]
                angles = np.arccos(np.clip(_unit_rows(batch["values"]) @ pivots.T, -1, 1))
                possible = (
                    (angles <= angles.min(axis=1, keepdims=True) + 2 * reach + slack)
                    & (angles - reach <= farthest + slack)
                    & (angles + reach >= nearest - slack)
                )
                # One frame per tile, so that a frame is no larger than its input.
                for first in range(0, possible.shape[1], _TILE):
                    inside = possible[:, first : first + _TILE]
                    rows = np.flatnonzero(inside.any(axis=1))
                    if rows.size:
                        cells = [(np.flatnonzero(inside[r]) + first).astype("int32") for r in rows]
                        yield batch.iloc[rows].assign(tile=np.int32(first // _TILE), cells=cells)

    return visit


def _best_in_rows(similarity: np.ndarray, smallest: np.ndarray, keep: int, threshold: float) -> tuple:
    """Row, column and value of the best ``keep`` entries of each row, ties to the smaller id."""
    least = np.full((len(similarity), 1), threshold)
    similarity = np.where(np.isnan(similarity), -np.inf, similarity)
    if similarity.shape[1] > keep:
        # Only what can be among the best, ties included, is listed.
        least = np.maximum(least, np.partition(similarity, -keep, axis=1)[:, [-keep]])
    row, col = np.nonzero(similarity >= least)
    value = similarity[row, col]
    order = np.lexsort((smallest[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < keep
    return row[best], col[best], value[best]


def _tile_scorer(keep: int, threshold: float):
    """Best ``keep`` candidates of a tile for each anchor, among the cells that the anchor visits."""

    def score(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if anchors.empty or candidates.empty:
            return pd.DataFrame({c: [] for c in ("gid", "ids", "score")})
        mine = _unit_rows(anchors["values"])
        gid, ids = anchors["gid"].to_numpy(), candidates["ids"].to_numpy()
        smallest = np.array([i[0] for i in ids], dtype=str)
        visited = anchors["cells"].to_numpy()
        visitor = np.repeat(np.arange(len(anchors)), [len(c) for c in visited])
        cell = np.concatenate(visited)
        found = [(np.array([], "int64"), np.array([], "int64"), np.array([], "float64"))]
        for own, members in candidates.groupby("cell").indices.items():
            theirs = _unit_rows(candidates["values"].iloc[members]).T
            here = visitor[cell == own]
            for at in range(0, len(here), _ROWS):
                part = here[at : at + _ROWS]
                r, c, value = _best_in_rows(mine[part] @ theirs, smallest[members], keep, threshold)
                found.append((part[r], members[c], value))
        row, col, value = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((smallest[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < keep
        return pd.DataFrame({"gid": gid[row[best]], "ids": ids[col[best]], "score": value[best]})

    return score


def knn_join(
    anchors: DataFrame,
    candidates: DataFrame,
    k: int = TOP_K,
    threshold: float = THRESHOLD,
    block: int = 2048,
    max_cells: int = 1024,
) -> DataFrame:
    """Exact near neighbours (anchor_id, neighbour_id, score) by cosine.

    Both inputs have (id, values). Each anchor takes its k + 1 best candidates
    at or above the threshold, ties by id, and then drops itself.

    Equal vectors are scored once: a group of copies is represented by its k + 1
    smallest ids, all that can appear in a result. Distinct vectors are divided
    among cells of about ``block`` around pivots, and cells are skipped when the
    triangle inequality rules out a partner. A vector moves once to each tile of
    ``_TILE`` cells that it must look at. Tiles and their visitors are cut to the size of
    that many blocks; one task compares two of these, ``_ROWS`` anchors at a time, and
    keeps k + 1 per anchor.
    """
    keep = k + 1
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    mine = anchors.select(F.col("id").cast("string").alias("id"), fingerprint("values").alias("gid"), "values")
    theirs = candidates.select(
        F.col("id").cast("string").alias("id"), fingerprint("values").alias("gid"), "values"
    )
    asked = mine.groupBy("gid").agg(F.first("values").alias("values"), F.count(F.lit(1)).alias("copies"))
    # Both are read several times below.
    asked, asked_seen = checkpoint_with(asked, total=F.sum("copies"))
    pool, pool_seen = checkpoint_with(
        first_n(theirs, ["gid"], [F.asc("id")], keep)
        .groupBy("gid")
        .agg(F.first("values").alias("values"), F.sort_array(F.collect_list("id")).alias("ids")),
        n=F.count(F.lit(1)),
    )
    cells = min(max_cells, math.ceil(pool_seen["n"] / block))
    if cells > 1:
        # The fingerprint is a hash, so the first ones are an even sample.
        chosen = pool.orderBy("gid").limit(cells).select("values").toPandas()
        pivots = _unit_rows(chosen["values"])
        homes = pool.mapInPandas(
            _nearest_cell(pivots), "gid string, values array<float>, ids array<string>, cell int, angle double"
        ).withColumn("tile", F.floor(F.col("cell") / _TILE).cast("int")).checkpoint()
        sizes = homes.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")
        )
        nearest, farthest = np.full(cells, np.inf), np.full(cells, -np.inf)
        for r in sizes.collect():  # one row per pivot
            nearest[r["cell"]], farthest[r["cell"]] = r["lo"], r["hi"]
        visits = asked.select("gid", "values").mapInPandas(
            _reachable_cells(pivots, nearest, farthest, reach), _VISIT
        )
    else:
        homes = pool.withColumns({"cell": F.lit(0), "tile": F.lit(0)})
        visits = asked.select("gid", "values", F.lit(0).alias("tile"), F.array(F.lit(0)).alias("cells"))

    tile_rows = homes.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    visitors = visits.groupBy("tile").agg(F.count(F.lit(1)).alias("m"))
    splits = F.broadcast(  # at most one row per pivot
        tile_rows.join(visitors, "tile").select(
            "tile",
            F.ceil(F.col("n") / (block * _TILE)).cast("int").alias("cs"),
            F.ceil(F.col("m") / (block * _TILE)).cast("int").alias("vs"),
        )
    )

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = visits.join(splits, "tile").select("gid", "values", "cells", "tile", part("vs").alias("vb"), every("cs").alias("cb"))
    right = homes.join(splits, "tile").select(
        "values", "ids", "cell", "tile", part("cs").alias("cb"), every("vs").alias("vb")
    )
    scored = (
        left.groupBy("tile", "vb", "cb")
        .cogroup(right.groupBy("tile", "vb", "cb"))
        .applyInPandas(_tile_scorer(keep, threshold), "gid string, ids array<string>, score double")
    )
    return neighbour_lists(scored, mine, asked, keep, asked_seen["total"] or 0)


def neighbour_lists(scored: DataFrame, members: DataFrame, asked: DataFrame, keep: int, total: int) -> DataFrame:
    """(anchor_id, neighbour_id, score): the best of each group's scores for all its members.

    ``scored`` has (gid, ids, score) with the ids of equal candidates, ``members``
    (id, gid), ``asked`` (gid, copies), and ``total`` counts the members.
    """
    best = first_n(
        scored.select("gid", F.explode("ids").alias("neighbour_id"), "score"),
        ["gid"],
        [F.desc("score"), F.asc("neighbour_id")],
        keep,
    )
    lists = (
        best.groupBy("gid")
        .agg(F.collect_list(F.struct("neighbour_id", "score")).alias("found"))
        .join(asked.select("gid", "copies"), "gid")
    )
    each = members.select(F.col("id").alias("anchor_id"), "gid")
    return (
        lookup_by_key(each, lists, "gid", "copies", total)
        .select("anchor_id", F.inline("found"))
        .filter(F.col("anchor_id") != F.col("neighbour_id"))
    )


def similarity_edges(neighbours: DataFrame) -> DataFrame:
    """Undirected edges (src < dst) of neighbour lists, each once."""
    pair: Sequence[str] = ("anchor_id", "neighbour_id")
    return neighbours.select(F.least(*pair).alias("src"), F.greatest(*pair).alias("dst")).distinct()
