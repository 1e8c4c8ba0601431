"""Weighted words: the model, the sparse cosine join, and refreshed vectors."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import similarity as S
from threadloom.operators import terms as T
from threadloom.plans.duplicates import daily_clustering


def vectors_of(texts):
    bags = {i: Counter(t.lower().split()) for i, t in texts.items() if t is not None}
    df = Counter(w for bag in bags.values() for w in bag)
    out = {}
    for i, bag in bags.items():
        v = {w: n * math.log((len(bags) + 1) / (df[w] + 1)) for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if norm:
            out[i] = {w: x / norm for w, x in v.items()}
    return out


def brute(texts, k, threshold, anchors=None):
    v = vectors_of(texts)
    found = set()
    for a in v if anchors is None else anchors:
        hits = [(-round(sum(x * v[b].get(w, 0) for w, x in v[a].items()), 9), b) for b in v]
        best = sorted(h for h in hits if -h[0] >= threshold)[: k + 1]
        found |= {(a, b, round(-s, 6)) for s, b in best if b != a}
    return found


def corpus(seed, n):
    """Texts over a skewed vocabulary, in groups of near and exact copies."""
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7)) % 4000}" for _ in range(20_000)]
    texts = {}
    while len(texts) < n:
        base = [draw.choice(words) for _ in range(draw.randint(1, 40))]
        for _ in range(draw.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 3])):
                w[draw.randrange(len(w))] = draw.choice(words)
            texts[f"{len(texts):04d}"] = " ".join(w)
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id string, text string")


@pytest.mark.parametrize("threshold, block", [(0.86, 1024), (0.86, 5), (0.5, 16)])
def test_join_against_all_pairs(spark, threshold, block):
    texts = corpus(int(threshold * 100) + block, 250)
    df = frame(spark, texts).repartition(5)
    vectors = T.term_vectors(df, T.fit_terms(df)).checkpoint()
    got = T.sparse_knn_join(vectors, vectors, 6, threshold, block).collect()
    assert {(r.anchor_id, r.neighbour_id, round(r.score, 6)) for r in got} == brute(texts, 6, threshold)
    some = sorted(texts)[::7]
    mine = vectors.filter(F.col("id").isin(some))
    got = T.sparse_knn_join(mine, vectors, 2, threshold, block).collect()
    assert {(r.anchor_id, r.neighbour_id, round(r.score, 6)) for r in got} == brute(texts, 2, threshold, some)


def test_group_of_copies_holding_a_third(spark):
    texts = corpus(9, 120) | {f"c{i:03d}": "the same few words again" for i in range(60)}
    df = frame(spark, texts)
    vectors = T.term_vectors(df, T.fit_terms(df))
    got = T.sparse_knn_join(vectors, vectors, 3).collect()
    assert {(r.anchor_id, r.neighbour_id, round(r.score, 6)) for r in got} == brute(texts, 3, S.THRESHOLD)


def test_odd_texts(spark):
    texts = {"a": None, "b": "", "c": " \t\n", "d": "common", "e": "common x", "f": "common X", "g": "y " * 5000}
    df = frame(spark, texts).withColumn("df", F.lit(1)).withColumn("terms", F.lit("clash"))
    model = T.fit_terms(df)
    assert {(r.term is None, r.df) for r in model.collect()} == {(True, 6), (False, 3), (False, 2), (False, 1)}
    vectors = T.term_vectors(df, model)
    got = T.sparse_knn_join(vectors, vectors).collect()
    assert {(r.anchor_id, r.neighbour_id) for r in got} == {("e", "f"), ("f", "e")}
    nothing = df.filter("false")
    empty = T.term_vectors(nothing, T.fit_terms(nothing))
    assert empty.collect() == [] and T.sparse_knn_join(empty, empty).collect() == []
    assert T.sparse_knn_join(vectors, empty).collect() == []
    with pytest.raises(ValueError):
        T.sparse_knn_join(vectors, vectors, threshold=0)


def test_updated_model_is_that_of_a_full_run(spark):
    old, new = corpus(1, 40), corpus(2, 40)
    went, came = dict(list(old.items())[:10]), dict(list(new.items())[:15])
    now = {k: v for k, v in old.items() if k not in went} | {f"n{k}": v for k, v in came.items()}
    model = T.update_terms(T.fit_terms(frame(spark, old)), frame(spark, came), frame(spark, went))
    assert {tuple(r) for r in model.collect()} == {tuple(r) for r in T.fit_terms(frame(spark, now)).collect()}


def test_refreshed_vector_is_that_of_a_full_run(spark):
    df = frame(spark, corpus(3, 60))
    embedder = S.hashing_embedder(64, S.fit_slots(df, 64).checkpoint())
    full = {r.id: r["values"] for r in embedder(df).collect()}
    assert full == {r.id: r["values"] for r in S.hashing_embedder(64)(df).collect()}
    cached = embedder(df.filter("id != '0007'")).select("id", "values")
    got = {r.id: r["values"] for r in S.refresh_embeddings(df, cached, embedder).collect()}
    assert got == full and abs(np.linalg.norm(got["0007"]) - 1) < 1e-6


def test_daily_clustering_by_words(spark):
    texts = corpus(5, 150)
    issues = frame(spark, texts).select(
        "id", F.lit(None).cast("string").alias("name"), F.col("text").alias("first_message_content"),
        F.array().cast("array<string>").alias("applied_tags"), F.lit("c").alias("channel_id"),
        F.lit(None).cast("string").alias("sentiment"), F.lit(None).cast("string").alias("duplicate_cluster_id"),
        F.lit(0).cast("timestamp").alias("created_at"),
    )
    clusters, assigned = daily_clustering(issues)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in brute(texts, S.TOP_K, S.THRESHOLD):
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    sizes = Counter(map(root, texts))
    assert {r.id: r.duplicate_cluster_id for r in assigned.collect()} == {i: root(i) if sizes[root(i)] > 1 else None for i in texts}
    assert {r.id: r.issue_count for r in clusters.collect()} == {i: n for i, n in sizes.items() if n > 1}


def test_only_likely_pairs_move(spark):
    # All share one rare word with all others, which no two texts need to be alike for.
    texts = {f"{i:03d}": "seldom " + " ".join(f"x{i}_{j}" for j in range(12)) for i in range(60)}
    texts |= {f"n{i:02d}": " ".join(f"y{i // 2}_{j}" for j in range(40)) + f" z{i}" for i in range(20)}
    df = frame(spark, texts)
    vectors = T.term_vectors(df, T.fit_terms(df)).checkpoint()
    held = T._vectors(vectors).select(
        F.monotonically_increasing_id().alias("row"), "id", F.lit(1).alias("copies"), F.array("id").alias("ids"), "keys", "weights"
    ).checkpoint()
    name = {r.row: r.id for r in held.select("row", "id").collect()}
    pairs = {(name[r.a], name[r.b]) for r in T._candidate_pairs(held, S.THRESHOLD, 7).collect()}
    assert pairs == {(a, b) for a, b, _ in brute(texts, 6, S.THRESHOLD)} and len(pairs) == 20


def test_length_of_a_text_is_computed_once(spark):
    df = frame(spark, {str(i): " ".join(f"w{i}_{j}" for j in range(6000)) for i in range(80)}).repartition(4).checkpoint()
    vectors = T.term_vectors(df, T.fit_terms(df).checkpoint())
    began = time.monotonic()
    assert vectors.agg(F.round(F.sum(F.aggregate("terms", F.lit(0.0), lambda s, x: s + x.weight * x.weight)), 6)).first()[0] == 80
    # 480,000 terms; the square of a text's terms would be 2.9 billion steps.
    assert time.monotonic() - began < 25


def test_no_table_of_pairs_and_one_move_of_vectors(spark, monkeypatch):
    """Texts that all share rare words: pairs outnumber texts, but only vectors are stored, once, and no candidate moves."""
    stored = []
    real = T._blocks
    monkeypatch.setattr(T, "_blocks", lambda held, parts, threshold: stored.append(real(held, parts, threshold)) or stored[-1])
    monkeypatch.setattr(T, "_TERMS", 500)
    texts = {f"{i:03d}": " ".join(f"x{i % 7}_{j}" for j in range(9)) + f" y{i} z{i}" for i in range(140)}
    df = frame(spark, texts)
    vectors = T.term_vectors(df, T.fit_terms(df)).checkpoint()
    got = T.sparse_knn_join(vectors, vectors, 3, 0.5)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "CartesianProduct" in plan and stored[0].count() == 4
    assert {(r.anchor_id, r.neighbour_id, round(r.score, 6)) for r in got.collect()} == brute(texts, 3, 0.5)
    some = df.select("id").filter("id like '%7'")
    assert {(r.anchor_id, r.neighbour_id, round(r.score, 6)) for r in T.sparse_knn_join(some, vectors, 3, 0.5).collect()} == brute(
        texts, 3, 0.5, [i for i in texts if i.endswith("7")]
    )


def test_texts_that_share_an_id_are_added_up(spark):
    df = frame(spark, {"a": "one two", "b": "two three"})
    vectors = T.term_vectors(df.unionAll(df.filter("id = 'a'")), T.fit_terms(df))
    assert {(r.id, len(r.terms)) for r in vectors.collect()} == {("a", 1), ("b", 1)}
