import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph as G
from threadloom.operators import similarity as S
from threadloom.plans.duplicates import MEMBERS, daily_clustering, grow_components
from threadloom.sources.keyed import KeyedTable


def frame(spark, ids, matrix):
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, matrix, strict=True)]
    return spark.createDataFrame(rows, "id string, values array<float>")


def brute_force(anchors, candidates, k, threshold):
    def unit(df):
        m = np.array(df["values"].tolist(), dtype="float64")
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    a, c = anchors.toPandas(), candidates.toPandas()
    sims = unit(a) @ unit(c).T
    found = set()
    for i, row in enumerate(sims):
        order = sorted(range(len(c)), key=lambda j: (-round(row[j], 9), c.id[j]))[: k + 1]
        found |= {(a.id[i], c.id[j]) for j in order if row[j] >= threshold and c.id[j] != a.id[i]}
    return found


def clustered(rng, n, centres, d=16, noise=0.15):
    middle = rng.normal(size=(centres, d))
    return middle[rng.integers(centres, size=n)] + noise * rng.normal(size=(n, d))


@pytest.mark.parametrize("threshold, block", [(0.86, 4096), (0.86, 40), (0.3, 40), (-1.0, 64)])
def test_neighbours_equal_brute_force(spark, threshold, block):
    rng = np.random.default_rng(3)
    table = frame(spark, [f"v{i}" for i in range(300)], clustered(rng, 300, 12))
    anchors = table.filter("id like '%1%'")
    got = S.knn_join(anchors, table, 4, threshold, block=block)
    pairs = {(r["anchor_id"], r["neighbour_id"]) for r in got.collect()}
    assert pairs == brute_force(anchors, table, 4, threshold)


def test_neighbour_tasks_hold_bounded_frames():
    """What a task holds at once does not grow with the number of cells."""
    rng = np.random.default_rng(4)
    matrix, pivots = rng.normal(size=(1500, 8)), rng.normal(size=(90, 8))
    frame = pd.DataFrame({"gid": [f"g{i}" for i in range(1500)], "values": list(matrix)})
    everywhere = np.zeros(90), np.full(90, np.pi)
    frames = list(S._reachable_cells(pivots, *everywhere, np.pi)(iter([frame])))
    assert max(map(len, frames)) <= 512
    seen = [(g, c) for f in frames for g, cells in zip(f["gid"], f["cells"], strict=True) for c in cells]
    assert len(seen) == len(set(seen)) == 1500 * 90
    assert {c // S._TILE == t for f in frames for t, cells in zip(f["tile"], f["cells"], strict=True) for c in cells} == {True}


def test_best_in_rows_keeps_ties_and_skips_undefined():
    scores = np.array([[0.5, np.nan, 0.9, 0.5, 0.5, 0.1], [np.nan] * 6])
    row, col, value = S._best_in_rows(scores, np.array(list("fedcba")), 3, 0.2)
    assert list(zip(row, col, value, strict=True)) == [(0, 2, 0.9), (0, 4, 0.5), (0, 3, 0.5)]


def test_copies_and_absent_anchor(spark):
    rng = np.random.default_rng(5)
    vectors = clustered(rng, 60, 5)
    # A third of all vectors are copies of one another.
    matrix = np.vstack([vectors, np.repeat(vectors[:1], 30, axis=0)])
    table = frame(spark, [f"v{i:03d}" for i in range(90)], matrix)
    got = S.knn_join(table, table, 3, 0.86, block=16)
    assert {(r["anchor_id"], r["neighbour_id"]) for r in got.collect()} == brute_force(table, table, 3, 0.86)
    # An anchor that is not a candidate keeps k + 1.
    outside = frame(spark, ["new"], vectors[:1])
    rows = S.knn_join(outside, table, 3, 0.86).orderBy("neighbour_id").collect()
    assert [r["neighbour_id"] for r in rows] == ["v000", "v060", "v061", "v062"]


def test_no_neighbours(spark):
    table = frame(spark, ["a", "b"], np.eye(2))
    assert S.knn_join(table, table).count() == 0
    assert S.knn_join(table.limit(0), table).count() == 0
    assert S.knn_join(table, table.limit(0)).count() == 0


def test_search(spark):
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(50, 8))
    table = frame(spark, [f"v{i:02d}" for i in range(50)], matrix).select(
        "values", F.struct(F.col("id").alias("issueId"), F.lit("c").alias("channelId")).alias("metadata")
    )
    asked = frame(spark, ["q"], matrix[:1]).withColumnRenamed("id", "query_id")
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    want = [f"v{j:02d}" for j in np.argsort(-(unit @ unit[0]))[:4]]
    got = S.semantic_search(asked, table.repartition(5), 4).orderBy("rank").collect()
    assert [r["issue_id"] for r in got] == want and got[0]["score"] == pytest.approx(1)
    # Queries and records in several blocks each.
    all_asked = frame(spark, [f"q{i:02d}" for i in range(50)], matrix).withColumnRenamed("id", "query_id")
    found = {}
    for r in S.semantic_search(all_asked, table, 3, block=20, query_block=15).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r["issue_id"])
    scores = unit @ unit.T
    assert found == {f"q{i:02d}": [f"v{j:02d}" for j in np.argsort(-scores[i])[:3]] for i in range(50)}
    assert S.semantic_search(asked.limit(0), table).count() == 0


def components_by_union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("share", [1, 20, 1000])
@pytest.mark.parametrize("kind", ["random", "star", "path", "none"])
def test_components_equal_union_find(spark, kind, share, monkeypatch):
    rng = np.random.default_rng(11)
    edges = {
        "random": [(f"{a:03d}", f"{b:03d}") for a, b in rng.integers(300, size=(220, 2)) if a != b],
        "star": [("m", f"{i:03d}") for i in range(150)] + [("z", "y")],
        "path": [(f"{(i * 37) % 101:03d}", f"{((i + 1) * 37) % 101:03d}") for i in range(100)],
        "none": [],
    }[kind]
    # None, the hubs, or all of the keys take the path for heavy ones.
    monkeypatch.setattr(G.lookup_by_key, "__defaults__", (share,))
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r["id"]: r["component"] for r in G.connected_components(df).collect()}
    assert got == components_by_union_find(edges)


def test_components_grow_as_over_all_edges(spark, tmp_path):
    rng = np.random.default_rng(5)
    table = KeyedTable(spark, str(tmp_path / "m"), MEMBERS, buckets=4)
    # A hub, loops, a repeated edge, a null end and a day without edges; later days join older components.
    days = [
        [(f"{a:03d}", f"{b:03d}") for a, b in rng.integers(200, size=(60, 2))] + [("150", f"n{i:03d}") for i in range(60)],
        [],
        [(f"{a:03d}", f"{b:03d}") for a, b in rng.integers(200, size=(60, 2))] + [("150", "n003"), ("n004", None), ("zz", "zz")],
        [("a", "150"), ("a", "zy"), ("n001", "n002")],
    ]
    past = []
    for day in days:
        past += [(a, b) for a, b in day if b is not None and a != b]
        links = spark.createDataFrame(day, "src string, dst string")
        want = components_by_union_find(past)
        for _ in range(2):  # the second time after a failure
            touched = {r["id"]: r["component"] for r in grow_components(table, links).collect()}
            assert {r["id"]: r["component"] for r in table.read().collect()} == want
            ends = {want[x] for edge in day for x in edge if x in want}
            assert touched == {i: c for i, c in want.items() if c in ends}
    assert G.changed_components(table.read(), links).count() == 0


def test_clustering_of_a_later_day_extends_clusters(spark, tmp_path):
    members = KeyedTable(spark, str(tmp_path / "m"), MEMBERS, buckets=4)
    turned = {"a": 0, "b": 20, "c": 40, "x": 90, "y": 110}  # degrees; b and c join only through one another
    rows = {i: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for i, d in turned.items()}

    def run(ids, clusters):
        issues = spark.createDataFrame([(i, f"n{i}", clusters.get(i)) for i in ids], "id string, name string, duplicate_cluster_id string")
        issues = issues.withColumn("created_at", F.lit(None).cast("timestamp"))
        vectors = spark.createDataFrame([(rows[i], (i,)) for i in ids], "values array<float>, metadata struct<issueId: string>")
        found, assigned = daily_clustering(issues, threshold=0.9, vectors=vectors, members=members)
        return {r["id"]: r["issue_count"] for r in found.collect()}, {r["id"]: r["duplicate_cluster_id"] for r in assigned.collect()}

    first, known = run("bcxy", {})
    assert first == {"b": 2, "x": 2} and known == {"b": "b", "c": "b", "x": "x", "y": "x"}
    assert run("abcxy", known) == ({"a": 3}, {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"})


def test_rounds_are_limited(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    with pytest.raises(RuntimeError):
        G.connected_components(df, max_rounds=1)


def test_cluster_names(spark):
    components = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")], "id string, component string")
    issues = spark.createDataFrame(
        [("a", "x" * 100, None), ("b", "n", "old"), ("c", "", None), ("d", "n", None), ("f", "n", "old")],
        "id string, name string, duplicate_cluster_id string",
    )
    got = {r["id"]: (r["name"], r["issue_count"]) for r in G.build_clusters(components, issues).collect()}
    assert got == {"a": ("x" * 80, 2), "c": ("cluster-c", 2)}
    assigned = {r["id"]: r["duplicate_cluster_id"] for r in G.assign_clusters(issues, components).collect()}
    assert assigned == {"a": "a", "b": "a", "c": "c", "d": "c", "f": "old"}


TEXTS = [
    ("1", "cannot log in with google account since friday", None),
    ("2", "cannot log in with google account since friday", None),
    ("3", "my invoice shows the wrong currency and a wrong total", "old"),
    ("4", "my invoice shows the wrong currency and a wrong total", None),
    ("5", "webhooks arrive twice after the latest release", None),
    ("6", "", None),
]


def text_issues(spark):
    return spark.createDataFrame(
        [(i, "", t, c, "ch", None, []) for i, t, c in TEXTS],
        "id string, name string, first_message_content string, duplicate_cluster_id string, channel_id string,"
        " sentiment string, applied_tags array<string>",
    ).withColumn("created_at", F.timestamp_seconds(F.col("id").cast("bigint")))


def test_duplicate_job(spark):
    clusters, issues = daily_clustering(text_issues(spark))
    got = {r["id"]: r["duplicate_cluster_id"] for r in issues.collect()}
    # Issue 4 pulls the clustered issue 3 into a new cluster.
    assert got == {"1": "1", "2": "1", "3": "3", "4": "3", "5": None, "6": None}
    assert {r["id"]: r["issue_count"] for r in clusters.collect()} == {"1": 2, "3": 2}


def test_embedding_records(spark):
    records = S.embed_issues(text_issues(spark)).collect()
    assert sorted(r["id"] for r in records) == [f"issue:{i}" for i in range(1, 6)]
    assert all(abs(np.linalg.norm(r["values"]) - 1) < 1e-5 for r in records)

    def encode(texts):
        return np.array([[len(t), 1.0] for t in texts])

    plugged = S.embed_issues(text_issues(spark), S.model_embedder(encode)).collect()
    assert all(len(r["values"]) == 2 for r in plugged)


def test_cache_policies(spark):
    texts = text_issues(spark).select("id", F.col("first_message_content").alias("text"))
    encode = S.model_embedder(lambda ts: np.ones((len(ts), 2)))
    cached = texts.filter("id < '4'").withColumn("values", F.array(F.lit(5.0), F.lit(5.0)).cast("array<float>"))
    assert S.embedding_cache_delta(texts, cached).first()["policy"] == "partial"
    fresh = {r["id"]: r["values"][0] for r in S.refresh_embeddings(texts, cached, encode).collect()}
    assert fresh["1"] == 5.0 and fresh["5"] < 1 and len(fresh) == 6
    assert S.embedding_cache_delta(cached, cached).first()["policy"] == "reuse"
    large = spark.range(100).select(F.col("id").cast("string").alias("id"))
    assert S.embedding_cache_delta(large, cached).first()["policy"] == "stale"


def test_embed_text_forms(spark):
    rows = [("1", " a ", "b", '["x","y"]'), ("2", None, "", "[oops"), ("3", "n", None, None), ("4", "z" * 9000, "", "[]")]
    df = spark.createDataFrame(rows, "id string, name string, first_message_content string, applied_tags string")
    got = {r["id"]: r["text"] for r in S.embed_text(df).collect()}
    assert got["1"] == "a \n\nb\n\nTags: x y" and got["2"] == "" and got["3"] == "n" and len(got["4"]) == 9000
    assert {r["id"]: len(r["text"]) for r in S.embed_text(df, S.MODEL_TEXT).collect()}["4"] == 8000
