"""Whitening and nearest neighbours against numpy, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import curves, whitening
from threadloom.llm.queries import registry

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
CLASHING = "cast(1 as int) as component, 'a' as score, 2L as rank, 'g' as gid, 3L as x, 'i' as id"
ODD = [None, [], [None, 1.0], [NAN, 1.0], [INF, 1.0], [-INF, 0.0]]


def table(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int" if rows and len(rows[0]) > 2 else f"vec_id long, embedding array<{kind}>")
    return df.selectExpr("*", *CLASHING.split(", "))


def matrix(spark, folder=SF):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])


# Whitening


def expected(vectors, k):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), [sum(int(v) for v in col) for col in x.T]
    y = (x - np.array([s // n for s in sums])) - np.array([s % n for s in sums]) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviations = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviations, y @ basis / np.sqrt(values), values / np.trace(y.T @ y / n)


def check_whitening(got, ids, vectors, k, tolerance=1e-9):
    n, deviations, coordinates, share = expected(vectors, k)
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert sorted((r.id, int(r.deviation)) for r in got if r.component == 1) == sorted(zip(ids, deviations))
    for c in range(1, k + 1):
        mine = {r.id: r.whitened for r in got if r.component == c}
        column = np.array([mine[i] for i in ids])
        wanted = coordinates[:, c - 1]
        assert min(np.abs(column - wanted).max(), np.abs(column + wanted).max()) < tolerance
        assert next(iter({r.explained for r in got if r.component == c})) == pytest.approx(share[c - 1], rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def renamed(df):
    return df.withColumnRenamed("vec_id", "id").collect()


def test_whitening_query(spark):
    ids, vectors = matrix(spark)
    df = registry()["op11_whitening"](spark, SF)
    assert dict(df.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    check_whitening(renamed(df), ids.tolist(), vectors, 8)


def test_whitening_of_skewed_scales(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(300, 6)) @ np.diag([1e6, 1e4, 100, 10, 1, 0.1]) + [5e8, 0, -3, 0, 0, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    check_whitening(renamed(whitening.whiten(table(spark, rows).repartition(5), 4)), list(range(300)), vectors, 4, 1e-6)


def test_whitening_of_dependent_dimensions(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(100, 3))
    vectors = np.concatenate([base, base[:, :2], np.full((100, 2), 0.25)], axis=1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = renamed(whitening.whiten(table(spark, rows), 8))
    assert {r.component for r in got} == {1, 2, 3}
    check_whitening(got, list(range(100)), vectors, 3)


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(5)
    good = [(i, draw.normal(size=2).tolist()) for i in range(30)]
    rows = [*good, good[0], *[(100 + i, v) for i, v in enumerate(ODD)]]
    got = renamed(whitening.whiten(table(spark, rows), 8))
    assert {r.id for r in got} == set(range(30)) and {r.n for r in got} == {31} and len(got) == 62
    null_key = renamed(whitening.whiten(table(spark, [*good, (None, [1.0, 2.0])]), 8))
    assert sum(r.id is None for r in null_key) == 2


def test_exact_deviations_beyond_long(spark):
    rows = [(0, [2.0**35, 0.0]), (1, [-(2.0**35), 1.0]), (2, [0.5, 2.0])]
    got = renamed(whitening.whiten(table(spark, rows), 1))
    _, deviations, _, _ = expected([r[1] for r in rows], 1)
    assert max(deviations) > 2**63
    assert [int(r.deviation) for r in sorted(got, key=lambda r: r.id)] == deviations


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_spread(spark, rows):
    assert whitening.whiten(table(spark, rows), 8).collect() == []


def test_whitening_errors(spark):
    with pytest.raises(Exception, match="length"):
        whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0])]), 8).collect()
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(table(spark, [(1, [1e30, 2.0]), (2, [1.0, 1.0])]), 8).collect()


# Nearest neighbours


def brute(ids, vectors, queries, k):
    out = {}
    for i in queries:
        mine = [(-float((vectors[ids.index(i)] * v).sum()), j) for j, v in zip(ids, vectors) if j != i]
        out[i] = sorted(mine)[:k]
    return out


def neighbours(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for hits in out.values():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
    return {q: [(s, i) for _, s, i in hits] for q, hits in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-12)


def test_small_tables_are_exact(spark):
    ids, vectors = matrix(spark)
    got = neighbours(registry()["op13_hilbert_windows"](spark, SF))
    same(got, brute(ids.tolist(), vectors, [i for i in ids.tolist() if i % 20 == 0], 20))


def test_window_is_measured_at_every_size(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 6)))]
    seen, measure = [], curves._window
    monkeypatch.setattr(curves, "_window", lambda *a: seen.append(measure(*a)) or seen[-1])
    found = []
    for block in (4096, 100):  # above and below the number of records
        rule = curves.Curves(block=block, query_block=8 * block)
        found.append(neighbours(curves.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 5, rule)))
    assert len(seen) == 2 and seen[0] == seen[1]
    assert found[0].keys() == found[1].keys() == {0, 20, 40, 60, 80, 100}


def test_hilbert_curve_visits_neighbouring_cells():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.indices((1 << bits,) * d).reshape(d, -1).T
        keys = [k.tobytes() for k in curves.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(keys)
        path = cells[np.argsort(np.array(keys, dtype=object))]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in hits}) for q, hits in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("norms", [False, True])
def test_recall_in_windows(spark, norms):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 24))
    vectors = centres[draw.integers(0, 40, 4000)] + 0.4 * draw.normal(size=(4000, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if norms:
        vectors *= draw.uniform(0.5, 2.0, (4000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rule = curves.Curves(block=64, query_block=512, probes=60)
    got = neighbours(curves.nearest(table(spark, rows).repartition(6), F.col("vec_id") % 20 == 0, 20, rule))
    want = brute(list(range(4000)), vectors, range(0, 4000, 20), 20)
    assert all(len(hits) == 20 for hits in got.values()) and got.keys() == want.keys()
    assert recall(got, want) >= 0.9


def test_many_copies(spark):
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(400, 5))
    vectors[100:300] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rule = curves.Curves(block=32, query_block=64, probes=16, recall=1.0)
    got = neighbours(curves.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 20, rule))
    want = brute(list(range(400)), vectors, range(0, 400, 20), 20)
    for q in [0, *range(100, 300, 20)]:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]


def test_odd_vectors_and_few_candidates(spark):
    odd = [(20 * (i + 5), v) for i, v in enumerate([*ODD, [0.0, 0.0]])]
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [2.0, 0.0]), (4, [2.0, 0.0]), (None, [9.0, 9.0]), *odd]
    got = neighbours(curves.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {0: [(-2.0, 3), (-2.0, 4), (-0.5, 20)], 20: [(-1.0, 3), (-1.0, 4), (-0.5, 0)]}
    assert curves.nearest(table(spark, []), F.lit(True)).collect() == []
    assert curves.nearest(table(spark, [(1, [1.0])]), F.lit(True)).collect() == []
    assert curves.nearest(table(spark, [(1, [1.0]), (2, [1.0])]), F.lit(False)).collect() == []


def test_keys_that_are_strings(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "name string, v array<float>")
    got = curves.nearest(df, F.col("name") == "a", 2, key="name", vector="v").orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.name, r.score) for r in got] == [("a", 1, "c", 1.0), ("a", 2, "b", 0.0)]


def test_vectors_of_different_lengths(spark):
    with pytest.raises(ValueError, match="length"):
        curves.nearest(table(spark, [(0, [1.0]), (1, [1.0, 2.0])]), F.lit(True))
