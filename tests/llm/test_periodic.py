"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import cases
import numpy as np
import pytest

from threadloom.llm import periodic
from threadloom.llm.queries import registry

SF = "/root/testdata/sf0.001"


def brute(w, min_length=6, min_periods=4):
    """(start, length, period) of all runs, by comparing the words at every distance."""
    numbers = {}
    a = np.array([numbers.setdefault(x, len(numbers)) for x in w], np.int64)
    found = {}
    for q in range(1, len(w) // min_periods + 1):
        edges = np.diff(np.concatenate([[0], (a[q:] == a[:-q]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if e - s + q >= max(min_length, min_periods * q):
                found.setdefault((int(s), int(e) + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(draw):
    letters = draw.choice([1, 2, 2, 3, 5, 50])
    w = [b"%d" % draw.randrange(letters) for _ in range(draw.randint(0, 150))]
    for _ in range(draw.randint(0, 3)):
        base = [draw.choice([b"a", b"b", b"0", b"%d" % draw.randrange(30)]) for _ in range(draw.randint(1, 20))]
        if draw.random() < 0.4:
            base = (base[:2] * 6 + base)[: draw.randint(3, 20)]
        at = draw.randint(0, len(w))
        w[at:at] = (base * draw.randint(2, 9))[: draw.randint(1, 200)]
    return w


def test_all_runs_of_random_words():
    draw = random.Random(7)
    for _ in range(30):
        documents = [random_words(draw) for _ in range(40)]
        ids, starts = periodic._numbered(documents)
        found = periodic.runs_of(ids, max(map(len, documents)))
        owner = np.searchsorted(starts, found[:, 0], "right") - 1
        got = {}
        for (s, e, q), i in zip(found.tolist(), owner.tolist()):
            got.setdefault(i, []).append((s - int(starts[i]), e - s, q))
        for i, w in enumerate(documents):
            assert sorted(got.get(i, [])) == sorted(brute(w, 3, 3))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in registry()["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], planted + 1
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs)).hexdigest()
    assert planted > 5


def test_odd_documents(spark):
    docs = cases.odd_documents(spark).selectExpr("*", "1 as runs", "'c' as collapsed_text")
    got = periodic.find_runs(docs).collect()
    assert len(got) == docs.count()
    assert set(got[0].asDict()) == {*docs.columns, "n_words", "runs", "collapsed_text"}
    for r in got:
        w = (r.text or "").encode().split()
        assert (r.n_words, r.runs, r.collapsed_text) == (len(w), [], b" ".join(w).decode())
    assert periodic.find_runs(cases.no_documents(spark)).collect() == []


def test_runs_of_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000)) + " " + " ".join(f"x{i}" for i in range(5000))
    texts = {1: "a " * 6, 2: "a b a b a b", 3: "x a b a b a b a b y", 4: "a a a a a", 5: long, 6: "A a A a A a A a"}
    got = {r.doc_id: r for r in periodic.find_runs(cases.documents(spark, texts)).collect()}
    runs = {i: [tuple(x) for x in r.runs] for i, r in got.items()}
    assert runs == {1: [(0, 6, 1)], 2: [], 3: [(1, 8, 2)], 4: [], 5: [(0, 30_000, 997)], 6: [(0, 8, 2)]}
    assert got[1].collapsed_text == "a" and got[3].collapsed_text == "x a b y"
    assert got[5].collapsed_text.split()[:998] == [f"w{i}" for i in range(997)] + ["x0"]


def test_three_periods_at_least(spark):
    docs = cases.documents(spark, {1: "p q r p q r p q r"})
    assert [tuple(x) for x in periodic.find_runs(docs, min_periods=3).first().runs] == [(0, 9, 3)]
    with pytest.raises(ValueError):
        periodic.find_runs(docs, min_periods=2)
