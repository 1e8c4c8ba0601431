"""Operators over pages and conversations, against brute force and on odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.llm import queries, quotes, url_filter, warc

# URLs


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def rule(host, path):
    fits = [
        (len(h + p), h + p, v) for h, p, v in queries.URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "http://www.example.com/en/x", "http://a.www.example.com/en/x",
    "http://example.com", "http://example.com?x=/en/", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/es",
    "http://net/fr/#top", "a\nb://İ.COM/ÄÖ?q", "x://y://z.com/", "http://x.org/" + "a/" * 20_000, "http://x.net/fr/", "http://x.net/fr/",
]


def test_url_rules(spark):
    rows = list(enumerate(ODD_URLS)) + [(None, "http://x.net/es/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "verdict": F.lit(3)})
    got = url_filter.judge_urls(pages, queries.URL_RULES).collect()
    expected = Counter((i, u, *parts(u), rule(*parts(u))[0]) for i, u in rows)
    assert Counter((r.page_id, r.url, r.host, r.path, r.rule) for r in got) == expected
    for r in got:
        assert r.verdict == (rule(r.host, r.path)[1] or ("block" if r.blocked_score > 0.5 else "allow"))


def test_url_trees_learn(spark):
    draw = random.Random(3)
    rows = []
    for i in range(1200):
        bad = i % 2
        host = f"{'x-' * 3 if bad else ''}h{draw.randint(1, 99)}.{draw.choice(['org', 'net'])}"
        rows.append((i, f"http://{host}/{'p/' * draw.randint(1, 3)}{'?a=1&b=2&c=3' if bad else ''}", bad))
    labelled = spark.createDataFrame(rows[:800], "page_id long, url string, blocked int")
    asked = spark.createDataFrame(rows[800:], "page_id long, url string, blocked int")
    got = url_filter.judge_urls(asked, [], labelled=labelled, rounds=5).collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum((r.verdict == "block") == truth[r.page_id] for r in got) / len(got) > 0.97


def test_suffix_statistics_of_all_urls(spark):
    rows = [(f"http://h{i}.{'org' if i % 20 else 'rare'}/{i}", int(i % 3 == 0)) for i in range(1000)]
    model = url_filter.train(spark.createDataFrame(rows, "url string, blocked int"), max_rows=60, rounds=2)
    got = {r["_suffix"]: (r["_n"], r["_b"]) for r in model.suffixes.table.collect()}
    assert got == {"org": (950, 317), "rare": (50, 17)}
    # Two urls of one fold and of unlike labels share their statistics, and differ from an unlabelled one.
    urls = spark.createDataFrame(rows, "url string, blocked int").withColumns({"host": F.lit("x.rare"), "path": F.lit("/"), "labelled": F.lit(True)})
    values = url_filter._vectors(urls, model.suffixes).select(url_filter._fold(F.col("url")).alias("fold"), F.col("_features")).collect()
    assert len({(r.fold, r["_features"][10]) for r in values}) == len({r.fold for r in values})
    new = url_filter._vectors(urls.withColumn("labelled", F.lit(False)), model.suffixes).first()
    assert new["_features"][10] == pytest.approx((17 + 20 * 0.334) / 70)


def test_url_features_and_edges(spark):
    got = spark.range(1).select(url_filter.entropy(F.lit("aabb")).alias("two"), url_filter.entropy(F.lit("")).alias("none")).first()
    assert got.two == 1.0 and got.none == 0.0
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(none, queries.URL_RULES).collect() == []
    with pytest.raises(ValueError):
        url_filter.match_rule(F.lit(""), F.lit(""), [("a", "/", "block")] * 1001)


# WARC


def audit_by_hand(one, two):
    def places(rows):
        held = {}
        for a, o, length, d in rows:
            held.setdefault((-1 if a is None else a, -1 if o is None else o), []).append((length, d))
        return {k: sorted(v) for k, v in held.items()}

    x, y = places(one), places(two)
    return {
        k: "missing" if k not in y else "extra" if k not in x else "changed"
        for k in x.keys() | y.keys() if x.get(k) != y.get(k)
    }


SCHEMA = "archive long, offset long, length long, digest string"


def test_audit(spark):
    draw = random.Random(1)
    one = [(a, o * 97, 97, f"{draw.random()}") for a in range(3) for o in range(200)]
    one += [(0, 97, 97, "again"), (0, 97, 97, "again"), (None, 5, 1, "x"), (2, None, 1, "y")]
    two = [r for i, r in enumerate(one) if i % 37 != 5]
    two = [(*r[:3], "rot") if i % 41 == 3 else r for i, r in enumerate(two)] + [(9, 0, 1, "new"), (1, 100_000, 3, "far")]
    two.remove((0, 97, 97, "again"))
    draw.shuffle(two)
    got = warc.audit(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA), range_bytes=256, fanout=4)
    assert {(r.archive, r.offset): r.status for r in got.collect()} == audit_by_hand(one, two)


def test_audit_descends_only_where_needed(spark):
    one = spark.createDataFrame([(0, o, 1, f"d{o}") for o in range(1000)], SCHEMA)
    two = one.withColumn("digest", F.when(F.col("offset") == 500, "rot").otherwise(F.col("digest")))
    height = warc.height_of(one, two, range_bytes=10, fanout=4)
    trees = [warc.build_tree(x, height, 10, 4) for x in (one, two)]
    assert [level.count() for level in trees[0].levels] == [100, 25, 7, 2, 1]
    assert [tuple(r) for r in warc.differing_ranges(*trees).collect()] == [(0, 50)]


def test_equal_and_empty_replicas(spark):
    one = spark.createDataFrame([(0, o, 1, f"d{o}") for o in range(50)], SCHEMA)
    none = one.limit(0)
    assert warc.audit(one, one.repartition(3)).collect() == [] and warc.audit(none, none).collect() == []
    assert warc.audit(one, none).filter("status = 'missing'").count() == 50


def test_layout(spark):
    rows = [(2, "u2", "bb"), (1, None, None), (None, "u", "x" * 100_000), (1, None, None), (3, "ü", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("x"))
    got = warc.layout(pages, 1 << 40).orderBy("offset").collect()
    assert [r.record_id for r in got] == [None, 1, 1, 2, 3]
    assert [r.offset for r in got] == [sum(x.length for x in got[:i]) for i in range(5)]
    size = len("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ü\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode())
    assert got[-1].length == size
    assert {r.archive for r in warc.layout(pages, 100).collect()} == {0, 1000, 1001, 1002} or warc.layout(pages, 100).count() == 5
    assert warc.layout(pages.limit(0), 100).collect() == []


# Quotes

MAIL = [
    ("a", 1, "Hello all,\n\nhow are you?\n"),
    ("a", 2, "> hello  all,\n> how are YOU?\n\nFine, thanks."),
    ("a", 3, "> > Hello all,\n> > how are you?\n> Fine, thanks.\n\nGood to hear."),
    ("a", 4, "Unrelated."),
    ("a", 5, "Top post\n>> nothing\n> unrelated.\nbottom post"),
    ("b", 1, "> Fine, thanks.\nnot in this list"),
    ("b", 2, None), ("b", 3, ""), ("b", 4, ">\n> \n"),
    (None, 1, "Null scope"), (None, 2, "> null scope\nyes"),
    ("c", None, "> Hello"), ("c", 1, "Hello"), ("c", 1, "Hello"), ("c", 2, "> Hello\nHello"), ("c", 3, "> Hello\nlater"),
]


def test_conversations(spark):
    mail = spark.createDataFrame(MAIL, "conv_id string, turn long, text string").withColumns({"root": F.lit(1), "_scope": F.lit(2)})
    got = quotes.conversations(mail).collect()
    assert len(got) == len(MAIL)
    found = {(r.conv_id, r.turn): (r.root, r.parent, r.depth, r.own_text) for r in got}
    assert found[("a", 2)] == (1, 1, 1, "Fine, thanks.")
    assert found[("a", 3)] == (1, 2, 2, "Good to hear.")
    assert found[("a", 4)] == (4, None, 0, "Unrelated.")
    assert found[("a", 5)] == (4, 4, 1, "Top post\nbottom post")
    assert found[("b", 1)] == (1, None, 0, "not in this list")
    assert [found[("b", i)] for i in (2, 3, 4)] == [(i, None, 0, "") for i in (2, 3, 4)]
    assert found[(None, 2)] == (1, 1, 1, "yes")
    assert found[("c", None)] == (None, None, 0, "")
    assert found[("c", 2)] == (1, 1, 1, "Hello") and found[("c", 3)] == (1, 1, 1, "later")
    places = {}
    for r in got:
        places.setdefault((r.conv_id, r.root), []).append((r.position, r.turn))
    for mine in places.values():
        assert [p for p, _ in sorted(mine)] == list(range(len(mine)))
        assert [t for _, t in sorted(mine) if t is not None] == sorted(t for _, t in mine if t is not None)
    assert quotes.conversations(mail.limit(0)).collect() == []


def test_long_chain(spark):
    rows = [("x", i, (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(100)]
    rows.append(("x", 100, "> line 99\n" + "word " * 100_000))
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id string, turn long, text string")).collect()
    assert all(r.root == 0 and r.depth == r.turn == r.position for r in got)


PARTS = [
    ("p", 1, "Hello all,\n\nthe first paragraph\nhas two lines.\n\nAnd a third one ends it."),
    ("p", 2, "Something else\nin two lines."),
    ("p", 3, "> The first paragraph has\n> two lines.\n\nA paragraph, wrapped anew."),
    ("p", 4, "> in two lines.\nOne line."),
    ("p", 5, "> Hello all,\nhello\n> the first paragraph\nyes\n> has two lines.\n>\n> And a third one ends it.\nin between"),
    ("p", 6, ">> One line.\n> altered beyond use\n\nThe level below is lost."),
    ("p", 7, ">>> Something else\n>> nobody wrote this\n> nor this\n\nDeeper still."),
    ("p", 8, "> One line.\n>> in between\nLevel 1 goes first."),
]


def test_quoted_parts(spark):
    mail = spark.createDataFrame(PARTS, "conv_id string, turn long, text string")
    got = {r.turn: (r.root, r.parent, r.own_text) for r in quotes.conversations(mail).collect()}
    assert {t: p for t, (_, p, _) in got.items()} == {1: None, 2: None, 3: 1, 4: 2, 5: 1, 6: 4, 7: 2, 8: 4}
    assert got[5][2] == "hello\nyes\nin between" and got[6][0] == 2


def test_mail_quotes_parts_and_interleaves(spark):
    turns = [("c", i, "\n".join(f"line {i} {j}" for j in range(4))) for i in range(5)]
    sent = {r.turn: r.text for r in queries.mail(spark.createDataFrame(turns, "conv_id string, turn long, text string")).collect()}
    assert sent[1] == "> line 0 3\n" + turns[1][2]
    assert sent[2].split("\n")[4:7] == ["> line 1 0", "line 2 0", "> line 1 1"]
