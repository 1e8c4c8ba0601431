import csv
import glob
import json
import os
import random
import string
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rows import at, issues, replies

from threadloom.operators import maintenance as M
from threadloom.operators import normalize as Z
from threadloom.plans.queries import registry
from threadloom.schemas import ISSUE, REPLY
from threadloom.session import release, shared_dir
from threadloom.sources import exports as X
from threadloom.sources import forum_json as J
from threadloom.sources import tables as B
from threadloom.sources import texts as L
from threadloom.sources.derived import Forum
from threadloom.sources.keyed import KeyedTable
from threadloom.streaming import jobs


def message(i, thread, text, **more):
    return {"id": i, "channel_id": thread, "content": text, **more}


def put(folder, name, *docs, indent=None):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(d, indent=indent) for d in docs))
    return str(folder)


def test_dump_defaults_and_last_message_wins(spark, tmp_path):
    page = {
        "threads": [
            {"id": "1", "name": "a", "owner_id": "o", "parent_id": "c", "message_count": 2, "applied_tags": ["t"],
             "thread_metadata": {"archived": True, "archive_timestamp": "bad", "create_timestamp": "2026-05-14T12:00:00.000000+00:00"},
             "owner": {"user": {"id": "o", "username": "ann"}}},
            {"id": "2", "name": "b", "owner_id": "o"},
        ],
        "first_messages": [
            message("m0", "1", "stale"),
            message("m1", "1", "hello", timestamp="2026-05-14T12:00:00Z", author={"id": "x", "username": "bob", "global_name": "Bob"},
                    attachments=[{"filename": "f.txt"}, {"filename": "g.txt"}]),
            message("m2", None, "lost"),
        ],
        "has_more": False,
    }
    path = put(tmp_path / "dump", "a.json", page, indent=2)
    one, two = J.read_search_dump(spark, path, multiline=True).orderBy("id").collect()
    assert (one["first_message_content"], one["first_message_author_name"], one["owner_global_name"]) == ("hello", "Bob", "ann")
    assert (one["created_at"], one["archived_at"], one["archived"]) == (at(), None, True)
    assert (one["has_attachment"], one["attachment_filenames"]) == (True, ["f.txt", "g.txt"])
    assert (two["owner_username"], two["owner_global_name"], two["message_count"], two["applied_tags"]) == ("unknown", None, 0, [])
    assert (two["created_at"], two["first_message_content"], two["has_attachment"], two["locked"]) == (None, "", False, False)
    stored = Z.stored_issue(J.read_search_dump(spark, path, True), None, "g", at()).orderBy("id").collect()
    assert (stored[1]["channel_id"], stored[1]["created_at"], stored[1]["guild_id"]) == ("2", at(), "g")


def test_post_data_and_backfill(spark, tmp_path):
    doc = {"threads": {"1": {"first_message": message("p1", "1", "x")}, "2": {"owner": {}}, "3": {"first_message": message("p3", "3", "x")}}}
    post = J.read_post_data_map(spark, put(tmp_path / "post", "p.json", doc))
    assert {r["thread_id"] for r in post.collect()} == {"1", "3"}
    threads = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    first = post.filter("thread_id = '1'").withColumn("message", F.col("message").withField("id", F.lit("s1")))
    got = {r["thread_id"]: (r["message"] and r["message"]["id"], r["origin"]) for r in M.backfill_first_messages(threads, first, post).collect()}
    assert got == {"1": ("s1", "search"), "2": (None, None), "3": ("p3", "post_data")}


def test_scan_keeps_whole_last_page(spark, tmp_path):
    def page(archived, offset, n, more, total):
        return {"threads": [{"id": f"{archived}{offset}{i}"} for i in range(n)], "archived": archived, "offset": offset,
                "has_more": more, "total_results": total}

    pages = J.read_pages(spark, put(tmp_path / "pages", "p.json", page(True, 0, 3, True, 5), page(False, 0, 3, True, 4),
                                    page(False, 3, 1, False, 4), page(True, 3, 2, False, 5)))
    read = J.paged_thread_scan(pages, 5)
    assert {(r["archived"], r["offset"], r["before"]) for r in read.collect()} == {(False, 0, 0), (False, 3, 3), (True, 0, 4)}
    assert J.scan_summary(read).first().asDict() == {"threads": 7, "total_results": 9, "has_more": True}
    assert J.paged_thread_scan(pages, 3).count() == 1


def test_thread_messages(spark):
    rows = [("1", f"m{i}", at(i)) for i in range(6)] + [("2", "n0", at(0))]
    messages = spark.createDataFrame(rows, "thread_id string, id string, timestamp timestamp")
    first = spark.createDataFrame([("1", "m4"), ("2", None)], "thread_id string, first_message_id string")
    assert [r["id"] for r in J.thread_messages(messages, first, 3).collect()] == ["m3", "m5", "n0"]


def test_reply_defaults(spark):
    docs = spark.read.schema("issue_id string, message struct<id:string,content:string,timestamp:string,"
                             "author:struct<id:string,username:string,global_name:string>,attachments:array<struct<filename:string>>>").json(
        spark.sparkContext.parallelize(['{"issue_id": "1", "message": {"id": "r"}}']))
    got = Z.reply_rows(docs, at()).first()
    assert (got["author_id"], got["author_username"], got["content"], got["timestamp"]) == ("unknown", "unknown", "", at())
    assert (got["has_attachment"], got["attachment_count"]) == (False, 0)


def test_pages_and_load(spark):
    i = issues(spark, *[{"id": f"{n:02d}", "created_at": at(n)} for n in range(45)])
    assert [r["id"] for r in B.issue_page(i, 2).collect()] == [f"{n:02d}" for n in range(40, 45)]
    assert B.issue_page(i, 0, after="42").count() == 2
    missing = [f for f in ISSUE.fields if f.name not in i.columns]
    full = i.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).withColumn("first_message_content", F.lit("x" * 300))

    def replies_of(*ids):
        return spark.createDataFrame([(n,) for n in ids], "issue_id string")

    rows = B.load_issues(full, "c", limit=3, replies=replies_of("44")).collect()
    assert [r["id"] for r in rows] == ["44", "43", "42"] and {(r["total_results"], r["has_replies"]) for r in rows} == {(45, True)}
    assert not B.load_issues(full, "c", limit=3, replies=replies_of("41")).first()["has_replies"]
    assert B.load_issues(full, "c").count() == 45
    assert len(rows[0]["first_message_content"]) == 250


def test_merge_replaces_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), REPLY, ["issue_id"], buckets=4)

    def rows(*pairs):
        r = replies(spark, *[{"id": i, "issue_id": k} for i, k in pairs])
        return r.withColumns({f.name: F.lit(None).cast(f.dataType) for f in REPLY.fields if f.name not in r.columns})

    def keys(*names):
        return spark.createDataFrame([(n,) for n in names], "issue_id string")

    def state(df=None):
        return {r["id"] for r in (table.read() if df is None else df).collect()}

    assert state() == set() and state(table.of(keys("1"))) == set()
    table.merge(rows(("x", "9"), ("n", None)))  # no table yet
    table.write(rows(("a", "1"), ("b", "2"), ("n", None)))
    table.merge(rows(("c", "1"), ("d", "1")))
    assert state() == {"b", "c", "d", "n"} and state(table.of(keys("1", "7"))) == {"c", "d"}
    table.merge(rows(("e", "3")), keys("2", "3"))  # nothing is left of 2
    table.merge(rows(("m", None)))
    assert state() == {"c", "d", "e", "m"}
    table.merge(rows().limit(0), keys("1", "3", None))  # nor of any
    assert state() == set()
    table.merge(rows(("f", "3")))
    assert state() == {"f"}


def test_merge_touches_only_partitions_of_its_keys(spark, tmp_path):
    schema = "id bigint, v string"
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, buckets=8)
    table.write(spark.range(1000).selectExpr("id", "'old' v"))

    def files():
        return {str(p) for p in (tmp_path / "t" / "table").glob("*/*.parquet")}

    before = files()
    one = spark.createDataFrame([(5, "new")], schema)
    table.merge(one)
    assert len(before & files()) == len(before) - 1
    assert table.read().count() == 1000 and [r["v"] for r in table.of(one).collect()] == ["new"]
    plan = table.of(one)._jdf.queryExecution().toString()
    assert "PartitionFilters: [key_bucket" in plan or "key_bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_merge_after_a_lost_driver(spark, tmp_path, monkeypatch):
    schema = "id bigint, v string"
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, buckets=4)
    table.write(spark.range(20).selectExpr("id", "'old' v"))
    finish = KeyedTable._finish
    monkeypatch.setattr(KeyedTable, "_finish", lambda self: None)
    table.merge(spark.createDataFrame([(5, "new")], schema))  # written beside the table, not put in place
    assert table.read().filter("v = 'new'").count() == 0
    monkeypatch.setattr(KeyedTable, "_finish", finish)
    assert table.read().filter("v = 'new'").count() == 1 and table.read().count() == 20
    (tmp_path / "t" / "next").mkdir()  # left by one that was lost earlier
    assert table.read().count() == 20


@pytest.fixture
def export_input(spark):
    i = issues(
        spark,
        {"id": "1", "name": 'say "hi", all', "first_message_content": "a\nb" + "x" * 600, "applied_tags": ["1006941128441999421", "7777"]},
        {"id": "2", "replies_loaded": False, "created_at": None},
        {"id": "3", "message_count": 4, "sentiment": "frustrated"},
    )
    return i.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ISSUE.fields if f.name not in i.columns})



def test_csv(spark, tmp_path, export_input):
    X.write_csv(X.export_csv(export_input).coalesce(1), str(tmp_path / "csv"))
    with open(glob.glob(str(tmp_path / "csv" / "part-*"))[0], newline="") as f:
        rows = {r["id"]: r for r in csv.DictReader(f)}
    assert rows["1"]["name"] == 'say "hi", all' and rows["1"]["appliedTags"] == "Database; Tag 7777"
    assert rows["1"]["firstMessageContent"] == "a b" + "x" * 497
    assert (rows["2"]["createdAt"], rows["2"]["resolutionStatus"], rows["2"]["sentiment"]) == ("", "unknown", "")
    assert rows["3"]["createdAt"] == "2026-05-14T12:00:00.000Z" and rows["3"]["archived"] == "false"


def test_json_splits_long_threads(spark, tmp_path, export_input):
    r = replies(spark, *[{"id": f"r{n:02d}", "issue_id": "1", "timestamp": at(n)} for n in range(25)])
    r = r.withColumn("has_attachment", F.lit(False)).withColumn("attachment_count", F.lit(0))
    X.write_json(X.export_json(export_input, r, per_line=10), str(tmp_path / "json"))
    rows = spark.read.json(str(tmp_path / "json" / "issues")).orderBy("id", "part").collect()
    assert [(x["id"], x["part"], x["replies"] and len(x["replies"])) for x in rows] == [
        ("1", 0, 10), ("1", 1, 10), ("1", 2, 5), ("2", 0, None), ("3", 0, [])]
    assert [y["id"] for x in rows[:3] for y in x["replies"]] == [f"r{n:02d}" for n in range(25)]
    assert spark.read.json(str(tmp_path / "json" / "manifest")).first()["count"] == 3


def test_report_without_themes_or_clusters(spark, tmp_path, export_input):
    from threadloom.operators.response import response_analytics
    from threadloom.operators.themes import keyword_themes

    analytics = response_analytics(export_input)
    none = spark.createDataFrame([], "id string, name string, description string, issue_count int")
    report = X.summary_report(export_input, keyword_themes(export_input).limit(0), none, analytics, title="T")
    X.write_report(report, str(tmp_path / "md"))
    lines = open(glob.glob(str(tmp_path / "md" / "part-*"))[0]).read().splitlines()
    assert lines[0] == "# T" and "| Frustrated Issues | 1 |" in lines
    assert not any(x.startswith(("## Common", "## Duplicate")) for x in lines)
    assert [x for x in lines if x.startswith("- **")][0].startswith("- **n** — 4 msgs, by @owner (May 14, 2026)")


def test_written_pages_are_compressed(spark, tmp_path):
    """Texts of many threads lie on disk compressed, and every thread is on its page."""
    forum = Forum(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    raw = forum.full_issues.agg(F.sum(F.octet_length("first_message_content"))).first()[0]
    for write, name in ((forum.write_pages, "pages"), (forum.write_post_data, "post"), (forum.write_messages, "messages")):
        path = write(str(tmp_path / name))
        files = [p for p in (tmp_path / name).iterdir() if p.name.startswith("part-")]
        assert {p.suffix for p in files} == {".gz"}
        if name != "messages":
            assert sum(p.stat().st_size for p in files) < raw / 2, path
    pages = J.read_pages(spark, str(tmp_path / "pages"))
    assert pages.select(F.explode("threads.id")).distinct().count() == forum.issues.count()


def test_export_sorts_only_threads_beyond_a_task(spark, monkeypatch):
    threads = issues(spark, *[{"id": i} for i in "123"])
    rows = [{"id": f"r{n:02d}", "issue_id": i, "timestamp": at(n)} for i in "12" for n in range(7 if i == "1" else 3)]
    rows += [rows[0], {**rows[1], "id": None}, {**rows[2], "issue_id": None}]  # a row that comes twice, one without id or thread
    r = replies(spark, *rows).withColumn("has_attachment", F.lit(False)).withColumn("attachment_count", F.lit(0))

    def lines(df):
        return [(x["id"], x["part"], [y["id"] for y in x["replies"]]) for x in df.orderBy("id", "part").collect()]

    # In a thread of several parts each copy of an id goes to the parts of all its copies.
    want = [("1", 0, ["r00"] * 4 + ["r01"]), ("1", 1, ["r02", "r03", "r04", "r05"]), ("1", 2, ["r06"]),
            ("2", 0, ["r00", "r01", "r02"]), ("3", 0, [])]
    monkeypatch.setattr(X, "positions", lambda *a: pytest.fail("no thread is longer than a task holds"))
    assert lines(X.export_json(threads, r, per_line=4)) == want
    monkeypatch.undo()
    monkeypatch.setattr(X, "REPLIES_PER_LINE", 4)  # thread 1 goes by the sort
    assert lines(X.export_json(threads, r, per_line=4)) == want


def test_first_messages_with_some_fields(spark):
    rows = [("f", 0, [message("1", "a", "x"), message("2", "a", "y"), message("3", "b", "z")]), ("f", 25, [message("0", "b", "w")])]
    pages = spark.createDataFrame(rows, "file string, offset int, first_messages array<struct<id: string, channel_id: string, content: string>>")
    whole = J.first_messages(pages).select("thread_id", "message.id")
    some = J.first_messages(pages, ["id"])
    assert some.schema["message"].dataType.names == ["id"]
    assert {tuple(r) for r in some.select("thread_id", "message.id").collect()} == {tuple(r) for r in whole.collect()} == {("a", "2"), ("b", "0")}


def star(spark, folder, threads, texts):
    """Small star-schema tables: ``threads`` orders with a reply each, and the documents that they take turns at."""
    day = "timestamp '1996-01-01'"
    tables = {
        "region": "select 0L r_regionkey, 'ASIA' r_name",
        "nation": "select 0L n_nationkey, 0L n_regionkey",
        "customer": "select 1L c_custkey, 0L c_nationkey, 'seg' c_mktsegment",
        "part": "select 1L p_partkey, 'a ring' p_name",
        "orders": f"select id o_orderkey, 1L o_custkey, 'O' o_orderstatus, {day} o_orderdate, '1-URGENT' o_orderpriority from range({threads})",
        "lineitem": f"select id l_orderkey, 1L l_partkey, 1L l_suppkey, 1 l_linenumber, {day} l_shipdate from range({threads})",
        "labels": "select 0L doc_id, 1 quality, 0 toxic",
    }
    frames = {name: spark.sql(sql) for name, sql in tables.items()}
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    frames["documents"] = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return Forum(spark, str(folder))


def test_post_data_stores_the_text_of_many_threads_about_once(spark, tmp_path):
    texts = ["".join(random.Random(i).choices(string.ascii_letters, k=8000)) for i in range(7)] + [None]
    forum = star(spark, tmp_path / "star", 400, texts)
    path = forum.write_post_data(str(tmp_path / "post"))
    stored = sum(p.stat().st_size for p in (tmp_path / "post").glob("part-*"))
    assert stored < 400 / 4 * 8000  # 50 threads share a text, a map holds ten of them
    got = {r["thread_id"]: r["message"]["content"] for r in J.read_post_data_map(spark, path).collect()}
    assert got == {str(i): texts[i % 8] or "" for i in range(400) if i % 11}
    sizes = spark.read.json(path).count(), spark.read.schema(J.POST_DATA).json(path).agg(F.max(F.size("threads"))).first()[0]
    assert sizes == (8 * 5, 10)


def long_texts():
    return ["".join(random.Random(i).choices(string.ascii_letters, k=8000)) for i in range(7)] + [None]


def test_pages_store_the_text_of_many_threads_about_once(spark, tmp_path):
    texts = long_texts()
    forum = star(spark, tmp_path / "star", 400, texts)
    path = forum.write_pages(str(tmp_path / "pages"))
    stored = sum(p.stat().st_size for p in (tmp_path / "pages").glob("part-*"))
    assert stored < 400 / 4 * 8000  # 50 threads share a text
    rows = J.read_search_dump(spark, path).collect()
    got = {r["id"]: (r["first_message_id"], r["first_message_content"]) for r in rows}
    assert len(rows) == 400 and got == {str(i): (f"m{i}", texts[i % 8] or "") if i % 5 else (None, "") for i in range(400)}
    assert [(r["offset"], len(r["threads"])) for r in J.read_pages(spark, path).orderBy("offset").collect()] == [(25 * i, 25) for i in range(16)]


def test_long_texts_move_once(spark, tmp_path):
    """Of a text that many messages share one copy moves; short ones and those that look like a reference are kept."""
    odd = ["sha256:" + "0" * 64, "x" * 64, "x" * 65, "", None, "é" * 33]
    texts = odd + ["".join(random.Random(i).choices(string.ascii_letters, k=20000)) for i in range(3)]
    threads = [{"id": str(i), "name": "n"} for i in range(300)]
    first = [{"id": f"m{i}", "channel_id": str(i), "content": texts[i % 9]} for i in range(299)]
    first.append({"id": "again", "channel_id": "7", "content": "later"})
    (tmp_path / "dump.json").write_text(json.dumps({"threads": threads, "first_messages": first}))
    found = J.read_search_dump(spark, str(tmp_path / "dump.json"))
    got = {r["id"]: (r["first_message_id"], r["first_message_content"]) for r in found.collect()}
    want = {str(i): (f"m{i}", texts[i % 9] or "") for i in range(299)} | {"299": (None, ""), "7": ("again", "later")}
    assert got == want
    spread = L.distinct_texts(spark.createDataFrame([(t,) for t in texts * 20], "text string"))
    assert {r["text"] for r in spread.collect()} == {t for t in texts if t and len(t.encode()) > 64} and spread.count() == 6
    assert all(r["ref"].startswith("sha256:") and len(r["ref"]) == 71 for r in spread.collect())


def test_table_with_texts_by_reference(spark, tmp_path):
    schema = T.StructType.fromDDL("id string, v string, text string")
    table = KeyedTable(spark, str(tmp_path / "t"), schema, buckets=2, texts=["text"])
    long = ["".join(random.Random(i).choices(string.ascii_letters, k=5000)) for i in range(3)]

    def rows(*found):
        return spark.createDataFrame(found, schema)

    def state(df):
        return {tuple(r) for r in df.collect()}

    assert state(table.read()) == set()
    first = [(str(i), "a", long[0]) for i in range(50)] + [("x", "a", "short"), ("n", "a", None)]
    table.write(rows(*first))
    assert state(table.read()) == set(first) and state(table.of(rows(("7", None, None)))) == {first[7]}
    table.merge(rows(("7", "b", long[1]), ("x", "b", long[0]), (None, "b", "sha256:" + "0" * 64)))
    light = table.read(light=True)
    assert {len(r["text"] or "") for r in light.collect()} == {0, 71}
    new = spark.createDataFrame([(t,) for t in long], "text string")
    refs = L.distinct_texts(new).filter(F.col("text") == long[2]).select(F.lit("8").alias("id"), F.lit("c").alias("v"), F.col("ref").alias("text"))
    table.merge(refs, texts=new)
    want = {r for r in first if r[0] not in ("7", "8", "x")}
    want |= {("7", "b", long[1]), ("x", "b", long[0]), (None, "b", "sha256:" + "0" * 64), ("8", "c", long[2])}
    assert state(table.read()) == want
    kept = spark.read.parquet(str(tmp_path / "t" / "texts"))
    assert sorted(r["text"] for r in kept.collect()) == sorted([*long, "sha256:" + "0" * 64])


@pytest.mark.parametrize("job", ["incremental_sync", "hourly_recent_sync"])
def test_sync_by_reference_stores_the_same(spark, tmp_path, job):
    forum = star(spark, tmp_path / "star", 120, long_texts())
    pages, messages = forum.write_pages(str(tmp_path / "pages")), forum.write_messages(str(tmp_path / "messages"))
    states = []
    for name, texts in (("plain", ()), ("shared", ["first_message_content"])):
        issues_table = KeyedTable(spark, str(tmp_path / name / "issues"), ISSUE, texts=texts)
        replies_table = KeyedTable(spark, str(tmp_path / name / "replies"), REPLY, ["issue_id"])
        issues_table.write(forum.stored.filter("cast(id as bigint) % 7 != 0").withColumn("message_count", F.expr("message_count + int(cast(id as bigint) % 3 = 0)")))
        run = getattr(jobs, job)
        run(jobs.page_stream(spark, pages), J.read_messages(spark, messages), issues_table, replies_table, str(tmp_path / name / "cp"), now=at())
        states.append([sorted(map(str, t.read().collect())) for t in (issues_table, replies_table)])
    assert states[0] == states[1] and len(states[0][0]) == 120


@pytest.mark.parametrize("name", ["incremental_sync", "hourly_recent_sync"])
def test_sync_keeps_shared_texts_about_once_on_disk(spark, tmp_path, name):
    star(spark, tmp_path / "star", 400, long_texts())

    def kept():
        return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(shared_dir(spark)) for x in names)

    before = kept()
    assert registry()[name](spark, str(tmp_path / "star")).count() == 400
    assert kept() - before < 400 * 8000  # of all threads; each state of the rows held that once


def test_shared_texts_move_once_and_by_reference(spark):
    long, other = "a long text " * 20, "another one " * 20
    page = [{"content": long}] * 30 + [{"content": other}, {"content": "short"}, {"content": None}]
    pages = spark.createDataFrame([(page,), ([{"content": long}],), (None,)], "first_messages array<struct<content:string>>")
    assert pages.select(F.explode(F.array_distinct("first_messages"))).count() == 5
    texts = L.message_texts(pages)
    assert texts.count() == 5  # not 34
    found = L.distinct_texts(texts)
    assert {r.text: len(r.ref) for r in found.collect()} == {long: 71, other: 71}
    rows = spark.createDataFrame([(str(i), "x" * 71) for i in range(9)], "id string, c string")
    plan = L.with_texts(rows, found.hint("merge"), "c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one for each side


def test_files_of_a_finished_step_are_deleted(spark, tmp_path):
    df = spark.range(50_000).select((F.col("id") % 977).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    kept = df.repartition(8, "k").sortWithinPartitions("v")
    kept.write.parquet(str(tmp_path / "rows"))
    home = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return home.getAllBlocks().size()

    before = shuffled()
    del kept
    release(spark, every=0)
    for _ in range(50):  # the cleaner works beside the driver
        if shuffled() < before:
            break
        time.sleep(0.2)
    assert shuffled() < before
