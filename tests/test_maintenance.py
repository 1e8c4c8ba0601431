from pyspark.sql import functions as F
from rows import at, by_id, issues, replies

from threadloom.operators import maintenance as M
from threadloom.operators import notes as N

STAMP = "2026-06-01 00:00:00"


def test_upsert_keeps_unlisted_columns_and_is_idempotent(spark):
    target = issues(
        spark,
        {"id": "1", "is_answered": True, "response_time_ms": 5, "sentiment": "positive", "message_count": 2},
        {"id": "2"},
    )
    source = issues(spark, {"id": "1", "message_count": 9, "name": "new"}, {"id": "3", "resolution_status": "in-progress"})
    once = M.upsert_issues(target, source)
    got = by_id(once)
    assert (got["1"]["message_count"], got["1"]["name"]) == (9, "new")
    assert (got["1"]["is_answered"], got["1"]["response_time_ms"], got["1"]["sentiment"]) == (True, 5, "positive")
    assert got["3"]["resolution_status"] == "unanswered" and got["3"]["replies_loaded"] is False
    assert by_id(M.upsert_issues(once, source)) == got
    # With replies read, analytics are listed and overwritten.
    listed = by_id(M.upsert_issues(target, source, ["is_answered", "response_time_ms"]))
    assert (listed["1"]["is_answered"], listed["1"]["response_time_ms"], listed["1"]["name"]) == (False, None, "n")


def test_small_batches_are_broadcast_against_the_target(spark, capsys):
    target, source = issues(spark, {"id": "1"}), issues(spark, {"id": "1"})
    M.upsert(target, source).explain()
    assert "SortMergeJoin FullOuter" not in capsys.readouterr().out


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, n int, v string")
    assert {r["k"]: r["v"] for r in M.latest_by_key(df, ["k"], ["n"]).collect()} == {"a": "y", "b": None}


def test_replace_replies_of_loaded_issues_only(spark):
    old = replies(spark, {"id": "a", "issue_id": "1"}, {"id": "b", "issue_id": "2"}, {"id": "c", "issue_id": "3"})
    fresh = replies(spark, {"id": "d", "issue_id": "1"})
    loaded = spark.createDataFrame([("1",), ("3",)], "id string")
    assert set(by_id(M.replace_replies(old, loaded, fresh))) == {"b", "d"}


def test_changes(spark):
    fetched = issues(spark, {"id": "1"}, {"id": "2"}, {"id": "3", "locked": True}, {"id": "4", "archived": True}, {"id": "5", "message_count": 2})
    stored = issues(spark, *[{"id": n, "name": "other name"} for n in "2345"])
    got = {r["id"]: r["change"] for r in M.changed_threads(fetched, stored).collect()}
    assert got == {"1": "new", "2": "same", "3": "changed", "4": "changed", "5": "changed"}


def test_scan_stops_at_first_quiet_page(spark):
    rows = [(False, 0, "new"), (False, 1, "same"), (False, 1, "changed"), (False, 2, "same"), (False, 3, "new"), (True, 0, "same"), (True, 1, "new")]
    df = spark.createDataFrame(rows, "archived boolean, page int, change string")
    assert {(r["archived"], r["page"]) for r in M.caught_up_pages(df).collect()} == {(False, 0), (False, 1)}
    assert M.caught_up_pages(df, max_pages=1).count() == 1


def test_reply_queue(spark):
    i = issues(spark, *[{"id": f"{n:02d}", "message_count": 2, "fetched_at": at(n)} for n in range(30)], {"id": "x", "fetched_at": at(-1)})
    r = replies(spark, *[{"id": f"r{n}", "issue_id": f"{n:02d}"} for n in range(5)])
    batch = [x["id"] for x in M.missing_replies(i, r).collect()]
    assert batch == [f"{n:02d}" for n in range(5, 15)]
    assert M.missing_replies(i, r, batch=None, take=200).count() == 25
    moved = {x["id"] for x in M.rotate_queue(i, r, STAMP).filter(F.col("fetched_at") == F.lit(STAMP).cast("timestamp")).collect()}
    assert moved == {f"{n:02d}" for n in range(15)}


def test_clear(spark):
    i = issues(spark, {"id": "1", "duplicate_cluster_id": "a"}, {"id": "2", "channel_id": "d", "duplicate_cluster_id": "b"})
    r = replies(spark, {"id": "x", "issue_id": "1"}, {"id": "y", "issue_id": "2"})
    c = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    t = spark.createDataFrame([("t",)], "id string")
    state = M.clear_channel(i, r, c, t, "c")
    assert {k: set(by_id(v)) for k, v in state.items()} == {"issues": {"2"}, "replies": {"y"}, "clusters": {"b"}, "themes": set()}
    assert all(v.count() == 0 for v in M.clear_channel(i, r, c, t).values())


NOTE = "id string, issue_id string, user_id string, user_name string, content string, version bigint, updated_at timestamp, deleted_at timestamp"


def note(spark, *rows):
    return spark.createDataFrame([(i, i, "u", "User", text, 1, when, None) for i, text, when in rows], NOTE)


def test_newer_note_wins_and_tie_keeps_local(spark):
    local = note(spark, ("1", "l", at(1)), ("2", "l", at(5)), ("3", "l", at(3)), ("4", "l", at(0)))
    remote = note(spark, ("1", "r", at(2)), ("2", "r", at(4)), ("3", "r", at(3)), ("5", "r", at(0)))
    got = {r["id"]: r["content"] for r in N.note_merge_lww(local, remote).collect()}
    assert got == {"1": "r", "2": "l", "3": "l", "4": "l", "5": "r"}


def test_note_versions(spark):
    edits = spark.createDataFrame([("1", "u", "User", "x"), ("9", "u", "User", "y")], "issue_id string, user_id string, user_name string, content string")
    once = N.note_write(note(spark, ("1", "l", at(1)), ("2", "l", at(1))), edits, STAMP)
    got = {r["issue_id"]: (r["id"] == r["issue_id"], r["content"], r["version"]) for r in once.collect()}
    assert got == {"1": (True, "x", 2), "2": (True, "l", 1), "9": (False, "y", 1)}
    again = {r["issue_id"]: r["version"] for r in N.note_write(once, edits, STAMP).collect()}
    assert again == {"1": 3, "2": 1, "9": 2}
