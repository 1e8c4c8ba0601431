from pyspark.sql import functions as F
from rows import at, issues, replies

from threadloom.operators import metrics as M
from threadloom.operators import rankings as K
from threadloom.operators.response import response_analytics
from threadloom.plans.dashboard import metrics_bundle
from threadloom.schemas import ISSUE


def test_global_metrics_interpolate_and_count_zero_as_fast(spark):
    rows = [{"id": str(n), "response_time_ms": w, "is_answered": True} for n, w in enumerate([0, 10, 21, 5_000_000])]
    got = M.global_metrics(issues(spark, *rows, {"id": "x", "channel_id": "d"})).collect()
    c, d = sorted(got, key=lambda r: r["channel_id"])
    assert (c["median_response_time_ms"], c["fast_response_count"]) == (15.5, 3)
    assert (d["median_response_time_ms"], d["avg_response_time_ms"], d["fast_response_count"]) == (None, None, 0)


def test_metrics_of_null_values(spark):
    rows = [{"id": "1", "owner_id": None, "message_count": None}, {"id": "2", "owner_id": "a", "is_answered": None, "channel_id": None},
            {"id": None, "owner_id": "a", "response_time_ms": 7, "message_count": 2}, {"id": "3", "owner_id": "a", "message_count": None}]
    got = {r["channel_id"]: r for r in M.global_metrics(issues(spark, *rows)).collect()}
    c = got["c"]
    assert (c["total_issues"], c["total_messages"], c["unique_users"], c["median_response_time_ms"]) == (2, 2, 1, 7)
    assert (got[None]["total_issues"], got[None]["answered_issues"], got[None]["avg_response_time_ms"]) == (1, 0, None)
    assert M.global_metrics(issues(spark)).count() == 0


def test_metrics_read_the_issues_once(spark, tmp_path):
    issues(spark, {"id": "1", "response_time_ms": 5}).write.parquet(str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    parts = metrics_bundle(stored, replies(spark))
    for df in (M.global_metrics(stored), response_analytics(stored), parts["kpis"], parts["daily_stats"], parts["top_responders"]):
        assert "Scan parquet" not in df._jdf.queryExecution().executedPlan().toString()


def test_bundle_fills_zero(spark):
    parts = metrics_bundle(issues(spark, {"id": "x"}), replies(spark))
    assert parts["kpis"].first()["median_response_time_ms"] == 0
    assert parts["top_responders"].count() == 0


def test_trend_values(spark):
    rows = [{"id": f"c{n}", "owner_id": "a", "is_answered": True, "response_time_ms": 300} for n in range(3)]
    rows += [{"id": f"p{n}", "owner_id": f"b{n}", "created_at": at(days=-8), "archived": True,
              "is_answered": n == 0, "response_time_ms": 200 if n == 0 else None} for n in range(8)]
    rows += [{"id": "old", "created_at": at(days=-30)}, {"id": "none", "created_at": None}]
    got = {r["metric"]: (r["value"], r["direction"], r["status"]) for r in M.weekly_trends(issues(spark, *rows)).collect()}
    assert got["issues_created"] == ("-63%", "down", "error")  # -62.5 rounds half up
    assert got["active_issues"] == ("+3", "up", "success")
    assert got["response_rate"] == ("+88%", "up", "success")
    assert got["avg_response_time"] == ("+50%", "up", "error")
    assert got["unanswered"] == ("-100%", "down", "success")


def test_trend_of_equal_and_missing_sides(spark):
    rows = [{"id": "1", "replies_loaded": False}, {"id": "2", "created_at": at(days=-7)}, {"id": "3", "created_at": at(days=-9)}]
    got = {r["metric"]: (r["value"], r["direction"]) for r in M.weekly_trends(issues(spark, *rows)).collect()}
    # Exactly seven days old belongs to the current window.
    assert got["issues_created"] == ("+100%", "up")
    assert got["avg_response_time"] == ("0%", "neutral")
    assert M.weekly_trends(issues(spark)).count() == 7


def test_kpis_prefer_total_sent_unless_zero(spark):
    i = issues(spark, {"id": "1", "total_message_sent": 0, "message_count": 4}, {"id": "2", "total_message_sent": 9, "owner_id": ""})
    got = M.kpi_strip(i).first()
    assert (got["total_messages"], got["unique_users"], got["avg_messages_per_issue"]) == (13, 1, 7)
    assert M.kpi_strip(issues(spark)).first()["archived_pct"] == 0


def test_heatmap_is_dense_and_local(spark):
    cells = M.time_of_week_heatmap(issues(spark, {"id": "1"}, {"id": "2", "created_at": None}), "America/New_York").collect()
    assert len(cells) == 168 and {c["total"] for c in cells} == {1}
    # 2026-05-14 is a Thursday, 12:00 UTC is 8:00 in New York.
    assert [(c["day"], c["hour"]) for c in cells if c["count"]] == [(3, 8)]


def test_flags_and_tags(spark):
    i = issues(spark, {"id": "1", "sentiment": "unknown", "applied_tags": ["1006941128441999421", "12345"], "replies_loaded": False})
    flags = M.data_flags(i).first()
    assert (flags["has_sentiment"], flags["has_duplicates"], flags["has_replies"]) == (False, False, False)
    names = {r["name"] for r in M.issues_by_tag(i).collect()}
    assert names == {"Database", "Tag 2345"}


def test_cumulative_ends_at_total(spark):
    i = issues(spark, *[{"id": str(n), "created_at": at(days=n % 4)} for n in range(10)], {"id": "x", "created_at": None})
    rows = M.cumulative_issues(M.issues_by_day(i)).orderBy("date").collect()
    assert [r["cumulative"] for r in rows] == [3, 6, 8, 10]


def test_responders_merge_renamed_users(spark):
    i = issues(spark, {"id": "1"}, {"id": "2", "created_at": at(days=1)})
    r = replies(
        spark,
        {"id": "a", "issue_id": "1", "author_id": "x", "author_username": "old"},
        {"id": "b", "issue_id": "2", "author_id": "x", "author_username": "new", "timestamp": at(5)},
        {"id": "c", "issue_id": "2", "author_id": "x", "author_username": "newer", "timestamp": at(6)},
        {"id": "d", "issue_id": "2", "author_id": None},
        {"id": "e", "issue_id": "2", "author_id": "o"},
    )
    top = K.top_responders(i, r).collect()
    assert [(t["author_id"], t["username"], t["global_name"], t["reply_count"], t["issues_helped"]) for t in top] == [
        ("x", "new", "new", 3, 2)
    ]
    assert K.top_responders_view(i, r).count() == 3


def test_escalation_reasons(spark):
    i = issues(
        spark,
        {"id": "busy", "message_count": 5, "created_at": at(days=-7)},
        {"id": "calm", "message_count": 4, "created_at": at(days=-13)},
        {"id": "old", "message_count": 1, "created_at": at(days=-14)},
        {"id": "hidden", "message_count": 9, "replies_loaded": False},
        {"id": "undated", "message_count": 9, "created_at": None, "is_answered": True},
    )
    got = {r["id"]: r["reasons"] for r in K.escalation_watchlist(i, at()).collect()}
    assert got == {"busy": ["high activity, no reply", "high activity, aging"], "old": ["old, unanswered"]}


def test_unanswered_without_date_is_oldest(spark):
    i = issues(spark, {"id": "1"}, {"id": "2", "created_at": None}, {"id": "3", "replies_loaded": False})
    assert [r["id"] for r in K.unanswered_issues(i, newest=False).collect()] == ["2", "1"]


def test_listing_texts(spark):
    i = issues(
        spark,
        {"id": "1", "first_message_content": "see ```a\nb``` and ```c```", "applied_tags": ["1", "2", "3"],
         "response_time_ms": 8_100_000, "resolution_status": "in-progress", "created_at": at(-90)},
        {"id": "2", "replies_loaded": False, "created_at": at(days=-400)},
    )
    got = {r["id"]: r for r in K.issue_listing(i, at()).collect()}
    assert (got["1"]["snippet"], got["1"]["more_tags"], got["1"]["response"]) == ("see [code] and [code]", 1, "2h 15m")
    assert (got["1"]["status"], got["1"]["created"]) == ("In Progress", "2h ago")
    assert (got["2"]["snippet"], got["2"]["replies"], got["2"]["response"]) == ("(no message body)", "—", "—")
    assert (got["2"]["status"], got["2"]["created"]) == ("—", "1y ago")


def test_trends_bound_reaches_the_scan(spark, tmp_path):
    """The plan has one scalar bound on the column as stored, within the scan's own filters."""
    path = str(tmp_path / "i")
    days = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400)
    types = {f.name: f.dataType for f in ISSUE.fields}
    columns = {n: F.lit(None).cast(t) for n, t in types.items()} | {"created_at": days, "replies_loaded": F.lit(True)}
    spark.range(0, 100, 1, 5).select(*[v.alias(n) for n, v in columns.items()]).write.parquet(path)
    df = M.weekly_trends(spark.read.parquet(path))
    assert {(r["metric"], r["current"]) for r in df.collect()} >= {("issues_created", 8)}
    scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert any("created_at" in x and "ubquery" in x.split("DataFilters")[1] and "getfield" not in x.lower() for x in scans)
