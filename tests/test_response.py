from rows import at, by_id, issues, replies

from threadloom.operators import response as R


def test_first_reply_of_others_counts(spark):
    i = issues(spark, {"id": "1"}, {"id": "2"}, {"id": "3"}, {"id": "4"}, {"id": "5", "created_at": None})
    r = replies(
        spark,
        {"id": "a", "issue_id": "1", "author_id": "o", "timestamp": at(1), "content": "that WORKED"},
        {"id": "b", "issue_id": "1", "author_id": "x", "timestamp": at(5)},
        {"id": "c", "issue_id": "1", "author_id": "x", "timestamp": at(3)},
        {"id": "d", "issue_id": "2", "author_id": "o", "timestamp": at(1), "content": "thanks"},
        {"id": "e", "issue_id": "3", "author_id": "x", "timestamp": at(-9)},
        {"id": "f", "issue_id": "3", "author_id": None, "timestamp": at(2)},
        {"id": "g", "issue_id": "5", "author_id": "x", "timestamp": at(2)},
        {"id": "h", "issue_id": "unknown issue", "author_id": "x", "timestamp": at(2)},
    )
    got = by_id(R.issue_response(i, r))
    assert set(got) == {"1", "2", "3", "4", "5"}
    assert got["1"]["response_time_ms"] == 180_000
    # The owner's own words can resolve, and two replies by one person are one responder.
    assert (got["1"]["resolution_status"], got["1"]["responder_count"], got["1"]["reply_count"]) == ("likely-resolved", 1, 3)
    # Only the owner wrote: not answered, so no keyword counts.
    assert (got["2"]["is_answered"], got["2"]["resolution_status"]) == (False, "unanswered")
    # A backdated reply clamps to 0; a missing author answers but is no responder.
    assert (got["3"]["response_time_ms"], got["3"]["responder_count"]) == (0, 1)
    assert (got["4"]["response_time_ms"], got["4"]["reply_count"]) == (None, 0)
    assert (got["5"]["is_answered"], got["5"]["response_time_ms"]) == (True, None)


def test_first_message_time_is_the_start(spark):
    i = issues(spark, {"id": "1", "first_message_created_at": at(2)})
    r = replies(spark, {"id": "a", "issue_id": "1", "author_id": "x", "timestamp": at(3)})
    assert by_id(R.issue_response(i, r))["1"]["response_time_ms"] == 60_000


def test_first_reply(spark):
    i = issues(spark, {"id": "1"})
    r = replies(
        spark,
        {"id": "a", "issue_id": "1", "author_id": "o", "timestamp": at(1)},
        {"id": "c", "issue_id": "1", "author_id": "y", "timestamp": at(2)},
        {"id": "b", "issue_id": "1", "author_id": "x", "timestamp": at(2)},
    )
    assert [x["reply_id"] for x in R.first_reply(i, r).collect()] == ["b"]


def test_analytics_exclude_zero_and_unloaded(spark):
    waits = [0, 10, 20, 30, 4_000_000]
    rows = [
        {"id": str(n), "is_answered": True, "response_time_ms": w, "reply_count": 2, "resolution_status": "in-progress"}
        for n, w in enumerate(waits)
    ]
    rows += [{"id": "u", "resolution_status": "unanswered"}, {"id": "n", "replies_loaded": False, "is_answered": True}]
    got = R.response_analytics(issues(spark, *rows)).first()
    assert (got["total_with_replies"], got["answered_count"], got["unanswered_count"]) == (6, 5, 1)
    # Four positive waits: position 2 is the upper of the two middle ones.
    assert got["median_response_time_ms"] == 30
    assert got["avg_response_time_ms"] == (10 + 20 + 30 + 4_000_000) / 4
    assert (got["fast_response_count"], got["total_replies"]) == (3, 10)


def test_analytics_of_nothing(spark):
    got = R.response_analytics(issues(spark, {"id": "n", "replies_loaded": False})).first()
    assert (got["total_with_replies"], got["response_rate"], got["avg_response_time_ms"]) == (0, 0, None)
    assert (got["median_response_time_ms"], got["avg_replies_per_issue"], got["total_replies"]) == (None, 0, 0)


def test_buckets_include_upper_bound_and_empty_ones(spark):
    hour = 3_600_000
    waits = [0, hour, hour + 1, 24 * hour, 168 * hour, 168 * hour + 1, None]
    rows = [{"id": str(n), "response_time_ms": w} for n, w in enumerate(waits)]
    got = {r["bucket"]: r["count"] for r in R.response_time_distribution(issues(spark, *rows)).collect()}
    assert list(got.values()) == [2, 1, 1, 0, 1, 1] and sum(got.values()) == 6


def test_attach_replies(spark):
    i = issues(
        spark,
        {"id": "1", "message_count": 1, "resolution_status": "unknown"},
        {"id": "2", "message_count": 3},
        {"id": "3", "message_count": 3},
        {"id": "4", "message_count": None},
    )
    r = replies(spark, *[{"id": f"r{n}", "issue_id": n, "author_id": "x", "timestamp": at(1)} for n in "1234"])
    failed = spark.createDataFrame([("3",)], "id string")
    got = by_id(R.attach_replies(i, r, failed))
    assert [got[n]["resolution_status"] for n in "1234"] == ["unanswered", "in-progress", "unknown", "in-progress"]
    assert [got[n]["reply_count"] for n in "1234"] == [0, 1, 0, 1]
    assert all(x["replies_loaded"] for x in got.values())
