import pytest
from rows import at, issues

from threadloom.operators.filters import IssueFilter, Theme, filter_issues, unclustered_issues


@pytest.fixture(scope="module")
def table(spark):
    return issues(
        spark,
        {"id": "1", "applied_tags": ["a", "b"], "sentiment": "positive", "reply_count": 2, "name": "Login", "has_attachment": True},
        {"id": "2", "archived": True, "resolution_status": "in-progress", "message_count": None, "created_at": at(days=-1)},
        {"id": "3", "replies_loaded": False, "duplicate_cluster_id": "", "created_at": None},
        {"id": "4", "duplicate_cluster_id": "c", "owner_global_name": None, "first_message_content": "my KEY text",
         "created_at": at(11 * 60 + 59)},
    )


@pytest.mark.parametrize(
    "spec, expected",
    [
        ({}, "1234"),
        ({"archived": True}, "2"),
        ({"archived": "active"}, "134"),
        ({"archived": "all"}, "1234"),
        ({"tag_ids": ["b", "z"]}, "1"),
        ({"statuses": ["unknown"]}, "134"),
        ({"sentiments": ["unknown"]}, "234"),
        ({"has_replies": "has"}, "1"),
        ({"has_replies": False}, "24"),
        ({"has_replies": "any"}, "1234"),
        ({"min_message_count": 1}, "134"),
        ({"min_message_count": 0}, "1234"),
        ({"has_attachment": False}, "234"),
        ({"duplicates_only": True}, "4"),
        ({"date_from": "2026-05-14"}, "134"),
        ({"date_to": "2026-05-14"}, "1234"),
        ({"date_to": "2026-05-13"}, "23"),
        ({"theme": "t", "themes": {"t": Theme(["KEY", ""], ["1"])}}, "14"),
        ({"theme": "t", "themes": {"t": Theme([""], [])}}, ""),
        ({"theme": "unknown", "themes": {"t": Theme(["x"])}}, "1234"),
        # The gap of a missing global name stays: username, two blanks, text.
        ({"query": " OWNER  MY "}, "4"),
        ({"query": "owner my"}, ""),
        ({"query": "login", "archived": True}, ""),
    ],
)
def test_dimensions(table, spec, expected):
    got = filter_issues(table, IssueFilter(**spec))
    assert "".join(sorted(r["id"] for r in got.collect())) == expected


def test_unclustered_oldest_first(table):
    assert [r["id"] for r in unclustered_issues(table.filter("id != '3'"), 1).collect()] == ["2"]
