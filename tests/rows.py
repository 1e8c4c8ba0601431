"""Small hand-written tables."""

from datetime import datetime, timedelta

T0 = datetime(2026, 5, 14, 12, 0)

ISSUE = (
    "id string, name string, channel_id string, owner_id string, owner_username string, owner_global_name string,"
    " created_at timestamp, archived boolean, locked boolean, message_count int, total_message_sent int,"
    " applied_tags array<string>, first_message_id string, first_message_content string,"
    " first_message_created_at timestamp, response_time_ms bigint, is_answered boolean, resolution_status string,"
    " sentiment string, duplicate_cluster_id string, fetched_at timestamp, has_attachment boolean, reply_count int,"
    " replies_loaded boolean"
)
REPLY = (
    "id string, issue_id string, author_id string, author_username string, author_global_name string,"
    " content string, timestamp timestamp"
)


def at(minutes=0, days=0):
    return T0 + timedelta(minutes=minutes, days=days)


def issues(spark, *rows):
    names = [f.strip().split(" ")[0] for f in ISSUE.split(",")]
    base = {"name": "n", "channel_id": "c", "owner_id": "o", "owner_username": "owner", "created_at": T0,
            "archived": False, "locked": False, "message_count": 1, "applied_tags": [], "first_message_content": "",
            "is_answered": False, "fetched_at": T0, "has_attachment": False, "reply_count": 0, "replies_loaded": True}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], ISSUE)


def replies(spark, *rows):
    names = [f.strip().split(" ")[0] for f in REPLY.split(",")]
    base = {"author_username": "u", "content": "", "timestamp": T0}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], REPLY)


def by_id(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}
