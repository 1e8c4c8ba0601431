"""Table and source-document schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _D, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.DoubleType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


USER = _struct(id=_S, username=_S, global_name=_S, avatar=_S)
ATTACHMENT = _struct(id=_S, filename=_S, size=_L, url=_S)
MESSAGE = _struct(
    id=_S,
    channel_id=_S,
    content=_S,
    timestamp=_S,
    author=USER,
    attachments=T.ArrayType(ATTACHMENT),
)
THREAD = _struct(
    id=_S,
    name=_S,
    guild_id=_S,
    parent_id=_S,
    owner_id=_S,
    message_count=_I,
    member_count=_I,
    total_message_sent=_I,
    applied_tags=T.ArrayType(_S),
    thread_metadata=_struct(archived=_B, archive_timestamp=_S, locked=_B, create_timestamp=_S),
    owner=_struct(user=USER),
)
SEARCH_PAGE = _struct(
    threads=T.ArrayType(THREAD),
    first_messages=T.ArrayType(MESSAGE),
    has_more=_B,
    total_results=_L,
    archived=_B,
    offset=_L,
)
POST_DATA = _struct(threads=T.MapType(_S, _struct(first_message=MESSAGE)))

ISSUE = _struct(
    id=_S,
    name=_S,
    channel_id=_S,
    guild_id=_S,
    owner_id=_S,
    owner_username=_S,
    owner_global_name=_S,
    owner_avatar=_S,
    created_at=_TS,
    archived_at=_TS,
    archived=_B,
    locked=_B,
    message_count=_I,
    member_count=_I,
    total_message_sent=_I,
    applied_tags=T.ArrayType(_S),
    first_message_id=_S,
    first_message_content=_S,
    first_message_author_id=_S,
    first_message_author_name=_S,
    first_message_created_at=_TS,
    response_time_ms=_L,
    responder_count=_I,
    is_answered=_B,
    resolution_status=_S,
    sentiment=_S,
    sentiment_score=_D,
    sentiment_summary=_S,
    duplicate_cluster_id=_S,
    fetched_at=_TS,
    updated_at=_TS,
)
REPLY = _struct(
    id=_S,
    issue_id=_S,
    author_id=_S,
    author_username=_S,
    author_global_name=_S,
    content=_S,
    timestamp=_TS,
    has_attachment=_B,
    attachment_count=_I,
    sentiment=_S,
    sentiment_score=_D,
    created_at=_TS,
)
CLUSTER = _struct(id=_S, name=_S, description=_S, issue_count=_I, created_at=_TS)
THEME = _struct(
    id=_S,
    theme=_S,
    description=_S,
    keywords=T.ArrayType(_S),
    count=_I,
    sample_issue_ids=T.ArrayType(_S),
    method=_S,
    channel_id=_S,
    created_at=_TS,
)
NOTE = _struct(
    id=_S,
    issue_id=_S,
    user_id=_S,
    user_name=_S,
    content=_S,
    version=_L,
    updated_at=_TS,
    deleted_at=_TS,
)
# The newest copy of a note that the other side is known to hold, and the batch that told so.
NOTE_MARK = _struct(issue_id=_S, user_id=_S, updated_at=_TS, batch=_L, sent=_B)
VECTOR = _struct(
    id=_S,
    values=T.ArrayType(T.FloatType()),
    metadata=_struct(issueId=_S, channelId=_S, sentiment=_S),
)
COMPLETION = T.StructType(
    [
        T.StructField(
            "themes",
            T.ArrayType(
                _struct(
                    theme=_S,
                    description=_S,
                    keywords=T.ArrayType(_S),
                    issue_idxs=T.ArrayType(_L),
                )
            ),
        )
    ]
)

# Columns of an issue that come from replies. A merge leaves them alone unless
# replies were read together with the thread.
ANALYTICS_COLUMNS = ["is_answered", "response_time_ms", "responder_count", "resolution_status"]
SENTIMENT_COLUMNS = ["sentiment", "sentiment_score", "sentiment_summary"]
