"""Leaderboards, watchlists and single-issue views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import blank_to_null, fold_code, status_label, tag_name
from threadloom.functions.time import DAY_MS, duration_text, elapsed_ms, now_literal, relative_age
from threadloom.operators.distributed import ranked_top


def _newest_first() -> Column:
    return F.struct(-F.unix_micros("created_at"), F.col("id"))


def top_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    order = [F.desc("message_count"), F.desc("created_at"), F.asc("id")]
    return ranked_top(issues, order, n)


def unanswered_issues(issues: DataFrame, n: int = 10, newest: bool = True) -> DataFrame:
    """Loaded issues without a reply by somebody else; a missing date counts as 1970."""
    open_ones = issues.filter(
        F.col("replies_loaded") & ~F.coalesce(F.col("is_answered"), F.lit(False))
    ).withColumn("_at", F.coalesce(F.unix_micros("created_at"), F.lit(0)))
    order = [F.desc("_at") if newest else F.asc("_at"), F.asc("id")]
    return ranked_top(open_ones, order, n).drop("_at")


def escalation_watchlist(
    issues: DataFrame, now: datetime | str | None = None, n: int = 15, min_messages: int = 5
) -> DataFrame:
    """Busy or old issues that need attention, with the reasons."""
    age_days = F.coalesce(elapsed_ms(now_literal(now), F.col("created_at")) / DAY_MS, F.lit(0.0))
    busy = F.coalesce(F.col("message_count") >= min_messages, F.lit(False))
    waiting = F.coalesce(F.col("replies_loaded"), F.lit(False)) & ~F.coalesce(
        F.col("is_answered"), F.lit(False)
    )
    reasons = F.array_compact(
        F.array(
            F.when(busy & waiting, "high activity, no reply"),
            F.when(busy & (age_days >= 7), "high activity, aging"),
            F.when((age_days >= 14) & waiting, "old, unanswered"),
        )
    )
    listed = issues.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    return ranked_top(listed, [F.desc("message_count"), F.desc("created_at"), F.asc("id")], n)


def top_contributors(issues: DataFrame, n: int = 10) -> DataFrame:
    """Owners by number of issues, named as on their newest issue."""
    owners = issues.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.sum("message_count").alias("total_messages"),
        F.min_by(
            F.struct("owner_username", "owner_global_name", "created_at", "id"), _newest_first()
        ).alias("seen"),
    )
    order = [F.desc("issue_count"), F.desc("seen.created_at"), F.asc("seen.id")]
    return ranked_top(owners, order, n).select(
        "rank",
        "owner_id",
        F.col("seen.owner_username").alias("username"),
        F.col("seen.owner_global_name").alias("global_name"),
        "issue_count",
        "total_messages",
    )


def _helped(issues: DataFrame, replies: DataFrame, names: list[Column]) -> DataFrame:
    """One row per (issue, author, names) of replies by others than the owner.

    Replies are counted before the join, so a thread with very many of them
    enters it as one row per author.
    """
    counted = replies.groupBy("issue_id", "author_id", *names).agg(
        F.count("id").alias("replies"),
        F.min_by(
            F.struct("author_username", "author_global_name", "timestamp", "id"),
            F.struct("timestamp", "id"),
        ).alias("first"),
    )
    owners = issues.select(
        F.col("id").alias("issue_id"), "owner_id", "channel_id", "created_at"
    )
    return counted.join(owners, "issue_id").filter(F.col("author_id") != F.col("owner_id"))


def top_responders_join(issues: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies matched to their issue, the owner's own left out."""
    owners = issues.select(F.col("id").alias("issue_id"), "owner_id", "channel_id")
    return replies.join(owners, "issue_id").filter(F.col("author_id") != F.col("owner_id"))


def top_responders_view(issues: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies and issues helped per channel, author and names as written."""
    names = [F.col("author_username"), F.col("author_global_name")]
    return (
        _helped(issues, replies, names)
        .groupBy("channel_id", "author_id", "author_username", "author_global_name")
        .agg(F.sum("replies").alias("reply_count"), F.count(F.lit(1)).alias("issues_helped"))
    )


def top_responders(issues: DataFrame, replies: DataFrame, n: int = 10) -> DataFrame:
    """Authors by number of replies, named as in the first reply of their newest issue."""
    order_key = F.struct(-F.unix_micros("created_at"), F.col("issue_id"))
    authors = (
        _helped(issues, replies, [])
        .groupBy("author_id")
        .agg(
            F.sum("replies").alias("reply_count"),
            F.count(F.lit(1)).alias("issues_helped"),
            F.min_by(F.struct("first", "created_at", "issue_id"), order_key).alias("seen"),
        )
    )
    order = [
        F.desc("reply_count"),
        F.desc("seen.created_at"),
        F.asc("seen.issue_id"),
        F.asc("seen.first.timestamp"),
        F.asc("seen.first.id"),
    ]
    name = F.col("seen.first.author_username")
    return ranked_top(authors.filter(F.col("author_id") != ""), order, n).select(
        "rank",
        "author_id",
        F.coalesce(name, F.lit("unknown")).alias("username"),
        F.coalesce("seen.first.author_global_name", name).alias("global_name"),
        "reply_count",
        "issues_helped",
    )


def issue_listing(issues: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """The columns of the issue table, as shown."""
    tags = F.coalesce("applied_tags", F.array())
    loaded = F.coalesce(F.col("replies_loaded"), F.lit(False))
    content = blank_to_null(F.col("first_message_content"))
    status = F.col("resolution_status")
    return issues.select(
        "id",
        "name",
        F.coalesce(fold_code(content), F.lit("(no message body)")).alias("snippet"),
        F.transform(F.slice(tags, 1, 2), tag_name).alias("tag_names"),
        F.greatest(F.size(tags) - 2, F.lit(0)).alias("more_tags"),
        F.when(loaded, F.col("reply_count").cast("string")).otherwise("—").alias("replies"),
        F.when(F.col("response_time_ms").isNotNull(), duration_text(F.col("response_time_ms")))
        .when(loaded, "no reply")
        .otherwise("—")
        .alias("response"),
        F.when(status.isNull() | (status == "unknown"), "—")
        .otherwise(status_label(status))
        .alias("status"),
        F.coalesce("owner_global_name", "owner_username").alias("reporter"),
        relative_age(F.col("created_at"), now_literal(now)).alias("created"),
    )


def issue_detail(issues: DataFrame, replies: DataFrame, issue_id: str) -> DataFrame:
    """One issue followed by its replies, oldest first, the owner's own marked."""
    one = (
        issues.filter(F.col("id") == issue_id)
        .select(F.col("id").alias("issue_id"), "name", "owner_id")
        .limit(1)
    )
    none = F.lit(None).cast("string")
    head = one.select(
        F.lit("issue").alias("kind"),
        "issue_id",
        none.alias("reply_id"),
        F.col("owner_id").alias("author_id"),
        F.col("name").alias("content"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(True).alias("is_op"),
    )
    its = (
        replies.filter(F.col("issue_id") == issue_id)
        .join(F.broadcast(one), "issue_id")  # one row
        .select(
            F.lit("reply").alias("kind"),
            "issue_id",
            F.col("id").alias("reply_id"),
            "author_id",
            "content",
            "timestamp",
            F.col("author_id").eqNullSafe(F.col("owner_id")).alias("is_op"),
        )
    )
    return head.unionByName(its).orderBy(F.asc_nulls_first("timestamp"), "reply_id")
