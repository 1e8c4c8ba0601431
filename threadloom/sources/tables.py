"""Reads of the stored issue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import cut
from threadloom.schemas import ISSUE


def issues_light(issues: DataFrame) -> DataFrame:
    """All stored columns, the first message cut to 250 characters."""
    return issues.select(
        *[
            cut(F.col(c), 250).alias(c) if c == "first_message_content" else F.col(c)
            for c in ISSUE.fieldNames()
        ]
    )


def load_issues(
    issues: DataFrame, channel_id: str | None = None, limit: int = 50_000, replies: DataFrame | None = None
) -> DataFrame:
    """Newest issues (of a channel) with ``total_results``, the exact count behind them.

    With ``replies``, ``has_replies`` says whether any issue of the answer has a stored reply.
    """
    if channel_id:
        issues = issues.filter(F.col("channel_id") == channel_id)
    total = issues.agg(F.count(F.lit(1)))
    page = issues_light(issues).orderBy(F.desc("created_at"), F.asc("id")).limit(limit)
    out = page.withColumn("total_results", total.scalar())
    if replies is None:
        return out
    answered = replies.select(F.col("issue_id").alias("id")).join(page.select("id"), "id", "left_semi")
    return out.withColumn("has_replies", answered.agg(F.count(F.lit(1)) > 0).scalar())


def issue_page(issues: DataFrame, page: int, size: int = 20, after: str | None = None) -> DataFrame:
    """One page in id order.

    Page numbers suit the first pages: Spark keeps (page + 1) * size rows per
    task. To walk through a whole table, read it, or pass the last id seen as
    ``after`` and page 0.
    """
    if after is not None:
        issues = issues.filter(F.col("id") > after)
    return issues.orderBy("id").offset(page * size).limit(size)
