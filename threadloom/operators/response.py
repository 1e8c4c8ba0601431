"""First-response and resolution analytics of threads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.constants import RESOLUTION_KEYWORDS, RESPONSE_BUCKETS
from threadloom.functions.text import contains_any
from threadloom.functions.time import HOUR_MS
from threadloom.operators.distributed import first_n, upper_of_counts


def issue_response(
    issues: DataFrame, replies: DataFrame, keywords: Sequence[str] = tuple(RESOLUTION_KEYWORDS)
) -> DataFrame:
    """Per issue: answered, first-reply latency, responders, status, reply count.

    The owner is not looked up by a join. Issues enter the same aggregation as
    replies, as a mark on their (issue, owner) pair: grouping by that pair
    spreads a busy thread over its authors, and the second grouping by issue
    gets at most one row per pair.
    """
    none = F.lit(None)
    reply_rows = replies.select(
        F.col("issue_id"),
        F.col("author_id"),
        F.lit(False).alias("is_owner"),
        none.cast("timestamp").alias("start_at"),
        F.col("timestamp").alias("reply_at"),
        contains_any(F.lower(F.coalesce("content", F.lit(""))), keywords).alias("resolves"),
        F.lit(1).alias("replies"),
    )
    owner_rows = issues.select(
        F.col("id").alias("issue_id"),
        F.col("owner_id").alias("author_id"),
        F.lit(True).alias("is_owner"),
        F.coalesce("first_message_created_at", "created_at").alias("start_at"),
        none.cast("timestamp").alias("reply_at"),
        F.lit(False).alias("resolves"),
        F.lit(0).alias("replies"),
    )
    pairs = (
        reply_rows.unionByName(owner_rows)
        .groupBy("issue_id", "author_id")
        .agg(
            F.max("is_owner").alias("is_owner"),
            F.max("start_at").alias("start_at"),
            F.min("reply_at").alias("reply_at"),
            F.max("resolves").alias("resolves"),
            F.sum("replies").alias("replies"),
        )
    )
    other = ~F.col("is_owner")
    per_issue = (
        pairs.groupBy("issue_id")
        .agg(
            F.max("is_owner").alias("known"),
            F.max("start_at").alias("start_at"),
            F.min(F.when(other, F.col("reply_at"))).alias("first_reply_at"),
            F.count_if(other).alias("others"),
            F.count_if(other & (F.col("author_id") != "")).alias("responders"),
            F.max("resolves").alias("resolves"),
            F.sum("replies").alias("reply_count"),
        )
        .filter("known")
    )
    answered = F.col("others") > 0
    wait = F.unix_millis("first_reply_at") - F.unix_millis("start_at")
    return per_issue.select(
        F.col("issue_id").alias("id"),
        answered.alias("is_answered"),
        F.when(answered, F.when(wait < 0, 0).otherwise(wait)).alias("response_time_ms"),
        F.when(answered, F.col("responders")).otherwise(0).cast("int").alias("responder_count"),
        F.when(~answered, "unanswered")
        .when(F.col("resolves"), "likely-resolved")
        .otherwise("in-progress")
        .alias("resolution_status"),
        F.col("reply_count").cast("int").alias("reply_count"),
    )


def attach_response(issues: DataFrame, response: DataFrame) -> DataFrame:
    """Issues with their response columns replaced by freshly computed ones."""
    fresh = [c for c in response.columns if c != "id"]
    return issues.drop(*fresh).join(response, "id", "left")


def first_reply(issues: DataFrame, replies: DataFrame) -> DataFrame:
    """Earliest reply per issue that is not by its owner."""
    earliest = (
        replies.groupBy("issue_id", "author_id")
        .agg(F.min_by(F.struct("id", "timestamp"), F.struct("timestamp", "id")).alias("r"))
        .join(issues.select(F.col("id").alias("issue_id"), "owner_id"), "issue_id")
        .filter(~F.col("author_id").eqNullSafe(F.col("owner_id")))
        .select("issue_id", "author_id", F.col("r.id").alias("reply_id"), "r.timestamp")
    )
    order = [F.col("timestamp"), F.col("reply_id")]
    return first_n(earliest, ["issue_id"], order, 1).drop("rank")


def response_analytics(issues: DataFrame) -> DataFrame:
    """One row over the issues whose replies are loaded.

    They are read once, when this is called: counts by response time are checkpointed.
    """
    status, n = F.col("resolution_status"), F.col("total_with_replies")
    waited = F.col("is_answered") & (F.col("response_time_ms") > 0)
    counts = {
        "answered_count": F.count_if(F.col("is_answered")),
        "unanswered_count": F.count_if(~F.col("is_answered")),
        "likely_resolved_count": F.count_if(status == "likely-resolved"),
        "in_progress_count": F.count_if(status == "in-progress"),
        "total_replies": F.sum("reply_count"),
    }
    loaded = issues.filter("replies_loaded")
    counted = loaded.groupBy(F.when(waited, F.col("response_time_ms")).cast("bigint").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), *[c.alias(name) for name, c in counts.items()]
    ).checkpoint()
    wait, rows = F.col("_v"), F.col("_c")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    totals = counted.agg(
        total(rows).alias("total_with_replies"),
        total(F.col("answered_count")).alias("answered_count"),
        total(F.col("unanswered_count")).alias("unanswered_count"),
        (F.sum(wait.cast("double") * rows) / F.sum(F.when(wait.isNotNull(), rows))).alias("avg_response_time_ms"),
        total(F.when(wait <= HOUR_MS, rows)).alias("fast_response_count"),
        total(F.col("likely_resolved_count")).alias("likely_resolved_count"),
        total(F.col("in_progress_count")).alias("in_progress_count"),
        total(F.col("total_replies")).alias("total_replies"),
    )
    waits = counted.filter(wait.isNotNull()).select("_v", "_c")
    median = upper_of_counts(waits, [], "median").agg(F.max("median"))

    def per_issue(c: str) -> Column:
        return F.when(n > 0, F.col(c) / n).otherwise(0.0)

    return totals.select(
        "*",
        per_issue("answered_count").alias("response_rate"),
        median.scalar().alias("median_response_time_ms"),
        per_issue("total_replies").alias("avg_replies_per_issue"),
    )


def response_time_distribution(issues: DataFrame) -> DataFrame:
    """Issue count per response-time bucket, empty buckets included."""
    wait = F.col("response_time_ms")
    slot = F.lit(len(RESPONSE_BUCKETS) - 1)
    for i, (_, upper) in reversed(list(enumerate(RESPONSE_BUCKETS))):
        if upper is not None:
            slot = F.when(wait <= upper, i).otherwise(slot)
    counts = issues.filter(wait.isNotNull()).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.array(*[F.lit(name) for name, _ in RESPONSE_BUCKETS])
    uppers = F.array(*[F.lit(u).cast("bigint") for _, u in RESPONSE_BUCKETS])
    grid = issues.sparkSession.range(len(RESPONSE_BUCKETS)).select(F.col("id").cast("int").alias("slot"))
    return grid.join(counts, "slot", "left").select(
        "slot",
        F.get(labels, F.col("slot")).alias("bucket"),
        F.get(uppers, F.col("slot")).alias("bucket_ms"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def attach_replies(
    issues: DataFrame,
    replies: DataFrame,
    failed_ids: DataFrame,
    keywords: Sequence[str] = tuple(RESOLUTION_KEYWORDS),
) -> DataFrame:
    """Issues after a reply fetch.

    A thread of one message has no replies and is unanswered, a failed fetch
    has no replies and an unknown status, every other thread gets its analytics.
    """
    alone = F.coalesce(F.col("message_count") <= 1, F.lit(False))
    failed = failed_ids.select("id", F.lit(True).alias("_failed")).distinct()
    response = issue_response(issues, replies, keywords)
    joined = (
        issues.drop("reply_count", "replies_loaded")
        .withColumnsRenamed({c: f"_old_{c}" for c in response.columns if c != "id" and c in issues.columns})
        .join(response, "id", "left")
        .join(failed, "id", "left")
    )
    empty = alone | F.col("_failed").isNotNull()
    kept = [c for c in joined.columns if not c.startswith("_")]
    fresh = {
        "is_answered": F.when(empty, False).otherwise(F.col("is_answered")),
        "response_time_ms": F.when(~empty, F.col("response_time_ms")),
        "responder_count": F.when(empty, 0).otherwise(F.col("responder_count")),
        "resolution_status": F.when(alone, "unanswered")
        .when(empty, "unknown")
        .otherwise(F.col("resolution_status")),
        "reply_count": F.when(empty, 0).otherwise(F.col("reply_count")),
    }
    return joined.select(
        *[fresh[c].alias(c) if c in fresh else F.col(c) for c in kept],
        F.lit(True).alias("replies_loaded"),
    )
