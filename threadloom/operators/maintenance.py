"""Merges, queues and clean-up of the stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.time import now_literal
from threadloom.operators.distributed import positions
from threadloom.schemas import ANALYTICS_COLUMNS, SENTIMENT_COLUMNS

# Written by other jobs, so a thread merge leaves them as they are.
_OWNED_ELSEWHERE = {*ANALYTICS_COLUMNS, *SENTIMENT_COLUMNS, "duplicate_cluster_id", "reply_count", "replies_loaded"}

# What a newly stored issue holds where its source has no column.
ISSUE_DEFAULTS = {
    "is_answered": False,
    "responder_count": 0,
    "resolution_status": "unanswered",
    "reply_count": 0,
    "replies_loaded": False,
}


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key, by an order that has no ties."""
    whole = F.struct(*df.columns)
    return (
        df.groupBy(*keys)
        .agg(F.max_by(whole, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def of_keys(table: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The rows of a large table that have one of the wanted keys."""
    return table.join(wanted.select(*keys), list(keys), "left_semi")


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str = "id",
    columns: Sequence[str] | None = None,
    defaults: Mapping[str, object] | None = None,
    stamps: Mapping[str, Column] | None = None,
) -> DataFrame:
    """New state of ``target`` after insert-or-update by ``source`` (one row per key).

    Only ``columns`` are overwritten in a matched row. ``stamps`` sets columns of
    every touched row. No full outer join: a small batch is broadcast against
    the large target, which is then not shuffled at all.
    """
    columns = [c for c in (columns or source.columns) if c != key and c in target.columns]
    stamps = dict(stamps or {})
    fields = {f.name: f.dataType for f in target.schema.fields}
    incoming = source.select(key, F.struct(*[F.col(c) for c in columns], F.lit(1).alias("_hit")).alias("_s"))
    hit = F.col("_s").isNotNull()

    def updated(name: str) -> Column:
        if name in stamps:
            return F.when(hit, stamps[name]).otherwise(F.col(name)).cast(fields[name]).alias(name)
        if name in columns:
            return F.when(hit, F.col(f"_s.{name}")).otherwise(F.col(name)).cast(fields[name]).alias(name)
        return F.col(name)

    def inserted(name: str) -> Column:
        default = F.lit((defaults or {}).get(name))
        if name in stamps:
            value = stamps[name]
        elif name == key or name in columns:
            value = F.col(name)
        else:
            value = default
        return value.cast(fields[name]).alias(name)

    kept = target.join(incoming, key, "left").select(*[updated(c) for c in target.columns])
    known = of_keys(target.select(key), source, [key])
    new = source.join(known, key, "left_anti").select(*[inserted(c) for c in target.columns])
    return kept.unionByName(new)


def upsert_issues(
    target: DataFrame,
    source: DataFrame,
    columns: Sequence[str] | None = None,
    now: datetime | str | None = None,
) -> DataFrame:
    """Store issues by id. By default columns computed by other jobs are kept."""
    if columns is None:
        columns = [c for c in source.columns if c not in _OWNED_ELSEWHERE]
    stamp = {"updated_at": now_literal(now)} if "updated_at" in target.columns else {}
    return upsert(target, source, "id", columns, ISSUE_DEFAULTS, stamp)


def upsert_replies(target: DataFrame, source: DataFrame) -> DataFrame:
    return upsert(target, source, "id", defaults={"has_attachment": False, "attachment_count": 0})


def replace_replies(target: DataFrame, loaded_issues: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop the replies of every loaded issue and put the fresh ones in their place."""
    ids = loaded_issues.select(F.col("id").alias("issue_id"))
    kept = target.join(ids, "issue_id", "left_anti").select(*target.columns)
    return kept.unionByName(fresh.select(*target.columns))


def _differs(pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def changed_threads(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched issues with ``change``: new, changed or same."""
    watched = ["message_count", "archived", "locked"]
    old = of_keys(stored.select("id", *watched), fetched).select(
        "id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in watched]
    )
    change = (
        F.when(F.col("_known").isNull(), "new")
        .when(_differs([(c, f"_{c}") for c in watched]), "changed")
        .otherwise("same")
    )
    return (
        fetched.join(old, "id", "left")
        .withColumn("change", change)
        .drop("_known", *[f"_{c}" for c in watched])
    )


def paged(issues: DataFrame, size: int = 25) -> DataFrame:
    """Position and page of each issue, newest first, active and archived apart."""
    numbered = positions(issues, ["archived"], [F.desc("created_at"), F.asc("id")])
    return numbered.withColumn("page", F.floor(F.col("position") / size))


def caught_up_pages(changes: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages before the first one without a change, active and archived apart.

    Expects (archived, page, change) rows, one per fetched thread.
    """
    pages = changes.groupBy("archived", "page").agg(
        F.count(F.lit(1)).alias("threads"), F.count_if(F.col("change") != "same").alias("changes")
    )
    stop = pages.groupBy("archived").agg(
        F.min(F.when(F.col("changes") == 0, F.col("page"))).alias("stop")
    )
    ahead = F.col("stop").isNull() | (F.col("page") < F.col("stop"))
    if max_pages is not None:
        ahead &= F.col("page") < max_pages
    return pages.join(F.broadcast(stop), "archived").filter(ahead).drop("stop")  # two rows


def missing_replies(
    issues: DataFrame, replies: DataFrame, batch: int | None = 20, take: int | None = 10
) -> DataFrame:
    """Threads that should have replies but have none stored, least recently fetched first.

    With ``batch`` only the head of the queue is looked at (the scheduled job);
    without it the whole queue (the bulk job). Without ``take`` all are returned,
    in no order.
    """
    order = ["fetched_at", "id"]
    queue, stored = _queue(issues, replies, batch)
    missing = queue.join(stored, "id", "left_anti")
    return missing if take is None else missing.orderBy(*order).limit(take)


def _queue(issues: DataFrame, replies: DataFrame, batch: int | None) -> tuple[DataFrame, DataFrame]:
    """The queue (or its head), and the ids in it that have stored replies."""
    queue = issues.filter(F.col("message_count") > 1)
    stored = replies.select(F.col("issue_id").alias("id"))
    if batch is not None:
        queue = queue.orderBy("fetched_at", "id").limit(batch)
        # At most ``batch`` ids, so the replies are filtered where they are read.
        stored = stored.join(F.broadcast(queue.select("id")), "id", "left_semi")
    return queue, stored.distinct()


def handled_queue(
    issues: DataFrame, replies: DataFrame, batch: int | None = 20, take: int | None = 10
) -> DataFrame:
    """Ids of the batch whose replies are stored already or were just taken."""
    queue, stored = _queue(issues, replies, batch)
    synced = queue.select("id").join(stored, "id", "left_semi")
    return synced.unionByName(missing_replies(issues, replies, batch, take).select("id"))


def rotate_queue(
    issues: DataFrame,
    replies: DataFrame,
    now: datetime | str | None = None,
    batch: int | None = 20,
    take: int = 10,
) -> DataFrame:
    """Move the handled head of the reply queue to its end."""
    handled = handled_queue(issues, replies, batch, take).withColumn("_handled", F.lit(True))
    return (
        issues.join(handled, "id", "left")
        .withColumn(
            "fetched_at", F.when(F.col("_handled"), now_literal(now)).otherwise(F.col("fetched_at"))
        )
        .drop("_handled")
    )


def orphan_clusters(clusters: DataFrame, issues: DataFrame) -> DataFrame:
    """Clusters that no issue refers to."""
    used = issues.select(F.col("duplicate_cluster_id").alias("id")).filter("id is not null")
    # Distinct first: one cluster may hold a large part of all issues.
    return clusters.join(used.distinct(), "id", "left_anti")


def clear_channel(
    issues: DataFrame,
    replies: DataFrame,
    clusters: DataFrame,
    themes: DataFrame,
    channel_id: str | None = None,
) -> dict[str, DataFrame]:
    """State of all tables after wiping one channel, or everything."""
    gone = F.lit(True) if channel_id is None else F.col("channel_id").eqNullSafe(F.lit(channel_id))
    left = issues.filter(~gone)
    removed = issues.filter(gone).select(F.col("id").alias("issue_id"))
    orphans = orphan_clusters(clusters, left).select("id")
    return {
        "issues": left,
        "replies": replies.join(removed, "issue_id", "left_anti").select(*replies.columns),
        "clusters": clusters.join(orphans, "id", "left_anti"),
        "themes": themes.filter(F.lit(False)),
    }


def backfill_first_messages(
    threads: DataFrame, first_messages: DataFrame, post_data: DataFrame
) -> DataFrame:
    """First message per thread: from the search page, else from the second source.

    Message tables have (thread_id, message); threads without either keep null.
    """
    ids = threads.select(F.col("id").alias("thread_id"))
    have = ids.join(first_messages, "thread_id", "inner")
    lack = ids.join(first_messages.select("thread_id"), "thread_id", "left_anti")
    found = lack.join(post_data, "thread_id", "left")
    return have.withColumn("origin", F.lit("search")).unionByName(
        found.withColumn("origin", F.when(F.col("message").isNotNull(), "post_data"))
    )
