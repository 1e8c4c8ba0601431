"""Scheduled jobs as Structured Streaming with ``availableNow``.

Each job reads new files since its last run (the checkpoint remembers them) and
merges every micro-batch into keyed tables, reading and writing only the partitions
of the keys it touches. Jobs may share tables, one running at a time. The table that
tells what has been done is merged last, so a batch that runs again after a failure
ends in the same state.

Tables: issues are keyed by id, replies by issue_id, notes by issue and user,
daily totals by date and channel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.constants import RESOLUTION_KEYWORDS
from threadloom.functions.time import now_literal
from threadloom.operators.maintenance import (
    backfill_first_messages,
    changed_threads,
    handled_queue,
    latest_by_key,
    missing_replies,
    of_keys,
    upsert,
    upsert_issues,
    upsert_replies,
)
from threadloom.operators.normalize import normalize_issue, reply_rows, stored_issue
from threadloom.operators.notes import note_merge_lww
from threadloom.operators.response import issue_response
from threadloom.schemas import ANALYTICS_COLUMNS, NOTE, SEARCH_PAGE
from threadloom.session import release
from threadloom.sources.forum_json import first_messages
from threadloom.sources.keyed import KeyedTable
from threadloom.sources.texts import message_texts, reference, referenced_messages


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there now, then stop."""
    query = (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(SEARCH_PAGE)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
        .withColumns({"file": F.col("_metadata.file_path"), "file_time": F.col("_metadata.file_modification_time")})
    )


def _last_copies(pages: DataFrame) -> DataFrame:
    """(thread_id, archived, offset, thread), the copy of each thread that was fetched last.

    Copies are ordered by the time of their file, then by file, offset and position.
    """
    copies = pages.select("archived", "offset", "file", "file_time", F.posexplode("threads").alias("pos", "thread"))
    place = F.struct("file_time", "file", F.coalesce("offset", F.lit(0)), "pos")
    last = copies.groupBy(F.col("thread.id").alias("thread_id")).agg(F.max_by(F.struct("archived", "offset", "thread"), place).alias("c"))
    return last.select("thread_id", "c.*")


def _fetched_issues(
    pages: DataFrame, channel_id: str | None, now: datetime | str | None, post_data: DataFrame | None = None
) -> DataFrame:
    """Normalised issues of a batch of pages, the last copy per id.

    First messages that the pages lack are taken from ``post_data`` (thread_id, message).
    """
    threads, firsts = _last_copies(pages), first_messages(pages)
    if post_data is not None:
        ids = threads.select(F.col("thread_id").alias("id"))
        firsts = backfill_first_messages(ids, firsts, post_data).filter("message is not null").drop("origin")
    rows = normalize_issue(threads.join(firsts, "thread_id", "left"))
    return stored_issue(rows, channel_id, now=now)


def _by_reference(
    issues: KeyedTable, pages: DataFrame, post_data: DataFrame | None = None
) -> tuple[bool, DataFrame, DataFrame | None, DataFrame | None]:
    """Whether the table stores first messages by reference; if so pages and post data with references, and their texts."""
    if issues.texts != ["first_message_content"]:
        return False, pages, post_data, None
    light, texts = referenced_messages(pages), message_texts(pages)
    if post_data is not None:
        content = F.col("message.content")
        texts = texts.unionAll(post_data.select(content.alias("text")))
        post_data = post_data.withColumn("message", F.col("message").withField("content", reference(content)))
    return True, light, post_data, texts


_FIRST = ["first_message_id", "first_message_content", "first_message_author_id", "first_message_author_name", "first_message_created_at"]


def _keep_first_messages(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched issues, with the stored first message where the pages had none."""
    names = [c for c in _FIRST if c in fetched.columns and c in stored.columns]
    old = of_keys(stored.filter("first_message_id is not null"), fetched)
    old = old.select("id", F.struct(*names).alias("_old"))
    kept = {c: F.when(F.col("first_message_id").isNull() & F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)) for c in names}
    return fetched.join(old, "id", "left").withColumns(kept).select(*fetched.columns)


def _messages_of(messages: DataFrame, issues: DataFrame) -> DataFrame:
    """All messages of the given issues without their first one, as (issue_id, message)."""
    wanted = issues.select(F.col("id").alias("thread_id"), "first_message_id")
    flat = messages.select(F.col("issue_id").alias("thread_id"), "message").join(wanted.select("thread_id"), "thread_id", "left_semi")
    # All messages of a thread, whose order is in their timestamps.
    rest = flat.join(wanted, "thread_id", "left").filter(~F.col("message.id").eqNullSafe(F.col("first_message_id")))
    return rest.select(F.col("thread_id").alias("issue_id"), "message")


def incremental_sync(
    pages: DataFrame,
    messages: DataFrame,
    issues: KeyedTable,
    replies: KeyedTable,
    checkpoint: str,
    channel_id: str | None = None,
    now: datetime | str | None = None,
    keywords: Sequence[str] = tuple(RESOLUTION_KEYWORDS),
    post_data: DataFrame | None = None,
) -> None:
    """Store new and changed threads, refresh their replies and analytics.

    Every fetched row is compared with the stored one. (A live client stops at
    the first page without a change to save requests; files are already here.)
    The replies of every changed thread are refreshed, from all its messages.
    ``messages`` has (issue_id, message), ``post_data`` first messages (thread_id,
    message) that pages may lack; a stored one is never replaced by none.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        light, threads, post, texts = _by_reference(issues, df, post_data)
        fetched = _fetched_issues(threads, channel_id, now, post).checkpoint()
        release(df.sparkSession)
        stored = issues.of(fetched, light)
        fetched = _keep_first_messages(fetched, stored)
        changed = changed_threads(fetched, stored).filter("change != 'same'").drop("change").checkpoint()
        del fetched, stored  # with their files
        release(df.sparkSession)
        merged = upsert_issues(issues.of(changed, light), changed, now=now)
        refresh = changed.filter("message_count > 1")
        refresh = refresh.select("id", "owner_id", "first_message_id", "first_message_created_at", "created_at")
        refresh = refresh.checkpoint()
        fresh = reply_rows(_messages_of(messages, refresh), now)
        for name in set(replies.schema.names) - set(fresh.columns):
            fresh = fresh.withColumn(name, F.lit(None).cast(replies.schema[name].dataType))
        fresh = fresh.checkpoint()
        release(df.sparkSession)
        response = issue_response(refresh, fresh, keywords)
        # All replies of a refreshed thread are replaced, also by none.
        replies.merge(fresh, refresh.select(F.col("id").alias("issue_id")))
        issues.merge(upsert(merged, response, "id", ANALYTICS_COLUMNS), texts=texts)

    run_available(pages, batch, checkpoint)


def hourly_recent_sync(
    pages: DataFrame,
    messages: DataFrame,
    issues: KeyedTable,
    replies: KeyedTable,
    checkpoint: str,
    channel_id: str | None = None,
    now: datetime | str | None = None,
    queue: int | None = None,
    take: int | None = None,
) -> None:
    """Store the active threads and fill in replies that are missing.

    With ``queue`` and ``take`` a batch looks at the head of the queue only and
    leaves the rest to later ones. The queue is made of the whole tables.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        light, threads, _, texts = _by_reference(issues, df.filter("not coalesce(archived, false)"))
        stored, kept = issues.read(light), replies.read()
        fetched = _fetched_issues(threads, channel_id, now)
        newest = _keep_first_messages(fetched, stored).drop("fetched_at").checkpoint()
        release(df.sparkSession)
        touched = upsert(
            of_keys(stored, newest),
            newest,
            "id",
            defaults={"is_answered": False, "responder_count": 0, "resolution_status": "unknown"},
            stamps={"updated_at": now_literal(now)},
        )
        touched = touched.withColumn("fetched_at", F.coalesce("fetched_at", "updated_at")).checkpoint()
        del fetched, newest  # with their files
        release(df.sparkSession)
        current = stored.join(touched.select("id"), "id", "left_anti").unionByName(touched)
        todo = missing_replies(current, kept, queue, take).select("id", "first_message_id").checkpoint()
        release(df.sparkSession)
        fresh = reply_rows(_messages_of(messages, todo), now)
        ids = todo.select(F.col("id").alias("issue_id"))
        # All that is read from the tables is read before the first of them is written.
        handled = handled_queue(current, kept, queue, take).withColumn("_handled", F.lit(True)).checkpoint()
        moved = of_keys(current, touched.select("id").unionByName(handled.select("id")))
        again = F.when(F.col("_handled"), now_literal(now)).otherwise(F.col("fetched_at"))
        moved = moved.join(handled, "id", "left").withColumn("fetched_at", again).checkpoint()
        del current, handled, touched  # with their files
        release(df.sparkSession)
        replies.merge(upsert_replies(replies.of(ids), fresh), ids)
        issues.merge(moved, texts=texts)

    run_available(pages, batch, checkpoint)


def note_sync(
    incoming: DataFrame, notes: KeyedTable, checkpoint: str, keys: Sequence[str] = ("issue_id", "user_id")
) -> None:
    """Merge streamed notes into the stored ones, the newer copy wins."""

    def batch(df: DataFrame, batch_id: int) -> None:
        newest = latest_by_key(df, list(keys), ["updated_at", "version", "id"]).checkpoint()
        old = notes.of(newest)
        notes.merge(note_merge_lww(old, newest.select(*old.columns), keys).drop("origin"))

    run_available(incoming, batch, checkpoint)


def note_exchange(
    copies: DataFrame,
    notes: KeyedTable,
    marks: KeyedTable,
    outbox: str,
    checkpoint: str,
    keys: Sequence[str] = ("issue_id", "user_id"),
) -> None:
    """Merge notes of both sides and put those out that the other side lacks.

    ``copies`` streams notes with their ``origin``, "local" edits and "remote" copies. The
    newer copy is stored; of equally new ones the local one stays. A note goes to the
    folder ``outbox``, in ``batch=<number>``, if the remote side holds no copy or an older
    one, as far as ``marks`` and the batch tell; one put out counts as held. Notes stored
    before the first run go out when they come in the stream as local.

    A batch reads and writes the partitions of its keys only. The marks are merged last and
    carry their batch, so one that runs again puts out the same notes.
    """
    names = notes.schema.names

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.select(*names, "origin").checkpoint()
        touched = df.select(*keys).distinct().checkpoint()
        known = marks.of(touched).withColumn("origin", F.lit("mark"))
        known = known.withColumn("again", F.col("batch") == batch_id)
        rows = df.unionByName(notes.of(touched).withColumn("origin", F.lit("stored"))).unionByName(known, allowMissingColumns=True)
        at, origin, again = F.col("updated_at"), F.col("origin"), F.coalesce("again", F.lit(False))
        order = F.struct("updated_at", (origin != "remote").alias("own"), "version", "id", "content")
        found = rows.groupBy(*keys).agg(
            F.max_by(F.struct(*names), F.when(origin != "mark", order)).alias("note"),
            F.max(F.when(origin.isin("remote", "mark") & ~again, at)).alias("held"),
            F.max(F.when(origin == "mark", at)).alias("marked"),
            F.bool_or(F.when(again, F.col("sent"))).alias("sent"),
        )
        newer = F.col("held").isNull() | (F.col("note.updated_at") > F.col("held"))
        found = found.withColumn("sent", F.coalesce("sent", newer, F.lit(False))).checkpoint()
        merged = found.select("note.*")
        found.filter("sent").select("note.*").write.mode("overwrite").parquet(f"{outbox.rstrip('/')}/batch={batch_id}")
        notes.merge(merged)
        stamp = F.greatest("held", "marked", F.when(F.col("sent"), F.col("note.updated_at")))
        marks.merge(found.select(*keys, stamp.alias("updated_at"), F.lit(batch_id).alias("batch"), "sent"))

    run_available(copies, batch, checkpoint)


def note_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(NOTE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


DAILY = T.StructType(
    [
        T.StructField("date", T.DateType()), T.StructField("channel_id", T.StringType()),
        T.StructField("issue_count", T.LongType()), T.StructField("total_messages", T.LongType()),
        T.StructField("answered_count", T.LongType()),
        T.StructField("batch", T.LongType()),  # the last one that changed the row
    ]
)


def stream_daily_stats(
    incoming: DataFrame, issues: KeyedTable, stats: KeyedTable, checkpoint: str,
    order: Sequence[str] = ("message_count", "is_answered", "created_at", "channel_id"),
) -> None:
    """Keep daily totals per channel equal to the totals over all issues seen.

    Every issue of a batch takes its old row out of the totals and adds its new
    one: the stored issues are read for the issues of the batch only, the totals for the
    days that change. So rows may come late by any time, and an issue that comes
    again counts once, in its last state; of copies within a batch the last by
    ``order`` counts. Counts of messages that are missing count as 0. Totals carry the
    batch that wrote them, so one that runs again adds nothing twice; one stream
    writes to a table of totals.
    """
    day, counts = ["date", "channel_id"], ["issue_count", "total_messages", "answered_count"]

    def batch(df: DataFrame, batch_id: int) -> None:
        newest = latest_by_key(df.select(*issues.schema.names), ["id"], list(order)).checkpoint()
        signed = newest.withColumn("_sign", F.lit(1)).unionByName(issues.of(newest).withColumn("_sign", F.lit(-1)))
        amounts = [F.lit(1), F.coalesce("message_count", F.lit(0)), F.coalesce(F.col("is_answered").cast("int"), F.lit(0))]
        change = signed.groupBy(F.to_date("created_at").alias("date"), "channel_id").agg(
            *[F.sum(F.col("_sign") * a).cast("bigint").alias(c) for c, a in zip(counts, amounts, strict=True)]
        ).checkpoint()
        both = stats.of(change).withColumn("_new", F.lit(False)).unionByName(
            change.withColumns({"batch": F.lit(None).cast("bigint"), "_new": F.lit(True)})
        )
        totals = both.groupBy(*day).agg(
            F.coalesce(F.max("batch") == batch_id, F.lit(False)).alias("_done"),
            *[F.sum(F.when(F.col("_new") == new, F.col(c))).alias(f"{c}_{new}") for c in counts for new in (False, True)],
        )
        added = {c: F.coalesce(f"{c}_False", F.lit(0)) + F.when(F.col("_done"), 0).otherwise(F.coalesce(f"{c}_True", F.lit(0))) for c in counts}
        rows = totals.select(*day, *[v.alias(c) for c, v in added.items()], F.lit(batch_id).alias("batch"))
        stats.merge(rows.filter("issue_count > 0"), change.select(*day))
        issues.merge(newest)

    run_available(incoming, batch, checkpoint)
