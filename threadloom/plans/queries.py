"""Registry of queries over the derived forum tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators import (
    filters,
    graph,
    maintenance,
    metrics,
    normalize,
    notes,
    rankings,
    response,
    sentiment,
    similarity,
    terms,
    themes,
)
from threadloom.operators.distributed import first_n, ranked_top, upper_median
from threadloom.plans import duplicates
from threadloom.plans.dashboard import metrics_bundle
from threadloom.plans.duplicates import MEMBERS, daily_clustering
from threadloom.schemas import ISSUE, NOTE, NOTE_MARK, REPLY
from threadloom.session import staging_path
from threadloom.sources import exports, forum_json, postings, tables
from threadloom.sources.derived import KEYWORDS, Forum
from threadloom.sources.keyed import KeyedTable
from threadloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

NOW = "2000-01-01 00:00:00"
CHANNEL = "ASIA"
VECTOR_THRESHOLD = 0.35
# Words of the derived texts, standing in for the themes of a real forum.
DEMO_THEMES = {"demo": filters.Theme(["ware", "zzz"], ["1", "2"])}

_registry: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Column types both engines of the comparison agree on."""

    def plain(field: T.StructField) -> Column:
        c, t = F.col(field.name), field.dataType
        if isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(t, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(build: Callable[[Forum], DataFrame]) -> Callable[[Forum], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(build(Forum(spark, folder)))

    run.__name__ = build.__name__
    _registry[build.__name__] = run
    return build


def registry() -> dict[str, Query]:
    return dict(_registry)


# Response analytics


@query
def issue_response(f: Forum) -> DataFrame:
    return f.response


@query
def first_reply(f: Forum) -> DataFrame:
    return response.first_reply(f.threads, f.replies)


@query
def response_analytics(f: Forum) -> DataFrame:
    out = response.response_analytics(f.issues)
    doubles = ["avg_response_time_ms", "response_rate", "avg_replies_per_issue"]
    return out.withColumns({c: F.round(c, 3) for c in doubles})


@query
def upper_median_by_channel(f: Forum) -> DataFrame:
    return upper_median(f.issues, ["channel_id"], "response_time_ms", "upper_median")


@query
def response_time_distribution(f: Forum) -> DataFrame:
    return response.response_time_distribution(f.issues)


@query
def attach_replies(f: Forum) -> DataFrame:
    failed = f.threads.filter("okey % 17 = 0").select("id")
    return response.attach_replies(f.issues, f.replies, failed, KEYWORDS).select(
        "id", "is_answered", "response_time_ms", "responder_count", "resolution_status", "reply_count",
        "replies_loaded",
    )


# Metrics


@query
def global_metrics(f: Forum) -> DataFrame:
    return metrics.global_metrics(f.issues).withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 3))


@query
def metrics_bundle_long(f: Forum) -> DataFrame:
    parts = metrics_bundle(f.issues, f.replies)

    def long(name: str, keys: list[str]) -> DataFrame:
        df = parts[name]
        values = [c for c in df.columns if c not in keys]
        wide = df.select(
            F.lit(name).alias("part"),
            F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]).alias("key"),
            *[F.round(F.col(c).cast("double"), 3).alias(c) for c in values],
        )
        return wide.unpivot(["part", "key"], values, "metric", "value")

    names = ["channel_id", "author_id", "author_username", "author_global_name"]
    return (
        long("kpis", ["channel_id"])
        .unionByName(long("daily_stats", ["date", "channel_id"]))
        .unionByName(long("top_responders", names))
    )


@query
def daily_stats(f: Forum) -> DataFrame:
    return metrics.daily_stats(f.issues)


@query
def issues_by_day(f: Forum) -> DataFrame:
    return metrics.issues_by_day(f.threads)


@query
def cumulative_issues(f: Forum) -> DataFrame:
    return metrics.cumulative_issues(metrics.issues_by_day(f.threads))


@query
def cumulative_issues_by_channel(f: Forum) -> DataFrame:
    daily = metrics.daily_stats(f.issues).select("date", "channel_id", F.col("issue_count").alias("count"))
    return metrics.cumulative_issues(daily, ("channel_id",))


@query
def issues_by_tag(f: Forum) -> DataFrame:
    return metrics.issues_by_tag(f.threads)


@query
def distinct_tags(f: Forum) -> DataFrame:
    return metrics.distinct_tags(f.threads)


@query
def distinct_reporters(f: Forum) -> DataFrame:
    return metrics.distinct_reporters(f.event_issues)


@query
def channel_totals(f: Forum) -> DataFrame:
    return metrics.channel_totals(f.threads)


@query
def data_flags(f: Forum) -> DataFrame:
    return metrics.data_flags(f.full_issues)


@query
def kpi_strip(f: Forum) -> DataFrame:
    return metrics.kpi_strip(f.issues)


@query
def time_of_week_heatmap(f: Forum) -> DataFrame:
    return metrics.time_of_week_heatmap(f.event_issues)


@query
def time_of_week_heatmap_local(f: Forum) -> DataFrame:
    return metrics.time_of_week_heatmap(f.event_issues, "Asia/Kolkata")


@query
def weekly_trends(f: Forum) -> DataFrame:
    return metrics.weekly_trends(f.event_issues).withColumns(
        {c: F.round(c, 6) for c in ("current", "previous")}
    )


# Rankings and listings


@query
def top_issues(f: Forum) -> DataFrame:
    return rankings.top_issues(f.issues).select("rank", "id", "message_count")


@query
def unanswered_issues(f: Forum) -> DataFrame:
    return rankings.unanswered_issues(f.issues, 20).select("rank", "id", "created_at")


@query
def unanswered_issues_oldest(f: Forum) -> DataFrame:
    return rankings.unanswered_issues(f.issues, 20, newest=False).select("rank", "id", "created_at")


@query
def escalation_watchlist(f: Forum) -> DataFrame:
    return rankings.escalation_watchlist(f.issues, NOW).select("rank", "id", "message_count", "reasons")


@query
def top_contributors(f: Forum) -> DataFrame:
    return rankings.top_contributors(f.issues)


@query
def leaderboard_rank(f: Forum) -> DataFrame:
    owners = f.issues.groupBy("owner_id").agg(F.sum("message_count").alias("messages"))
    return ranked_top(owners, [F.desc("messages"), F.asc("owner_id")], 8)


@query
def top_responders(f: Forum) -> DataFrame:
    return rankings.top_responders(f.threads, f.replies)


@query
def top_responders_view(f: Forum) -> DataFrame:
    return rankings.top_responders_view(f.threads, f.replies)


@query
def top_responders_join(f: Forum) -> DataFrame:
    return rankings.top_responders_join(f.threads, f.replies).select(
        "id", "issue_id", "channel_id", "author_id", "owner_id"
    )


@query
def issue_listing(f: Forum) -> DataFrame:
    return rankings.issue_listing(f.full_issues, NOW).withColumn("snippet", F.md5("snippet"))


@query
def issue_detail(f: Forum) -> DataFrame:
    return rankings.issue_detail(f.full_issues, f.replies, "42").withColumn("timestamp", F.col("timestamp"))


@query
def first_n_per_group(f: Forum) -> DataFrame:
    newest = [F.desc("created_at"), F.asc("id")]
    return first_n(f.threads, ["owner_id"], newest, 5).select("owner_id", "rank", "id")


@query
def latest_by_key(f: Forum) -> DataFrame:
    events = f.table("events").select("user_id", "event_id", "event_type", "ts")
    return maintenance.latest_by_key(events, ["user_id"], ["ts", "event_id"])


# Filters


def _filtered(f: Forum, **spec: object) -> DataFrame:
    return filters.filter_issues(f.full_issues, filters.IssueFilter(**spec)).select("id")


@query
def filter_archived(f: Forum) -> DataFrame:
    return _filtered(f, archived=True)


@query
def filter_active(f: Forum) -> DataFrame:
    return _filtered(f, archived="active")


@query
def filter_tags(f: Forum) -> DataFrame:
    return _filtered(f, tag_ids=["1-URGENT", "st-P"])


@query
def filter_status(f: Forum) -> DataFrame:
    return _filtered(f, statuses=["in-progress", "unanswered"])


@query
def filter_sentiment(f: Forum) -> DataFrame:
    return _filtered(f, sentiments=["frustrated", "unknown"])


@query
def filter_has_replies(f: Forum) -> DataFrame:
    return _filtered(f, has_replies="has")


@query
def filter_no_replies(f: Forum) -> DataFrame:
    return _filtered(f, has_replies=False)


@query
def filter_min_messages(f: Forum) -> DataFrame:
    return _filtered(f, min_message_count=6)


@query
def filter_attachment(f: Forum) -> DataFrame:
    return _filtered(f, has_attachment=True)


@query
def filter_duplicates(f: Forum) -> DataFrame:
    return _filtered(f, duplicates_only=True)


@query
def filter_dates(f: Forum) -> DataFrame:
    return _filtered(f, date_from="1996-01-01", date_to="1997-06-30")


@query
def filter_theme(f: Forum) -> DataFrame:
    return _filtered(f, theme="demo", themes=DEMO_THEMES)


@query
def filter_query(f: Forum) -> DataFrame:
    return _filtered(f, query="  User 7 ")


@query
def search_issues(f: Forum) -> DataFrame:
    """A third of the texts come twice, first in another state."""
    spark, home = f.spark, staging_path(f.spark, "search")
    light = f.with_text(f.issues, light=True)
    light = light.select("id", "name", "owner_username", "owner_global_name", "first_message_content").checkpoint()
    stored = KeyedTable(spark, f"{home}/issues", light.schema, texts=["first_message_content"])
    stored.write(light, f.texts)
    before = light.filter("cast(id as bigint) % 3 = 0").withColumn("owner_username", F.lit("user 7"))
    postings.add_postings(before, f"{home}/grams", texts=f.texts)
    postings.add_postings(light, f"{home}/grams", texts=f.texts)
    return postings.search_issues(stored, f"{home}/grams", "  User 7 ").select("id")


@query
def filter_issues(f: Forum) -> DataFrame:
    return _filtered(
        f,
        query="building",
        tag_ids=["1-URGENT", "2-HIGH", "st-O"],
        archived=False,
        statuses=["in-progress", "likely-resolved"],
        sentiments=["positive", "neutral", "unknown"],
        has_replies=True,
        min_message_count=3,
        has_attachment=False,
        date_from="1994-01-01",
        date_to="1999-12-31",
    )


@query
def unclustered_issues(f: Forum) -> DataFrame:
    return filters.unclustered_issues(f.threads).select("id", "created_at")


# Stored tables


@query
def issues_light(f: Forum) -> DataFrame:
    return tables.issues_light(f.stored)


@query
def load_issues(f: Forum) -> DataFrame:
    out = tables.load_issues(f.stored, CHANNEL, replies=f.replies)
    return out.select("id", "name", "created_at", "message_count", "first_message_content", "total_results", "has_replies")


@query
def issue_page(f: Forum) -> DataFrame:
    return tables.issue_page(f.threads.select("id", "created_at"), page=2)


# Themes and sentiment


@query
def issue_themes(f: Forum) -> DataFrame:
    return themes.issue_themes(f.document_issues)


@query
def keyword_themes(f: Forum) -> DataFrame:
    return themes.keyword_themes(f.document_issues)


@query
def theme_share(f: Forum) -> DataFrame:
    found = themes.keyword_themes(f.document_issues)
    total = f.table("documents").agg(F.count(F.lit(1)))
    return themes.theme_share(found, total).withColumn("bar", F.round("bar", 6))


@query
def theme_prompt_rows(f: Forum) -> DataFrame:
    return themes.theme_prompt_rows(f.document_issues)


def _completions(f: Forum) -> DataFrame:
    """Model answers made from the documents: good, fenced, empty and broken ones."""
    key = F.col("doc_id")
    word = F.regexp_extract("text", r"([A-Za-z]+)", 1)
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    word.alias("theme"),
                    F.concat(F.lit("about "), word).alias("description"),
                    F.array(word, F.lit("x"), F.lit("y"), F.lit("z"), F.lit("u"), F.lit("v"), F.lit("w")).alias(
                        "keywords"
                    ),
                    F.array(key % 180, (key + 7) % 180, F.lit(-1), key + 10_000_000).alias("issue_idxs"),
                ),
                F.struct(
                    F.lit("second").alias("theme"),
                    F.lit("").alias("description"),
                    F.array(F.lit("k")).alias("keywords"),
                    F.sequence(key % 50, key % 50 + 7).alias("issue_idxs"),
                ),
                F.struct(
                    F.lit("nothing").alias("theme"),
                    F.lit("").alias("description"),
                    F.array().cast("array<string>").alias("keywords"),
                    F.array().cast("array<bigint>").alias("issue_idxs"),
                ),
            ).alias("themes")
        )
    )
    answer = (
        F.when(key % 4 == 0, F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(key % 4 == 1, F.concat(F.lit("Sure. "), body))
        .when(key % 4 == 2, F.lit("I cannot help with that."))
        .otherwise(F.lit('{"themes": ['))
    )
    return f.table("documents").select(key.cast("string").alias("completion_id"), answer.alias("answer"))


def _themes_of_completions(f: Forum) -> DataFrame:
    numbered = themes.numbered_issues(f.document_issues)
    total = f.table("documents").agg(F.count(F.lit(1)))
    return themes.themes_from_completions(_completions(f), numbered, total)


@query
def themes_from_completions(f: Forum) -> DataFrame:
    return _themes_of_completions(f).drop("pos")


@query
def themes_with_fallback(f: Forum) -> DataFrame:
    found = _themes_of_completions(f)
    fallback = themes.keyword_themes(f.document_issues)
    return themes.with_fallback(found, _completions(f), fallback).drop("description", "keywords")


@query
def sentiment_groups(f: Forum) -> DataFrame:
    return sentiment.sentiment_groups(f.document_issues)


@query
def merge_sentiment(f: Forum) -> DataFrame:
    results = f.document_issues.filter("sentiment is not null").select(
        "id", "sentiment", F.lit(0.5).alias("score"), F.concat(F.lit("s "), "id").alias("summary")
    )
    base = f.full_issues.select("id", "sentiment", "sentiment_score", "sentiment_summary")
    return sentiment.merge_sentiment(base, results)


# Source documents


def _pages(f: Forum) -> DataFrame:
    return forum_json.read_pages(f.spark, f.write_pages(staging_path(f.spark, "pages")))


@query
def read_search_dump(f: Forum) -> DataFrame:
    path = f.write_pages(staging_path(f.spark, "pages"))
    return forum_json.read_search_dump(f.spark, path).select(
        "id", "name", "channel_id", "owner_username", "owner_global_name", "created_at", "archived_at", "archived",
        "locked", "message_count", "applied_tags", "first_message_id", F.md5("first_message_content").alias("content"),
        "first_message_created_at", "has_attachment", "attachment_filenames",
    )


@query
def read_post_data_map(f: Forum) -> DataFrame:
    path = f.write_post_data(staging_path(f.spark, "post-data"))
    return forum_json.read_post_data_map(f.spark, path).select(
        "thread_id", F.col("message.id").alias("message_id"), F.md5("message.content").alias("content")
    )


@query
def paged_thread_scan(f: Forum) -> DataFrame:
    read = forum_json.paged_thread_scan(_pages(f), max_threads=500)
    return read.select(
        "archived", "offset", "before", F.size("threads").alias("threads"), F.element_at("threads.id", 1).alias("first_id")
    )


@query
def scan_summary(f: Forum) -> DataFrame:
    return forum_json.scan_summary(forum_json.paged_thread_scan(_pages(f), max_threads=500))


@query
def archive_scan_before(f: Forum) -> DataFrame:
    return forum_json.archive_scan_before(f.thread_docs, "1997-01-01 00:00:00").select("id", "archived_at")


@query
def thread_messages(f: Forum) -> DataFrame:
    turns = f.table("conversations").select(
        F.col("conv_id").cast("string").alias("thread_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.timestamp_seconds(F.col("turn") * 60).alias("timestamp"),
        "role",
    )
    first = turns.filter("id like '%-0'").select("thread_id", F.col("id").alias("first_message_id"))
    return forum_json.thread_messages(turns, first, limit=5)


@query
def threads_first_message(f: Forum) -> DataFrame:
    pages = _pages(f)
    joined = forum_json.threads_first_message(forum_json.page_threads(pages), forum_json.first_messages(pages, ["id"]))
    return joined.select(F.col("thread.id").alias("id"), F.col("message.id").alias("message_id"))


@query
def backfill_first_messages(f: Forum) -> DataFrame:
    pages = _pages(f)
    post = forum_json.read_post_data_map(f.spark, f.write_post_data(staging_path(f.spark, "post-data")))
    post = post.select("thread_id", F.struct("message.id").alias("message"))  # all that is returned below
    threads = forum_json.page_threads(pages).select("thread.id")
    found = maintenance.backfill_first_messages(threads, forum_json.first_messages(pages, ["id"]), post)
    return found.select("thread_id", F.col("message.id").alias("message_id"), "origin")


@query
def normalize_issue(f: Forum) -> DataFrame:
    docs = f.thread_docs.select("thread", F.when(F.col("okey") % 5 != 0, F.col("message")).alias("message"))
    return normalize.normalize_issue(docs).withColumn("first_message_content", F.md5("first_message_content"))


@query
def reply_rows(f: Forum) -> DataFrame:
    return normalize.reply_rows(f.reply_docs, NOW)


# Merges and maintenance


def _even(f: Forum) -> DataFrame:
    return f.stored.filter("cast(id as bigint) % 2 = 0")


@query
def upsert_issues(f: Forum) -> DataFrame:
    source = (
        f.stored.filter("cast(id as bigint) % 3 = 0")
        .select("id", F.concat(F.lit("new "), "name").alias("name"), "channel_id", "owner_id", "owner_username",
                "created_at", (F.col("message_count") + 1).alias("message_count"), "resolution_status")
    )
    merged = maintenance.upsert_issues(_even(f), source, now=NOW)
    return merged.select(
        "id", "name", "message_count", "member_count", "is_answered", "resolution_status", "response_time_ms", "updated_at"
    )


@query
def upsert_replies(f: Forum) -> DataFrame:
    n = F.col("issue_id").cast("bigint")
    target = f.replies.filter(n % 2 == 0)
    source = f.replies.filter(n % 3 == 0).withColumn("content", F.concat(F.lit("new "), "content"))
    return maintenance.upsert_replies(target, source).select("id", "issue_id", "content", "attachment_count")


@query
def replace_replies(f: Forum) -> DataFrame:
    n = F.col("issue_id").cast("bigint")
    loaded = f.threads.filter("okey % 4 = 0").select("id")
    fresh = f.replies.filter((n % 4 == 0) & F.col("has_attachment")).withColumn(
        "content", F.concat(F.lit("new "), "content")
    )
    return maintenance.replace_replies(f.replies, loaded, fresh).select("id", "issue_id", "content")


def _changes(f: Forum) -> DataFrame:
    stored = f.issues.filter("okey % 7 != 0").withColumns(
        {
            "message_count": F.col("message_count") + F.when(F.col("okey") % 11 == 0, 1).otherwise(0),
            "archived": F.when(F.col("okey") % 13 == 0, ~F.col("archived")).otherwise(F.col("archived")),
        }
    )
    return maintenance.changed_threads(f.issues, stored)


@query
def changed_threads(f: Forum) -> DataFrame:
    return _changes(f).select("id", "change")


@query
def caught_up_pages(f: Forum) -> DataFrame:
    # Recent threads differ, old ones do not, as after a pause of the sync.
    quiet = F.col("created_at") < F.lit("1999-06-01").cast("timestamp")
    known = _changes(f).withColumn("change", F.when(quiet, "same").otherwise(F.col("change")))
    return maintenance.caught_up_pages(maintenance.paged(known.select("id", "archived", "created_at", "change")))


def _stored_replies(f: Forum) -> DataFrame:
    return f.replies.filter(F.col("issue_id").cast("bigint") % 5 != 0)


@query
def missing_replies(f: Forum) -> DataFrame:
    return maintenance.missing_replies(f.issues, _stored_replies(f)).select("id", "fetched_at")


@query
def missing_replies_bulk(f: Forum) -> DataFrame:
    return maintenance.missing_replies(f.issues, _stored_replies(f), batch=None, take=200).select("id", "fetched_at")


@query
def rotate_queue(f: Forum) -> DataFrame:
    return maintenance.rotate_queue(f.issues, _stored_replies(f), NOW).select("id", "fetched_at")


def _clusters(f: Forum) -> DataFrame:
    """Clusters c0 to c249; the derived issues use those below c200."""
    n = F.col("c_custkey") % 250
    return f.table("customer").groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("issue_count")).select(
        F.concat(F.lit("c"), F.col("n").cast("string")).alias("id"),
        F.concat(F.lit("Cluster "), F.col("n").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.col("issue_count").cast("int").alias("issue_count"),
    )


@query
def orphan_clusters(f: Forum) -> DataFrame:
    return maintenance.orphan_clusters(_clusters(f), f.threads)


@query
def clear_channel(f: Forum) -> DataFrame:
    found = themes.keyword_themes(f.document_issues)
    state = maintenance.clear_channel(f.threads, f.replies, _clusters(f), found, CHANNEL)
    parts = [df.select(F.lit(name).alias("table"), "id") for name, df in state.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def cluster_members(f: Forum) -> DataFrame:
    issues = f.threads.withColumn("name", F.col("title"))
    return graph.cluster_members(_clusters(f), issues)


def _notes(f: Forum, remote: bool) -> DataFrame:
    """The newest note per issue and user of one side."""
    side = f.table("events").filter(F.col("event_id") % 2 == (1 if remote else 0))
    rows = side.select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("id"),
        F.col("event_type").alias("issue_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("user_name"),
        F.col("props").alias("content"),
        F.lit(1).cast("bigint").alias("version"),
        F.col("ts").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return maintenance.latest_by_key(rows, ["id"], ["updated_at", "content"])


@query
def note_merge_lww(f: Forum) -> DataFrame:
    return notes.note_merge_lww(_notes(f, False), _notes(f, True))


@query
def note_write(f: Forum) -> DataFrame:
    edits = _notes(f, True).filter("cast(user_id as bigint) % 2 = 0").select(
        "issue_id", "user_id", "user_name", F.lit("edited").alias("content")
    )
    return notes.note_write(_notes(f, False), edits, NOW).select(
        "issue_id", "user_id", "content", "version", "updated_at", "deleted_at"
    )


# Similarity and clusters


@query
def embed_text(f: Forum) -> DataFrame:
    key = F.col("id").cast("bigint")
    as_json = F.when(key % 6 == 0, F.lit("[broken")).otherwise(F.to_json("applied_tags"))
    issues = f.document_issues.withColumn("applied_tags", as_json)
    return similarity.embed_text(issues).select("id", F.md5("text").alias("text"), F.length("text").alias("n"))


def _entries(records: DataFrame, *columns: str) -> DataFrame:
    """One row for each entry of a vector that is not 0."""
    each = records.select(*columns, F.posexplode("values").alias("slot", "value")).filter("value != 0")
    return each.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def embed_issues(f: Forum) -> DataFrame:
    return _entries(similarity.embed_issues(f.document_issues), "id", "metadata.channelId", "metadata.sentiment")


@query
def refresh_embeddings(f: Forum) -> DataFrame:
    """Vectors of texts that the cache lacks, under the model of all; the others from the cache."""
    texts = similarity.embed_text(f.document_issues).filter("text != ''").select("id", "text")
    late = F.col("id").cast("bigint") % 150 == 3
    # The model was fitted before the late texts came.
    model = similarity.add_models(similarity.fit_slots(texts.filter(~late)), similarity.fit_slots(texts.filter(late)))
    embedder = similarity.hashing_embedder(model=model.checkpoint())
    cached = embedder(texts.filter(~late)).select("id", "values").checkpoint()
    return _entries(similarity.refresh_embeddings(texts, cached, embedder), "id")


@query
def update_terms(f: Forum) -> DataFrame:
    """How many words have which document frequency, after texts came, changed and went."""
    texts = similarity.embed_text(f.document_issues).filter("text != ''").select("id", "text")
    key = F.col("id").cast("bigint")
    other = texts.withColumn("text", F.concat("text", F.lit(" formerly "), "id"))
    before = texts.filter((key % 3 != 0) & (key % 5 != 1)).unionByName(other.filter(key % 5 == 1))
    came = texts.filter((key % 3 == 0) & (key % 5 != 1)).unionByName(texts.filter(key % 5 == 1))
    model = terms.update_terms(terms.fit_terms(before), came, other.filter(key % 5 == 1))
    word = F.col("term").isNotNull().alias("is_word")
    return model.groupBy(word, "df").agg(F.count(F.lit(1)).alias("words"))


@query
def sparse_knn_join(f: Forum) -> DataFrame:
    """Near neighbours of all documents by their weighted words."""
    texts = similarity.embed_text(f.document_issues).filter("text != ''").select("id", "text")
    vectors = terms.term_vectors(texts, terms.fit_terms(texts).checkpoint()).checkpoint()
    return terms.sparse_knn_join(vectors, vectors).withColumn("score", F.round("score", 6))


@query
def vector_upsert(f: Forum) -> DataFrame:
    key = F.col("id").cast("bigint")
    index = f.vectors.filter(key % 2 == 0)
    records = f.vectors.filter(key % 3 == 0).withColumn("label", F.lit(-1))
    return similarity.vector_upsert(index, records).select("id", "label", F.size("values").alias("dimension"))


def _neighbours(f: Forum) -> DataFrame:
    vectors = f.vectors.select("id", "values")
    return similarity.knn_join(vectors, vectors, threshold=VECTOR_THRESHOLD)


@query
def knn_join(f: Forum) -> DataFrame:
    return _neighbours(f).withColumn("score", F.round("score", 6))


@query
def similarity_edges(f: Forum) -> DataFrame:
    return similarity.similarity_edges(_neighbours(f))


def _components(f: Forum) -> DataFrame:
    return graph.connected_components(similarity.similarity_edges(_neighbours(f)))


@query
def connected_components(f: Forum) -> DataFrame:
    return _components(f)


@query
def grow_components(f: Forum) -> DataFrame:
    """The links of three days, one day after the other."""
    links = similarity.similarity_edges(_neighbours(f)).checkpoint()
    members = KeyedTable(f.spark, staging_path(f.spark, "members"), MEMBERS)
    day = F.pmod(F.xxhash64("src", "dst"), F.lit(3))
    for n in range(3):
        duplicates.grow_components(members, links.filter(day == n))
    return members.read()


def _vector_issues(f: Forum) -> DataFrame:
    key = F.col("id").cast("bigint")
    name = F.when(key % 4 != 0, F.concat(F.lit("vector "), "id"))
    old = F.when(key % 10 == 0, F.lit("old"))
    return f.vectors.select("id", name.alias("name"), old.alias("duplicate_cluster_id"))


@query
def build_clusters(f: Forum) -> DataFrame:
    return graph.build_clusters(_components(f), _vector_issues(f))


@query
def assign_clusters(f: Forum) -> DataFrame:
    return graph.assign_clusters(_vector_issues(f), _components(f))


@query
def semantic_search(f: Forum) -> DataFrame:
    """Each label's first vector as the query; labels are few."""
    asked = first_n(f.vectors, ["label"], [F.col("id").cast("bigint")], 1).select(
        F.col("label").cast("string").alias("query_id"), "values"
    )
    records = f.vectors.select(
        "values", F.struct(F.col("id").alias("issueId"), F.col("label").cast("string").alias("channelId")).alias("metadata")
    )
    return similarity.semantic_search(asked, records).withColumn("score", F.round("score", 6))


@query
def embedding_cache_delta(f: Forum) -> DataFrame:
    key = F.col("id").cast("bigint")
    return similarity.embedding_cache_delta(f.vectors.filter(key % 90 != 1), f.vectors.filter(key % 80 != 0))


@query
def duplicate_documents(f: Forum) -> DataFrame:
    """The whole duplicate job over the documents."""
    issues = f.document_issues.withColumn("duplicate_cluster_id", F.lit(None).cast("string"))
    return daily_clustering(issues, limit=None)[1].select("id", "duplicate_cluster_id")


@query
def daily_clustering_vectors(f: Forum) -> DataFrame:
    """The scheduled form over given vectors, all unclustered issues as anchors."""
    key = F.col("id").cast("bigint")
    issues = _vector_issues(f).withColumn("created_at", F.timestamp_seconds(key * 60))
    records = f.vectors.select(F.struct(F.col("id").alias("issueId")).alias("metadata"), "values")
    clusters, _ = daily_clustering(issues, threshold=VECTOR_THRESHOLD, vectors=records)
    return clusters


# Exports


@query
def export_csv(f: Forum) -> DataFrame:
    path = staging_path(f.spark, "csv")
    exports.write_csv(exports.export_csv(f.full_issues), path)
    rows = f.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.fillna("").withColumn("firstMessageContent", F.md5("firstMessageContent"))


@query
def export_json(f: Forum) -> DataFrame:
    # A small part size, so that issues with continued parts occur.
    rows = exports.export_json(f.issues, f.replies, per_line=4)
    return rows.select("id", "part", F.col("replies.id").alias("reply_ids"))


@query
def summary_report(f: Forum) -> DataFrame:
    report = exports.summary_report(
        f.full_issues, themes.keyword_themes(f.document_issues), _clusters(f), response.response_analytics(f.issues),
        channel_id=CHANNEL, generated=NOW, total_results=f.issues.agg(F.count(F.lit(1))),
    )
    return report


@query
def backup_ndjson(f: Forum) -> DataFrame:
    path = staging_path(f.spark, "backup")
    saved = {
        "issues": f.threads,
        "replies": f.replies,
        "duplicate_clusters": _clusters(f),
        "theme_clusters": themes.keyword_themes(f.document_issues),
    }
    exports.backup_ndjson(saved, path)
    return f.spark.read.schema("table string, rows bigint").json(f"{path}/manifest")


# Scheduled jobs


def _sync_tables(spark: SparkSession, home: str) -> tuple[KeyedTable, KeyedTable]:
    issues = KeyedTable(spark, f"{home}/issues", ISSUE, texts=["first_message_content"])
    return issues, KeyedTable(spark, f"{home}/replies", REPLY, ["issue_id"])


@query
def incremental_sync(f: Forum) -> DataFrame:
    spark, home = f.spark, staging_path(f.spark, "sync")
    issues, replies = _sync_tables(spark, home)
    key = F.col("id").cast("bigint")
    old = f.stored_light.filter(key % 7 != 0).withColumns(
        {
            "message_count": F.col("message_count") + F.when(key % 11 == 0, 1).otherwise(0),
            "archived": F.when(key % 13 == 0, ~F.col("archived")).otherwise(F.col("archived")),
            "is_answered": F.lit(False),
            "response_time_ms": F.lit(None),
            "responder_count": F.lit(0),
            "resolution_status": F.lit("unknown"),
        }
    )
    issues.write(old, f.texts)
    messages = f.write_messages(f"{home}/messages")
    jobs.incremental_sync(
        jobs.page_stream(spark, f.write_pages(f"{home}/pages")),
        forum_json.read_messages(spark, messages),
        issues,
        replies,
        f"{home}/checkpoint",
        now=NOW,
        keywords=KEYWORDS,
    )
    counts = replies.read().groupBy(F.col("issue_id").alias("id")).agg(F.count(F.lit(1)).alias("replies"))
    return (
        issues.read(light=True)
        .select("id", "message_count", "archived", "is_answered", "response_time_ms", "responder_count", "resolution_status")
        .join(counts, "id", "left")
        .fillna(0, ["replies"])
    )


@query
def hourly_recent_sync(f: Forum) -> DataFrame:
    spark, home = f.spark, staging_path(f.spark, "hourly")
    issues, replies = _sync_tables(spark, home)
    issues.write(f.stored_light.filter("cast(id as bigint) % 7 != 0"), f.texts)
    messages = f.write_messages(f"{home}/messages")
    jobs.hourly_recent_sync(
        jobs.page_stream(spark, f.write_pages(f"{home}/pages")),
        forum_json.read_messages(spark, messages),
        issues,
        replies,
        f"{home}/checkpoint",
        now=NOW,
    )
    return issues.read(light=True).select(
        "id", "message_count", "fetched_at", "resolution_status"
    ).join(
        replies.read().groupBy(F.col("issue_id").alias("id")).agg(F.count(F.lit(1)).alias("replies")), "id", "left"
    ).fillna(0, ["replies"])


@query
def note_sync(f: Forum) -> DataFrame:
    spark, home = f.spark, staging_path(f.spark, "notes")
    table = KeyedTable(spark, f"{home}/notes", NOTE, ["issue_id", "user_id"])
    table.write(_notes(f, False))
    _notes(f, True).write.parquet(f"{home}/incoming")
    jobs.note_sync(jobs.note_stream(spark, f"{home}/incoming"), table, f"{home}/checkpoint")
    return table.read()


@query
def note_exchange(f: Forum) -> DataFrame:
    """Remote notes first; then local ones, and a part of the remote ones once more."""
    spark, home = f.spark, staging_path(f.spark, "exchange")
    table = KeyedTable(spark, f"{home}/notes", NOTE, ["issue_id", "user_id"])
    marks = KeyedTable(spark, f"{home}/marks", NOTE_MARK, ["issue_id", "user_id"])
    local, remote = _notes(f, False), _notes(f, True)
    again = remote.filter("cast(user_id as bigint) % 3 = 0")
    for own, other in ((local.limit(0), remote), (local, again)):
        own.write.mode("append").parquet(f"{home}/local")
        other.write.mode("append").parquet(f"{home}/remote")
        sides = [jobs.note_stream(spark, f"{home}/{side}").withColumn("origin", F.lit(side)) for side in ("local", "remote")]
        jobs.note_exchange(sides[0].unionByName(sides[1]), table, marks, f"{home}/outbox", f"{home}/checkpoint")
    sent = spark.read.schema(NOTE).parquet(f"{home}/outbox").select(*NOTE.names)
    return table.read().withColumn("side", F.lit("stored")).unionByName(sent.withColumn("side", F.lit("sent")))


@query
def stream_daily_stats(f: Forum) -> DataFrame:
    spark, home = f.spark, staging_path(f.spark, "daily")
    issues = f.event_issues.select("id", "created_at", "channel_id", "message_count", "is_answered")
    # Newest first, so that later batches are late; every seventh issue comes in two states.
    parts = [
        issues.filter(F.col("created_at") < "2024-01-15"),
        issues.filter(F.col("created_at") >= "2024-01-15"),
        issues.filter(F.crc32(F.col("id").cast("binary")) % 7 == 0).withColumn("message_count", F.col("message_count") + 1),
    ]
    stored = KeyedTable(spark, f"{home}/issues", issues.schema)
    table = KeyedTable(spark, f"{home}/stats", jobs.DAILY, ["date", "channel_id"])
    for part in reversed(parts):
        part.write.mode("append").parquet(f"{home}/incoming")
        stream = spark.readStream.schema(issues.schema).parquet(f"{home}/incoming")
        jobs.stream_daily_stats(stream, stored, table, f"{home}/checkpoint", order=["created_at", "message_count"])
    return table.read().drop("batch")


