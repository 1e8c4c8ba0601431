"""CSV, JSON, Markdown and backup writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.constants import CSV_HEADERS, DEFAULT_GUILD_ID
from threadloom.functions.text import cut, one_line, tag_name, thread_url
from threadloom.functions.time import duration_text, half_up, short_date
from threadloom.operators.distributed import checkpoint_with, positions, ranked_top


def _iso(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def export_csv(issues: DataFrame, guild_id: str = DEFAULT_GUILD_ID) -> DataFrame:
    """The rows of the CSV export, every value as text."""
    tags = F.transform(F.coalesce("applied_tags", F.array().cast("array<string>")), tag_name)
    values = [
        F.col("id"),
        F.col("name"),
        _iso("created_at"),
        _iso("archived_at"),
        F.coalesce(F.col("archived"), F.lit(False)).cast("string"),
        F.coalesce(F.col("locked"), F.lit(False)).cast("string"),
        _blank("message_count"),
        _blank("member_count"),
        _blank("total_message_sent"),
        F.array_join(tags, "; "),
        _blank("owner_id"),
        _blank("owner_username"),
        _blank("owner_global_name"),
        cut(one_line(_blank("first_message_content")), 500),
        _iso("first_message_created_at"),
        _blank("response_time_ms"),
        _blank("responder_count"),
        F.coalesce(F.col("is_answered"), F.lit(False)).cast("string"),
        F.coalesce("resolution_status", F.lit("unknown")),
        _blank("sentiment"),
        _blank("sentiment_score"),
        one_line(_blank("sentiment_summary")),
        _blank("duplicate_cluster_id"),
        thread_url(F.col("id"), guild_id),
    ]
    return issues.select(*[v.alias(h) for v, h in zip(values, CSV_HEADERS, strict=True)])


def write_csv(rows: DataFrame, path: str) -> None:
    (
        rows.write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


# Replies per exported line. Nearly every issue fits on one line.
REPLIES_PER_LINE = 10_000


def export_json(issues: DataFrame, replies: DataFrame, per_line: int = REPLIES_PER_LINE) -> DataFrame:
    """Issues with nested replies, oldest first.

    A row cannot grow without limit, so an issue with more than ``per_line``
    replies continues on further rows: ``part`` counts them from 0.
    """
    fields = ["id", "author_id", "author_username", "author_global_name", "content", "timestamp",
              "has_attachment", "attachment_count"]
    rows = replies.select("issue_id", *fields)
    order, held = [F.asc("timestamp"), F.asc("id")], max(per_line, REPLIES_PER_LINE)
    # Threads that fit in a task are numbered where they are collected, so their rows move once;
    # longer ones by a sort over all tasks.
    counts = replies.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n"))
    busy, seen = checkpoint_with(counts.filter(F.col("n") > held).select("issue_id"), n=F.count(F.lit(1)))

    def collected(parted: DataFrame) -> DataFrame:
        return (
            parted.groupBy("issue_id", "part")
            .agg(F.sort_array(F.collect_list(F.struct("timestamp", "id", F.struct(*fields).alias("r")))).alias("_rows"))
            .select(F.col("issue_id").alias("id"), "part", F.col("_rows.r").alias("replies"))
        )

    usual = rows.join(busy, "issue_id", "left_anti") if seen["n"] else rows
    thread, part = Window.partitionBy("issue_id"), F.floor(F.col("_at") / per_line)
    usual = usual.withColumn("_at", F.row_number().over(thread.orderBy(*order)) - 1)
    usual = usual.withColumns({"_n": F.count(F.lit(1)).over(thread), "_part": part})
    # In a thread of several parts a reply goes to the parts of its id: a repeated id has several, none has no part.
    own = F.collect_list("_part").over(Window.partitionBy("issue_id", "id"))
    zero = F.array(F.lit(0).cast("bigint"))
    several = F.when(F.col("id").isNotNull(), own)
    usual = usual.withColumn("_parts", F.when(F.col("_n") > per_line, several).otherwise(zero))
    parts = collected(usual.withColumn("part", F.explode("_parts")))
    if seen["n"]:
        slim = replies.select("issue_id", "id", "timestamp").join(busy, "issue_id", "left_semi")
        numbered = positions(slim, ["issue_id"], order, "_at").select("issue_id", "id", part.alias("part"))
        parts = parts.unionByName(collected(rows.join(numbered, ["issue_id", "id"])))
    return issues.join(parts, "id", "left").withColumns(
        {
            "part": F.coalesce("part", F.lit(0)),
            # An empty list means none, null means not loaded.
            "replies": F.when(
                F.col("replies_loaded"),
                F.coalesce("replies", F.array().cast(parts.schema["replies"].dataType)),
            ),
        }
    )


def write_json(exported: DataFrame, path: str) -> None:
    """Lines of issues, and a manifest with the number of issues."""
    exported.write.json(f"{path}/issues")
    manifest(exported.filter("part = 0")).write.json(f"{path}/manifest")


def manifest(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count(F.lit(1)).alias("count")).select(
        F.current_timestamp().alias("exportedAt"), "count"
    )


def backup_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def backup_ndjson(tables: Mapping[str, DataFrame], path: str) -> None:
    """Every table as compressed JSON lines, and the manifest of row counts."""
    for name, df in tables.items():
        df.write.option("compression", "gzip").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    written = {name: spark.read.schema(df.schema).json(f"{path}/{name}") for name, df in tables.items()}
    backup_counts(written).write.json(f"{path}/manifest")


def summary_report(
    issues: DataFrame,
    themes: DataFrame,
    clusters: DataFrame,
    analytics: DataFrame,
    title: str = "Forum issues: summary report",
    guild_id: str = DEFAULT_GUILD_ID,
    channel_id: str = "",
    generated: str = "",
    total_results: DataFrame | None = None,
    footer: str = "Generated from the forum tables",
) -> DataFrame:
    """Lines of the Markdown report as (section, ord, line).

    ``analytics`` is the row of ``response_analytics``; clusters have
    (id, name, description, issue_count). ``total_results`` is a one-row count of
    the issues in the forum, of which ``issues`` are those loaded; by default
    these are all. ``generated`` is the time shown.
    """
    def table_head(*names: str) -> list[str]:
        return ["| " + " | ".join(names) + " |", "|" + "|".join("---" for _ in names) + "|"]

    def number(c: Column | str) -> Column:
        return F.format_number(F.col(c) if isinstance(c, str) else c, 0)

    def lines(df: DataFrame, section: int, start: Column | int, *texts: Column | str) -> DataFrame:
        """Each row of ``df`` as consecutive lines; null lines are left out."""
        columns = F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])
        first = F.lit(start) if isinstance(start, int) else start
        out = df.select(first.cast("bigint").alias("_first"), F.posexplode(columns).alias("_i", "line"))
        return out.filter("line is not null").select(
            F.lit(section).alias("section"), (F.col("_first") + F.col("_i")).alias("ord"), "line"
        )

    messages = F.coalesce(F.nullif(F.col("total_message_sent"), F.lit(0)), F.col("message_count"), F.lit(0))
    totals = issues.agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_distinct("owner_id").alias("reporters"),
        F.coalesce(F.sum(messages), F.lit(0)).alias("messages"),
        F.count_if(F.col("sentiment") == "frustrated").alias("frustrated"),
        F.count_if(F.col("sentiment") == "resolved").alias("resolved"),
        F.count_if(F.col("sentiment") != "").alias("scored"),
    )
    both = F.struct(F.col("response_rate").alias("rate"), F.col("avg_response_time_ms").alias("wait"))
    totals = totals.withColumn("_a", analytics.select(both).scalar()).select("*", "_a.rate", "_a.wait")
    totals = totals.withColumn("forum", F.col("issues") if total_results is None else total_results.scalar())

    def row(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"| {name} | "), value.cast("string"), F.lit(" |"))

    scored = F.col("scored") > 0
    metrics = lines(
        totals, 1, 0, f"# {title}", "",
        f"**Channel ID:** {channel_id}", f"**Generated:** {generated}",
        F.concat(F.lit("**Issues loaded:** "), F.col("issues").cast("string"), F.lit(" of "), number("forum"), F.lit(" total")),
        "", "## Key Metrics", "", *table_head("Metric", "Value"),
        row("Total Issues (loaded)", F.col("issues")),
        row("Total Issues (in forum)", number("forum")),
        row("Unique Reporters", F.col("reporters")),
        row("Total Messages", number("messages")),
        row("Response Rate", F.concat(half_up(F.col("rate") * 100).cast("string"), F.lit("%"))),
        F.when(F.col("wait").isNotNull(), row("Avg Response Time", duration_text(F.col("wait")))),
        F.when(scored, row("Frustrated Issues", F.col("frustrated"))),
        F.when(scored, row("Resolved Issues", F.col("resolved"))),
        "",
    )
    def heading(df: DataFrame, section: int, *texts: str) -> DataFrame:
        """Fixed lines, shown only when ``df`` has rows."""
        return lines(df.limit(1), section, 0, *texts)

    top_themes = ranked_top(themes, [F.asc(F.col("theme") == "Other"), F.desc("count"), F.asc("theme")], 10)
    theme_lines = lines(
        top_themes, 2, F.col("rank") + 10,
        F.concat(F.lit("| "), F.concat_ws(" | ", "theme", F.col("count").cast("string"), "description"), F.lit(" |")),
    )
    top_clusters = ranked_top(clusters, [F.desc("issue_count"), F.asc("id")], 8)
    cluster_lines = lines(
        top_clusters, 3, F.col("rank") * 10,
        F.concat(F.lit("### "), "name", F.lit(" ("), F.col("issue_count").cast("string"), F.lit(" duplicates)")),
        F.concat(F.lit("_"), F.coalesce("description", F.lit("")), F.lit("_")),
        "",
    )
    top = ranked_top(issues, [F.desc("message_count"), F.desc("created_at"), F.asc("id")], 10)
    issue_lines = lines(
        top, 4, F.col("rank") * 10,
        F.concat(
            F.lit("- **"), "name", F.lit("** — "), F.col("message_count").cast("string"), F.lit(" msgs, by @"),
            "owner_username", F.lit(" ("), short_date(F.col("created_at")), F.lit(")"),
        ),
        F.concat(F.lit("  "), thread_url(F.col("id"), guild_id)),
    )
    parts = [
        metrics,
        heading(themes, 2, "## Common Themes", "", *table_head("Theme", "Count", "Description")),
        theme_lines,
        heading(clusters, 3, "## Duplicate Clusters (Recurring Issues)", ""),
        cluster_lines,
        heading(totals, 4, "## Top Issues by Message Count", ""),
        issue_lines,
        lines(totals, 5, 0, "", "---", f"_{footer}_"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.orderBy("section", "ord")


def write_report(report: DataFrame, path: str) -> None:
    """The report as one text file; it has fewer than a hundred lines."""
    report.coalesce(1).sortWithinPartitions("section", "ord").select("line").write.text(path)
