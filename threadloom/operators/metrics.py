"""Channel KPIs, time series and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import tag_name
from threadloom.functions.time import DAY_MS, HOUR_MS, half_up, whole_text
from threadloom.operators.distributed import middle_of_counts


def _n() -> Column:
    return F.count(F.lit(1))


def _counted(issues: DataFrame) -> DataFrame:
    """Sums of each channel by response time, and one row for each of its owners.

    Both come from one pass, as two entries of each issue that meet in one grouping.
    """
    owner = issues.schema["owner_id"].dataType
    entries = F.array(
        F.struct(F.lit(False).alias("is_owner"), F.col("response_time_ms").cast("bigint").alias("wait"), F.lit(None).cast(owner).alias("owner")),
        F.struct(F.lit(True).alias("is_owner"), F.lit(None).cast("bigint").alias("wait"), F.col("owner_id").alias("owner")),
    )
    sums = ["id", "message_count", "is_answered", "resolution_status", "archived"]
    rows = issues.select("channel_id", *sums, F.inline(entries))
    once = ~F.col("is_owner")
    return rows.groupBy("channel_id", "is_owner", "wait", "owner").agg(
        F.count_if(once).alias("_c"),
        F.count_if(once & F.col("id").isNotNull()).alias("issues"),
        F.count_if(once & F.col("is_answered")).alias("answered"),
        F.sum(F.when(once, F.col("message_count"))).alias("messages"),
        F.count_if(once & (F.col("resolution_status") == "likely-resolved")).alias("resolved"),
        F.count_if(once & F.col("archived")).alias("archived"),
    )


def global_metrics(issues: DataFrame) -> DataFrame:
    """KPIs per channel, with the interpolated median response time.

    The issues are read once, when this is called: their counts are checkpointed,
    and KPIs and medians are taken from these.
    """
    counted = _counted(issues).checkpoint()
    wait, median = F.col("wait"), "median_response_time_ms"
    waited = F.when(wait.isNotNull(), F.col("_c"))
    kpis = counted.groupBy("channel_id").agg(
        F.sum("issues").alias("total_issues"),
        F.sum("answered").alias("answered_issues"),
        F.sum("messages").alias("total_messages"),
        F.sum("resolved").alias("resolved_issues"),
        (F.sum(wait.cast("double") * F.col("_c")) / F.sum(waited)).alias("avg_response_time_ms"),
        F.coalesce(F.sum(F.when(wait <= HOUR_MS, F.col("_c"))), F.lit(0)).alias("fast_response_count"),
        F.count("owner").alias("unique_users"),
        F.sum("archived").alias("archived_issues"),
    )
    waits = counted.filter(wait.isNotNull()).select("channel_id", wait.alias("_v"), "_c")
    medians = middle_of_counts(waits, ["channel_id"], median).withColumnRenamed("channel_id", "_channel")
    same = F.col("channel_id").eqNullSafe(F.col("_channel"))
    return kpis.join(medians, same, "left").drop("_channel")


def daily_stats(issues: DataFrame) -> DataFrame:
    """Issues, messages and answered issues per UTC day and channel."""
    return issues.groupBy(F.to_date("created_at").alias("date"), "channel_id").agg(
        _n().alias("issue_count"),
        F.sum("message_count").alias("total_messages"),
        F.count_if(F.col("is_answered")).alias("answered_count"),
    )


def issues_by_day(issues: DataFrame) -> DataFrame:
    """Issue count per UTC day; rows without a date are left out."""
    return (
        issues.filter(F.col("created_at").isNotNull())
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(_n().alias("count"))
    )


def cumulative_issues(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Running total over daily counts. Its input has one row per day (and channel)."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative", F.sum("count").over(w))


def issues_by_tag(issues: DataFrame) -> DataFrame:
    """Issue count per applied tag with the tag's name."""
    return (
        issues.select(F.explode("applied_tags").alias("tag_id"))
        .groupBy("tag_id")
        .agg(_n().alias("count"))
        .select("tag_id", tag_name(F.col("tag_id")).alias("name"), "count")
    )


def distinct_tags(issues: DataFrame) -> DataFrame:
    return issues.select(F.explode("applied_tags").alias("tag")).agg(
        F.count_distinct("tag").alias("distinct_tags")
    )


def distinct_reporters(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_distinct(F.nullif(F.col("owner_id"), F.lit(""))).alias("reporters"))


def channel_totals(issues: DataFrame, channel_id: str | None = None) -> DataFrame:
    """Exact issue count, of one channel or per channel."""
    if channel_id is not None:
        issues = issues.filter(F.col("channel_id") == channel_id)
    return issues.groupBy("channel_id").agg(_n().alias("total"))


def data_flags(issues: DataFrame) -> DataFrame:
    """Which optional analyses have data."""
    def any_row(c: Column) -> Column:
        return F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))

    return issues.agg(
        any_row((F.col("sentiment") != "") & (F.col("sentiment") != "unknown")).alias("has_sentiment"),
        any_row(F.col("duplicate_cluster_id") != "").alias("has_duplicates"),
        any_row(F.col("replies_loaded")).alias("has_replies"),
    )


def kpi_strip(issues: DataFrame) -> DataFrame:
    """The headline numbers over one set of issues."""
    loaded = F.coalesce(F.col("replies_loaded"), F.lit(False))
    answered = F.coalesce(F.col("is_answered"), F.lit(False))
    messages = F.coalesce(
        F.nullif(F.col("total_message_sent"), F.lit(0)), F.col("message_count"), F.lit(0)
    )
    base = issues.agg(
        _n().alias("issues"),
        F.count_distinct(F.nullif(F.col("owner_id"), F.lit(""))).alias("unique_users"),
        F.coalesce(F.sum(messages), F.lit(0)).alias("total_messages"),
        F.count_if(F.col("archived")).alias("archived"),
        F.count_if(loaded).alias("with_replies"),
        F.count_if(loaded & answered).alias("answered"),
        F.count_if(loaded & ~answered).alias("unanswered"),
        F.count_if(loaded & (F.col("resolution_status") == "likely-resolved")).alias("resolved"),
    )

    def percent(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, half_up(F.col(part) / F.col(whole) * 100)).otherwise(0)

    return base.select(
        "issues",
        "unique_users",
        "total_messages",
        "archived",
        (F.col("issues") - F.col("archived")).alias("active"),
        percent("archived", "issues").alias("archived_pct"),
        F.when(F.col("issues") > 0, half_up(F.col("total_messages") / F.col("issues")))
        .otherwise(0)
        .alias("avg_messages_per_issue"),
        "answered",
        "unanswered",
        "resolved",
        percent("answered", "with_replies").alias("response_rate_pct"),
        percent("resolved", "with_replies").alias("resolved_pct"),
        percent("unanswered", "with_replies").alias("unanswered_pct"),
    )


def time_of_week_heatmap(issues: DataFrame, tz: str = "UTC") -> DataFrame:
    """Issue counts for each of 7 x 24 cells (Monday is day 0), with total and maximum."""
    local = F.from_utc_timestamp(F.col("created_at"), tz)
    counts = (
        issues.filter(F.col("created_at").isNotNull())
        .groupBy((F.weekday(local) * 24 + F.hour(local)).alias("cell"))
        .agg(_n().alias("n"))
    )
    grid = issues.sparkSession.range(7 * 24).select(F.col("id").cast("int").alias("cell"))
    whole = Window.partitionBy()  # 168 rows
    return (
        grid.join(counts, "cell", "left")
        .select(
            F.floor(F.col("cell") / 24).cast("int").alias("day"),
            (F.col("cell") % 24).alias("hour"),
            F.coalesce("n", F.lit(0)).alias("count"),
        )
        .withColumn("max_count", F.max("count").over(whole))
        .withColumn("total", F.sum("count").over(whole))
    )


def weekly_trends(issues: DataFrame) -> DataFrame:
    """Seven indicators: last seven days against the seven before.

    Both windows are anchored at the newest issue. Returns metric, current,
    previous, value, direction and status.
    """
    at = F.unix_millis("created_at")
    dated = issues.filter(F.col("created_at") > F.lit("1970-01-01").cast("timestamp"))
    # One whole bound on the column as stored, so that a scan can skip what is older. (Two
    # would be merged into one subquery of two fields, which Spark does not push down.)
    start = dated.agg(F.timestamp_millis(F.max(at) - 14 * DAY_MS)).scalar()
    recent = issues.filter(F.col("created_at") >= start)
    recent = recent.withColumn("_cur", at - F.unix_millis(start) >= 7 * DAY_MS)
    loaded = F.coalesce(F.col("replies_loaded"), F.lit(False))
    answered = F.coalesce(F.col("is_answered"), F.lit(False))
    wait = F.when(F.col("response_time_ms") > 0, F.col("response_time_ms"))
    owner = F.nullif(F.col("owner_id"), F.lit(""))

    sides = recent.groupBy("_cur").agg(
        _n().alias("issues_created"),
        F.count_distinct(owner).alias("unique_users"),
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages"),
        F.count_if(~F.coalesce(F.col("archived"), F.lit(False))).alias("active_issues"),
        F.count_if(loaded).alias("loaded"),
        F.count_if(loaded & answered).alias("answered"),
        F.coalesce(F.avg(wait), F.lit(0.0)).alias("avg_response_time"),
        F.count_if(loaded & ~answered).alias("unanswered"),
    )
    names = [c for c in sides.columns if c != "_cur"]

    def side(c: str, current: bool) -> Column:
        picked = F.max(F.when(F.col("_cur") == F.lit(current), F.col(c)))
        return F.coalesce(picked.cast("double"), F.lit(0.0))

    one = sides.agg(
        *[side(c, True).alias(f"c_{c}") for c in names],
        *[side(c, False).alias(f"p_{c}") for c in names],
    )

    def metric(order: int, name: str, cur: Column, prev: Column, better: int, kind: str) -> Column:
        return F.struct(
            F.lit(order).alias("ord"),
            F.lit(name).alias("metric"),
            cur.alias("current"),
            prev.alias("previous"),
            F.lit(better).alias("better"),
            F.lit(kind).alias("kind"),
        )

    def plain(order: int, name: str, better: int = 1) -> Column:
        return metric(order, name, F.col(f"c_{name}"), F.col(f"p_{name}"), better, "change")

    def rate(p: str) -> Column:
        return F.when(F.col(f"{p}_loaded") > 0, F.col(f"{p}_answered") / F.col(f"{p}_loaded") * 100)

    rows = F.array(
        plain(1, "issues_created"),
        plain(2, "unique_users"),
        plain(3, "total_messages"),
        plain(4, "active_issues"),
        metric(5, "response_rate", rate("c"), rate("p"), 1, "points"),
        plain(6, "avg_response_time", -1),
        plain(7, "unanswered", -1),
    )
    cur, prev = F.col("current"), F.col("previous")
    points = F.col("kind") == "points"
    delta = F.when(points, F.coalesce(cur - prev, F.lit(0.0))).when(
        prev != 0, (cur - prev) / F.nullif(prev, F.lit(0.0)) * 100
    ).otherwise(F.when(cur > 0, F.lit(1.0)).otherwise(0.0))
    sign = F.when(delta > 0, "+").when(delta < 0, "-").otherwise("")
    from_nothing = ~points & (prev == 0) & (cur > 0)
    good = F.signum(delta) * F.col("better")
    plain_text = F.regexp_replace(cur.cast("decimal(38,9)").cast("string"), r"\.?0+$", "")
    return (
        one.select(F.inline(rows))
        .select(
            "ord",
            "metric",
            "current",
            "previous",
            F.when(from_nothing, F.concat(F.lit("+"), plain_text))
            .otherwise(F.concat(sign, whole_text(delta), F.lit("%")))
            .alias("value"),
            F.when(delta > 0, "up").when(delta < 0, "down").otherwise("neutral").alias("direction"),
            F.when(good > 0, "success").when(good < 0, "error").otherwise("neutral").alias("status"),
        )
    )
