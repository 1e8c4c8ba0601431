"""Keyword themes, and themes read from model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.constants import OTHER_THEME, THEME_RULES
from threadloom.functions.text import blank_to_null, contains_any, cut, needed_keywords
from threadloom.functions.time import half_up
from threadloom.operators.distributed import first_n, positions
from threadloom.schemas import COMPLETION

Rules = Sequence[tuple[str, list[str], str]]
SAMPLES = 5


def issue_themes(issues: DataFrame, rules: Rules = THEME_RULES) -> DataFrame:
    """(id, created_at, theme_no): position of the first matching rule, or the rule count."""
    lowered = issues.select(
        "id",
        "created_at",
        F.lower(
            F.concat(
                F.coalesce("name", F.lit("")),
                F.lit(" "),
                F.coalesce("first_message_content", F.lit("")),
            )
        ).alias("_text"),
    )
    tests: list[list[str]] = []
    for _, keywords, _ in rules:
        # A later rule is only tried on texts without any earlier keyword.
        tests.append(needed_keywords(keywords, [k for words in tests for k in words]))
    number = F.lit(len(rules))
    for i, keywords in reversed(list(enumerate(tests))):
        number = F.when(contains_any(F.col("_text"), keywords), i).otherwise(number)
    return lowered.select("id", "created_at", number.alias("theme_no"))


def keyword_themes(
    issues: DataFrame, rules: Rules = THEME_RULES, channel_id: str | None = None
) -> DataFrame:
    """Themes with count and newest sample ids, largest first and Other last."""
    # Read twice; the texts should be searched once.
    themed = issue_themes(issues, rules).checkpoint()
    return summarize_themes(themed, rules, channel_id)


def summarize_themes(
    themed: DataFrame, rules: Rules = THEME_RULES, channel_id: str | None = None
) -> DataFrame:
    """Theme rows from ``issue_themes`` output (possibly kept as a table)."""
    counts = themed.groupBy("theme_no").agg(F.count(F.lit(1)).alias("count"))
    samples = (
        first_n(themed, ["theme_no"], [F.desc("created_at"), F.asc("id")], SAMPLES)
        .groupBy("theme_no")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("s"))
    )
    named = [(i, *rule) for i, rule in enumerate([*rules, OTHER_THEME])]
    table = themed.sparkSession.createDataFrame(
        named, "theme_no int, theme string, keywords array<string>, description string"
    )
    out = (
        counts.join(samples, "theme_no")
        .join(F.broadcast(table), "theme_no")  # one row per rule
        .select(
            F.concat(F.lit("theme-"), F.col("theme_no").cast("string")).alias("id"),
            "theme",
            "description",
            "keywords",
            F.col("count").cast("int").alias("count"),
            F.col("s.id").alias("sample_issue_ids"),
            F.lit("fallback").alias("method"),
            F.lit(channel_id).cast("string").alias("channel_id"),
            "theme_no",
        )
    )
    last = F.col("theme_no") == len(rules)
    return out.orderBy(last, F.desc("count"), "theme_no").drop("theme_no")


def theme_share(themes: DataFrame, total: DataFrame) -> DataFrame:
    """Share of all issues in percent, and bar length relative to the largest theme.

    ``total`` is a one-row, one-column count of the issues.
    """
    biggest = F.max("count").over(Window.partitionBy())  # one row per theme
    whole = total.scalar()
    count = F.col("count")
    return themes.select(
        "theme",
        "count",
        F.when(whole > 0, half_up(count / whole * 100)).otherwise(0).alias("pct"),
        (count / F.greatest(biggest, F.lit(1)) * 100).alias("bar"),
    )


def theme_prompt_rows(issues: DataFrame, n: int = 120) -> DataFrame:
    """The newest n issues, numbered from 0, cut to what a prompt can hold."""
    newest = [F.desc("created_at"), F.asc("id")]
    content = blank_to_null(F.col("first_message_content"))
    return (
        issues.orderBy(*newest)
        .limit(n)
        .select(
            (F.row_number().over(Window.orderBy(*newest)) - 1).alias("idx"),
            F.col("id").alias("issue_id"),
            cut(F.col("name"), 140).alias("title"),
            cut(F.coalesce(content, F.col("name")), 280).alias("excerpt"),
        )
    )


def numbered_issues(issues: DataFrame) -> DataFrame:
    """(idx, issue_id) of all issues in the order in which prompts number them."""
    newest = [F.desc("created_at"), F.asc("issue_id")]
    rows = issues.select("created_at", F.col("id").alias("issue_id"))
    return positions(rows, [], newest, "idx").select("idx", "issue_id")


def _json_object(answer):
    """The JSON object inside an answer, a code fence around it removed."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    has_fence = answer.rlike(r"(?s)```.*?```")
    body = F.when(has_fence, fenced).otherwise(answer)
    return blank_to_null(F.regexp_extract(body, r"(?s)\{.*\}", 0))


def themes_from_completions(
    completions: DataFrame, numbered: DataFrame, n_issues: DataFrame
) -> DataFrame:
    """Clean themes from model answers.

    ``completions`` has (completion_id, answer), ``numbered`` all issues by number
    (``numbered_issues``; a model may have seen more than the default prompt holds),
    ``n_issues`` is a one-row count. Answers that cannot be read or name no issues
    give no rows: see ``with_fallback``.
    """
    parsed = completions.select(
        "completion_id", F.from_json(_json_object(F.col("answer")), COMPLETION).alias("c")
    )
    themes = (
        parsed.select("completion_id", F.posexplode("c.themes").alias("pos", "t"))
        .filter(F.size("t.issue_idxs") > 0)
        .withColumn("n", n_issues.scalar())
    )
    keyword = F.transform(F.slice(F.coalesce("t.keywords", F.array()), 1, 6), lambda k: cut(k, 40))
    clean = themes.select(
        "completion_id",
        "pos",
        cut(F.coalesce("t.theme", F.lit("Unknown")), 60).alias("theme"),
        cut(F.coalesce("t.description", F.lit("")), 240).alias("description"),
        keyword.alias("keywords"),
        F.size("t.issue_idxs").alias("count"),
        F.slice(
            F.filter("t.issue_idxs", lambda i: (i >= 0) & (i < F.col("n"))), 1, SAMPLES
        ).alias("idxs"),
    )
    ids = (
        clean.select("completion_id", "pos", F.posexplode("idxs").alias("at", "idx"))
        .join(numbered.select("idx", "issue_id"), "idx")
        .groupBy("completion_id", "pos")
        .agg(F.sort_array(F.collect_list(F.struct("at", "issue_id"))).alias("s"))
    )
    return (
        clean.join(ids, ["completion_id", "pos"], "left")
        .select(
            "completion_id",
            "pos",
            "theme",
            "description",
            "keywords",
            "count",
            F.coalesce("s.issue_id", F.array().cast("array<string>")).alias("sample_issue_ids"),
            F.lit("llm").alias("method"),
        )
        .orderBy("completion_id", F.desc("count"), "pos")
    )


def with_fallback(themes: DataFrame, completions: DataFrame, fallback: DataFrame) -> DataFrame:
    """Model themes, or the keyword themes for every completion that gave none.

    ``fallback`` holds at most one row per rule.
    """
    columns = ["completion_id", "theme", "description", "keywords", "count", "sample_issue_ids", "method"]
    bare = completions.select("completion_id").join(
        themes.select("completion_id").distinct(), "completion_id", "left_anti"
    )
    list_of = F.collect_list(F.struct(*columns[1:]))
    packed = fallback.agg(list_of.alias("rows")).scalar()
    filled = bare.select("completion_id", F.inline(packed))
    return themes.select(*columns).unionByName(filled.select(*columns))
