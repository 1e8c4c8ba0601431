"""Sentiment results and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.constants import SENTIMENT_ORDER
from threadloom.operators.distributed import first_n


def merge_sentiment(issues: DataFrame, results: DataFrame) -> DataFrame:
    """Overwrite sentiment columns where a result (id, sentiment, score, summary) exists."""
    fresh = results.select(
        "id",
        F.struct(
            F.col("sentiment"),
            F.col("score").alias("sentiment_score"),
            F.col("summary").alias("sentiment_summary"),
        ).alias("_r"),
    )
    columns = ["sentiment", "sentiment_score", "sentiment_summary"]
    hit = F.col("_r").isNotNull()
    return (
        issues.join(fresh, "id", "left")
        .withColumns({c: F.when(hit, F.col(f"_r.{c}")).otherwise(F.col(c)) for c in columns})
        .drop("_r")
    )


def sentiment_groups(issues: DataFrame, shown: int = 8) -> DataFrame:
    """Count and first issues per sentiment; anything unrecognised counts as unknown."""
    known = F.col("sentiment").isin(*SENTIMENT_ORDER)
    grouped = issues.select(
        F.when(known, F.col("sentiment")).otherwise("unknown").alias("sentiment"), "id", "created_at"
    )
    counts = grouped.groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"))
    heads = (
        first_n(grouped, ["sentiment"], [F.desc("created_at"), F.asc("id")], shown)
        .groupBy("sentiment")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("s"))
    )
    place = F.array_position(F.array(*map(F.lit, SENTIMENT_ORDER)), F.col("sentiment"))
    return counts.join(heads, "sentiment").select(
        place.cast("int").alias("ord"), "sentiment", "count", F.col("s.id").alias("issue_ids")
    )
