"""The server-side KPI bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.metrics import daily_stats, global_metrics
from threadloom.operators.rankings import top_responders_view


_NEEDED = [
    "id", "channel_id", "owner_id", "created_at", "message_count", "archived", "is_answered", "response_time_ms",
    "resolution_status",
]


def metrics_bundle(
    issues: DataFrame, replies: DataFrame, channel_id: str | None = None, n: int = 20
) -> dict[str, DataFrame]:
    """KPIs (missing numbers as 0), daily rows by date, and the top responders."""
    if channel_id is not None:
        issues = issues.filter(F.col("channel_id") == channel_id)
    # All three parts read the issues, whose response times are costly to make.
    issues = issues.select(*_NEEDED).checkpoint()
    return {
        "kpis": global_metrics(issues).fillna(0),
        "daily_stats": daily_stats(issues).orderBy("date", "channel_id"),
        "top_responders": top_responders_view(issues, replies)
        .orderBy(F.desc("reply_count"), "channel_id", "author_id", "author_username", "author_global_name")
        .limit(n),
    }
