"""Composable issue filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import contains_any


@dataclass(frozen=True)
class Theme:
    """What a theme filter needs to know about a theme (both lists are short)."""

    keywords: Sequence[str]
    sample_issue_ids: Sequence[str] = ()


@dataclass(frozen=True)
class IssueFilter:
    """All set dimensions must hold; an unset or empty one lets everything pass."""

    query: str = ""
    tag_ids: Sequence[str] = ()
    archived: bool | str | None = None
    statuses: Sequence[str] = ()
    sentiments: Sequence[str] = ()
    has_replies: bool | str | None = None
    min_message_count: int | None = None
    has_attachment: bool | None = None
    duplicates_only: bool = False
    date_from: date | str | None = None
    date_to: date | str | None = None
    theme: str | None = None
    themes: Mapping[str, Theme] | None = None


# Choices of the filter bar and the tri-state they stand for.
_CHOICES = {"all": None, "active": False, "archived": True, "any": None, "has": True, "none": False}


def _tri_state(value: bool | str | None) -> bool | None:
    return _CHOICES[value] if isinstance(value, str) else value


def _issue_text(*columns: str) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    spaced = [p for part in parts for p in (F.lit(" "), part)][1:]
    return F.lower(F.concat(*spaced))


def searched_text() -> Column:
    """What the text query looks at, in lower case."""
    return _issue_text("name", "owner_username", "owner_global_name", "first_message_content")


def _known(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("unknown"))


def predicates(spec: IssueFilter) -> list[Column]:
    """One condition per dimension that is set."""
    found: list[Column] = []
    archived = _tri_state(spec.archived)
    if archived is not None:
        found.append(F.coalesce(F.col("archived"), F.lit(False)) == archived)
    if spec.tag_ids:
        found.append(F.arrays_overlap("applied_tags", F.array(*map(F.lit, spec.tag_ids))))
    if spec.statuses:
        found.append(_known("resolution_status").isin(*spec.statuses))
    if spec.sentiments:
        found.append(_known("sentiment").isin(*spec.sentiments))
    has_replies = _tri_state(spec.has_replies)
    if has_replies is not None:
        count = F.col("reply_count")
        found.append(F.col("replies_loaded") & ((count > 0) if has_replies else (count == 0)))
    if spec.min_message_count is not None:
        found.append(F.coalesce("message_count", F.lit(0)) >= spec.min_message_count)
    if spec.has_attachment is not None:
        found.append(F.coalesce(F.col("has_attachment"), F.lit(False)) == spec.has_attachment)
    if spec.duplicates_only:
        found.append(F.col("duplicate_cluster_id") != "")
    undated = F.col("created_at").isNull()
    if spec.date_from:
        found.append(undated | (F.col("created_at") >= F.lit(str(spec.date_from)).cast("timestamp")))
    if spec.date_to:
        next_day = F.date_add(F.lit(str(spec.date_to)).cast("date"), 1).cast("timestamp")
        found.append(undated | (F.col("created_at") < next_day))
    theme = (spec.themes or {}).get(spec.theme or "")
    if theme is not None:
        hit = contains_any(_issue_text("name", "first_message_content"), theme.keywords)
        found.append(F.col("id").isin(*theme.sample_issue_ids) | hit)
    wanted = spec.query.strip().lower()
    if wanted:
        found.append(searched_text().contains(wanted))
    return found


def filter_issues(issues: DataFrame, spec: IssueFilter) -> DataFrame:
    return issues.filter(reduce(lambda a, b: a & b, predicates(spec), F.lit(True)))


def unclustered_issues(issues: DataFrame, limit: int | None = None) -> DataFrame:
    """Issues without a cluster, oldest first."""
    todo = issues.filter(F.col("duplicate_cluster_id").isNull()).orderBy("created_at", "id")
    return todo if limit is None else todo.limit(limit)
