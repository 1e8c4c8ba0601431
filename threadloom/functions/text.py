"""String, tag and JSON expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.constants import DEFAULT_GUILD_ID, STATUS_LABELS, TAG_NAMES, THREAD_URL_BASE


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def needed_keywords(keywords: Iterable[str], ruled_out: Iterable[str] = ()) -> list[str]:
    """Keywords that can still decide a substring test.

    A keyword that contains another one of the list adds nothing, and one that
    contains a ``ruled_out`` keyword cannot occur in the text.
    """
    words = list(dict.fromkeys(k.lower() for k in keywords if k))
    out = list(ruled_out)
    return [
        w for w in words if not any(o in w for o in out) and not any(o != w and o in w for o in words)
    ]


def contains_any(lowered: Column, keywords: Iterable[str]) -> Column:
    """True when the lower-cased text holds one of the keywords (case-insensitive)."""
    return any_of(lowered.contains(k) for k in needed_keywords(keywords))


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def fold_code(text: Column) -> Column:
    """Replace every fenced code block by a short marker."""
    return F.regexp_replace(text, r"(?s)```.*?```", "[code]")


def tag_name(tag: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TAG_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, tag), F.concat(F.lit("Tag "), F.right(tag, F.lit(4))))


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), F.lit("Unknown"))


def thread_url(thread_id: Column, guild_id: Column | str = DEFAULT_GUILD_ID) -> Column:
    guild = F.lit(guild_id) if isinstance(guild_id, str) else guild_id
    return F.concat_ws("/", F.lit(THREAD_URL_BASE), guild, thread_id)


def tags_from_json(text: Column) -> Column:
    """Tags kept as a JSON string; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def text_words(text: Column) -> Column:
    """Words between blanks, in lower case."""
    return F.filter(F.split(F.lower(text), "[ \\t-\\r]+"), lambda w: w != "")


def slot_of(word: Column, dimension: int) -> Column:
    """Place of a word in a vector of fixed length, from its MD5."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dimension).cast("int")
