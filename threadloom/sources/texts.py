"""Long texts that many rows share: rows carry references, each text moves and is stored once.

A text of more than ``LONG`` bytes is replaced by "sha256:" and its digest. That is longer
than any text that stays as it is, so a value tells by its length which of both it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 64  # bytes; a reference has 71


def reference(text: Column) -> Column:
    """The text itself if it is short (or null), else what stands for it."""
    return F.when(F.octet_length(text) > LONG, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def referenced_messages(pages: DataFrame) -> DataFrame:
    """Pages whose first messages hold references to their texts."""
    light = F.transform("first_messages", lambda m: m.withField("content", reference(m["content"])))
    return pages.withColumn("first_messages", light)


def message_texts(pages: DataFrame) -> DataFrame:
    """The texts of the first messages of pages, as (text), each once for a page."""
    contents = F.transform("first_messages", lambda m: m["content"])
    return pages.select(F.explode(F.array_distinct(contents)).alias("text"))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(ref, text) of the different long texts of ``text``; copies in a task are put together before they move."""
    found = texts.select("text").filter(F.octet_length("text") > LONG).select(reference(F.col("text")).alias("ref"), "text")
    # By reference, as is the join with them, so they move once.
    return found.groupBy("ref").agg(F.first("text").alias("text"))


def with_texts(rows: DataFrame, texts: DataFrame, column: str, spread: str = "id") -> DataFrame:
    """Rows with the texts (ref, text) that ``column`` refers to.

    Rows move with their references, and short ones, which find no text, by ``spread``.
    """
    value = F.col(column)
    alone = F.concat(F.lit("-"), F.xxhash64(spread).cast("string"))
    keyed = rows.withColumn("_ref", F.when(F.octet_length(value) > LONG, value).otherwise(alone))
    found = keyed.join(texts.select(F.col("ref").alias("_ref"), F.col("text").alias("_text")), "_ref", "left")
    return found.withColumn(column, F.coalesce("_text", value)).select(*rows.columns)
