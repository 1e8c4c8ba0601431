"""Per-issue notes: versioned writes and last-write-wins merge."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.time import now_literal


def note_merge_lww(local: DataFrame, remote: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The newer copy of each note; on a tie the local one stays."""
    both = local.withColumn("origin", F.lit("local")).unionByName(
        remote.withColumn("origin", F.lit("remote"))
    )
    row = F.struct(*both.columns)
    newest = F.max_by(row, F.struct(F.col("updated_at"), F.col("origin") == "local"))
    return both.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")


def note_write(notes: DataFrame, edits: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """Store edits (issue_id, user_id, user_name, content), one per issue and user.

    An existing note keeps its id and gets the next version, a new one starts at 1.
    """
    keys = ["issue_id", "user_id"]
    edit = edits.select(*keys, F.struct("user_name", "content").alias("_e"))
    hit = F.col("_e").isNotNull()
    stamp = now_literal(now)
    fields = {f.name: f.dataType for f in notes.schema.fields}
    kept = notes.join(edit, keys, "left").select(
        *[
            {
                "user_name": F.when(hit, F.col("_e.user_name")).otherwise(F.col("user_name")),
                "content": F.when(hit, F.col("_e.content")).otherwise(F.col("content")),
                "version": F.when(hit, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")),
                "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
                "deleted_at": F.when(~hit, F.col("deleted_at")),
            }
            .get(c, F.col(c))
            .cast(fields[c])
            .alias(c)
            for c in notes.columns
        ]
    )
    new = edits.join(notes.select(*keys), keys, "left_anti").select(
        # Same edit, same id: a repeated task must not make a second note.
        F.sha2(F.concat_ws("/", *keys), 256).alias("id"),
        *keys,
        "user_name",
        "content",
        F.lit(1).cast("bigint").alias("version"),
        stamp.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return kept.unionByName(new.select(*notes.columns))
