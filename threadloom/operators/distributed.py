"""Order statistics and running positions that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# Values are first counted per block of this width, then only inside the block
# that holds the wanted rank. Both steps see at most about a million rows per
# group for millisecond durations of up to 35 years.
_BLOCK = 1 << 20


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows ``_c`` of each value ``_v`` of an integer column, per group; nulls are left out."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("bigint").alias("_v"))
    return counted.agg(F.count(F.lit(1)).alias("_c"))


def values_at_ranks(counted: DataFrame, keys: Sequence[str], ranks: Mapping[str, Column]) -> DataFrame:
    """Exact values at 0-based ascending ranks per group, from ``value_counts``.

    ``ranks`` maps a name to an expression over ``n``, the number of values of the
    group. Returns one row per (keys, name) with ``value``.
    """
    keys = list(keys)
    block = F.floor(F.col("_v") / F.lit(_BLOCK)).alias("_b")
    per_group = Window.partitionBy(*keys)
    upto = per_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        counted.groupBy(*keys, block)
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_hi", F.sum("_bc").over(upto))
        .withColumn("n", F.sum("_bc").over(per_group))
    )
    wanted = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()]
        )
    )
    hits = (
        blocks.select(*keys, "_b", "_hi", (F.col("_hi") - F.col("_bc")).alias("_lo"), wanted.alias("_w"))
        .filter((F.col("_w.rank") >= F.col("_lo")) & (F.col("_w.rank") < F.col("_hi")))
        .select(*[F.col(k).alias(f"_{k}") for k in keys], "_b", "_lo", "_w.name", "_w.rank")
    )
    # Null-safe equality keeps groups with a null key. It also adds no filters to
    # ``counted``, so that both its uses share one shuffle.
    same = F.floor(F.col("_v") / F.lit(_BLOCK)).eqNullSafe(F.col("_b"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = counted.join(hits, same)
    running = (
        Window.partitionBy(*keys, "name")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        inside.withColumn("_upto", F.col("_lo") + F.sum("_c").over(running))
        .filter(F.col("_upto") > F.col("rank"))
        .groupBy(*keys, "name")
        .agg(F.min("_v").alias("value"))
    )


def middle_of_counts(counted: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Mean of the two middle values (equal when the count is odd), from ``value_counts``."""
    n = F.col("n")
    found = values_at_ranks(counted, keys, {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)})
    return found.groupBy(*keys).agg((F.sum("value") / F.lit(2.0)).alias(out))


def upper_of_counts(counted: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Value at 0-based position floor(n/2), from ``value_counts``."""
    found = values_at_ranks(counted, keys, {"upper": F.floor(F.col("n") / 2)})
    return found.select(*keys, F.col("value").alias(out))


def interpolated_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return middle_of_counts(value_counts(df, keys, value), keys, out)


def upper_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return upper_of_counts(value_counts(df, keys, value), keys, out)


def _slots(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort globally and note each row's partition and place in it.

    The result is checkpointed: the place must not change when a lost task
    runs again, and it is read twice below.
    """
    placed = df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    return placed.withColumn("_part", F.shiftright("_slot", 33)).checkpoint()


def positions(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "position"
) -> DataFrame:
    """0-based place of each row within its group; a group may have any size."""
    group = list(group)
    slots = _slots(df, [*[F.col(g) for g in group], *order])
    runs = slots.groupBy(*group, "_part").agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        slots.join(runs.drop("_n"), [*group, "_part"])
        .withColumn(out, F.col("_slot") - F.col("_first") + F.col("_before"))
        .drop("_slot", "_part", "_first", "_before")
    )


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Inclusive running total of ``value`` over the whole ordered table."""
    slots = _slots(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort partition, so both the window and the broadcast stay small.
    parts = slots.groupBy("_part").agg(F.sum(value).alias("_sum"))
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = (
        Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        slots.join(F.broadcast(parts), "_part")
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_slot", "_part", "_before")
    )


def first_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First n rows per group with their 1-based rank.

    Spark cuts each group to n rows before the shuffle (WindowGroupLimit), so a
    large group costs no more than a small one.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def ranked_top(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top n rows of a table with their 1-based rank; only n rows reach the window."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, never to be broadcast by a join: one that grows with the input, whatever size Spark takes it for."""
    return df.hint("merge")


def lookup_by_key(
    facts: DataFrame, dim: DataFrame, key: str, weight: str, total: int, heavy_share: int = 1000
) -> DataFrame:
    """Inner join of ``facts`` to one row per key, safe when a key has most facts.

    ``weight`` is the number of facts of the key and ``total`` at least their
    sum. Keys with more than total/heavy_share facts number fewer than
    ``heavy_share``, so those rows of ``dim`` are broadcast and their facts stay
    where they are. All others are joined by shuffle.
    """
    cut_off = total // heavy_share
    heavy = F.broadcast(dim.filter(F.col(weight) > cut_off).drop(weight))
    rest = dim.filter(F.col(weight) <= cut_off).drop(weight)
    heavy_part = facts.join(heavy, key)
    light_part = facts.join(F.broadcast(heavy.select(key)), key, "left_anti").join(by_shuffle(rest), key)
    return heavy_part.unionByName(light_part)


def checkpoint_with(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """Checkpoint a table and return totals over it, taken in the same pass."""
    seen = Observation()
    kept = df.observe(seen, *[c.alias(name) for name, c in measures.items()]).checkpoint()
    return kept, seen.get
