"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fresh, let, without
from threadloom.operators.distributed import positions

# 13 hexadecimal digits of an MD5 hash, 52 bits, are exact in a double.
_DIGITS = 13


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone."""
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary"))
    whole = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint")
    return (whole + F.lit(0.5)) / F.lit(float(16**_DIGITS))


def costs(key: Column, weights: Sequence[float]) -> Column:
    """One (cost, shard) pair per shard; the smallest cost takes the record.

    The cost is ``-ln(draw) / weight``: an exponential variable whose rate is the
    weight, so a shard wins in proportion to its weight, and a new or heavier
    shard changes no other shard's cost.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    rates = F.array(*[F.lit(float(w)) for w in weights])
    return let(
        F.coalesce(key.cast("string"), F.lit("")),
        lambda k: F.transform(
            F.sequence(F.lit(0), F.lit(len(weights) - 1)),
            lambda s: F.struct((-F.log(draw(k, s)) / rates[s]).alias("cost"), s.alias("shard")),
        ),
    )


def assign(
    df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] = (),
    shard: str = "shard", grown_shard: str = "grown_shard",
) -> DataFrame:
    """Add the shard of every record, and with ``grown`` (weights of further
    shards) the shard it would have after they joined.

    Only the key counts: equal keys always share a shard, whatever else the rows
    hold. A null key counts as the empty string. Equal costs, which take a hash
    collision, go to the smaller shard number. Columns of the same names as the
    new ones are replaced.
    """
    n = len(weights)
    both = let(
        costs(F.col(f"`{key}`"), [*weights, *grown]),
        lambda c: F.struct(
            F.array_min(F.slice(c, 1, n)).shard.cast("int").alias("now"),
            F.array_min(c).shard.cast("int").alias("then"),
        ),
    )
    name = fresh(df, "_both")
    new = {shard: F.col(f"{name}.now")} | ({grown_shard: F.col(f"{name}.then")} if grown else {})
    kept = without(df.withColumn(name, both), [shard, grown_shard])
    return kept.withColumns(new).drop(name)


def slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Number the records of each shard from 0, without gaps, in the given order.

    A shard may hold any share of the rows: the numbers come from one global sort
    and per-partition counts. Rows that tie follow their reading order.
    """
    numbered = without(df, [out]).withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`") for c in [*order, "_row"]]
    return positions(numbered, [shard], keys, out).drop("_row")


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float] = (),
    key: str = "doc_id", text: str = "text", overhead: int = 16,
) -> DataFrame:
    """Shard, slot and size of every document; the text itself is not shuffled.

    Returns ``key``, ``size`` (UTF-8 bytes of the text plus ``overhead``; a null
    text has no bytes), ``text_crc32`` (of the same bytes, 0 for none), ``shard``,
    ``grown_shard`` (null without ``grown``) and ``slot``. Repeated rows are
    separate records of one shard. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key),
        (F.octet_length(body) + overhead).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = assign(slim, key, weights, grown)
    if not grown:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    return slots(placed, "shard", [key, "text_crc32", "size"])
