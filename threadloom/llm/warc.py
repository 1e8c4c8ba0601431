"""Merkle fixity audit of WARC replicas.

Records are hashed, ranges of record offsets are hashed from them, and ranges of
ranges up to one root per archive. Two replicas are compared from the roots
down, entering only branches that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.distributed import running_total

RANGE_BYTES = 1 << 16
FANOUT = 16


def record_text(url: Column, body: Column) -> Column:
    """A WARC response record; null parts count as empty."""
    content = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"), content, F.lit("\r\n\r\n"),
    )


def layout(
    pages: DataFrame, archive_bytes: int, page: str = "page_id", url: str = "url", body: str = "html",
    held: Column | None = None,
) -> DataFrame:
    """Records in page order, end to end in archives of about ``archive_bytes``.

    Returns ``record_id``, ``archive``, ``offset`` (in the archive), ``length`` and
    ``digest`` (SHA-256). An archive holds the records that start in its share of
    the bytes; the offset counts from there. Repeated rows are records of their own.
    Only digests and lengths are shuffled. ``held`` is what a replica holds at the
    place of the record, if that is not the record itself: places come from the
    records, length and digest from the bytes held.
    """
    record = record_text(F.col(url), F.col(body))
    bytes_held = record if held is None else held
    slim = pages.select(
        F.col(page).alias("record_id"), F.octet_length(record).cast("bigint").alias("_step"),
        F.sha2(record, 256).alias("_order"), F.octet_length(bytes_held).cast("bigint").alias("length"),
        F.sha2(bytes_held, 256).alias("digest"),
    ).withColumn("_row", F.monotonically_increasing_id())
    ends = running_total(slim, [F.col("record_id"), F.col("_order"), F.col("_row")], "_step", "_end")
    start = F.col("_end") - F.col("_step")
    archive = F.floor(start / F.lit(archive_bytes)).cast("bigint")
    return ends.select(
        "record_id", archive.alias("archive"), (start - archive * archive_bytes).alias("offset"), "length", "digest"
    )


def _leaves(records: DataFrame) -> DataFrame:
    """One row per place; several records at one place count together, in any order.

    The hash of a place adds up the eight 32-bit words of its records' SHA-256, so
    that no place has to be gathered, and takes the SHA-256 of the sums.
    """
    counted = records.groupBy("archive", "offset", "length", "digest").agg(F.count(F.lit(1)).alias("_copies"))
    counted = counted.withColumn("_hash", F.sha2(F.concat_ws(":", "length", "digest", "_copies"), 256))
    parts = [F.conv(F.substring("_hash", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    placed = counted.groupBy("archive", "offset").agg(
        F.sum("_copies").alias("records"), F.min("digest").alias("digest"),
        *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(parts)],
    )
    place_hash = F.sha2(F.concat_ws(":", "records", *[f"_s{i}" for i in range(8)]), 256)
    return placed.select("archive", "offset", "records", "digest", place_hash.alias("hash"))


@dataclass(frozen=True)
class Tree:
    """Levels of nodes, from ranges of offsets to the roots, and the leaves below them."""

    leaves: DataFrame
    levels: list[DataFrame]
    range_bytes: int
    fanout: int


def build_tree(records: DataFrame, height: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> Tree:
    """Hash tree over records (archive, offset, length, digest).

    A lowest node is the SHA-256 of the places in a range of offsets with their
    hashes, in order of offset: at most ``range_bytes`` places, however many records
    there are. A node above hashes the digests of its ``fanout`` children in order.
    Records without archive or offset share one place, in a range of their own.
    ``height`` must be the same for replicas.
    """
    # Places without a number sort before all others.
    known = records.withColumns({"archive": F.coalesce("archive", F.lit(-1)), "offset": F.coalesce("offset", F.lit(-1))})
    leaves = _leaves(known).checkpoint()

    node = F.floor(F.col("offset") / F.lit(range_bytes)).alias("node")
    places = F.array_sort(F.collect_list(F.struct("offset", "hash")))
    line = F.array_join(F.transform(places, lambda p: F.concat_ws(":", p.offset, p.hash)), "|")
    low = leaves.groupBy("archive", node).agg(F.sum("records").alias("records"), F.sha2(line, 256).alias("digest"))
    levels = [low.checkpoint()]
    for _ in range(height):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c.node, c.digest)), "|")
        up = (
            levels[-1].groupBy("archive", F.floor(F.col("node") / F.lit(fanout)).alias("parent"))
            .agg(F.sum("records").alias("records"), F.sha2(joined, 256).alias("digest"))
            .withColumnRenamed("parent", "node")
        )
        levels.append(up.checkpoint())
    return Tree(leaves, levels, range_bytes, fanout)


def height_of(*replicas: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the ranges until each archive has one root (and one for places without a number)."""
    last = max(r.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for r in replicas)
    nodes, height = int(last) // range_bytes + 1, 0
    while nodes > 1:
        nodes, height = -(-nodes // fanout), height + 1
    return height


def _differing(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    left = one.select(*keys, F.struct("records", "digest").alias("a"))
    right = two.select(*keys, F.struct("records", "digest").alias("b"))
    return left.join(right, keys, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def differing_ranges(one: Tree, two: Tree) -> DataFrame:
    """(archive, node) of the lowest ranges whose hashes differ, found from the roots down."""
    suspects = _differing(one.levels[-1], two.levels[-1], ["archive", "node"]).checkpoint()
    for a, b in zip(one.levels[-2::-1], two.levels[-2::-1], strict=True):
        parent = F.floor(F.col("node") / F.lit(one.fanout))

        def below(level: DataFrame, parent: Column = parent, suspects: DataFrame = suspects) -> DataFrame:
            above = suspects.select("archive", F.col("node").alias("_parent"))
            return level.withColumn("_parent", parent).join(above, ["archive", "_parent"], "left_semi")

        suspects = _differing(below(a), below(b), ["archive", "node"]).checkpoint()
    return suspects


def audit(one: DataFrame, two: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Places where replicas differ: ``archive``, ``offset``, ``status`` and the digests.

    ``status`` is ``missing`` (only in the first), ``extra`` (only in the second) or
    ``changed``. Places with several records are compared as wholes, by count and
    contents; the digest shown is their smallest. Equal replicas, and empty ones,
    give no rows. A missing archive or offset is given as -1.
    """
    height = height_of(one, two, range_bytes=range_bytes, fanout=fanout)
    trees = [build_tree(r, height, range_bytes, fanout) for r in (one, two)]
    ranges = differing_ranges(*trees)

    def suspects(tree: Tree, name: str) -> DataFrame:
        node = F.floor(F.col("offset") / F.lit(range_bytes))
        found = tree.leaves.withColumn("node", node).join(ranges, ["archive", "node"], "left_semi")
        return found.select("archive", "offset", F.struct("records", "digest", "hash").alias(name))

    both = suspects(trees[0], "a").join(suspects(trees[1], "b"), ["archive", "offset"], "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        "archive", "offset", status.alias("status"), F.col("a.digest").alias("digest_a"), F.col("b.digest").alias("digest_b")
    )
