"""Benchmark decontamination: short test items inside long documents.

An item of n shingles that has the share t of them in a document misses at most
(1 - t) n, so of any floor((1 - t) n) + 1 of its shingles at least one is there.
Items are partitioned by size, each partition takes that many shingles of its
largest possible item as a MinHash sketch (those of smallest hash), and documents
are searched for sketch shingles. Candidates are verified on all shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fresh, let, shingle_hashes

# More sketch shingles than this are joined by shuffle instead of broadcast.
MAX_BROADCAST = 500_000


# Scripts written without spaces: every character is a word.
UNSPACED = "([\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}])"


def plain_words(text: Column) -> Column:
    """Words of letters and digits, lower-cased; everything else separates.

    Characters of scripts without spaces are words of their own.
    """
    cut = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNSPACED, " $1 ")
    spaced = F.regexp_replace(cut, "[^\\p{L}\\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _distinct_shingles(text: Column, size: int) -> Column:
    return F.array_distinct(shingle_hashes(plain_words(text), size))


def items_of(benchmark: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """Item id, its distinct shingles and their number. Items of fewer than ``size``
    words are searched by ``short_items``; those without an id are left out."""
    counted = benchmark.select(F.col(f"`{item}`").alias("item_id"), plain_words(F.col(f"`{text}`")).alias("_w"))
    counted = counted.filter(F.col("item_id").isNotNull() & (F.size("_w") >= size))
    sets = counted.select("item_id", F.array_distinct(shingle_hashes(F.col("_w"), size)).alias("shingles"))
    return sets.distinct().withColumn("n_shingles", F.size("shingles").cast("bigint"))


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(shingle, item_id): the sketch of every item, as long as its size partition needs."""
    # Partition p holds the sizes from 2**p to 2**(p + 1) - 1.
    largest = F.pow(2.0, F.floor(F.log2("n_shingles")) + 1) - 1
    needed = (F.floor(largest * (100 - percent) / 100) + 1).cast("int")
    ranked = F.sort_array(
        F.transform("shingles", lambda s: F.struct(F.xxhash64(F.lit("sketch"), s).alias("rank"), s.alias("shingle")))
    )
    chosen = F.slice(ranked, F.lit(1), needed)
    return items.select("item_id", F.explode(chosen).alias("_s")).select("item_id", F.col("_s.shingle").alias("shingle"))


def short_items(slim: DataFrame, benchmark: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """(doc_key, item_id) of the items of fewer than ``size`` words, found as exact runs of their own length."""
    items = benchmark.select(F.col(f"`{item}`").alias("item_id"), plain_words(F.col(f"`{text}`")).alias("_w"))
    items = items.filter(F.col("item_id").isNotNull() & F.size("_w").between(1, size - 1))

    def runs(w: Column, n: int) -> Column:
        return F.transform(shingle_hashes(w, n), lambda h: F.xxhash64(F.lit(n), h))

    by_size = F.coalesce(*[F.when(F.size("_w") == n, runs(F.col("_w"), n)[0]) for n in range(1, size)])
    items = items.select("item_id", F.size("_w").alias("_n"), by_size.alias("run")).distinct().checkpoint()
    lengths = sorted(r["_n"] for r in items.select("_n").distinct().collect())
    if not lengths:
        return slim.select("doc_key").crossJoin(items.select("item_id").limit(0))
    near = F.broadcast if items.count() <= MAX_BROADCAST else (lambda df: df)
    held = let(plain_words(F.col("_text")), lambda w: F.array_distinct(F.concat(*[runs(w, n) for n in lengths])))
    found = slim.select("doc_key", F.explode(held).alias("run")).join(near(items), "run")
    return found.select("doc_key", "item_id").distinct()


def contained_items(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", item: str = "item_id",
    text: str = "text", item_text: str = "text",
) -> DataFrame:
    """(key, item, n_shingles, n_shared) of every item with ``percent`` of its shingles in a document.

    Shingles are ``size`` words, compared without case and punctuation; whole texts
    are searched. An item of fewer words is one shingle, its words in a row. No such pair is
    missed. Null and empty texts contain nothing, and no item, document or table that is empty gives a pair. Rows
    with a null key are left out, repeated rows count once. Other columns play no part, whatever their names. Rows that share a
    key or an item id but not the text are judged each, and the best one counts.
    """
    items = items_of(benchmark, size, item, item_text).checkpoint()
    sketch = sketches(items, percent).distinct().checkpoint()
    small = sketch.count() <= MAX_BROADCAST
    near = F.broadcast if small else (lambda df: df)
    slim = docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").alias("_text"))
    slim = slim.filter(F.col("doc_key").isNotNull() & F.col("_text").isNotNull())
    runs = slim.select("doc_key", F.explode(shingle_hashes(plain_words(F.col("_text")), size)).alias("shingle"))
    candidates = runs.join(near(sketch), "shingle").select("doc_key", "item_id").distinct().checkpoint()
    whole = near(items)
    compared = slim.join(candidates, "doc_key").join(whole, "item_id")
    shared = let(
        _distinct_shingles(F.col("_text"), size), lambda mine: F.size(F.array_intersect(mine, F.col("shingles")))
    ).cast("bigint")
    one = F.lit(1).cast("bigint")
    short = (
        short_items(slim, benchmark, size, item, item_text)
        .select("doc_key", "item_id", one.alias("n_shingles"), one.alias("n_shared"))
        if size > 1
        else None
    )
    judged = compared.select("doc_key", "item_id", F.col("n_shingles"), shared.alias("n_shared"))
    judged = judged.unionByName(short) if short is not None else judged
    return (
        judged.filter(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
        .groupBy(F.col("doc_key").alias(key), F.col("item_id").alias(item))
        .agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("r"), "n_shared", "n_shingles")).alias("_b"))
        .select(key, item, F.col("_b.n_shingles").alias("n_shingles"), F.col("_b.n_shared").alias("n_shared"))
    )


def without_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents in which no item is found; rows with a null key stay."""
    one = fresh(docs, "_found")
    found = contained_items(docs, benchmark, key=key, **options).select(F.col(key).alias(one)).distinct()
    return docs.join(found, F.col(f"`{key}`") == F.col(one), "left_anti")
