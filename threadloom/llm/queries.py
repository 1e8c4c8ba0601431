"""Registered queries of the package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import (
    bpe,
    curves,
    decontam,
    langid,
    neardup,
    periodic,
    quality,
    quotes,
    sharding,
    substring,
    url_filter,
    warc,
    whitening,
)
from threadloom.llm.common import let, words
from threadloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}

N_SHARDS = 40
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _queries[fn.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> dict[str, Query]:
    return dict(_queries)


@_query
def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 40 shards of equal weight, and the shard each has with one more."""
    docs = _table(spark, sf_dir, "documents")
    placed = sharding.shard_documents(docs, [1.0] * N_SHARDS, grown=[1.0])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@_query
def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by the fixed rules, else by boosted trees."""
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "blocked_score")


@_query
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality.judge_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "lost_share", "kept",
    )


@_query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, and digests of its ids and of what they decode to."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _table(spark, sf_dir, "documents")
    tokens = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    hashed = tokens.withColumn("ids_sha256", F.sha2("token_ids", 256))
    decoded = bpe.decode(hashed, vocabulary)
    return decoded.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query
def op10_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, by 4-word shingles and similarity 0.8."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), neardup.Similarity(shingle_words=4))


@_query
def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents less their repeated 13-word windows, as a digest of the kept words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring.remove_repeats(docs)
    line = F.array_join(words(F.col("text")), " ")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(line, 256).alias("kept_sha256"))


@_query
def op7_size_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found inside documents, by 5-word shingles and containment 0.8."""
    found = decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


@_query
def op8_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; a quarter of the documents is held out of training."""
    docs = _table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model)


ARCHIVE_BYTES = 16 << 20


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica, hashed from its own bytes at the places of the first.

    Some bodies and some urls are altered, some records lost, some written once more
    one byte on.
    """
    n, html, url = F.col("page_id"), F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    body = F.when(F.pmod(n, F.lit(97)) == 5, F.concat(F.lit("x"), F.substr(html, F.lit(2)))).otherwise(html)
    target = F.when(F.pmod(n, F.lit(89)) == 3, F.concat(url, F.lit("#"))).otherwise(url)
    held = warc.layout(pages, ARCHIVE_BYTES, held=warc.record_text(target, body))
    more = F.when(F.pmod("record_id", F.lit(103)) == 9, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = held.filter(F.coalesce(F.pmod("record_id", F.lit(101)) != 7, F.lit(True)))
    return kept.withColumn("_on", F.explode(more)).withColumn("offset", F.col("offset") + F.col("_on")).drop("_on")


@_query
def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a damaged replica of the crawl's archives differs from the first."""
    pages = _table(spark, sf_dir, "pages")
    return warc.audit(warc.layout(pages, ARCHIVE_BYTES).checkpoint(), damaged(pages).checkpoint())


def mail(turns: DataFrame) -> DataFrame:
    """The conversations as mail: a turn quotes the one before it, and what that one quoted.

    Every fifth turn answers the one before the last instead. Turns quote by turns the
    whole message, its longest line only (a line of one word can be anybody's), or all
    of it with the answer's first line after its first line.
    """
    step = F.when((F.col("turn") % 5 == 4) & (F.col("turn") > 1), 2).otherwise(1)
    now = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") - step).alias("to"))
    back = turns.select("conv_id", F.col("turn").alias("to"), F.col("text").alias("first"), (F.col("turn") - 1).alias("older"))
    last = turns.select("conv_id", F.col("turn").alias("older"), F.col("text").alias("second"))
    joined = now.join(back, ["conv_id", "to"], "left").join(last, ["conv_id", "older"], "left")

    def marked(lines: Column, mark: str) -> Column:
        return F.transform(lines, lambda x: F.concat(F.lit(mark), x))

    def lines_of(name: str) -> Column:
        return F.split(F.col(name), "\n", -1)

    def longest(lines: Column) -> Column:
        return F.array(F.array_max(F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), x.alias("line")))).line)

    def rest(lines: Column) -> Column:
        return F.slice(lines, F.lit(2), F.size(lines))

    none = F.array().cast("array<string>")
    own, first, second = lines_of("text"), lines_of("first"), lines_of("second")
    inner, one = F.coalesce(marked(second, ">> "), none), F.slice(own, 1, 1)
    whole = F.concat(inner, marked(first, "> "), F.array(F.lit("")), own)
    part = F.concat(F.coalesce(marked(longest(second), ">> "), none), marked(longest(first), "> "), own)
    between = F.concat(inner, marked(F.slice(first, 1, 1), "> "), one, marked(rest(first), "> "), rest(own))
    kind = F.pmod("turn", F.lit(3))
    lines = F.when(kind == 0, whole).when(kind == 1, part).otherwise(between)
    return joined.select("conv_id", "turn", F.array_join(F.coalesce(lines, own), "\n").alias("text"))


@_query
def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from the quotes of their messages."""
    found = quotes.conversations(mail(_table(spark, sf_dir, "conversations")))
    return found.select(
        "conv_id", "turn", "root", "parent", "depth", "position", F.sha2("own_text", 256).alias("own_sha256")
    )


@_query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's coordinates on the first eight whitened components."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the hash of their id, gets a periodic end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def bounds(w: Column) -> Column:
        g = F.floor(h / 10)
        start = F.pmod(g, F.size(w))
        return F.struct(start.alias("start"), (1 + F.floor((F.size(w) - start) / (3 + g % 8))).alias("period"))

    def repeated(w: Column, b: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 1)
        return F.transform(at, lambda i: F.get(w, F.when(i < b.start, i).otherwise(b.start + (i - b.start) % b.period).cast("int")))

    def whole(w: Column) -> Column:
        return F.when(F.size(w) > 0, let(bounds(w), lambda b: F.array_join(repeated(w, b), " ")))

    changed = F.when(h % 10 == 0, let(words(F.col("text")), whole))
    return docs.select("doc_id", F.coalesce(changed, F.col("text")).alias("text"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, some of which get a periodic end first."""
    found = periodic.find_runs(planted(_table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("n"), r.start.alias("s"), r.period.alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    longest = found.select("*", best.alias("best"))
    return longest.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.n")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-1000 * F.col("best.n") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@_query
def op13_hilbert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest embeddings of every twentieth one."""
    return curves.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
