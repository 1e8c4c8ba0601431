"""URL filter: fixed rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, let, without

Rule = tuple[str, str, str]  # host, path, verdict
MAX_RULES = 1000
MAX_BROADCAST = 100_000  # more suffixes than this are joined by shuffle
FOLDS = 8
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
LEXICAL = (
    "url_chars host_chars path_chars path_depth host_labels digit_share hyphens entropy parameters encoded"
).split()
FEATURES = [*LEXICAL, "suffix_blocked", "suffix_seen"]


def split_url(url: Column) -> Column:
    """Struct of ``host`` (A-Z lower-cased) and ``path``; both empty without ``://`` or for null."""
    text = F.coalesce(url, F.lit(""))
    return F.struct(
        ascii_lower(F.regexp_extract(text, _PARTS, 1)).alias("host"),
        F.regexp_extract(text, _PARTS, 2).alias("path"),
    )


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict), or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of equally long rules the last in text order wins. At most ``MAX_RULES``
    rules, as each is compared with each url.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.array(
        *[
            F.struct(
                F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"),
                F.lit(h).alias("host"), F.lit(f".{h}").alias("below"), F.lit(p).alias("path"),
            )
            for h, p, v in rules
        ]
    )
    fits = F.filter(
        table, lambda r: ((host == r.host) | host.endswith(r.below)) & path.startswith(r.path)
    )
    return F.array_max(F.transform(fits, lambda r: F.struct(r.size, r.rule, r.verdict)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for empty text."""

    def of(chars: Column) -> Column:
        n = F.size(chars)
        shares = F.transform(
            F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        )
        return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(F.split(text, ""), of))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The lexical features by name. A null url counts as an empty one."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, "(?s)\\?([^#]*)", 1)
    parameters = F.when(query == "", F.lit(0)).otherwise(1 + _count(query, "&"))
    values = {
        "url_chars": F.length(text),
        "host_chars": F.length(host),
        "path_chars": F.length(path),
        "path_depth": _count(path, "/"),
        "host_labels": F.when(host == "", F.lit(0)).otherwise(1 + _count(host, ".")),
        "digit_share": _share(_count(text, "0123456789"), F.length(text)),
        "hyphens": _count(host, "-"),
        "entropy": entropy(host),
        "parameters": parameters,
        "encoded": _count(text, "%"),
    }
    return {name: value.cast("double") for name, value in values.items()}


def suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host, ".", -1)


@dataclass(frozen=True)
class Suffixes:
    """Labelled and blocked urls of every suffix, in all and by fold."""

    table: DataFrame
    small: bool
    prior: float
    smoothing: float


@dataclass(frozen=True)
class UrlModel:
    """Boosted trees with the suffix statistics that two of their features need."""

    trees: GBTClassificationModel | None
    suffixes: Suffixes
    prior: float


def train(
    labelled: DataFrame, max_rows: int = 20_000, min_suffix: int = 20, rounds: int = 20, depth: int = 4,
    smoothing: float = 20.0, seed: int = 7,
) -> UrlModel:
    """Fit the trees on labelled urls (url, blocked 0/1).

    The trees use ``max_rows`` different urls at most, those of smallest hash. Suffix
    statistics, the smoothed share of blocked urls and the number of urls, come
    from all different labelled urls, for suffixes with ``min_suffix`` of them. Null
    urls and labels are left out. With one class or no row there are no trees and
    every url scores the prior.
    """
    rows = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    distinct = rows.groupBy("url").agg(F.max(F.col("blocked").cast("double")).alias("blocked"))
    distinct = distinct.withColumn("_u", split_url(F.col("url")))
    distinct = distinct.select("url", "blocked", F.col("_u.host").alias("host"), F.col("_u.path").alias("path")).checkpoint()
    folds = (
        distinct.groupBy(suffix(F.col("host")).alias("_suffix"), _fold(F.col("url")).alias("fold"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b"))
        .groupBy("_suffix")
        .agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "b")))).alias("_folds"))
        .checkpoint()
    )
    n, blocked = folds.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0.0))).first()
    prior = blocked / n if n else 0.0
    seen = folds.filter(F.col("_n") >= min_suffix).checkpoint()
    suffixes = Suffixes(seen, seen.count() <= MAX_BROADCAST, prior, smoothing)
    sample = distinct.orderBy(F.xxhash64("url"), "url").limit(max_rows).withColumn("labelled", F.lit(True))
    parts = sample.repartition(4, "url").checkpoint()
    found = {r.blocked for r in parts.select("blocked").distinct().collect()}
    if len(found) < 2:
        return UrlModel(None, suffixes, prior)
    learner = GBTClassifier(
        labelCol="blocked", featuresCol="_features", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.2
    )
    return UrlModel(learner.fit(_vectors(parts, suffixes)), suffixes, prior)


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def _vectors(df: DataFrame, suffixes: Suffixes) -> DataFrame:
    """Add the feature vector; needs url, host, path and labelled.

    A labelled url takes the statistics of its suffix without its own fold, so its
    label is not in them. Leaving out the url alone would give the label away: the
    blocked urls of a suffix would all have one share and the others another.
    """
    full = df.withColumns({f"_{k}": v for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()})
    table = F.broadcast(suffixes.table) if suffixes.small else suffixes.table
    full = full.join(table, suffix(F.col("host")) == F.col("_suffix"), "left")
    own = F.when(F.col("labelled"), F.col("_folds")[_fold(F.col("url"))])
    left = F.col("_n") - F.coalesce(own.n, F.lit(0))
    share = (F.col("_b") - F.coalesce(own.b, F.lit(0.0)) + suffixes.smoothing * suffixes.prior) / (left + suffixes.smoothing)
    full = full.withColumns(
        {
            "_suffix_blocked": F.coalesce(share, F.lit(suffixes.prior)),
            "_suffix_seen": F.coalesce(F.log1p(left.cast("double")), F.lit(0.0)),
        }
    ).drop("_n", "_b", "_folds")
    names = [f"_{f}" for f in FEATURES]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(full).drop("_suffix", *names)


def score(df: DataFrame, model: UrlModel, out: str = "blocked_score") -> DataFrame:
    """Add the probability that a url is blocked; needs url, host, path and labelled."""
    if model.trees is None:
        return df.withColumn(out, F.lit(model.prior))
    scored = model.trees.transform(_vectors(df, model.suffixes))
    scored = scored.withColumn(out, vector_to_array("probability")[1])
    return scored.drop("_features", "rawPrediction", "probability", "prediction")


def with_rules(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Host, path and fitting rule of every page, by the given rules."""
    base = without(pages, ["host", "path", "rule", "rule_verdict", "_u", "_m"])
    split = base.withColumn("_u", split_url(F.col(url)))
    split = split.withColumns({"host": F.col("_u.host"), "path": F.col("_u.path")}).drop("_u")
    matched = split.withColumn("_m", match_rule(F.col("host"), F.col("path"), rules))
    return matched.withColumns(
        {"rule": F.col("_m.rule"), "rule_verdict": F.col("_m.verdict")}
    ).drop("_m")


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, threshold: float = 0.5,
    page: str = "page_id", url: str = "url", **training: float,
) -> DataFrame:
    """Verdict of every page's url: the fitting rule's, else the trees'.

    ``labelled`` holds urls with ``blocked`` 0/1; without it the pages that a rule
    decides are the labels. Returns ``page``, ``url``, ``host``, ``path``, ``rule``,
    ``blocked_score`` (of the trees, for every row) and ``verdict``. A null url
    fits no rule and is scored as an empty one. Repeated rows stay.
    """
    ruled = with_rules(pages.select(F.col(page), F.col(url).alias("url")), rules)
    if labelled is None:
        labelled = ruled.filter(F.col("rule").isNotNull()).select(
            "url", (F.col("rule_verdict") == "block").cast("int").alias("blocked")
        )
        ruled = ruled.withColumn("labelled", F.col("rule").isNotNull())
    else:
        known = labelled.filter(F.col("blocked").isNotNull()).select("url").distinct().withColumn("labelled", F.lit(True))
        ruled = ruled.join(known, "url", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    scored = score(ruled, train(labelled, **training))
    by_model = F.when(F.col("blocked_score") > threshold, "block").otherwise("allow")
    return scored.select(
        page, "url", "host", "path", "rule", "blocked_score",
        F.coalesce("rule_verdict", by_model).alias("verdict"),
    )
