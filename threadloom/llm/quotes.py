"""Quotation linking: who answers whom, read from quoted passages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import SPACE_PATTERN, let
from threadloom.operators.distributed import positions

_MARKS = "^[ \\t]*(?:>[ \\t]?)*"  # quote marks at the start of a line
_PARAGRAPH = "\\n[ \\t-\\r]*\\n"
_UNITS = "array<struct<level:int,run:int,paragraph:int,size:string,hash:binary>>"
MAX_ROUNDS = 64  # each round doubles the depth that is resolved


def passages(text: Column) -> Column:
    """Runs of lines of equal quote level, in order: array of struct(level, lines).

    Level 0 is the author's own text. ``> > x``, ``>>x`` and ``>> x`` have level 2.
    Empty lines within a run of own text separate nothing; null text has no runs.
    """

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        level = F.length(marks) - F.length(F.translate(marks, ">", ""))
        body = F.when(level > 0, F.substr(line, F.length(marks) + 1)).otherwise(line)
        return F.struct(level.alias("level"), body.alias("body"))

    def runs(lines: Column) -> Column:
        def begins(i: Column) -> Column:
            return (i == 0) | (F.get(lines, i).level != F.get(lines, i - 1).level)

        at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins)
        return let(
            at,
            lambda s: F.transform(
                s,
                lambda a, i: F.struct(
                    lines[a].level.alias("level"),
                    F.transform(
                        F.slice(lines, a + 1, F.coalesce(F.get(s, i + 1), F.size(lines)) - a), lambda x: x.body
                    ).alias("lines"),
                ),
            ),
        )

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), parsed)
    return let(lines, runs)


def normalised(text: Column) -> Column:
    """One line in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE_PATTERN, " "))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _full(texts: Column) -> Column:
    """The normalised texts that are not empty."""
    return F.filter(F.transform(texts, normalised), lambda t: t != "")


def _paragraphs(lines: Column) -> Column:
    return F.filter(F.split(_joined(lines), _PARAGRAPH, -1), lambda t: normalised(t) != "")


def _unit(level: Column, run: Column, paragraph: Column, size: str, text: Column) -> Column:
    return F.struct(
        level.alias("level"), run.alias("run"), paragraph.alias("paragraph"), F.lit(size).alias("size"),
        _digest(text).alias("hash"),
    )


def _quoted_units(runs: Column, level: Column) -> Column:
    """What is quoted at one level: all of it, its runs, their paragraphs and lines.

    A part that is the whole of the next larger one is left out.
    """
    none = F.lit(-1)

    def of_run(lines: Column, i: Column) -> Column:
        def of_paragraphs(paragraphs: Column) -> Column:
            single = F.transform(paragraphs, lambda t, p: _unit(level, i, p, "paragraph", normalised(t)))
            lines_of = F.transform(
                paragraphs,
                lambda t, p: let(
                    _full(F.split(t, "\n", -1)),
                    lambda x: F.when(F.size(x) > 1, F.transform(x, lambda y: _unit(level, i, p, "line", y))).otherwise(
                        F.array().cast(_UNITS)
                    ),
                ),
            )
            whole = F.array(_unit(level, i, none, "run", normalised(_joined(lines))))
            return (
                F.when(F.size(paragraphs) == 0, F.array().cast(_UNITS))
                .when(F.size(paragraphs) == 1, F.concat(whole, F.flatten(lines_of)))
                .otherwise(F.concat(whole, single, F.flatten(lines_of)))
            )

        return let(_paragraphs(lines), of_paragraphs)

    def of(mine: Column) -> Column:
        every = F.array(_unit(level, none, none, "all", normalised(_joined(F.flatten(F.transform(mine, lambda r: r.lines))))))
        parts = F.flatten(F.transform(mine, lambda r, i: of_run(r.lines, i)))
        return F.when(F.size(mine) > 1, F.concat(every, parts)).otherwise(parts)

    return let(F.filter(runs, lambda r: r.level == level), of)


def parse(messages: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys``, ``own_text``, ``own_hashes`` and ``quoted`` of every message.

    ``own_hashes`` are of the whole own text, its single runs, paragraphs and lines.
    ``quoted`` has the level, place, size and hash of what is quoted at each level:
    all of it, runs, paragraphs and lines. Empty passages have none.
    """

    def of(runs: Column) -> Column:
        own = F.filter(runs, lambda r: r.level == 0)
        levels = F.filter(F.array_distinct(F.transform(runs, lambda r: r.level)), lambda v: v > 0)

        def parts(lines: Column) -> Column:
            texts = F.concat(
                F.array(_joined(lines)), F.transform(own, lambda r: _joined(r.lines)),
                F.flatten(F.transform(own, lambda r: _paragraphs(r.lines))), lines,
            )
            return F.struct(
                F.regexp_replace(_joined(lines), "^(?:[ \\t\\r]*\\n)+|\\s+$", "").alias("own_text"),
                F.transform(F.array_distinct(_full(texts)), _digest).alias("own_hashes"),
                F.flatten(F.transform(levels, lambda v: _quoted_units(runs, v))).alias("quoted"),
            )

        return let(F.flatten(F.transform(own, lambda r: r.lines)), parts)

    parsed = messages.select(*[F.col(k) for k in keys], let(passages(F.col(text)), of).alias("_p"))
    return parsed.select(*keys, "_p.own_text", "_p.own_hashes", "_p.quoted")


def link(parsed: DataFrame, scope: str, order: str) -> DataFrame:
    """(scope, order, parent): the message that each message quotes.

    A passage belongs to the earliest message of the scope that wrote it, so a
    hash has one row however many messages repeat it. Paragraphs are looked at where
    their run is not found, lines where their paragraph is not. Of several messages
    quoted at level 1 the latest is answered; deeper levels count, the lowest first,
    where level 1 finds none. A message is never linked to itself or a later one.
    """
    wrote = (
        parsed.select(scope, order, F.explode("own_hashes").alias("hash"))
        .groupBy(scope, "hash")
        .agg(F.min(order).alias("parent"))
    )
    quoted = parsed.select(scope, order, F.explode("quoted").alias("_q")).select(scope, order, "_q.*")
    found = quoted.join(wrote, [scope, "hash"]).filter(F.col("parent") < F.col(order))

    def latest(size: str) -> Column:
        return F.max(F.when(F.col("size") == size, F.col("parent")))

    paragraphs = found.groupBy(scope, order, "level", "run", "paragraph").agg(
        latest("all").alias("all"), latest("run").alias("whole"),
        F.coalesce(latest("paragraph"), latest("line")).alias("part"),
    )
    runs = paragraphs.groupBy(scope, order, "level", "run").agg(
        F.max("all").alias("all"), F.coalesce(F.max("whole"), F.max("part")).alias("part")
    )
    levels = runs.groupBy(scope, order, "level").agg(F.coalesce(F.max("all"), F.max("part")).alias("parent"))
    return levels.groupBy(scope, order).agg(F.min_by("parent", "level").alias("parent"))


def roots(links: DataFrame, scope: str, order: str) -> DataFrame:
    """(scope, order, root, depth) of every linked message, by doubling the jumps.

    A message whose root is found takes no further part but as a step of others.
    """
    now = links.select(
        scope, order, F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth"), F.lit(True).alias("open")
    ).checkpoint()
    for _ in range(MAX_ROUNDS):
        ahead = now.select(
            scope, F.col(order).alias("root"), F.col("root").alias("_next"), F.col("depth").alias("_more"),
            F.col("open").alias("_open"),
        )
        moved = now.filter("open").join(ahead, [scope, "root"], "left").select(
            scope, order, F.coalesce("_next", "root").alias("root"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.coalesce("_open", F.lit(False)).alias("open"),
        )
        now = now.filter("not open").unionByName(moved).checkpoint()
        if now.filter("open").isEmpty():
            return now.drop("open")
    raise RuntimeError(f"no roots after {MAX_ROUNDS} rounds")


def conversations(messages: DataFrame, scope: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Reply-ordered conversations without quotes.

    Messages are rows of (scope, order, text): quotes are looked up within a scope
    (a mailbox or a given conversation), ``order`` is the time order in it. Returns
    ``scope``, ``order``, ``root`` and ``parent`` (orders of the first and of the
    answered message; parent null at the root), ``depth``, ``position`` (0, 1, ...
    in the conversation, a reply after what it answers) and ``own_text``.

    Null scopes are one scope. Rows with a null order come before all others of
    their scope, link to nothing and are conversations of their own. Rows that
    repeat a (scope, order) share parent, root and depth and have neighbouring
    positions. A null text is an empty one.
    """
    base = messages.select(F.col(f"`{scope}`").alias("_scope"), F.col(f"`{order}`").cast("bigint").alias("_order"), F.col(f"`{text}`").alias("_text"))
    # A struct never is null, so null scopes join each other.
    base = base.withColumn("_scope", F.struct("_scope"))
    parsed = parse(base, ["_scope", "_order"], "_text").checkpoint()
    links = link(parsed.filter(F.col("_order").isNotNull()), "_scope", "_order").checkpoint()
    tree = links.join(roots(links, "_scope", "_order"), ["_scope", "_order"])
    found = parsed.select("_scope", "_order", "own_text").join(tree, ["_scope", "_order"], "left")
    found = found.select(
        "_scope", "_order", F.coalesce("root", "_order").alias("root"), "parent",
        F.coalesce("depth", F.lit(0)).alias("depth"), "own_text",
    )
    placed = positions(
        found.withColumn("_row", F.monotonically_increasing_id()).withColumn("root", F.coalesce("root", F.lit(-(1 << 62)))),
        ["_scope", "root"], [F.col("_order"), F.col("_row")],
    )
    return placed.select(
        F.col("_scope._scope").alias(scope), F.col("_order").alias(order), F.nullif("root", F.lit(-(1 << 62))).alias("root"),
        "parent", "depth", "position", "own_text",
    )
