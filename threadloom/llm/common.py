"""Column expressions and table helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six characters that separate words, and A-Z with a-z.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_PATTERN = "[ \\t-\\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas.

    A plain column reference may be replaced by its expression, which a lambda
    would then evaluate again for every element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of characters other than the six spaces; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def shingle_hashes(tokens: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, repeats included.

    Fewer words than ``size`` count as one shingle, no words as none.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(0), n - size)
        runs = F.transform(at, lambda i: F.xxhash64(*[w[i + j] for j in range(size)]))
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(n >= size, runs).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, of)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be new in ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add (names match as Spark matches them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
