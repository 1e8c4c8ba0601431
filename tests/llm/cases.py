"""Small tables with everything that operators have to put up with."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = "kept long, shard string, n_words string, cleaned_text long, _v long, _kept string, _found long, kind string, id string, score string"


def prose(seed: int, n: int) -> str:
    """Sentences of invented words."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 or i == n - 1 else "") for i, w in enumerate(words))


def documents(spark, texts: dict | list):
    rows = list(texts.items()) if isinstance(texts, dict) else texts
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, a shared key, and a very long text."""
    base = prose(1, 80)
    return [
        (1, base), (1, base), (2, base), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (None, base), (None, None),
        (6, "one"), (6, prose(2, 70)), (7, prose(3, 40_000)), (8, "Ünïcödé 漢字 🙂 " + prose(4, 60)),
    ]


def odd_documents(spark):
    """The odd rows, with columns whose names clash."""
    values = ", ".join(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", "))
    return documents(spark, odd_rows()).selectExpr("*", *values.split(", "))


def no_documents(spark):
    return documents(spark, [])
