"""Line-first cleaning: judge lines, remove those that fail, then judge the document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import SPACES, fresh, let, without, words

# Fixed values.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "›", "•", "·", ">", "/")
# Sentence-terminal marks of all scripts (Unicode's STerm), and the ellipsis, as code points.
_MARKS = """
    2E 21 3F 2026 3002 FF01 FF1F 589 61D-61F 6D4 700-702 7F9 837 839 83D 83E 964 965
    104A 104B 1362 1367 1368 166E 1735 1736 17D4 17D5 1803 1809 1944 1945 1AA8-1AAB
    1B5A 1B5B 1B5E 1B5F 1C3B 1C3C 1C7E 1C7F 203C 203D 2047-2049 2E2E 2E3C A4FF A60E A60F
    A6F3 A6F7 A876 A877 A8CE A8CF A92F A9C8 A9C9 AA5D-AA5F AAF0 AAF1 ABEB FF0E FF61
    10A56 10A57 10F55-10F59 11047 11048 110BE-110C1 11141-11143 111C5 111C6
    111CD 111DE 111DF 11238 11239 1123B 1123C 112A9 1144B 1144C 115C2 115C3
    115C9-115D7 11641 11642 1173C-1173E 16A6E 16A6F 16AF5 16B37 16B38 16B44
    16E98 1BC9F 1DA88
"""
_RANGES = [[int(c, 16) for c in part.split("-")] for part in _MARKS.split()]
SENTENCE_MARKS = "".join(chr(c) for r in _RANGES for c in range(r[0], r[-1] + 1))
# Thai, Lao and Tibetan prose has no such marks: lines that end in these scripts.
UNMARKED = "[\\p{IsThai}\\p{IsLao}\\p{IsTibetan}][^\\p{L}]*\\z"
# The end of a sentence, where "." stands for all marks.
SENTENCE_END = "\\.[\"'\\)\\]\\u00BB\\u201C\\u201D\\u2019]*([ \\t\\r]|\\z)"
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "lorem ipsum",
    "click here to",
    "skip to content",
    "sign up for our newsletter",
    "subscribe to our",
    "powered by wordpress",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document verdict."""

    unpunctuated_words: int = 8  # a line of so many words needs the end of a sentence
    separator_share: float = 0.2  # navigation: separators among the words of a line
    symbol_share: float = 0.5  # symbols for each word of a line
    repeat_words: int = 8  # a line of so many words is judged for repetition
    distinct_share: float = 0.3  # and needs this share of different words
    boilerplate_words: int = 40  # longer lines may mention the phrases
    max_lost: float = 0.4  # a document may lose this share of its word characters
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(tokens: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more, first ones included."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, covered))

    def covered(h: Column) -> Column:
        none = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(none, F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), union)
        )

    def union(p: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(p, i - 1).h == x.h).otherwise(False)
            after = F.when(i < F.size(p) - 1, F.get(p, i + 1).h == x.h).otherwise(False)
            return before | after

        starts = F.sort_array(F.transform(F.filter(p, twice), lambda x: x.i))
        return let(starts, lengths)

    def lengths(s: Column) -> Column:
        # Each window adds the words up to the next window's start, three at most.
        new = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    return let(tokens, of).cast("bigint")


def ends_sentence(line: Column) -> Column:
    """Whether a line ends a sentence somewhere, or has a script that does not mark it."""
    # A class of all marks would be tried at every character, and few lines need more than ".".
    marked = F.translate(line, SENTENCE_MARKS, "." * len(SENTENCE_MARKS))
    return line.rlike(SENTENCE_END) | marked.rlike(SENTENCE_END) | line.rlike(UNMARKED)


def line_fails(line: Column, rules: LineRules) -> Column:
    """Why a line fails: punctuation, navigation, symbols, repetition or boilerplate; null if it stays."""

    def judge(line: Column, w: Column) -> Column:
        n = F.size(w)
        separators = F.size(F.filter(w, lambda x: x.isin(*SEPARATORS)))
        symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
        phrases = "|".join(BOILERPLATE)
        return (
            F.when(n == 0, F.lit(None).cast("string"))
            .when((separators >= 2) & (separators >= rules.separator_share * n), "navigation")
            .when((symbols >= 3) & (symbols >= rules.symbol_share * n), "symbols")
            .when((n >= rules.repeat_words) & (F.size(F.array_distinct(w)) < rules.distinct_share * n), "repetition")
            .when((n < rules.boilerplate_words) & F.lower(line).rlike(phrases), "boilerplate")
            .when((n >= rules.unpunctuated_words) & ~ends_sentence(line), "punctuation")
        )

    return let(line, lambda x: let(words(x), lambda w: judge(x, w)))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("bigint")


def verdicts(text: Column, rules: LineRules = LineRules()) -> Column:
    """Struct of the counts, the cleaned text and the verdict of one text."""

    def counts(t: Column, w: Column, lines: Column) -> list[Column]:
        full = F.filter(lines, lambda x: F.translate(x, SPACES, "") != "")
        return [
            F.size(w).cast("bigint").alias("n_words"),
            word_chars(t).alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ]

    def verdict(b: Column, cleaned: Column) -> Column:
        failed = (b.n_words < rules.min_words) | (100 * b.n_repeat_words > rules.max_repeat_percent * b.n_words)
        lost = F.when(b.word_chars == 0, F.lit(0.0)).otherwise(1 - word_chars(cleaned) / b.word_chars)
        return let(
            lost,
            lambda share: F.struct(
                b.n_words.alias("n_words"), b.word_chars.alias("word_chars"), b.n_symbols.alias("n_symbols"),
                b.n_dup_lines.alias("n_dup_lines"), b.n_repeat_words.alias("n_repeat_words"),
                failed.alias("base_failed"), share.alias("lost_share"), cleaned.alias("cleaned_text"),
                (~failed & (share <= rules.max_lost)).alias("kept"),
            ),
        )

    def whole(t: Column) -> Column:
        # With the limit -1 empty lines at the end stay, so joining gives the text back.
        return let(
            F.split(t, "\n", -1),
            lambda lines: let(
                F.array_join(F.filter(lines, lambda x: line_fails(x, rules).isNull()), "\n"),
                lambda cleaned: let(
                    let(words(t), lambda w: F.struct(*counts(t, w, lines))), lambda b: verdict(b, cleaned)
                ),
            ),
        )

    return let(F.coalesce(text, F.lit("")), whole)


def judge_documents(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Add the counts, ``base_failed``, ``lost_share``, ``cleaned_text`` and ``kept``.

    Counts are over the whole original text. A null or empty text has no words
    and fails the base rules. Empty lines always stay. Repeated rows get equal
    verdicts. Columns of the same names are replaced; all others are kept. The
    work is one pass without a shuffle.
    """
    names = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed lost_share cleaned_text kept"
    ).split()
    one = fresh(docs, "_v")
    judged = docs.withColumn(one, verdicts(F.col(text), rules))
    rest = [F.col(f"`{c}`") for c in without(docs, names).columns]
    return judged.select(*rest, *[F.col(f"{one}.{n}").alias(n) for n in names])


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The documents that stay, with the failing lines removed from their text.

    Same columns as the input; ``n_chars``, if there, is the new length. The
    verdict is taken once: rejected rows disappear in the generator.
    """
    passed = F.filter(F.array(verdicts(F.col(text), rules)), lambda v: v.kept)
    one = fresh(docs, "_v")
    rows = docs.select("*", F.explode(passed).alias(one))
    new = {text: F.col(f"{one}.cleaned_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(f"{one}.cleaned_text").cast("bigint")
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
