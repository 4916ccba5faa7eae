"""Quality rules: a table of thresholds compiled into one projection.

Each rule bounds a measure of one text. ``measured`` adds the measures, ``judged`` compiles
the table into one boolean. No user function runs: every measure is a column expression.

Words are runs of characters other than space and U+0009 to U+000D. A null text counts as
empty. Texts that are empty or have no words have zero for all measures and fail the base
rule; repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions.binding import let
from shelfdelta.llm.common import text_or_empty

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is for with that it as on by this are was be at from or an not have which "
    "der die das und ist nicht ein eine mit auf den von zu im für sich dem des auch es "
    "le la les de des et est en un une que qui dans pour pas sur au du il elle par avec "
    "el los las del y es un una que en por con para no se lo al su"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; an absent bound holds always."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 25.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.3),
    Rule("repeat_word_ratio", None, 0.5),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words in ``n``-word windows that the text has twice or more, the first included.

    Windows with their positions are sorted, so equal ones are neighbours; the covered words
    are the union of [i, i + n) over the starts i of such windows.
    """
    def of_words(w: Column) -> Column:
        # The last n - 1 entries lack a word: they are no windows.
        zipped = F.arrays_zip(*[F.slice(w, F.lit(j + 1), F.greatest(F.size(w) - (n - 1), F.lit(0))).alias(f"w{j}") for j in range(n)],
                              F.sequence(F.lit(1), F.size(w) - (n - 1)).alias("at"))
        return let(F.sort_array(zipped), of_windows)

    def of_windows(s: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            out = a["w0"] == b["w0"]
            for j in range(1, n):
                out = out & (a[f"w{j}"] == b[f"w{j}"])
            return F.coalesce(out, F.lit(False))

        pairs = F.arrays_zip(s.alias("c"), F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None))).alias("f"),
                             F.concat(F.array(F.lit(None)), F.slice(s, F.lit(1), F.size(s) - 1)).alias("b"))
        hit = F.filter(pairs, lambda p: same(p["c"], p["f"]) | same(p["c"], p["b"]))
        return let(F.sort_array(F.transform(hit, lambda p: p["c"]["at"])), covered)

    def covered(starts: Column) -> Column:
        gaps = F.arrays_zip(starts.alias("a"), F.slice(starts, 2, F.size(starts)).alias("b"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + F.coalesce(
            F.least(F.lit(n), g["b"] - g["a"]), F.lit(n)).cast("long"))

    return F.when(F.size(words) > n, of_words(words)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text", name: str = "_measure", least_dup_lines: int = 0) -> DataFrame:
    """``docs`` with one struct column ``name``; below ``least_dup_lines`` repeated lines their ratio is 0."""
    body = text_or_empty(text)
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def counts(w: Column, x: Column) -> Column:
        stop = F.filter(w, lambda v: F.lower(v).isin(*STOP_WORDS))
        return let(F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(stop).cast("long").alias("n_stop_words")), with_ratios)

    def with_ratios(m: Column) -> Column:
        def share(a: str, b: str) -> Column:
            return F.when(m[b] > 0, m[a] / m[b]).otherwise(F.lit(0.0))

        dup_line_ratio = share("n_dup_lines", "n_lines")
        if least_dup_lines:
            dup_line_ratio = F.when(m["n_dup_lines"] >= least_dup_lines, dup_line_ratio).otherwise(F.lit(0.0))
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
        return F.struct(*[m[c].alias(c) for c in names], share("word_chars", "n_words").alias("mean_word_chars"),
                        share("n_symbols", "n_words").alias("symbols_per_word"), share("n_stop_words", "n_words").alias("stop_word_ratio"),
                        dup_line_ratio.alias("dup_line_ratio"), share("n_repeat_words", "n_words").alias("repeat_word_ratio"))

    return docs.withColumn(name, let(words_of(body), lambda w: let(lines, lambda x: counts(w, x))))


def passes(rules: tuple[Rule, ...] = RULES, name: str = "_measure") -> Column:
    """The table as one predicate over the measures in ``name``."""
    out = F.lit(True)
    for rule in rules:
        value = F.col(name)[rule.measure]
        if rule.low is not None:
            out = out & (value >= F.lit(rule.low))
        if rule.high is not None:
            out = out & (value <= F.lit(rule.high))
    return out


def base_failed(name: str = "_measure") -> Column:
    m = F.col(name)
    return (m["n_words"] < 50) | (F.lit(100) * m["n_repeat_words"] > F.lit(50) * m["n_words"])


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", least_dup_lines: int = 0) -> DataFrame:
    """The rows that pass the base rule and the table, with their own columns."""
    name = "_measure"
    while name in docs.columns:
        name += "_"
    return measured(docs, text, name, least_dup_lines).where(~base_failed(name) & passes(rules, name)).select(*[F.col(f"`{c}`") for c in docs.columns])
