"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Every rule is a column that is true where a text fails. Cost and selectivity of the rules are
measured on a bounded sample; the rules then run as one CASE expression, the one with the most
rejections per second first, so that later rules are evaluated only on what is left. The order
changes the time, never the verdict.

Defined cases: a very long text is judged whole, within its row. A null text counts as no words, fails the base rule and is not kept; an empty text
likewise. Repeated rows and repeated ids are judged row by row. Other columns pass through,
except that those named like a result are replaced; working columns take names the table does not
have. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_SPACE, fresh, let, word_list

WINDOW = 5
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "base_failed", "failed_rule", "kept",
)
SYMBOLS = "[#*$%&|<>]+"
SAMPLE_ROWS = 2_000
# Frequent words of the languages at hand; a text without any of them is hardly prose.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "with", "for", "on",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "que", "qui", "pour",
    "el", "los", "las", "y", "una", "por", "con",
    "der", "die", "das", "und", "den", "mit", "von", "zu", "ein", "ist",
)


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    max_repeat_percent: int = 20       # words in repeated windows
    max_symbol_percent: int = 10       # symbols per word
    min_mean_word: float = 2.0
    max_mean_word: float = 20.0
    max_dup_line_percent: int = 50
    max_stutter_percent: int = 30      # words equal to the word before
    max_bare_word_percent: int = 20    # words without a letter
    min_stop_words: int = 1
    max_ellipsis_percent: int = 30     # lines that end in an ellipsis
    max_bullet_percent: int = 90       # lines that begin with a bullet


def repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the row's own text.

    Windows are sorted by hash inside the row, equal neighbours are repeats, and the union of
    their spans is counted; the work is n log n in the words of a text and needs no shuffle.
    """
    def windows(h):
        return F.when(F.size(h) >= WINDOW, F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.struct(
                F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))))

    def starts(s):
        again = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"])
                         | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p):
        spans = F.transform(p, lambda x, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    total = let(hashes, lambda h: let(windows(h), lambda s: let(starts(s), covered)))
    return F.coalesce(total, F.lit(0).cast("long"))


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words."""
    docs = docs.drop(*RESULTS)
    w, lines = fresh(docs, "_words", "_lines")
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(w, word_list(t)).withColumn(lines, F.filter(
        F.split(t, "\n", -1), lambda x: x.rlike(NO_SPACE)))
    return df.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(w)).alias("n_repeat_words"),
    ).drop(w, lines)


def rules(limits: Limits = Limits(), text: str = "text") -> dict[str, Column]:
    """The rules after the base rule, by name; true where a text fails."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines = word_list(t), F.split(t, "\n", -1)
    n, n_lines = F.col("n_words"), F.col("n_lines")

    def share(array: Column, test) -> Column:
        return F.size(F.filter(array, test))

    return {
        "symbols": F.col("n_symbols") * 100 > n * limits.max_symbol_percent,
        "word_length": (F.col("word_chars") < n * limits.min_mean_word)
        | (F.col("word_chars") > n * limits.max_mean_word),
        "dup_lines": F.col("n_dup_lines") * 100 > n_lines * limits.max_dup_line_percent,
        "bare_words": share(words, lambda x: ~x.rlike(r"\p{L}")) * 100
        > n * limits.max_bare_word_percent,
        "stop_words": share(words, lambda x: F.lower(x).isin(*STOP_WORDS))
        < limits.min_stop_words,
        "stutter": let(words, lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))) * 100
        > n * limits.max_stutter_percent,
        "ellipsis": share(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$")) * 100
        > n_lines * limits.max_ellipsis_percent,
        "bullets": share(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]")) * 100
        > n_lines * limits.max_bullet_percent,
    }


def base_failed(limits: Limits = Limits()) -> Column:
    return (F.col("n_words") < limits.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent)


def measure_rules(
    sample: DataFrame, checks: dict[str, Column], limits: Limits = Limits()
) -> dict[str, tuple[float, float]]:
    """Seconds and share of rejections of each rule over the sample, which has the base measures."""
    rows = sample.where(~base_failed(limits))
    try:
        counts = rows.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(c).alias(k) for k, c in checks.items()]).head()

        def seconds(cond: Column) -> float:
            best = float("inf")
            for _ in range(2):
                start = time.perf_counter()
                rows.agg(F.count_if(cond)).collect()
                best = min(best, time.perf_counter() - start)
            return best

        idle = seconds(F.col("n_words") < 0)
        return {
            k: (max(seconds(c) - idle, 1e-4), counts[k] / max(counts["n"], 1))
            for k, c in checks.items()
        }
    finally:
        sample.unpersist()


def order_rules(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Most rejections per second first; ties by name."""
    return sorted(measured, key=lambda k: (-measured[k][1] / measured[k][0], k))


def quality_cascade(
    docs: DataFrame,
    text: str = "text",
    limits: Limits = Limits(),
    sample_rows: int = SAMPLE_ROWS,
    order: list[str] | None = None,
) -> DataFrame:
    """Add the base measures, ``base_failed``, ``failed_rule`` and ``kept``.

    The rules are timed on a random sample of about ``sample_rows`` rows, which are drawn where they
    are read, without a shuffle. The sample only sets the order.
    ``failed_rule`` is the first rule of the order that rejects a text.
    """
    checks = rules(limits, text)
    if order is None:
        share = min(1.0, sample_rows / max(docs.count(), 1))
        part = docs.select(text).sample(share, seed=7)
        order = order_rules(measure_rules(base_measures(part, text).persist(), checks, limits))
    df = base_measures(docs, text).withColumn("base_failed", base_failed(limits))
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        cascade = cascade.when(checks[name], F.lit(name))
    return df.withColumn("failed_rule", cascade).withColumn("kept", F.col("failed_rule").isNull())
