"""Removal of repeated runs of lines by winnowing over line hashes.

1. Lines are trimmed; blank ones are left alone and do not count. From every line on, the shortest
   run that has ``run`` lines or ``words`` words is a window; the line with its smallest hash, the last of
   equals, is selected. Only the distinct selected places become rows, each with the hashes of
   the lines around it. Equal windows select equal lines, so two texts that share a run that is long
   enough share a print.
2. Places are joined on their prints; those whose print stands nowhere else end here.
3. The others are extended both ways, line by line, to the runs around them that are long enough, and
   each run is compared with its earliest place by content. Runs that overlap or touch
   make up the longer match.

Rule: a line goes if it lies in consecutive lines that also occur at an earlier place, in the order of
id, text mark and line number, and that are ``run`` lines or have ``words`` words together. The first
occurrence of a run therefore always stays.

Defined cases: a null text stays null, an empty one stays empty; a text with fewer lines than
``run`` and fewer words than ``words`` is never changed. A very long text is one row when it is cut
into lines, and one row per selected line from then on; the lines to delete come back as one list per text.
Null ids come first in the order. Rows that share id and text are one place and get the same
result, so a repeated row does not delete the other. Rows keep all their columns; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_SPACE, fresh, let, stored, text_mark

RUN = 3
WORDS = 50
SALTS = 16    # tasks that a very common line or run is spread over


def _words(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda total, x: total + x["words"])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN, words: int = WORDS,
) -> DataFrame:
    """One row per selected line: ``id, mark, at, print, near, mid``.

    ``at`` is its number among the lines that are not blank, ``near`` the lines at most ``run - 1`` away as
    (two hashes, words, number in the text), and ``mid`` its place in ``near``.
    """
    trimmed = F.transform(F.split(F.col(text), "\n", -1),
                          lambda x, i: F.struct(F.btrim(x, F.lit(" \t\r")).alias("line"), i.alias("n")))
    lines = F.transform(F.filter(trimmed, lambda x: x["line"] != ""), lambda x: F.struct(
        F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("h2"),
        F.regexp_count(x["line"], F.lit(f"{NO_SPACE}+")).alias("words"), x["n"].alias("n")))

    def select(full, i):
        window = F.slice(full, i + 1, run)
        total, reach = F.lit(0), F.when(F.lit(False), F.lit(0))
        for k in range(1, run):
            total = total + F.coalesce(F.get(window, F.lit(k - 1))["words"], F.lit(0))
            reach = reach.when(total >= words, k)
        reach = reach.when((F.size(window) == run) | (_words(window) >= words), F.size(window))
        low = F.array_min(F.transform(F.slice(window, 1, reach), lambda x, k: F.struct(x["h"], (-k).alias("k"))))
        return i - low["k"]

    def around(full, p):
        first = F.greatest(p - (run - 1), F.lit(0))
        return F.struct(p.alias("at"), F.get(full, p)["h"].alias("print"),
                        F.slice(full, first + 1, p - first + run).alias("near"), (p - first).alias("mid"))

    def selected(full):
        chosen = F.transform(F.sequence(F.lit(0), F.size(full) - 1), lambda i: select(full, i))
        return F.transform(F.array_distinct(F.filter(chosen, lambda p: p.isNotNull())), lambda p: around(full, p))

    rows = let(lines, lambda full: F.when(F.size(full) > 0, selected(full)))
    return docs.select(F.col(id_col).alias("id"), text_mark(F.col(text)).alias("mark"),
                       F.explode(rows).alias("w")).select("id", "mark", "w.*")


def _spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "mark", "at"), F.lit(SALTS)).cast("int"))


def _copies(keys: DataFrame) -> DataFrame:
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def matched_places(prints: DataFrame) -> DataFrame:
    """The selected places whose print stands at another place too."""
    shared = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    return _spread(prints).join(_copies(shared), ["print", "salt"], "left_semi").drop("salt")


def extended_runs(places: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """Every run of at most ``run`` lines around a place that is long enough: ``id, mark, at, wide, wide2, lines``."""
    def reach(size, left):
        first = F.col("mid") - left
        part = F.slice("near", F.greatest(first, F.lit(0)) + 1, size)
        enough = (first >= 0) & (F.size(part) == size)
        if size < run:
            enough &= _words(part) >= words
        h, h2 = F.transform(part, lambda x: x["h"]), F.transform(part, lambda x: x["h2"])
        return F.when(enough, F.struct(
            (F.col("at") - left).alias("at"), F.xxhash64(h, h2).alias("wide"), F.hash(h2, h).alias("wide2"),
            F.transform(part, lambda x: x["n"]).alias("lines")))

    runs = F.array(*[reach(size, left) for size in range(1, run + 1) for left in range(size)])
    return places.select("id", "mark", F.explode(F.filter(runs, lambda x: x.isNotNull())).alias("w")).select("id", "mark", "w.*")


def repeated_lines(runs: DataFrame) -> DataFrame:
    """Per text the sorted numbers of the lines to delete: ``id, mark, gone``."""
    place = F.struct("id", "mark", "at")
    first = (
        runs.groupBy("wide", "wide2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last").drop("last")
    )
    later = _spread(runs).join(_copies(first), ["wide", "wide2", "salt"]).where(place > F.col("first"))
    return (
        later.groupBy("id", "mark")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("gone"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN,
    words: int = WORDS, removed: str | None = None,
) -> DataFrame:
    """Delete later repeated runs from ``text``; ``removed`` names a column for the deleted numbers."""
    prints = stored(fingerprints(docs, id_col, text, run, words), "line_prints")
    gone = repeated_lines(stored(extended_runs(matched_places(prints), run, words), "line_runs"))
    i, m, g, d = fresh(docs, "_id", "_mark", "_gone", "_key")
    gone = gone.select(F.col("id").alias(i), F.col("mark").alias(m), F.col("gone").alias(g))
    joined = docs.withColumn(d, text_mark(F.col(text))).join(
        gone, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(d) == F.col(m)), "left")
    def without(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g))
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")

    short = let(F.split(F.col(text), "\n", -1), without)
    out = joined.withColumn(text, F.when(F.col(g).isNull(), F.col(text)).otherwise(short))
    if removed:
        out = out.withColumn(removed, F.coalesce(F.col(g), F.array().cast("array<int>")))
    return out.drop(i, m, g, d)
