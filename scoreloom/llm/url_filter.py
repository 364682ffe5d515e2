"""URL filter: host and path rules first, then a list of canonical URLs behind a Bloom filter.

The list is built into a blocked Bloom filter: a URL picks one block of eight 32-bit words and
sets one bit in each. Blocks are rows, made with a grouped bit-or, so building needs one small
shuffle. The filter is broadcast: it never has more than ``MAX_BLOCKS`` rows, whatever the size of the
list (above that it only lets more through). What passes is joined to the list itself, which
removes the false positives; a URL that is not listed is never blocked.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule, is not
listed and is allowed. Repeated pages are judged row by row. Columns of the pages pass through,
except that those named like a result are replaced. An empty list blocks nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MAX_BLOCKS = 1 << 17
BITS_PER_URL = 16
WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")
RESULTS = ("host", "path", "rule", "listed", "verdict")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    return F.coalesce(
        F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www, m or port, path without a closing slash, query without
    tracking parameters, no scheme and no fragment; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":\d*$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~p.rlike("^(" + "|".join(TRACKING) + ")=")))
    out = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&")))
                   .otherwise(""))
    return F.when(host != "", out)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.text)) if rule is None else rule.when(fits, F.lit(r.text))
        verdict = F.when(fits, F.lit(r.verdict)) if verdict is None else verdict.when(fits, F.lit(r.verdict))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _bits(key: Column) -> list[Column]:
    """One bit in each word of a block, from an independent hash of the URL."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * w).bitwiseAND(F.lit(31)).cast("int")) for w in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: at most ``blocks`` rows of a block number and eight words."""
    marks = listed.select(
        _block(F.col(key), blocks).alias("block"),
        *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])
    return marks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def block_count(n: int) -> int:
    """Enough blocks for ``BITS_PER_URL`` bits a URL, as a power of two, up to the bound."""
    need = max(1, n * BITS_PER_URL // (32 * WORDS))
    return min(MAX_BLOCKS, 1 << (need - 1).bit_length())


def listed_rows(rows: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """Rows whose key is listed: filter by Bloom blocks, then an exact hash join."""
    urls = listed.select(F.col(listed_key).alias("u")).where("u IS NOT NULL").distinct()
    blocks = block_count(urls.count())
    block, *words = fresh(rows, "_block", *[f"_w{i}" for i in range(WORDS)])
    bloom = bloom_blocks(urls, "u", blocks).toDF(block, *words)
    maybe = rows.where(F.col(key).isNotNull()).withColumn(block, _block(F.col(key), blocks)).join(
        F.broadcast(bloom), block)
    for w, bit in zip(words, _bits(F.col(key)), strict=True):
        maybe = maybe.where(F.col(w).bitwiseAND(bit) != 0)
    (u,) = fresh(rows, "_u")
    return maybe.drop(block, *words).join(urls.toDF(u), F.col(key) == F.col(u), "left_semi")


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url: str = "url",
    listed_url: str = "url",
) -> DataFrame:
    """Add host, path, rule, listed and verdict to the pages.

    The list is looked up only for the distinct canonical URLs of pages that no rule decides, so
    a URL that very many pages share costs one row in each join.
    """
    pages = pages.drop(*[c for c in RESULTS if c not in (id_col, url)])
    can, hit = fresh(pages, "_canonical", "_hit")
    known = listed.select(canonical(F.col(listed_url)).alias("canonical"))
    df = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, decided = fitting_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", rule).withColumn(
        can, F.when(F.col("rule").isNull(), canonical(F.col(url))))
    hits = listed_rows(df.select(can).where(F.col(can).isNotNull()).distinct(), can, known, "canonical")
    hits = hits.withColumn(hit, F.lit(True))
    # Pages that a rule decides, or that have no canonical URL, are not looked up: they share no key in the join.
    looked_up = df.where(F.col(can).isNotNull()).join(hits, can, "left")
    rest = df.where(F.col(can).isNull()).withColumn(hit, F.lit(None).cast("boolean"))
    out = looked_up.unionByName(rest).withColumn("listed", F.coalesce(F.col(hit), F.lit(False)))
    return out.withColumn("verdict", F.coalesce(
        fitting_rule(F.col("host"), F.col("path"), rules)[1],
        F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))).drop(can, hit)
