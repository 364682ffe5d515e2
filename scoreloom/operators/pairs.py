"""Mining of hard training pairs within items.

Pairs of an item are visited in a seeded random order and accepted greedily: both records must
have spare degree, the pair must not be blacklisted, pairs of two well-predicted records pass
only with a small probability, same-score pairs wait for enough different-score pairs, and an
item stops at a coverage cutoff.

The visiting order is a round-robin tournament over randomly placed records. Every unordered
pair is met in exactly one round, and within a round each record is met at most once. So the
pairs of one round cannot use up each other's degree, one round is a linear number of rows,
and rounds after the cutoff are never produced: the quadratic set of pairs is never built. Large items
go by blocks of rounds, so many that a block holds a good number of pairs that pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, TWO32, hash32, luck_salt, pair_hash
from ..session import shared_dir
from .items import blacklisted
from .sampling import shuffle_rows, split_by_item
from .scaling import BROADCAST_ROWS, GROUP_ROWS, dim_join, rank_within, running_totals

ITEM_ROWS = 50_000   # items up to this size are finished inside one task
BLOCK_PAIRS = 500_000   # passing pairs of a block of rounds that one task accepts in order
TILES = 64           # tiles of a larger item, unless they would exceed
TILE_ROWS = 4_000_000
MEETINGS = 1 << 20   # meetings of a tile that are looked at together
REPEATS = 12         # of the acceptance in blocks that are too large for a task
TASK_ROWS = 500_000  # records of small items per task
PAIR_KEYS = ("split1", "idx1", "split2", "idx2")


@dataclass(frozen=True)
class MineParams:
    ct_max: int = 2            # pairs per record
    np_min: float = 10         # different-score pairs per same-score pair
    easy_prob: float = 0.5     # chance of a pair without any prediction error
    easy_max: int = 1000       # such pairs kept per item
    blacklist: tuple = ()      # unordered score combinations to leave out
    cutoff: float = 0.4        # share of ct_max * records at which an item stops
    seed: int = 932


# Mining parameters of the two splits.
TRAIN_PARAMS = MineParams(ct_max=3, np_min=2, easy_prob=0.01, easy_max=1000, blacklist=((0, 0),))
VALID_PARAMS = MineParams(ct_max=1, np_min=2, easy_prob=0.01, easy_max=0, blacklist=((0, 0),))


# --- stateless column rules --------------------------------------------------------------

def pair_hardness(pred1, score1, pred2, score2) -> Column:
    return F.abs(F.col(pred1) - F.col(score1)) + F.abs(F.col(pred2) - F.col(score2))


def pair_polarity(score1="score1", score2="score2") -> Column:
    """True for a pair of equal scores."""
    return F.col(score1) == F.col(score2)


def sample_easy(hardness: Column, chance: Column, easy_prob: float) -> Column:
    """Hard pairs pass; easy ones when their uniform number is below ``easy_prob``."""
    return (hardness > 0) | (chance < easy_prob)


def pair_luck(low: Column, high: Column, salt: Column) -> Column:
    """The uniform number in [0, 1) of a pair's draw."""
    return pair_hash(low, high, luck_salt(salt)) / F.lit(float(PRIME))


def priority_order(low: Column, high: Column, salt: Column) -> Column:
    """Visiting priority of a pair inside its round."""
    return pair_hash(low, high, salt)


def pair_diffs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({
        "diff_abs": F.abs(F.col("score1") - F.col("score2")),
        "diff_norm": F.abs(F.col("score_norm1") - F.col("score_norm2")),
    })


# --- tournament ----------------------------------------------------------------------------

def place_records(
    df: DataFrame, seed, group_rows: int | None = None, largest: int | None = None
) -> DataFrame:
    """Give the records of each item random places 0..n-1; columns beyond these are dropped.

    A record without score or prediction has no hardness, so it is not minable and gets no place;
    reports over all records count it as one without pairs.
    """
    slim = df.where(minable()).select(
        "item", (F.col("split") != "train").cast("int").alias("later"),
        F.col("idx").cast("bigint").alias("idx"), F.col("score").cast("int").alias("score"),
        F.abs(F.col("pred") - F.col("score")).cast("int").alias("err"),
    )
    placed = rank_within(
        slim, ["item"], hash32(seed, "item", "later", "idx"), ["later", "idx"], "slot", "n",
        group_rows, largest,
    )
    return placed.withColumns({
        "slot": (F.col("slot") - 1).cast("bigint"), "n": F.col("n").cast("bigint"),
        "salt": hash32(seed, F.lit("pair"), "item") % PRIME,
    })


def minable() -> Column:
    return F.col("score").isNotNull() & F.col("pred").isNotNull()


def _partner(slot: Column, n: Column, turn) -> Column:
    """Opponent in a round: the last seat stays, the others meet where places add up to the
    round. A place that does not exist is a bye."""
    seats = n + n % 2
    ring = seats - 1
    fixed = (turn * (seats / 2).cast("bigint")) % ring
    met = F.pmod(turn - slot, ring)
    return F.when(slot == ring, fixed).when(met == slot, ring).otherwise(met)


def meet(placed: DataFrame, turn: Column) -> DataFrame:
    """Pairs of the given round(s): one row per meeting, ``a`` before ``b`` in load order."""
    turn = turn.cast("bigint")
    other = _partner(F.col("slot"), F.col("n"), turn)
    side = F.struct("later", "idx", "slot", "score", "err", "deg")
    return (
        placed.withColumns({"round": turn, "low": F.least("slot", other)})
        .groupBy("item", "round", "low")
        .agg(
            F.min(side).alias("a"), F.max(side).alias("b"), F.count(F.lit(1)).alias("met"),
            *[F.first(c).alias(c) for c in ("n", "salt")],
        )
    )


def candidate_pairs(df: DataFrame, seed, rounds: int, group_rows: int | None = None) -> DataFrame:
    """Pairs met in the first rounds. All n-1 (or n) rounds together hold every unordered
    pair of the item once; each round holds n/2 of them."""
    placed = place_records(df, seed, group_rows).withColumn("deg", F.lit(0))
    turns = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    turns = turns.where(F.col("turn") < F.col("n") + F.col("n") % 2 - 1)
    both = meet(turns, F.col("turn")).where("met = 2")
    low, high = F.least("a.slot", "b.slot"), F.greatest("a.slot", "b.slot")
    return both.select(
        "item", "round", priority_order(low, high, F.col("salt")).alias("visit"),
        *_both_sides(),
    )


def _both_sides() -> list[Column]:
    def split(side: str) -> Column:
        return F.when(F.col(f"{side}.later") == 0, "train").otherwise("valid")

    return [
        split("a").alias("split1"), F.col("a.idx").alias("idx1"), F.col("a.score").alias("score1"),
        split("b").alias("split2"), F.col("b.idx").alias("idx2"), F.col("b.score").alias("score2"),
        (F.col("a.err") + F.col("b.err")).alias("h"),
    ]


def hardness_profile(df: DataFrame, blacklist=()) -> DataFrame:
    """Number of candidate pairs of each item by hardness, polarity and blacklisting.

    Counted from the classes (score, error) of an item: as many rows as the rating scale
    allows, whatever the number of records.
    """
    classes = df.groupBy(
        "item", "score", F.abs(F.col("pred") - F.col("score")).alias("err")
    ).agg(F.count(F.lit(1)).alias("n"))
    one, two = (
        classes.select("item", *[F.col(c).alias(f"{c}{i}") for c in ("score", "err", "n")])
        for i in (1, 2)
    )
    ordered = (F.col("score1") < F.col("score2")) | (
        (F.col("score1") == F.col("score2")) & (F.col("err1") <= F.col("err2"))
    )
    same = (F.col("score1") == F.col("score2")) & (F.col("err1") == F.col("err2"))
    pairs = F.when(same, F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2"))
    return (
        one.join(two, "item").where(ordered)
        .groupBy(
            "item", (F.col("err1") + F.col("err2")).alias("h"),
            (F.col("score1") == F.col("score2")).alias("is_pos"),
            blacklisted(F.col("score1"), F.col("score2"), blacklist).alias("is_listed"),
        )
        .agg(F.sum(pairs).cast("bigint").alias("pairs")).where("pairs > 0")
    )


# --- greedy acceptance inside one task -----------------------------------------------------

def _stop_at(ct_max, cutoff, n):
    """The number of accepted pairs at which an item stops."""
    z = int(cutoff * ct_max * n)
    while z / (ct_max * n) <= cutoff:
        z += 1
    return z


def _hopeless(scores: np.ndarray, negatives: int, positives: int, p: MineParams) -> bool:
    """Can no pair of the open records be accepted any more?"""
    barred = {tuple(sorted(x)) for x in p.blacklist}
    values, counts = np.unique(scores, return_counts=True)
    if any((int(s), int(t)) not in barred for i, s in enumerate(values) for t in values[i + 1:]):
        return False
    return (negatives + 1) / (positives + 1) < p.np_min or not any(
        c > 1 and (int(s), int(s)) not in barred for s, c in zip(values, counts)
    )


def _meetings(
    slots: np.ndarray, n: int, first: int, size: int = 1 << 14
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Round and row positions of the meetings from round ``first`` on, in blocks of rounds: few at first, since
    most items stop after few."""
    seats = n + n % 2
    ring = seats - 1
    rows = np.arange(len(slots))
    if len(slots) == n:
        at = np.full(seats, -1)
        at[slots] = rows
        start, step, most = first, min(8, max(1, size // n)), max(1, size // n)
        while start < ring:
            turn = np.arange(start, min(start + step, ring))[:, None]
            met = (turn - slots) % ring
            met = np.where(met == slots, ring, met)
            met = np.where(slots == ring, turn * (seats // 2) % ring, met)
            other = at[met]
            t, left = np.nonzero(other > rows)
            yield t + start, left, other[t, left]
            start, step = start + step, min(2 * step, most)
        return
    i, j = np.triu_indices(len(slots), 1)
    low, high = np.minimum(slots[i], slots[j]), np.maximum(slots[i], slots[j])
    turn = np.where(high == ring, 2 * low % ring, (low + high) % ring)
    later = turn >= first
    yield turn[later], i[later], j[later]


def _greedy(
    slots: np.ndarray, score: np.ndarray, err: np.ndarray, salt: int, p: MineParams
) -> list[tuple[int, int, int, int]]:
    """Accept pairs among the records of one item: round, visiting number and the rows of both records.

    What a pair is by itself is computed for a block of rounds at once; only the running
    counts are walked through pair by pair.
    """
    n = len(slots)
    negatives = positives = 0
    stop = _stop_at(p.ct_max, p.cutoff, n)
    deg = [0] * n
    found: list[tuple[int, int, int, int]] = []
    for turn, i, j in _meetings(slots, n, 0):
        spare = np.array(deg) < p.ct_max
        if negatives + positives >= stop or _hopeless(score[spare], negatives, positives, p):
            break
        low, high = np.minimum(slots[i], slots[j]), np.maximum(slots[i], slots[j])
        s, t = np.minimum(score[i], score[j]), np.maximum(score[i], score[j])
        ok = spare[i] & spare[j]
        ok &= (err[i] + err[j] > 0) | (pair_hash(low, high, luck_salt(salt)) < p.easy_prob * PRIME)
        for a, b in p.blacklist:
            ok &= ~((s == min(a, b)) & (t == max(a, b)))
        turn, i, j, low, high, same = (x[ok] for x in (turn, i, j, low, high, s == t))
        visit = pair_hash(low, high, salt)
        order = np.lexsort((low, visit, turn))
        columns = (x[order].tolist() for x in (turn, visit, i, j, same))
        for r, v, a, b, alike in zip(*columns):
            if deg[a] >= p.ct_max or deg[b] >= p.ct_max:
                continue
            if alike:
                if (negatives + 1) / (positives + 1) < p.np_min:
                    continue
                positives += 1
            else:
                negatives += 1
            deg[a] += 1
            deg[b] += 1
            found.append((r, v, a, b))
            if negatives + positives >= stop:
                break
    return found


def _greedy_items(batches: Iterator[pa.RecordBatch], p: MineParams) -> Iterator[pa.RecordBatch]:
    """Accepted pairs of whole items, whose ``n`` rows follow one another; an item may run over several batches."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held, rows = [*held, batch], rows + batch.num_rows
        if rows < held[0].column("n")[0].as_py():
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        sizes, salts, slots, score, err = (
            table.column(c).to_numpy().astype(np.int64) for c in ("n", "salt", "slot", "score", "err"))
        start, found = 0, []
        while start < rows and start + sizes[start] <= rows:
            end = start + int(sizes[start])
            pairs = _greedy(slots[start:end], score[start:end], err[start:end], int(salts[start]), p)
            found += [(r, v, start + a, start + b) for r, v, a, b in pairs]
            start = end
        if found:
            yield _pair_batch(table, np.array(found, dtype=np.int64).T, score, err)
        held = table.slice(start).to_batches() if start < rows else []
        rows -= start


def _pair_batch(table: pa.Table, found: np.ndarray, score: np.ndarray, err: np.ndarray) -> pa.RecordBatch:
    """Accepted pairs of rows, the sides in load order."""
    turn, visit, i, j = found
    later = table.column("later").to_numpy().astype(np.int64)
    idx = table.column("idx").fill_null(np.iinfo(np.int64).min).to_numpy()
    swap = (later[i] > later[j]) | ((later[i] == later[j]) & (idx[i] > idx[j]))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    splits = pa.array(["train", "valid"])
    columns = {"item": table.column("item").take(pa.array(i)), "round": turn, "visit": visit}
    for k, side in ((1, i), (2, j)):
        columns |= {
            f"split{k}": splits.take(pa.array(later[side])), f"idx{k}": table.column("idx").take(pa.array(side)),
            f"score{k}": score[side].astype(np.int32)}
    columns["h"] = (err[i] + err[j]).astype(np.int32)
    return pa.Table.from_pydict(columns).combine_chunks().to_batches()[0]


def _finish(rows: DataFrame, p: MineParams, item_type: str) -> DataFrame:
    """Accepted pairs of items that lie whole in a partition. A call per item would cost more than its pairs."""
    schema = (
        f"item {item_type}, round bigint, visit bigint, split1 string, idx1 bigint, score1 int,"
        " split2 string, idx2 bigint, score2 int, h int"
    )
    return rows.sortWithinPartitions("item").mapInArrow(lambda batches: _greedy_items(batches, p), schema)


# --- greedy acceptance spread over tasks, a block of rounds at a time -------------------------

def _next_blocks(live: DataFrame, state: DataFrame, p: MineParams, block_pairs: int) -> DataFrame:
    """State of the items in which an open pair could still be accepted, and how many rounds come next.

    The open pairs are counted by class, so it is known how many of a round pass on average; a block
    has as many rounds as ``block_pairs`` (or half the open records) passing pairs take. ``wide`` items have too
    many in one round already.
    """
    classes = hardness_profile(live.withColumn("pred", F.col("score") + F.col("err")), p.blacklist)
    passing = F.when(F.col("h") > 0, F.col("pairs")).otherwise(F.col("pairs") * F.lit(p.easy_prob))
    weights = classes.where("NOT is_listed").groupBy("item").agg(
        F.sum(F.when(~F.col("is_pos"), passing).otherwise(0.0)).alias("mixed"),
        F.sum(F.when(F.col("is_pos"), passing).otherwise(0.0)).alias("alike"))
    left = live.groupBy("item").agg(F.count(F.lit(1)).alias("left"))
    ring = F.col("n") + F.col("n") % 2 - 1
    room = (F.floor((F.col("neg") + 1) / F.lit(p.np_min)) > F.col("pos")) if p.np_min > 0 else F.lit(True)
    rate = (F.col("mixed") + F.col("alike")) / ring
    goal = F.greatest(F.lit(float(block_pairs)), F.col("left") / 2.0)
    rounds = F.greatest(F.least(F.floor(goal / rate), ring - F.col("turn")), F.lit(1)).cast("bigint")
    open_items = state.join(weights, "item").join(left, "item").where(
        (F.col("neg") + F.col("pos") < F.col("stop")) & (F.col("turn") < ring)
        & ((F.col("mixed") > 0) | ((F.col("alike") > 0) & room)))
    return open_items.withColumn("rounds", rounds).select(
        *state.columns, "rounds", (rate * F.col("rounds") > 2.0 * block_pairs).alias("wide"),
        F.greatest(F.ceil(rate * F.col("rounds")), F.lit(1)).alias("expected"))


def _block_meetings(live: DataFrame, plan: DataFrame, p: MineParams, small: bool) -> DataFrame:
    """Passing pairs of open records that meet in the rounds of each item's block.

    The places are cut into tiles. In a block of B rounds a place meets B neighbouring places of the ring,
    so a record goes to its own tile and to those whose places it can meet, and a tile finds its meetings
    by itself: as many rows move for a thousand rounds as for one.
    """
    ring = F.col("n") + F.col("n") % 2 - 1
    rows = dim_join(live, plan.select("item", "n", "salt", "turn", "rounds"), ["item"], "inner", small=small)
    width = F.least(F.greatest(
        F.ceil(F.col("n") / F.lit(float(TILES))), F.ceil(F.col("rounds") / 16.0)), F.lit(TILE_ROWS)).cast("bigint")
    rows = rows.withColumns({"ring": ring, "width": width})
    first = F.pmod(F.col("turn") - F.col("slot"), F.col("ring"))
    end = first + F.col("rounds")

    def tiles(low: Column, high: Column) -> Column:
        """Tiles of the places low..high-1 that are not beyond the record's own."""
        last = F.least(F.floor((high - 1) / F.col("width")), F.floor(F.col("slot") / F.col("width")))
        from_ = F.floor(low / F.col("width"))
        return F.when((high > low) & (from_ <= last), F.sequence(from_, last)).otherwise(F.array().cast("array<bigint>"))

    zero = F.lit(0).cast("bigint")
    met = F.when(F.col("slot") == F.col("ring"), tiles(zero, F.col("ring"))).otherwise(F.array_union(
        tiles(first, F.least(end, F.col("ring"))), tiles(zero, end - F.col("ring"))))
    own = F.when(F.col("slot") < F.col("ring"), F.array(F.floor(F.col("slot") / F.col("width"))))
    none = F.array().cast("array<bigint>")
    sides = F.concat(
        F.transform(F.coalesce(own, none), lambda t: F.struct(t.alias("tile"), F.lit(0).alias("side"))),
        F.transform(met, lambda t: F.struct(t.alias("tile"), F.lit(1).alias("side"))))
    dealt = rows.select(
        "item", "n", "salt", "turn", "rounds", "slot", "score", "err", "deg", F.explode(sides).alias("at")
    ).select("*", "at.tile", "at.side").drop("at")
    item_type = dict(live.dtypes)["item"]
    schema = f"item {item_type}, {MEETING}"
    return dealt.groupBy("item", "tile").applyInPandas(lambda pdf: _tile(pdf, p), schema)


MEETING = "round bigint, visit bigint, low bigint, high bigint, same boolean, deg1 int, deg2 int"


def _tile(pdf: pd.DataFrame, p: MineParams) -> pd.DataFrame:
    """Passing meetings of one tile: a record of it, and a later place."""
    n, salt, turn, rounds = (int(pdf[c].iat[0]) for c in ("n", "salt", "turn", "rounds"))
    ring = n + n % 2 - 1
    pdf = pdf.sort_values("slot")
    own, met = pdf[pdf["side"] == 0], pdf[(pdf["side"] == 1) & (pdf["slot"] < ring)]
    seat = pdf[(pdf["side"] == 1) & (pdf["slot"] == ring)]
    barred: dict[int, set[int]] = {}
    for a, b in p.blacklist:
        barred.setdefault(a, set()).add(b)
        barred.setdefault(b, set()).add(a)
    listed = own["score"].isin(list(barred))
    parts = [(own[~listed], met)]
    parts += [(own[own["score"] == s], met[~met["score"].isin(list(t))]) for s, t in barred.items()]
    found = []
    columns = ("slot", "score", "err", "deg")

    def keep(one, two, i, j):
        """Rows i of one meet rows j of two."""
        u, w = one[0][i], two[0][j]
        ok = u < w
        u, w, i, j = u[ok], w[ok], i[ok], j[ok]
        ok = (one[2][i] + two[2][j] > 0) | (pair_hash(u, w, luck_salt(salt)) < p.easy_prob * PRIME)
        u, w, i, j = u[ok], w[ok], i[ok], j[ok]
        ok = np.ones(len(u), dtype=bool)
        s, t = np.minimum(one[1][i], two[1][j]), np.maximum(one[1][i], two[1][j])
        for a, b in p.blacklist:
            ok &= ~((s == min(a, b)) & (t == max(a, b)))
        u, w, i, j, same = u[ok], w[ok], i[ok], j[ok], (s == t)[ok]
        at = np.where(w == ring, 2 * u, u + w)
        found.append((turn + (at - turn) % ring, pair_hash(u, w, salt), u, w, same, one[3][i], two[3][j]))

    for mine, others in parts:
        one, two = ([x[c].to_numpy(np.int64) for c in columns] for x in (mine, others))
        if len(one[0]) and len(two[0]):
            twice = np.concatenate([two[0], two[0] + ring])
            start = (turn - one[0]) % ring
            low, high = np.searchsorted(twice, start), np.searchsorted(twice, start + rounds)
            ends = np.cumsum(high - low)
            at = 0
            while at < len(ends):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + MEETINGS, side="right")))
                size = (high - low)[at:to]
                i = np.repeat(np.arange(at, to), size)
                j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[at:to], size)
                keep(one, two, i, j % len(two[0]))
                at = to
    if len(seat):
        one, two = ([x[c].to_numpy(np.int64) for c in columns] for x in (own, seat))
        i = np.nonzero((2 * one[0] - turn) % ring < rounds)[0]
        keep(one, two, i, np.zeros(len(i), dtype=np.int64))
    names = [c.split()[0] for c in MEETING.split(", ")]
    found = [np.concatenate(c) for c in zip(*found)] if found else [[]] * len(names)
    out = pd.DataFrame(dict(zip(names, found)))
    out.insert(0, "item", pdf["item"].iat[0])
    return out.astype({"same": bool})


def _accept_block(pdf: pd.DataFrame, p: MineParams) -> pd.DataFrame:
    """Accept pairs of one item's block in visiting order."""
    negatives, positives, stop = (int(pdf[c].iat[0]) for c in ("neg", "pos", "stop"))
    pdf = pdf.sort_values(["round", "visit", "low"])
    low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
    slots, codes = np.unique(np.concatenate([low, high]), return_inverse=True)
    start = np.zeros(len(slots), dtype=np.int64)
    start[codes] = np.concatenate([pdf["deg1"].to_numpy(), pdf["deg2"].to_numpy()])
    deg, taken = start.tolist(), np.zeros(len(pdf), dtype=bool)
    for k, (a, b, alike) in enumerate(zip(codes[: len(low)].tolist(), codes[len(low):].tolist(), pdf["same"].tolist())):
        if negatives + positives >= stop:
            break
        if deg[a] >= p.ct_max or deg[b] >= p.ct_max:
            continue
        if alike:
            if (negatives + 1) / (positives + 1) < p.np_min:
                continue
            positives += 1
        else:
            negatives += 1
        deg[a] += 1
        deg[b] += 1
        taken[k] = True
    return pdf.loc[taken, ["item", "round", "visit", "low", "high", "same"]]


def _gate(rows: DataFrame, p: MineParams, pieced: bool, small: bool) -> DataFrame:
    """Flag the pairs that pass the class ratio and the cutoff, in every item.

    ``e`` and ``d`` mark the different- and same-score pairs whose records are free. Whether a same-score pair is accepted
    depends on all pairs before it only through running counts: with C the allowance after a pair and D the same-score
    pairs up to it, the accepted count is D + min(start, lowest C - D so far). Both running values are computed per
    piece of the visiting order and, where items have several pieces, shifted by the pieces before.
    """
    earlier = Window.partitionBy("item").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("item", "piece").orderBy("round", "visit", "low")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    allowed = F.floor((F.col("cum_e") + 1) / F.lit(p.np_min)) if p.np_min > 0 else F.lit(1 << 60)

    def counted(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "cum_e": F.col("neg") + F.col("e0") + F.sum("e").over(upto),
            "cum_d": F.col("d0") + F.sum("d").over(upto),
        }).withColumn("gap", allowed - F.col("cum_d"))

    if pieced:
        rows = rows.checkpoint()
        totals = rows.groupBy("item", "piece").agg(F.sum("e").alias("e"), F.sum("d").alias("d"))
        totals = totals.select(
            "item", "piece",
            F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("e0"),
            F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("d0"),
        )
        seen = counted(dim_join(rows, totals, ["item", "piece"], small=small))
        lows = seen.groupBy("item", "piece").agg(F.min("gap").alias("g")).select(
            "item", "piece", F.min("g").over(earlier).alias("gap0")
        )
        seen = dim_join(seen, lows, ["item", "piece"], small=small)
    else:
        seen = counted(rows.withColumns({"e0": F.lit(0), "d0": F.lit(0)}))
        seen = seen.withColumn("gap0", F.lit(None).cast("bigint"))
    before = F.least(
        "pos", "gap0", F.min("gap").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    total = F.col("cum_e") + F.col("cum_d") + F.least("before", "gap")
    fits = (F.col("e") == 1) | ((F.col("d") == 1) & (F.col("gap") >= F.col("before")))
    return seen.withColumn("before", before).select(
        *rows.columns, (fits & (total <= F.col("stop"))).alias("fits"))


def _accept_spread(
    met: DataFrame, p: MineParams, group_rows: int, pieced: bool, small: bool, repeats: int
) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs of blocks too large for a task, and the round up to which each item is settled.

    From a guess of what is accepted follow the degrees before every pair, from these the free pairs, from
    these by the gate what is accepted. Every decision depends on earlier ones only, so each repeat settles more
    of the order, and what no longer changes is the greedy result: mostly the whole block after a few
    repeats. What still changes at the end is left to the next block; the first round is always settled.
    """
    pieces = F.ceil(F.col("expected") / F.lit(float(group_rows)))
    at = (F.col("round") - F.col("turn") + F.col("visit") / F.lit(float(PRIME))) / F.col("rounds")
    key = ["item", "round", "low"]
    rest = ["visit", "high", "same", "deg1", "deg2", "neg", "pos", "stop", "piece", "taken"]
    rows = met.withColumns({
        "piece": F.least(F.floor(at * pieces), pieces - 1).cast("bigint"), "taken": F.lit(False)}).select(*key, *rest).checkpoint()
    before = Window.partitionBy("item", "slot").orderBy("round", "visit", "low").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(max(2, repeats)):
        ends = rows.select("*", F.explode(F.array(
            F.struct(F.col("low").alias("slot"), F.col("deg1").alias("deg")),
            F.struct(F.col("high").alias("slot"), F.col("deg2").alias("deg")))).alias("end")).select("*", "end.slot", "end.deg")
        used = F.coalesce(F.sum(F.col("taken").cast("int")).over(before), F.lit(0))
        free = ends.withColumn("free", F.col("deg") + used < p.ct_max).groupBy(*key).agg(
            F.min("free").alias("free"), *[F.first(c).alias(c) for c in rest])
        flags = free.select(
            *key, *rest, (F.col("free") & ~F.col("same")).cast("int").alias("e"),
            (F.col("free") & F.col("same")).cast("int").alias("d"))
        now = _gate(flags, p, pieced, small).checkpoint()
        changed = now.where(F.col("fits") != F.col("taken")).groupBy("item").agg(F.min("round").alias("changed")).checkpoint()
        rows = now.withColumn("taken", F.col("fits")).select(*key, *rest)
        if changed.isEmpty():
            break
    settled = dim_join(rows.where("taken"), changed, ["item"], small=small)
    settled = settled.where(F.col("changed").isNull() | (F.col("round") < F.col("changed")))
    return settled.select("item", "round", "visit", "low", "high", "same"), changed


def _blocks(
    placed: DataFrame, p: MineParams, group_rows: int, block_pairs: int, repeats: int = REPEATS
) -> Iterator[DataFrame]:
    """Tables of accepted pairs ``item, round, visit, low, high, same`` of large items, block after block."""
    item_type = dict(placed.dtypes)["item"]
    z = F.floor(F.lit(p.cutoff) * p.ct_max * F.col("n"))
    over = [(z + k) / (F.lit(p.ct_max) * F.col("n")) > p.cutoff for k in (0, 1)]
    stop = F.when(over[0], z).when(over[1], z + 1).otherwise(z + 2)
    zero = F.lit(0).cast("bigint")
    state = placed.select("item", "n", "salt").distinct().select(
        "item", "n", "salt", zero.alias("neg"), zero.alias("pos"), stop.alias("stop"), zero.alias("turn")
    ).checkpoint()
    # Items and their pieces only become fewer, so their number is checked once.
    sizes = state.agg(F.sum(F.ceil(F.col("n") / F.lit(float(group_rows)))).alias("pieces")).head()
    small = (sizes["pieces"] or 0) <= BROADCAST_ROWS
    live = placed.select("item", "slot", "score", "err", F.lit(0).alias("deg"))
    fields = f"item {item_type}, round bigint, visit bigint, low bigint, high bigint, same boolean"
    while True:
        plan = _next_blocks(live, state, p, block_pairs).checkpoint()
        left = plan.agg(
            F.count(F.lit(1)).alias("items"), F.count_if("wide").alias("wide"), F.max("expected").alias("expected")).head()
        if not left["items"]:
            return
        carried = plan.select("item", "neg", "pos", "stop", "turn", "rounds", "wide", "expected")
        met = dim_join(_block_meetings(live, plan, p, small), carried, ["item"], small=small)
        if left["wide"]:
            met = met.checkpoint()
        inside = met.where("NOT wide").groupBy("item").applyInPandas(lambda pdf: _accept_block(pdf, p), fields)
        if left["wide"]:
            spread, changed = _accept_spread(
                met.where("wide"), p, group_rows, left["expected"] > group_rows, small, repeats)
            taken = inside.unionByName(spread).checkpoint()
        else:
            taken, changed = inside.checkpoint(), None
        yield taken
        gained = taken.groupBy("item").agg(
            F.count_if(~F.col("same")).alias("gain_e"), F.count_if("same").alias("gain_d"))
        ends = plan.join(gained, "item", "left")
        ends = ends.withColumn("changed", F.lit(None).cast("bigint")) if changed is None else ends.join(changed, "item", "left")
        state = ends.select(
            "item", "n", "salt", (F.col("neg") + F.coalesce("gain_e", zero)).alias("neg"),
            (F.col("pos") + F.coalesce("gain_d", zero)).alias("pos"), "stop",
            F.coalesce("changed", F.col("turn") + F.col("rounds")).alias("turn")).checkpoint()
        more = taken.select("item", F.explode(F.array("low", "high")).alias("slot")).groupBy("item", "slot").agg(
            F.count(F.lit(1)).cast("int").alias("more"))
        still = dim_join(live, state.select("item"), ["item"], "inner", small=small)
        live = still.join(more, ["item", "slot"], "left").select(
            "item", "slot", "score", "err", (F.col("deg") + F.coalesce("more", F.lit(0))).alias("deg")
        ).where(F.col("deg") < p.ct_max).checkpoint()


def _with_sides(taken: DataFrame, placed: DataFrame) -> DataFrame:
    """Accepted places back to records, in load order."""
    side = F.struct("later", "idx", "score", "err")
    one, two = (placed.select("item", F.col("slot").alias(c), side.alias(f"at_{c}")) for c in ("low", "high"))
    both = taken.join(one, ["item", "low"]).join(two, ["item", "high"])
    return both.withColumns({"a": F.least("at_low", "at_high"), "b": F.greatest("at_low", "at_high")}).select(
        "item", "round", "visit", *_both_sides())


def greedy_pairs(
    df: DataFrame, p: MineParams = MineParams(), item_rows: int = ITEM_ROWS,
    group_rows: int = GROUP_ROWS, block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """Accepted pairs of every item: degree cap, class ratio and coverage cutoff, exactly.

    Small items take one task each. Items above ``item_rows`` go by blocks of rounds over all
    tasks, until cutoff or until no pair can pass any more, and give the same pairs.
    """
    shared_dir(df.sparkSession)
    df = df.where(minable())
    sizes = df.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.max("n").alias("top"), F.sum("n").alias("rows")).head()
    largest = total["top"] or 0
    if largest <= item_rows:
        # The per-item pass is heavy for its few bytes, so its tasks are counted in rows.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(max(tasks, (total["rows"] or 0) // TASK_ROWS), "item")
    placed = place_records(df, p.seed, group_rows, largest)
    item_type = dict(placed.dtypes)["item"]
    if largest <= min(item_rows, group_rows):
        return _finish(placed, p, item_type)   # the window has left items whole
    placed = placed.checkpoint()
    out = _finish(placed.where(F.col("n") <= item_rows).repartition("item"), p, item_type)
    if largest <= item_rows:
        return out
    large = placed.where(F.col("n") > item_rows)
    taken = list(_blocks(large, p, group_rows, block_pairs))
    return out.unionByName(_with_sides(reduce(DataFrame.unionByName, taken), large)) if taken else out


# --- after acceptance ------------------------------------------------------------------------

def rank_by_hardness(pairs: DataFrame, seed) -> DataFrame:
    """Hardest first, equals in random order, with the 1-based ``place`` in that order."""
    u = hash32(seed, "item", *PAIR_KEYS)
    keyed = pairs.withColumns({"_key": F.col("h") * F.lit(TWO32) - u, "_one": F.lit(1).cast("bigint")})
    ranked = running_totals(keyed, "_key", ["_one"], ["item", *PAIR_KEYS], descending=True)
    return ranked.withColumn("place", F.col("cum__one")).drop("_key", "_one", "cum__one", "all__one").orderBy("place")


def cap_easy(pairs: DataFrame, easy_max: int, seed, group_rows: int | None = None) -> DataFrame:
    """All hard pairs of an item and at most min(easy_max, hard) random easy ones.

    The pairs are read several times, here and by what follows, so they are stored once.
    """
    shared_dir(pairs.sparkSession)
    pairs = pairs.checkpoint()
    hard = pairs.where("h > 0")
    if easy_max <= 0:
        return hard
    easy = rank_within(
        pairs.where("h = 0"), ["item"], hash32(seed, "item", "split1", "idx1", "split2", "idx2"),
        ["split1", "idx1", "split2", "idx2"], "_rank", "_size", group_rows,
    )
    counts = hard.groupBy("item").agg(F.count(F.lit(1)).alias("_hard"))
    kept = dim_join(easy, counts, ["item"], "inner").where(
        F.col("_rank") <= F.least(F.col("_hard"), F.lit(easy_max))
    )
    return hard.unionByName(kept.select(*pairs.columns))


def attach_pair_payload(pairs: DataFrame, records: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Put text, payload and normalised score of both records on the pair, and further columns
    from the first. Wide columns meet the pairs only here, after selection."""
    sided = [c for c in ("text", "payload", "score_norm") if c in records.columns]

    def side(i: int, more: list[str]) -> DataFrame:
        return records.select(
            "item", F.col("split").alias(f"split{i}"), F.col("idx").alias(f"idx{i}"),
            *[F.col(c).alias(f"{c}{i}") for c in sided], *more,
        )

    keys = ["item", "split{0}", "idx{0}"]
    out = pairs
    for i, more in ((1, list(extra)), (2, [])):
        out = out.join(side(i, more), [k.format(i) for k in keys])
    return pair_diffs(out) if "score_norm" in sided else out


def mine_pairs(
    df: DataFrame, train: MineParams = TRAIN_PARAMS, valid: MineParams = VALID_PARAMS,
    seed=932, valid_share: float = 0.05, **sizes,
) -> DataFrame:
    """Pairs of both splits: items are divided, mined with the parameters of their split and
    capped. ``split`` names the split of a pair, ``split1``/``split2`` those of its records.
    """
    records = split_by_item(df.select("item", "split", "idx", "score", "pred"), seed, valid_share)
    parts = []
    for name, p in (("train", train), ("validation", valid)):
        pairs = greedy_pairs(records.where(F.col("part") == name).drop("part"), p, **sizes)
        parts.append(cap_easy(pairs, p.easy_max, seed).withColumn("split", F.lit(name)))
    return parts[0].unionByName(parts[1])


def shuffled_pairs(pairs: DataFrame, seed) -> DataFrame:
    return shuffle_rows(pairs, seed, ["item", *PAIR_KEYS])


def pair_coverage_report(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per item: share of records used, pair counts by class, ratio, and share of hard pairs.

    The pairs are read once: every count is half the sum over the records at both ends.
    """
    per_item = record_degrees(records, pairs).groupBy("item").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("degree") > 0).alias("used"),
        *[(F.sum(c) / 2).cast("bigint").alias(n) for c, n in (
            ("degree", "pairs"), ("same_ends", "pos"), ("hard_ends", "hard"))],
    )
    neg = F.col("pairs") - F.col("pos")
    return per_item.select(
        "item", "records", "used", (F.col("used") / F.col("records")).alias("coverage"),
        "pairs", "pos", neg.alias("neg"), ((neg + 1) / (F.col("pos") + 1)).alias("np_ratio"),
        "hard", (F.col("hard") / F.nullif(F.col("pairs"), F.lit(0))).alias("hard_share"),
    )


def record_degrees(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs per record, 0 included, and how many of them are same-score and hard."""
    keys = ["item", "split", "idx"]
    ends = pairs.select(
        "item", pair_polarity().alias("same"), (F.col("h") > 0).alias("hard"),
        F.explode(F.array(*[
            F.struct(F.col(f"split{i}").alias("split"), F.col(f"idx{i}").alias("idx")) for i in (1, 2)
        ])).alias("r"),
    ).select("item", "r.split", "r.idx", "same", "hard")
    per_record = ends.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("degree"), F.count_if("same").alias("same_ends"),
        F.count_if("hard").alias("hard_ends"),
    )
    return records.select(*keys).join(per_record, keys, "left").na.fill(
        0, ["degree", "same_ends", "hard_ends"]
    )


def degree_histogram(records: DataFrame, pairs: DataFrame) -> DataFrame:
    return record_degrees(records, pairs).groupBy("item", "degree").agg(
        F.count(F.lit(1)).alias("records")
    )
