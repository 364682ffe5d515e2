"""Pair mining."""

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import MULTIPLIERS, PRIME
from ..operators import agreement as ag
from ..operators import pairs as pm
from ..operators.items import blacklist_pairs as drop_listed
from . import bindings as b
from .catalog import query

SEED = pm.TRAIN_PARAMS.seed
P = pm.TRAIN_PARAMS


def mix_sql(low: str, high: str, salt: str) -> str:
    a, m, c = MULTIPLIERS
    one = f"((({low}) * {a} + ({high}) * {m} + ({salt})) % {PRIME})"
    two = f"({one} * (({low}) + {c}) % {PRIME})"
    return f"({two} * (({high}) + {m}) % {PRIME})"


# Every unordered pair of an item with its round and visiting number, by brute force.
ALL_PAIRS = f"""keyed AS (
  SELECT *, CASE split WHEN 'train' THEN 0 ELSE 1 END AS later, abs(pred - score) AS err FROM ratings),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY
      {b.u32(f"'{SEED}|' || item || '|' || later || '|' || idx")}, later, idx) - 1 AS slot,
    count(*) OVER (PARTITION BY item) AS n,
    {b.u32(f"'{SEED}|pair|' || item")} % {PRIME} AS salt
  FROM keyed),
joined AS (
  SELECT x.item, x.n, x.salt, least(x.slot, y.slot) AS lo, greatest(x.slot, y.slot) AS hi,
    x.split AS split1, x.idx AS idx1, x.score AS score1, y.split AS split2, y.idx AS idx2,
    y.score AS score2, x.err + y.err AS h, x.n + x.n % 2 - 1 AS ring
  FROM placed x JOIN placed y ON x.item = y.item AND (x.later, x.idx) < (y.later, y.idx)),
all_pairs AS (
  SELECT *, CASE WHEN hi = ring THEN 2 * lo % ring ELSE (lo + hi) % ring END AS round,
    {mix_sql("lo", "hi", "salt")} AS visit, {mix_sql("lo", "hi", f"salt * {MULTIPLIERS[2]} % {PRIME}")} AS luck
  FROM joined)"""


@query("candidate_pairs", f"""WITH {b.RATINGS}, {ALL_PAIRS}
SELECT item, h, score1 = score2 AS is_pos, score1 = 0 AND score2 = 0 AS is_listed, count(*) AS pairs
FROM all_pairs GROUP BY ALL""")
def candidate_pairs(spark, sf):
    """Complete numbers of candidate pairs; the pairs themselves grow with the square of an item."""
    return pm.hardness_profile(b.ratings(spark, sf), P.blacklist)


@query("pair_hardness", f"""WITH {b.RATINGS}, {ALL_PAIRS}
SELECT item, h, count(*) AS pairs, h > 0 AS is_hard FROM all_pairs GROUP BY item, h""")
def pair_hardness(spark, sf):
    """Hardness over every candidate pair, counted from record classes."""
    profile = pm.hardness_profile(b.ratings(spark, sf))
    return profile.groupBy("item", "h").agg(F.sum("pairs").alias("pairs")).withColumn(
        "is_hard", F.col("h") > 0)


@query("pair_polarity", f"""WITH {b.RATINGS}, {ALL_PAIRS}
SELECT item, score1 = score2 AS is_pos, count(*) AS pairs FROM all_pairs GROUP BY ALL""")
def pair_polarity(spark, sf):
    profile = pm.hardness_profile(b.ratings(spark, sf))
    return profile.groupBy("item", "is_pos").agg(F.sum("pairs").alias("pairs"))






def trained(spark, sf):
    return pm.greedy_pairs(b.ratings(spark, sf), P)


def greedy_sql(ct: str = str(P.ct_max), barred: str = "score1 = 0 AND score2 = 0") -> str:
    """The greedy pass as a fold over each item's pairs in visiting order; ``ct`` is the degree
    cap as an expression over the item, ``barred`` the condition of the blacklist."""
    return f"""{ALL_PAIRS}, open_pairs AS (
  SELECT item, n, {ct} AS ct, round, visit, lo, hi, score1 = score2 AS same FROM all_pairs
  WHERE NOT ({barred}) AND (h > 0 OR luck < {P.easy_prob} * {PRIME})),
lists AS (
  SELECT item, any_value(n) AS n, any_value(ct) AS ct,
    list({{'lo': lo, 'hi': hi, 'same': same, 'neg': 0::BIGINT, 'pos': 0::BIGINT,
      'deg': []::BIGINT[], 'acc': []::BIGINT[]}} ORDER BY round, visit, lo) AS ps
  FROM open_pairs GROUP BY item),
folded AS (
  SELECT item, list_reduce(ps, lambda s, x:
    CASE WHEN s.deg[x.lo + 1] >= ct OR s.deg[x.hi + 1] >= ct
           OR (s.neg + s.pos) / (ct * n)::DOUBLE > {P.cutoff}
           OR (x.same AND (s.neg + 1) / (s.pos + 1)::DOUBLE < {P.np_min}) THEN s
    ELSE {{'lo': s.lo, 'hi': s.hi, 'same': s.same,
      'neg': s.neg + CASE WHEN x.same THEN 0 ELSE 1 END,
      'pos': s.pos + CASE WHEN x.same THEN 1 ELSE 0 END,
      'deg': list_transform(s.deg, lambda d, i: d + CASE WHEN i = x.lo + 1 OR i = x.hi + 1 THEN 1 ELSE 0 END),
      'acc': list_append(s.acc, x.lo * n + x.hi)}} END,
    {{'lo': 0::BIGINT, 'hi': 0::BIGINT, 'same': false, 'neg': 0::BIGINT, 'pos': 0::BIGINT,
      'deg': list_transform(range(n), lambda v: 0::BIGINT), 'acc': []::BIGINT[]}}) AS s
  FROM lists),
accepted AS (SELECT item, unnest(s.acc) AS code FROM folded),
greedy AS (
  SELECT p.* FROM all_pairs p JOIN accepted a ON p.item = a.item AND a.code = p.lo * p.n + p.hi)"""


GREEDY = greedy_sql()


@query("blacklist_pairs", f"""WITH {b.RATINGS}, {greedy_sql(barred="false")}
SELECT item, split1, idx1, split2, idx2, score1, score2 FROM greedy
WHERE NOT (score1 = 0 AND score2 = 0) AND NOT (least(score1, score2) = 1 AND greatest(score1, score2) = 3)""")
def blacklist_pairs(spark, sf):
    """Applied after a mining run without a blacklist."""
    mined = pm.greedy_pairs(b.ratings(spark, sf), replace(P, blacklist=()))
    return drop_listed(mined, ((0, 0), (3, 1))).select(
        "item", "split1", "idx1", "split2", "idx2", "score1", "score2")


@query("sample_easy", f"""WITH {b.RATINGS}, {greedy_sql(barred="false")}
SELECT item, idx1, idx2, h, luck < {P.easy_prob} * {PRIME} AS lucky FROM greedy WHERE h > 0 OR luck < {P.easy_prob} * {PRIME}""")
def sample_easy(spark, sf):
    """The draw on accepted pairs: an easy one is there only if it was lucky."""
    mined = pm.greedy_pairs(b.ratings(spark, sf), replace(P, blacklist=()))
    places = pm.place_records(b.ratings(spark, sf), SEED).withColumn(
        "split", F.when(F.col("later") == 0, "train").otherwise("valid"))
    ends = [places.select("item", F.col("split").alias(f"split{i}"), F.col("idx").alias(f"idx{i}"),
                          F.col("slot").alias(f"slot{i}"), *(["salt"] if i == 1 else [])) for i in (1, 2)]
    met = mined.join(ends[0], ["item", "split1", "idx1"]).join(ends[1], ["item", "split2", "idx2"])
    chance = pm.pair_luck(F.least("slot1", "slot2"), F.greatest("slot1", "slot2"), F.col("salt"))
    lucky = chance < P.easy_prob
    return met.where(pm.sample_easy(F.col("h"), chance, P.easy_prob)).select(
        "item", "idx1", "idx2", "h", lucky.alias("lucky"))


@query("priority_order", f"""WITH {b.RATINGS}, {GREEDY}
SELECT item, idx1, idx2, CAST(row_number() OVER (PARTITION BY item ORDER BY round, visit, lo) AS INT) AS place
FROM greedy""")
def priority_order(spark, sf):
    """The place of every accepted pair in its item's visiting order."""
    order = Window.partitionBy("item").orderBy("round", "visit", "split1", "idx1", "split2", "idx2")
    return trained(spark, sf).select("item", "idx1", "idx2", F.row_number().over(order).alias("place"))


@query("greedy_degree_cap", f"""WITH {b.RATINGS}, {GREEDY}
SELECT item, round, visit, split1, idx1, score1, split2, idx2, score2, h FROM greedy""")
def greedy_degree_cap(spark, sf):
    """The accepted pairs themselves."""
    return trained(spark, sf)


@query("neg_pos_gate", f"""WITH {b.RATINGS}, {GREEDY}
SELECT item, count(*) FILTER (score1 <> score2) AS neg, count(*) FILTER (score1 = score2) AS pos,
  count(*) FILTER (score1 = score2) * {P.np_min} <= count(*) FILTER (score1 <> score2) + 1 AS holds
FROM greedy GROUP BY item""")
def neg_pos_gate(spark, sf):
    same = pm.pair_polarity()
    return trained(spark, sf).groupBy("item").agg(
        F.count_if(~same).alias("neg"), F.count_if(same).alias("pos")
    ).withColumn("holds", F.col("pos") * P.np_min <= F.col("neg") + 1)


@query("coverage_cutoff", f"""WITH {b.RATINGS}, {GREEDY}, g AS (
  SELECT item, count(*) AS pairs FROM greedy GROUP BY item)
SELECT item, count(*) AS records, any_value(pairs) AS pairs,
       any_value(pairs) <= floor({P.cutoff} * {P.ct_max} * count(*)) + 1 AS holds
FROM ratings JOIN g USING (item) GROUP BY item""")
def coverage_cutoff(spark, sf):
    r = b.ratings(spark, sf)
    report = pm.pair_coverage_report(r, pm.greedy_pairs(r, P)).where("pairs > 0")
    limit = F.floor(F.lit(P.cutoff) * P.ct_max * F.col("records")) + 1
    return report.select("item", "records", "pairs", (F.col("pairs") <= limit).alias("holds"))


PAIR_U = b.u32(f"'{SEED}|' || item || '|' || split1 || '|' || idx1 || '|' || split2 || '|' || idx2")


@query("rank_by_hardness", f"""WITH {b.RATINGS}, {GREEDY}
SELECT item, idx1, idx2, h, row_number() OVER (ORDER BY h DESC, {PAIR_U}, item, split1, idx1, split2, idx2) AS place
FROM greedy""")
def rank_by_hardness(spark, sf):
    return pm.rank_by_hardness(trained(spark, sf), SEED).select("item", "idx1", "idx2", "h", "place")


@query("cap_easy", f"""WITH {b.RATINGS}, {GREEDY},
ranked AS (
  SELECT *, count(*) FILTER (h > 0) OVER (PARTITION BY item) AS hard,
    row_number() OVER (PARTITION BY item, h = 0 ORDER BY {PAIR_U}, split1, idx1, split2, idx2) AS r FROM greedy)
SELECT item, idx1, idx2, h FROM ranked WHERE h > 0 OR r <= least(hard, 7)""")
def cap_easy(spark, sf):
    return pm.cap_easy(trained(spark, sf), 7, SEED).select("item", "idx1", "idx2", "h")


RANGES = """ranges AS (
  SELECT item, coalesce(min(score) FILTER (split = 'train'), min(score)) AS lo_s,
         coalesce(max(score) FILTER (split = 'train'), max(score)) AS hi_s FROM ratings GROUP BY item)"""


@query("pair_diffs", f"""WITH {b.RATINGS}, {RANGES}, {GREEDY}
SELECT item, idx1, idx2, abs(score1 - score2) AS diff_abs,
  round(abs((score1 - lo_s)::DOUBLE / nullif(hi_s - lo_s, 0) - (score2 - lo_s)::DOUBLE / nullif(hi_s - lo_s, 0)), 6)
    AS diff_norm
FROM greedy JOIN ranges USING (item)""")
def pair_diffs(spark, sf):
    r = b.ratings(spark, sf)
    out = pm.attach_pair_payload(pm.greedy_pairs(r, P), ag.with_score_norm(r))
    return out.select("item", "idx1", "idx2", "diff_abs", F.round("diff_norm", 6).alias("diff_norm"))


@query("attach_pair_payload", f"""WITH {b.RATINGS}, {GREEDY}
SELECT p.item, idx1, idx2, score1, score2, 'answer ' || idx1 AS text1, 'answer ' || idx2 AS text2,
       r.mode AS mode
FROM greedy p JOIN ratings r ON r.item = p.item AND r.idx = p.idx1""")
def attach_pair_payload(spark, sf):
    r = b.ratings(spark, sf).withColumn("text", F.concat(F.lit("answer "), F.col("idx").cast("string")))
    return pm.attach_pair_payload(pm.greedy_pairs(r, P), r, ["mode"]).select(
        "item", "idx1", "idx2", "score1", "score2", "text1", "text2", "mode")


@query("pair_coverage_report", f"""WITH {b.RATINGS}, {GREEDY}, used AS (
  SELECT item, count(DISTINCT i) AS used FROM (
    SELECT item, idx1 AS i FROM greedy UNION ALL SELECT item, idx2 FROM greedy) GROUP BY item),
c AS (SELECT item, count(*) AS pairs, count(*) FILTER (score1 = score2) AS pos,
             count(*) FILTER (h > 0) AS hard FROM greedy GROUP BY item)
SELECT item, records, used, round(used / records, 6) AS coverage, pairs, pos, pairs - pos AS neg,
       round((pairs - pos + 1) / (pos + 1), 6) AS np_ratio, hard, round(hard / pairs, 6) AS hard_share
FROM (SELECT item, count(*) AS records FROM ratings GROUP BY item) JOIN used USING (item) JOIN c USING (item)""")
def pair_coverage_report(spark, sf):
    r = b.ratings(spark, sf)
    out = pm.pair_coverage_report(r, pm.greedy_pairs(r, P))
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "np_ratio", "hard_share")})


@query("degree_histogram", f"""WITH {b.RATINGS}, {GREEDY}, ends AS (
  SELECT item, idx1 AS idx FROM greedy UNION ALL SELECT item, idx2 FROM greedy),
d AS (SELECT r.item, r.idx, count(e.idx) AS degree FROM ratings r
      LEFT JOIN ends e ON e.item = r.item AND e.idx = r.idx GROUP BY r.item, r.idx)
SELECT item, degree, count(*) AS records FROM d GROUP BY item, degree""")
def degree_histogram(spark, sf):
    r = b.ratings(spark, sf)
    return pm.degree_histogram(r, pm.greedy_pairs(r, P))


VALID = pm.VALID_PARAMS
PARTS = f"""parts AS (
  SELECT item, CASE WHEN r <= CAST(floor(n * 0.05) AS INT) THEN 'validation' ELSE 'train' END AS part
  FROM (SELECT item, row_number() OVER (ORDER BY {b.u32(f"'{SEED}|' || item")}, item) AS r, count(*) OVER () AS n
        FROM (SELECT DISTINCT item FROM ratings)))"""


@query("mine_pairs", f"""WITH {b.RATINGS}, {RANGES}, {PARTS},
{greedy_sql(f"CASE WHEN item IN (SELECT item FROM parts WHERE part = 'train') THEN {P.ct_max} ELSE {VALID.ct_max} END")},
ranked AS (
  SELECT g.*, part, count(*) FILTER (h > 0) OVER (PARTITION BY g.item) AS hard,
    row_number() OVER (PARTITION BY g.item, h = 0 ORDER BY
      {PAIR_U.replace("|| item ||", "|| g.item ||")}, split1, idx1, split2, idx2) AS r
  FROM greedy g JOIN parts USING (item))
SELECT part AS split, k.item, mode, idx1, idx2, score1, score2, h, abs(score1 - score2) AS diff_abs,
  round(abs((score1 - lo_s)::DOUBLE / nullif(hi_s - lo_s, 0) - (score2 - lo_s)::DOUBLE / nullif(hi_s - lo_s, 0)), 6)
    AS diff_norm
FROM ranked k JOIN ranges USING (item) JOIN ratings t ON t.item = k.item AND t.idx = k.idx1
WHERE h > 0 OR r <= least(hard, CASE part WHEN 'train' THEN {P.easy_max} ELSE {VALID.easy_max} END)""")
def mine_pairs(spark, sf):
    """Both splits with their own parameters, differences attached, shuffled."""
    r = b.ratings(spark, sf)
    pairs = pm.attach_pair_payload(pm.mine_pairs(r), ag.with_score_norm(r), ["mode"])
    return pm.shuffled_pairs(pairs, SEED).select(
        "split", "item", "mode", "idx1", "idx2", "score1", "score2", "h", "diff_abs",
        F.round("diff_norm", 6).alias("diff_norm"),
    )
