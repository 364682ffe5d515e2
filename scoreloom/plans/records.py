"""Typing, cleaning, projections and prompt columns."""

from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions import text as tx
from ..operators import records as rc
from ..operators.agreement import normalised, with_score_norm
from . import bindings as b
from .catalog import query

LONG_SPACE = " \n\t \n      \n  "


def raw_records(spark, sf):
    """Raw-shaped records: everything but index and grade is text."""
    digit = F.col("idx") % 3
    code = F.when(F.col("mode") == "fr", "3a").when(F.col("mode") == "de", "6a").otherwise("1a")
    section = (F.when(digit == 0, "Elaboration").when(digit == 1, "Opening").otherwise("Conclusion"))
    return b.responses(spark, sf).select(
        F.col("idx").cast("int").alias("index"),
        (3 + F.col("idx") % 9).cast("int").alias("grade"),
        F.concat(F.lit("Tar "), code, F.lit("  "), section).alias("mode"),
        F.concat(F.lit(" "), F.substring("item", 4, 9), F.lit(" ")).alias("item"),
        F.concat(F.lit("q-"), F.col("idx").cast("string")).alias("sqid"),
        F.coalesce(F.col("score").cast("bigint"), digit).cast("string").alias("sc"),
        digit.cast("string").alias("con"),
        (1 + F.col("idx") % 4).cast("string").alias("dev"),
        (1 + F.col("idx") % 4).cast("string").alias("org"),
        "text",
        F.when(F.col("idx") % 5 == 0, "valid").otherwise("train").alias("split"),
    )


RAW = b.RESPONSES + """, raw AS (
  SELECT CAST(idx AS INT) AS index, CAST(3 + idx % 9 AS INT) AS grade,
    CASE mode WHEN 'fr' THEN 'explanatory' WHEN 'de' THEN 'argumentative' ELSE 'narrative' END AS long_mode,
    CASE idx % 3 WHEN 0 THEN 'elaboration' WHEN 1 THEN 'opening' ELSE 'conclusion' END AS section,
    CASE mode WHEN 'fr' THEN '3a' WHEN 'de' THEN '6a' ELSE '1a' END AS code,
    CAST(substr(item, 4) AS INT) AS item, CAST(coalesce(score, idx % 3) AS INT) AS score,
    CAST(idx % 3 AS INT) AS con, CAST(1 + idx % 4 AS INT) AS dev, CAST(1 + idx % 4 AS INT) AS org,
    text, CASE WHEN idx % 5 = 0 THEN 'valid' ELSE 'train' END AS split
  FROM responses)"""


@query("type_common", f"WITH {RAW} SELECT item, index, grade FROM raw")
def type_common(spark, sf):
    return rc.type_common(raw_records(spark, sf)).select("item", "index", "grade")


@query("parse_mode_code", f"WITH {RAW} SELECT index, long_mode AS mode, section FROM raw")
def parse_mode_code(spark, sf):
    mode, section = rc.mode_parts(F.col("mode"))
    return raw_records(spark, sf).select("index", mode.alias("mode"), section.alias("section"))


@query("clean_bw", f"""WITH {RAW}
SELECT index, grade, long_mode AS mode, item, section, score, md5(text) AS text FROM raw""")
def clean_bw(spark, sf):
    out = rc.clean_bw(raw_records(spark, sf)).withColumn("text", F.md5("text"))
    return out.drop("split")


@query("clean_math", f"""WITH {RAW}
SELECT index, grade, 'tar ' || code || '  ' || section AS mode, item, score, md5(text) AS text FROM raw""")
def clean_math(spark, sf):
    return rc.clean_math(raw_records(spark, sf)).withColumn("text", F.md5("text")).drop("split")


@query("clean_fw", f"""WITH {RAW}, r AS (
  SELECT item,
         coalesce(min(con) FILTER (split = 'train'), min(con)) AS clo,
         coalesce(max(con) FILTER (split = 'train'), max(con)) AS chi,
         coalesce(min(dev) FILTER (split = 'train'), min(dev)) AS dlo,
         coalesce(max(dev) FILTER (split = 'train'), max(dev)) AS dhi
  FROM raw GROUP BY item)
SELECT index, grade, 'tar ' || code || '  ' || section AS mode, item, con, dev, org,
       clo AS con_min, chi AS con_max, round((con - clo)::DOUBLE / nullif(chi - clo, 0), 6) AS con_norm,
       round((dev - dlo)::DOUBLE / nullif(dhi - dlo, 0), 6) AS dev_norm,
       round((org - dlo)::DOUBLE / nullif(dhi - dlo, 0), 6) AS org_norm,
       md5(text) AS text, split, 'fw' AS item_type
FROM raw JOIN r USING (item)""")
def clean_fw(spark, sf):
    raw = raw_records(spark, sf)
    parts = [raw.where(F.col("split") == s) for s in ("train", "valid")]
    return rc.clean_items("fw", *parts).select(
        "index", "grade", "mode", "item", F.col("con.score").alias("con"),
        F.col("dev.score").alias("dev"), F.col("org.score").alias("org"),
        F.col("con.min_score").alias("con_min"), F.col("con.max_score").alias("con_max"),
        *[F.round(f"{t}.score_norm", 6).alias(f"{t}_norm") for t in rc.TRAITS],
        F.md5("text").alias("text"), "split", "item_type",
    )


@query("tag_split_type", f"""WITH {b.RATINGS}
SELECT item_type, split, count(*) AS n FROM (
  SELECT 'math' AS item_type, split FROM ratings
  UNION ALL SELECT 'bw', 'valid' FROM ratings WHERE score > 2) GROUP BY ALL""")
def tag_split_type(spark, sf):
    r = b.ratings(spark, sf)
    tagged = rc.tag_split_type(r, "math").unionByName(
        rc.tag_split_type(r.where("score > 2"), "bw", "valid")
    )
    return tagged.groupBy("item_type", "split").agg(F.count(F.lit(1)).alias("n"))


@query("word_count", """SELECT doc_id,
  CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INT) AS words
FROM documents""")
def word_count(spark, sf):
    return b.documents(spark, sf).select("doc_id", tx.word_count("text").alias("words"))


@query("reduce_whitespace", f"""WITH spaced AS (
  SELECT doc_id, '{LONG_SPACE}' || replace(text, '. ', '.{LONG_SPACE}') || '  ' AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'),
                                  '\\s{{10,}}', chr(10) || chr(10), 'g')) AS digest FROM spaced""")
def reduce_whitespace(spark, sf):
    spaced = F.concat(
        F.lit(LONG_SPACE), F.replace("text", F.lit(". "), F.lit("." + LONG_SPACE)), F.lit("  ")
    )
    return b.documents(spark, sf).select(
        "doc_id", F.md5(tx.reduce_whitespace(spaced)).alias("digest")
    )


RUNS = """stretched AS (
  SELECT doc_id, replace(replace(text, ' la ', ' laaaaaaaaaaaa '), 'the', 'theeeeeeeee') AS t FROM documents),
chars AS (
  SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS p
  FROM (SELECT doc_id, regexp_extract_all(t, '(?s).') AS cs FROM stretched)),
marks AS (
  SELECT *, p - row_number() OVER (PARTITION BY doc_id, c ORDER BY p) AS g FROM chars),
runs AS (SELECT doc_id, c, g, min(p) AS start, count(*) AS len FROM marks GROUP BY doc_id, c, g)"""


def stretched(spark, sf):
    t = F.replace("text", F.lit(" la "), F.lit(" laaaaaaaaaaaa "))
    t = F.replace(t, F.lit("the"), F.lit("theeeeeeeee"))
    return b.documents(spark, sf).select("doc_id", t.alias("t"))


@query("longest_char_run", f"""WITH {RUNS}
SELECT d.doc_id, coalesce(w.run, '') AS run FROM documents d LEFT JOIN (
  SELECT doc_id, first(repeat(c, len) ORDER BY len DESC, start) AS run FROM runs GROUP BY doc_id) w
ON w.doc_id = d.doc_id""")
def longest_char_run(spark, sf):
    return stretched(spark, sf).select("doc_id", tx.longest_char_run("t").alias("run"))


@query("collapse_runs", f"""WITH {RUNS}
SELECT doc_id, md5(string_agg(repeat(c, CASE WHEN len >= 10 THEN 2 ELSE len END), '' ORDER BY start)) AS digest
FROM runs GROUP BY doc_id""")
def collapse_runs(spark, sf):
    return stretched(spark, sf).select("doc_id", F.md5(tx.collapse_runs("t")).alias("digest"))


@query("truncate_longest_to_median", """WITH t AS (
  SELECT doc_id, doc_id // 8 AS batch, length(x) AS old_len,
         regexp_replace(x, 'a{10,}', 'aa', 'g') AS fixed
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0
                       THEN text || repeat('a', CAST(1000 * (doc_id % 5) AS INT)) ELSE text END AS x
        FROM documents)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY old_len DESC, doc_id) AS longest,
         row_number() OVER (PARTITION BY batch ORDER BY length(fixed), doc_id) AS nth,
         count(*) OVER (PARTITION BY batch) AS n FROM t),
m AS (SELECT batch, max(length(fixed)) FILTER (nth = n // 2 + 1) AS med FROM r GROUP BY batch)
SELECT doc_id, md5(CASE WHEN longest = 1 AND length(fixed) / old_len > 0.8
                        THEN left(fixed, med) ELSE fixed END) AS digest
FROM r JOIN m USING (batch)""")
def truncate_longest_to_median(spark, sf):
    extra = F.repeat(F.lit("a"), (1000 * (F.col("doc_id") % 5)).cast("int"))
    docs = b.documents(spark, sf).select(
        "doc_id", F.floor(F.col("doc_id") / 8).alias("batch"),
        F.when(F.col("doc_id") % 3 == 0, F.concat("text", extra)).otherwise(F.col("text")).alias("text"),
    )
    out = rc.truncate_longest_to_median(docs, order="doc_id")
    return out.select("doc_id", F.md5("text").alias("digest"))


def prompt_records(spark, sf):
    """Cleaned records with everything the prompt mentions."""
    raw = rc.clean_bw(raw_records(spark, sf))
    trait = F.when(F.col("index") % 3 == 0, "dev").when(F.col("index") % 3 == 1, "org")
    return with_score_norm(raw).withColumn("trait", trait)


PROMPT_SQL = RAW + """, pr AS (
  SELECT *, coalesce(min(score) FILTER (split = 'train') OVER w, min(score) OVER w) AS lo,
            coalesce(max(score) FILTER (split = 'train') OVER w, max(score) OVER w) AS hi
  FROM raw WINDOW w AS (PARTITION BY item)),
prompts AS (SELECT index, item, score, split,
  regexp_replace(regexp_replace(
    'Below is one answer written by a learner in grade ' || grade || '.' || chr(10)
    || CASE index % 3 WHEN 0 THEN 'Judge how the ideas are developed.'
                      WHEN 1 THEN 'Judge how the answer is organised.'
                      ELSE 'Judge the answer as a whole.' END || chr(10)
    || 'Task type: ' || long_mode || '. Allowed scores: ' || lo || ' to ' || hi || '.'
    || chr(10) || chr(10) || '--- answer ---' || chr(10) || text || chr(10) || '--- end ---'
    || chr(10) || chr(10) || 'Reply with the score only.',
    '^\\s+|\\s+$', '', 'g'), '\\s{10,}', chr(10) || chr(10), 'g') AS prompt
  FROM pr)"""


@query("render_prompt", f"WITH {PROMPT_SQL} SELECT index, md5(prompt) AS prompt FROM prompts")
def render_prompt(spark, sf):
    df = prompt_records(spark, sf)
    return df.select("index", F.md5(pr.render_prompt(pr.USER_TEMPLATE, df.columns)).alias("prompt"))


@query("infer_target", f"""WITH {RAW}
SELECT index, 'score' AS name, CAST(score AS VARCHAR) AS value, 'NULL' AS missing FROM raw""")
def infer_target(spark, sf):
    df = rc.clean_math(raw_records(spark, sf))
    name = pr.infer_target(pr.ASSISTANT_TEMPLATE)
    absent = pr.infer_target("{{ score }} or {{ verdict }}")
    return df.select(
        "index", F.lit(name).alias("name"), pr.target_value(name, df.columns).alias("value"),
        pr.target_value(absent, df.columns).alias("missing"),
    )


@query("build_payload", f"""WITH {PROMPT_SQL}
SELECT index, 'user' AS role1, md5(prompt) AS content1, 'assistant' AS role2,
       '{{''score'':''' || score || '''}}' AS content2, 'score' AS target_name,
       CAST(score AS VARCHAR) AS target_value FROM prompts""")
def build_payload(spark, sf):
    df = prompt_records(spark, sf)
    p = df.select("index", pr.build_payload(df.columns).alias("p"))
    first, second = F.get("p.messages", 0), F.get("p.messages", 1)
    return p.select(
        "index", first["role"].alias("role1"), F.md5(first["content"]).alias("content1"),
        second["role"].alias("role2"), second["content"].alias("content2"),
        F.col("p.target.name").alias("target_name"), F.col("p.target.value").alias("target_value"),
    )


@query("payload_json", f"""WITH {PROMPT_SQL}, j AS (
  SELECT index, to_json({{'messages': [{{'role': 'user', 'content': prompt}},
      {{'role': 'assistant', 'content': '{{''score'':''' || score || '''}}'}}],
    'target': ['score', CAST(score AS VARCHAR)]}}) AS j FROM prompts)
SELECT index, md5(json_extract_string(j, '$.messages[0].content')) AS content1,
       json_extract_string(j, '$.messages[1].content') AS content2,
       json_extract_string(j, '$.target[1]') AS target FROM j""")
def payload_json(spark, sf):
    df = prompt_records(spark, sf)
    text = df.select("index", pr.payload_json(pr.build_payload(df.columns)).alias("j"))
    back = text.select("index", pr.parse_payload(F.col("j")).alias("p"))
    return back.select(
        "index", F.md5(F.get("p.messages", 0)["content"]).alias("content1"),
        F.get("p.messages", 1)["content"].alias("content2"),
        F.element_at("p.target", -1).alias("target"),
    )


CHAT_TEXT_SQL = b.CHATS + """, full_text AS (
  SELECT conv_id, messages,
    array_to_string(list_transform(messages,
      lambda m: '<|' || m.role || '|>' || chr(10) || m.content || '<|end|>' || chr(10)), '')
    || CASE WHEN messages[-1].role = 'user' THEN '<|assistant|>' || chr(10) ELSE '' END AS t
  FROM chats), targets AS (
  SELECT conv_id, t, list_filter(regexp_split_to_array(messages[-1].content, '\\s+'), lambda x: x <> '')[-1] AS v
  FROM full_text)"""


@query("chat_text", f"""WITH {CHAT_TEXT_SQL}
SELECT conv_id, v AS target, md5(t) AS whole,
  md5(CASE WHEN v IS NULL OR position(reverse(v) IN reverse(t)) = 0 THEN t
           ELSE left(t, length(t) - position(reverse(v) IN reverse(t)) - length(v) + 1) END) AS cut
FROM targets""")
def chat_text(spark, sf):
    last = tx.words(F.element_at("messages", -1)["content"])
    chats = b.chats(spark, sf).withColumn("target", F.try_element_at(last, F.lit(-1)))
    return chats.select(
        "conv_id", "target", F.md5(pr.chat_text(F.col("messages"))).alias("whole"),
        F.md5(pr.chat_text(F.col("messages"), F.col("target"))).alias("cut"),
    )


@query("fallback_prompt", f"""WITH {PROMPT_SQL}
SELECT index, md5('<|user|>' || chr(10) || prompt || '<|end|>' || chr(10)
  || CASE WHEN index % 2 = 0 THEN '<|assistant|>' || chr(10) || '{{''score'':'''
          ELSE '<|assistant|>' || chr(10) || '{{''score'':''' END) AS txt
FROM prompts""")
def fallback_prompt(spark, sf):
    """Even records have a payload, odd ones a broken or missing one."""
    df = prompt_records(spark, sf)
    stored = F.when(F.col("index") % 2 == 0, pr.payload_json(pr.build_payload(df.columns)))
    stored = F.when(F.col("index") % 3 == 1, "{broken").otherwise(stored)
    text = pr.fallback_prompt(F.col("payload"), pr.USER_TEMPLATE, df.columns)
    return df.withColumn("payload", stored).select("index", F.md5(text).alias("txt"))


@query("keep_label_columns", f"""WITH {b.VECTOR_PAIRS}
SELECT diff, idx1 FROM vector_pairs""")
def keep_label_columns(spark, sf):
    return rc.keep_label_columns(b.vector_pairs(spark, sf), ["idx1"])


@query("pair_label", f"""WITH {b.VECTOR_PAIRS}
SELECT idx1, idx2, diff::DOUBLE AS label,
       round(diff / 9.0::DOUBLE, 6) AS norm_label FROM vector_pairs""")
def pair_label(spark, sf):
    df = b.vector_pairs(spark, sf).select(
        "idx1", "idx2", F.when(F.col("idx1") % 2 == 0, F.col("diff")).alias("diff_abs"), "diff",
        normalised(F.col("diff"), F.lit(0), F.lit(9)).alias("diff_norm"),
    )
    return df.select(
        "idx1", "idx2", rc.pair_label(df.columns).alias("label"),
        F.round(rc.pair_label(df.columns, use_diff_norm=True), 6).alias("norm_label"),
    )


@query("common_key_projection", f"""WITH {b.RATINGS}, {b.RESPONSES}
SELECT CAST(item AS VARCHAR) AS item, idx, mode, score FROM ratings
UNION ALL SELECT item, idx, mode, score FROM responses""")
def common_key_projection(spark, sf):
    r = b.ratings(spark, sf).withColumn("item", F.col("item").cast("string"))
    return rc.common_key_projection([r, b.responses(spark, sf)])


@query("union_splits", f"""WITH {b.RATINGS}
SELECT item, split, count(*) AS n, sum(score)::BIGINT AS total FROM ratings GROUP BY ALL""")
def union_splits(spark, sf):
    r = b.ratings(spark, sf)
    both = rc.union_splits(r.where("split = 'train'"), r.where("split = 'valid'"))
    return both.groupBy("item", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@query("union_configs", f"""WITH {b.RATINGS}, {b.VECTORS}
SELECT config, count(*) AS n, sum(score)::BIGINT AS total FROM (
  SELECT 'ratings' AS config, score FROM ratings UNION ALL SELECT 'vectors', score FROM vectors)
GROUP BY config""")
def union_configs(spark, sf):
    both = rc.union_configs({"ratings": b.ratings(spark, sf), "vectors": b.vectors(spark, sf)})
    return both.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
