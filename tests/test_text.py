"""String functions against plain Python."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.functions import prompts as pr
from scoreloom.functions import text as tx
from scoreloom.functions.itemexpr import item_filter

TEXTS = [
    "", " ", "one", "  two words ", "a b c", "x\x1cy\x1fz", "tab\tand\nline\r\n", "　wide　",
    "aaaaaaaaa", "aaaaaaaaaa", "b" * 25 + "cc" + "d" * 10, "é" * 12, "line\n" * 3 + "\n" * 14 + "end",
    "  " + " " * 10 + "x" + "\t" * 11 + "y" + " " * 9 + "z\n\n", "😀" * 11 + "ok", "abab" * 5, "$1 $1 \\1",
]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def first_longest_run(s):
    best = ""
    for m in re.finditer(r"(.)\1*", s, re.S):
        best = m[0] if len(m[0]) > len(best) else best
    return best


def shorten_runs(s, least=10):
    while len(run := first_longest_run(s)) >= least:
        s = s.replace(run, run[:2])
    return s


def test_whitespace_functions(spark):
    df = frame(spark, TEXTS)
    assert column(df, tx.word_count("t")) == [len(t.split()) for t in TEXTS]
    assert column(df, tx.words("t")) == [t.split() for t in TEXTS]
    assert column(df, tx.strip("t")) == [t.strip() for t in TEXTS]
    assert column(df, tx.reduce_whitespace("t")) == [re.sub(r"\s{10,}", "\n\n", t.strip()) for t in TEXTS]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab \n ", max_size=40), min_size=20, max_size=60))
def test_runs(spark, drawn):
    values = TEXTS + drawn + ["".join(c * (3 + len(d)) for c in d) for d in drawn]
    df = frame(spark, values)
    assert column(df, tx.longest_char_run("t")) == [first_longest_run(t) for t in values]
    assert column(df, tx.collapse_runs("t")) == [shorten_runs(t) for t in values]
    assert column(df, tx.collapse_runs("t", 4)) == [shorten_runs(t, 4) for t in values]


def test_long_run_does_not_overflow(spark):
    df = frame(spark, ["x" * 200_000 + "y"])
    assert column(df, F.length(tx.longest_char_run("t"))) == [200_000]
    assert column(df, tx.collapse_runs("t")) == ["xxy"]


def test_cut_before_last(spark):
    cases = [("score 3 of 3 end", "3"), ("none here", "7"), ("baaa", "aa"), ("aa", "aa"), ("x", "xyz"),
             ("1.5 and 15", "1.5"), ("éaéb", "é"), ("abc", "")]
    df = spark.createDataFrame(cases, "t string, v string")
    want = [t.rsplit(v, 1)[0] if v else t for t, v in cases]
    assert column(df, tx.cut_before_last(F.col("t"), F.col("v"))) == want


@pytest.mark.parametrize("rule", [
    "n%2!=0", "n % 3 == 0 and n > 10", "not n < 5 or n == 2", "5 <= n < 9", "(n + 1) * 2 // 3 == 4",
    "n % 3", "-n % 4 == 1", "n / 2 > 3.5",
])
def test_item_filter_equals_python(spark, rule):
    values = list(range(-12, 30))
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    got = [r["n"] for r in df.where(item_filter(rule, F.col("n"))).collect()]
    assert got == [n for n in values if eval(rule, {"__builtins__": {}}, {"n": n})]


@pytest.mark.parametrize("rule", ["__import__('os')", "m > 3", "n.real", "[n]", "n if n else 1", "n > 'a'"])
def test_item_filter_refuses(rule):
    with pytest.raises(ValueError):
        item_filter(rule, F.col("n"))


TEMPLATE = "Grade {{ grade }}:{% if trait == 'dev' %}D{% elif trait == \"org\" %}O{% else %}E{% endif %} {{who}} {{ gone }}!"


def test_template(spark):
    df = spark.createDataFrame([(3, "dev", "a"), (4, "org", "b"), (5, None, "c"), (6, "con", None)],
                               "grade int, trait string, who string")
    got = column(df, pr.compile_template(TEMPLATE, df.columns, {"who": "unused", "gone": "G"}))
    assert got == ["Grade 3:D a G!", "Grade 4:O b G!", "Grade 5:E c G!", "Grade 6:E  G!"]
    nested = "{% if trait == 'dev' %}{% if who == 'a' %}1{% endif %}2{% endif %}3"
    assert column(df, pr.compile_template(nested, df.columns)) == ["123", "3", "3", "3"]


@pytest.mark.parametrize("bad", ["{% if x == 'a' %}", "{% for x in y %}{% endfor %}", "a{% endif %}"])
def test_template_refuses(spark, bad):
    with pytest.raises(ValueError):
        pr.compile_template(bad, ["x"])


def test_payload_round_trip(spark):
    df = spark.createDataFrame([(1, "say \"hi\"\né", 2)], "grade int, text string, score int")
    payload = pr.build_payload(df.columns, "{{ text }} / {{ grade }}", "{'score':'{{ score }}'}")
    row = df.select(pr.payload_json(payload).alias("j")).head()["j"]
    assert json.loads(row) == {
        "messages": [{"role": "user", "content": "say \"hi\"\né / 1"},
                     {"role": "assistant", "content": "{'score':'2'}"}],
        "target": ["score", "2"],
    }


def test_target_missing_from_the_record(spark):
    df = spark.createDataFrame([("x",)], "text string")
    p = df.select(pr.build_payload(df.columns).alias("p")).head()["p"]
    assert p["target"]["value"] == "NULL"
    assert p["messages"][1]["content"] == "{'score':'NULL'}"


def test_chat_text_and_fallback(spark):
    df = spark.createDataFrame(
        [('{"messages":[{"role":"user","content":"q 2"},{"role":"assistant","content":"{\'score\':\'2\'}"}],'
          '"target":["score","2"]}', "t1"), ("{oops", "t2"), (None, "t3")], "payload string, text string")
    got = column(df, pr.fallback_prompt(F.col("payload"), "P {{ text }}", df.columns))
    assert got[0] == "<|user|>\nq 2<|end|>\n<|assistant|>\n{'score':'"
    assert got[1] == "<|user|>\nP t2<|end|>\n<|assistant|>\n{'score':'"
    assert got[2] == "<|user|>\nP t3<|end|>\n<|assistant|>\n{'score':'"
