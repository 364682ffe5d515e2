import random
import re

from pyspark.sql import functions as F

from scoreloom.llm import language_id, queries, substring_dedup, url_filter


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op5(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows) > 200
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {queries.fold(r["doc_id"]) for r in rows} == {1}


def test_language_edges(docs_of):
    train = docs_of([(1, "the cat and the dog"), (2, "le chat et les chiens"), (3, "die Katze und der Hund"), (4, None)], False).withColumn(
        "lang", F.expr("element_at(array('en', 'fr', 'de', null), int(doc_id))"))
    model = language_id.fit(train)
    rows = [(1, None), (2, ""), (3, "123 !? ..."), (4, "the dog and cat"), (5, "les chats et le chien"), (6, "x" * 3_000_000), (4, "the dog and cat")]
    out = language_id.identify(docs_of(rows), model).collect()
    assert len(out) == 7
    for r in out:
        if r["doc_id"] <= 3:
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
    assert {r["lang_pred"] for r in out if r["doc_id"] == 4} == {"en"} and {r["lang_pred"] for r in out if r["doc_id"] == 5} == {"fr"}
    none = language_id.fit(train.where("lang IS NULL"))
    assert {r["lang_pred"] for r in language_id.identify(docs_of(rows), none).collect()} == {"und"}
    one = language_id.fit(train.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.identify(docs_of(rows), one).collect()} == {"und", "en"}
    assert language_id.identify(docs_of([]), model).count() == 0


def test_codewords_stand_apart():
    for n in (2, 4, 9, 15, 40):
        c = language_id.codewords(n)
        distance = [(a != b).sum() for i, a in enumerate(c) for b in c[:i]]
        assert len(c) == n and min(distance) >= 8


RULES = queries.URL_RULES


def urls(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("_w0", F.lit(2)).withColumn("_hit", F.lit(3))


def test_rules_and_list(spark):
    rows = [
        (1, "http://A.Example.org/es/x"), (2, "https://example.org/en/12?x"), (3, "https://example.org/en/2"), (4, "http://notexample.org"),
        (5, "http://x.com/fr/"), (6, "http://x.com/de/"), (7, "http://www.bad.net/p/?utm_source=a&b=2&a=1#t"), (8, "https://bad.net:80/p?a=1&b=2"),
        (9, "http://bad.net/p"), (10, None), (11, "no scheme"), (12, "http://"), (7, "http://www.bad.net/p/?utm_source=a&b=2&a=1#t"), (13, "ftp://com/de/x\ny"),
    ]
    listed = urls(spark, [(0, "http://m.bad.net/p?b=2&a=1"), (1, None), (2, "zzz")])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["listed"], r["verdict"]) for r in url_filter.filter_urls(urls(spark, rows), listed, RULES).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", False, "block")
    assert got[2][2:] == ("example.org/en/1", False, "block") and got[3][2:] == ("org/", False, "allow")
    assert got[4] == ("notexample.org", "", None, False, "allow")
    assert got[5][2:] == ("com/fr/", False, "allow") and got[6][2:] == ("com/de/", False, "block")
    assert got[7][4] == got[8][4] == "block" and got[9][4] == "allow"
    assert got[10] == got[11] == ("", "", None, False, "allow") and got[12][0] == ""
    assert got[13] == ("com", "/de/x\ny", "com/de/", False, "block")
    assert url_filter.filter_urls(urls(spark, rows), listed, RULES).count() == len(rows)
    assert url_filter.filter_urls(urls(spark, rows), listed.limit(0), []).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(urls(spark, []), listed, RULES).count() == 0


def test_bloom_filter_passes_all_listed_and_few_others(spark, monkeypatch):
    listed = spark.range(3000).select(F.concat(F.lit("l"), "id").alias("u"))
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, F.concat(F.lit("l"), "id")).otherwise(F.concat(F.lit("o"), "id")).alias("k"))
    for most in (url_filter.MAX_BLOCKS, 4):      # also far too few blocks
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
        assert {r["k"] for r in url_filter.listed_rows(rows, "k", listed, "u").collect()} == {f"l{i}" for i in range(3000)}


def brute_removed(rows, least):
    seen, out = set(), {}
    for i, text in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0)):
        spans, run = [], []
        for a, b, norm, words in substring_dedup.cut_units(text):
            has = any(c.isalnum() for c in norm)
            if has and norm in seen:
                run.append((a, b, words))
            else:
                spans.append(run)
                run = []
            if has:
                seen.add(norm)
        spans.append(run)
        out[i, text] = [(r[0][0], r[-1][1]) for r in spans if r and sum(x[2] for x in r) >= least]
    return out


def test_substrings_as_a_single_pass(docs_of):
    rng = random.Random(8)
    sentences = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 12))) + rng.choice([".", "!", "?"]) for _ in range(60)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(sentences) for _ in range(rng.randrange(12)))) for i in range(50)]
    passage = " ".join(f"p{k} q{k} r{k} s{k} t{k}." for k in range(12))
    rows += [(100, f"start of text {passage} and the end"), (101, f"Another begin {passage.upper()} other end\n..."), (102, None), (103, ""), (104, "..."), (None, passage), (100, rows[0][1]), (7, rows[7][1])]
    want = brute_removed(rows, substring_dedup.MIN_WORDS)
    out = substring_dedup.dedup_substrings(docs_of(rows).withColumn("before", F.col("text"))).collect()
    assert len(out) == len(rows)
    for r in out:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert spans == want.get((r["doc_id"], r["before"]), [])
        if r["before"] is not None:
            keep, at = "", 0
            for a, b in spans:
                keep, at = keep + r["before"][at:a], b
            assert r["text"] == keep + r["before"][at:]
    assert want[101, rows[51][1]] and want[100, rows[50][1]]
    assert substring_dedup.dedup_substrings(docs_of([])).count() == 0


def brute_passages(rows, least, wide):
    """Spans by looking at every window of words, and at units in order with blank ones passed over."""
    seen_units, seen, out = set(), set(), {}
    for i, text in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0)):
        spans, run = [], []
        for a, b, norm, words in [*((u for u in substring_dedup.cut_units(text) if any(map(str.isalnum, u[2])))), (0, 0, None, 0)]:
            if norm in seen_units:
                run.append((a, b, words))
            else:
                if run and sum(x[2] for x in run) >= least:
                    spans.append((run[0][0], run[-1][1]))
                run = []
            seen_units |= {norm} - {None}
        found = list(re.finditer("[^ \\t-\\r]+", text))
        words = [m.group().lower() for m in found]
        for k in range(len(words) - wide + 1):
            key = tuple(words[k:k + wide])
            if key in seen:
                spans.append((found[k].start() if k else 0, found[k + wide].start() if k + wide < len(found) else len(text)))
            seen.add(key)
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out[i, text] = merged
    return out


def test_passages_glued_at_both_ends(docs_of):
    rng = random.Random(9)
    prose = lambda n, v=4000: " ".join(f"w{rng.randrange(v)}é" for _ in range(n))
    bare, ended = prose(61), ". ".join(prose(20) for _ in range(4)) + "."
    rows = [(1, f"{prose(30)} {bare} {prose(40)}"), (2, f"{prose(9)} {bare.upper()} {prose(70)}"), (3, f" \n{bare}"), (4, f"{prose(80)} {bare}"),
            (5, f"{prose(20)} {ended} {prose(30)}"), (6, f"{prose(33)}\n{ended} {prose(12)}"), (7, "x " * 120), (8, prose(300)), (9, None), (10, "")]
    rows += [(20 + k, " ".join([prose(rng.randrange(9)), *rng.choices(bare.split()[:56] + bare.split()[:3], k=3), bare[k:], prose(rng.randrange(60))])) for k in range(0, 60, 7)]
    rows += [(40 + k, prose(200, 2)) for k in range(3)] + [(50, rows[7][1]), (51, rows[7][1][:500] + " changed " + rows[7][1][500:]), (None, rows[0][1]), (1, rows[0][1])]
    short = "a b c d e f g h.\n...\nA b c d e f g i."
    rows += [(60, short), (61, short), (62, "İ ẞ " + prose(3) + " " + bare + " tail")]
    want = brute_passages(rows, substring_dedup.MIN_WORDS, 50)
    out = substring_dedup.dedup_passages(docs_of(rows).withColumn("before", F.col("text"))).collect()
    assert len(out) == len(rows)
    for r in out:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert spans == want.get((r["doc_id"], r["before"]), []), r["doc_id"]
    texts = {r["doc_id"]: r["text"] for r in out}
    assert texts[3] == "" and bare.lower() not in texts[2].lower() and len(texts[4].split()) == 80 and texts[61] == ""
    assert len(texts[6].split()) == 45 and texts[7] == "x "
    assert substring_dedup.dedup_passages(docs_of([])).count() == 0
