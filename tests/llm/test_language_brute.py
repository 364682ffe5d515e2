"""The query of language identification against the same rules written once more in plain Python."""

import collections
import math
import zlib

from pyspark.sql import functions as F

from scoreloom.llm import language_id, queries

MASK = 0xFFFFFFFF


def grams(text):
    """Bucket -> count of the 1- to 3-grams of letters, or None without a letter."""
    out = []
    for ch in text.lower():
        if ch.isalpha():
            out.append(ord(ch))
        elif out and out[-1] != 32:
            out.append(32)
    if not out:
        return None
    padded = [32, *out, 32]
    found = collections.Counter()
    for i in range(len(padded)):
        for n in (1, 2, 3):
            if i + n <= len(padded):
                key = 0
                for code in padded[i:i + n]:
                    key = (key * 0x01000193 + code * 0x9E3779B1) & MASK
                found[(((key ^ (key >> 15)) * 0x85EBCA6B) & MASK) >> 19] += 1
    return found


def sign(row, column):
    """An entry of the Hadamard matrix."""
    return -1 if bin(row & column).count("1") % 2 else 1


def learn(rows):
    sums = {}
    for text, lang in rows:
        found = grams(text) if text is not None and lang is not None else None
        if found is not None:
            root = math.sqrt(sum(found.values()))
            table = sums.setdefault(lang, collections.Counter())
            for bucket, n in found.items():
                table[bucket] += n / root
    languages = sorted(sums)
    shares = []
    for lang in languages:
        rounded = {b: round(n, 3) for b, n in sums[lang].items()}
        total = sum(rounded.values())
        shares.append({b: n / total for b, n in rounded.items()})
    return languages, shares


def decide(text, languages, shares):
    found = None if text is None else grams(text)
    if found is None or not languages:
        return "und", 0.0, True
    bits = []
    for column in range(1, language_id.BITS + 1):
        sides = {s: [i for i in range(len(languages)) if sign(i, column) == s] for s in (1, -1)}
        if not sides[1] or not sides[-1]:
            continue
        margin = 0.0
        for bucket, n in found.items():
            one, zero = (sum(shares[i].get(bucket, 0.0) for i in sides[s]) / len(sides[s]) + 1e-6 for s in (1, -1))
            margin += n * (math.log(one) - math.log(zero))
        bits.append((column, margin * language_id.MARGIN_SCALE / sum(found.values())))
    weight = sum(abs(math.tanh(m)) for _, m in bits)
    losses = [
        sum(math.log1p(math.exp(-min(max(sign(i, c) * m, -30), 30))) * abs(math.tanh(m)) for c, m in bits) / weight
        for i in range(len(languages))]
    best = min(range(len(losses)), key=lambda i: losses[i])
    score = 1 / sum(math.exp(-2 * (x - losses[best])) for x in losses)
    gap = sorted(losses)[1] - losses[best]
    return languages[best], score, score < language_id.MIN_SCORE or gap < language_id.MIN_GAP


def test_query_as_plain_python(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 900").orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in source.limit(90).collect()]
    assert len({lang for _, _, lang in rows if lang}) >= 3
    last = max(r[0] for r in rows)
    extra = [None, "", "12 34 !?", "é", "the the the", "ÀÉÎ straße ΣΑΣ", rows[0][1], "a" * 4000, "x1y2z3 " * 50]
    rows += [(last + 1 + k, text, "en" if k % 2 else None) for k, text in enumerate(extra)]
    rows += [rows[1], (None, rows[2][1], rows[2][2])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 3 == 1

    languages, shares = learn([(t, lang) for i, t, lang in rows if not held(i)])
    found = queries.op5(spark, str(tmp_path)).collect()
    want = collections.Counter()
    for i, text, _ in rows:
        lang, score, ambiguous = decide(text, languages, shares)
        want[i, held(i), lang, round(score, 6), ambiguous] += 1
    got = collections.Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6), r["ambiguous"]) for r in found)
    assert got == want
