import itertools
import random
import re

import pytest

from scoreloom.llm import ngram_join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    """(id -> (group, links, copies)) by comparing all different sets."""
    sets = {i: shingle_set(t) for i, t in rows}
    classes = {}
    for i, s in sets.items():
        classes.setdefault(s or i, []).append(i)
    keys = list(classes)
    links, parent = {k: 0 for k in keys}, {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations([k for k in keys if isinstance(k, frozenset)], 2):
        if len(a & b) >= 0.8 * len(a | b):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    group = {}
    for k in keys:
        group.setdefault(find(k), []).extend(classes[k])
    return {i: (min(group[find(k)]), links[k], len(classes[k])) for k in keys for i in classes[k]}


def run(df):
    return {r["id"]: (r["group_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(df).collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("chunk", [512, 8])
def test_same_as_all_pairs(docs_of, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = random.Random(5)
    rows = []
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 300]))]
        for k in range(14):
            rows.append((len(rows), edited(rng, words, rng.choice([0, 0, 1, 2, 3, 6]))))
    rows += [(1000, ""), (1001, None), (1002, " \n "), (1003, "a b"), (1004, "A  b"), (1005, "a b c d"), (1006, "a")]
    assert run(docs_of(rows)) == brute(rows)


def test_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark.read.parquet(f"{sf}/documents.parquet")) == brute(rows)


def test_first_of_each_group_stays(docs_of):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text), (1, text), (2, text + " end"), (9, None), (9, None), (8, ""), (7, "other text"), (7, "other text")]
    kept = ngram_join.drop_near_duplicates(docs_of(rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, text), (7, "other text"), (8, ""), (9, None)]
    assert kept.columns == docs_of(rows).columns


def test_empty_table(docs_of):
    assert ngram_join.near_duplicates(docs_of([])).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert all(m < 0.8 * n for n, m in least.items()) and least[96] > 48
