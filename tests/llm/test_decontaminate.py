import random

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import decontaminate as dc


def least_edits(item, words):
    """Least edits from the item to any stretch of the words, cell by cell."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(words):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def brute(rows, items):
    out = {}
    for d, text in rows:
        for i, item in items:
            a, b = (item or "").lower().split(), (text or "").lower().split()
            if a:
                n = least_edits(a, b)
                if n <= int(dc.MAX_SHARE * len(a)):
                    out[d, i] = n
    return out


def mutate(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = f"x{rng.randrange(999)}"
        elif kind == 1 and len(words) > 1:
            del words[k]
        else:
            words.insert(k, f"y{rng.randrange(999)}")
    return words


def prose(rng, n):
    return [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(n)]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 9))]
        b = [rng.randrange(5) for _ in range(rng.randrange(0, 14))]
        d, x, y = dc.edit_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert d == least_edits(a, b)
        assert d == min(least_edits(a, b[x:y]), len(a))


def planted(seed, edits):
    rng = random.Random(seed)
    items = [(i, " ".join(prose(rng, rng.randrange(14, 60)))) for i in range(40)]
    rows = []
    for d in range(240):
        words = prose(rng, rng.randrange(0, 300))
        item = items[d % 40][1].split()
        at = rng.randrange(len(words) + 1)
        part = mutate(rng, item, edits(rng, len(item)))
        rows.append((d, " ".join(words[:at] + part + words[at:])))
    return rows, items


@pytest.mark.parametrize("share, recall", [(0.0, 1.0), (0.05, 0.98), (0.1, 0.95), (0.15, 0.9)])
def test_recall_and_no_false_match(spark, docs_of, share, recall):
    rows, items = planted(int(share * 100), lambda rng, n: int(share * n))
    want = brute(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): r["distance"] for r in dc.find_matches(docs_of(rows), bench).collect()}
    assert set(got) <= set(want)
    assert len(got) >= recall * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def test_blocks_give_the_same(spark, docs_of):
    rows, items = planted(1, lambda rng, n: 0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in dc.find_matches(docs_of(rows), bench).collect()}
    many = {tuple(r) for r in dc.find_matches(docs_of(rows), bench, block_words=300).collect()}
    assert one == many and len(one) >= 240


def test_edges(spark, docs_of):
    bench = spark.createDataFrame(
        [(1, "One two three"), (2, "one TWO three"), (3, None), (4, "  "), (5, "solo"), (None, "four five six")],
        "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "zero one two\nthree four"), (3, "zero one two\nthree four"), (4, "one two"), (None, "a four five six")]
    got = sorted((str(r["id"]), str(r["item_id"]), r["first_word"], r["end_word"])
                 for r in dc.find_matches(docs_of(rows), bench).collect())
    assert got == [("3", "1", 1, 4), ("3", "1", 1, 4), ("3", "2", 1, 4), ("3", "2", 1, 4), ("None", "None", 1, 4)]
    kept = dc.drop_contaminated(docs_of(rows), bench)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 2, 4]
    assert kept.columns == docs_of(rows).columns
    assert dc.find_matches(docs_of([]), bench).count() == 0
    assert dc.find_matches(docs_of(rows), bench.limit(0)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(dc, "PIECE", 50)
    rng = random.Random(9)
    item = prose(rng, 20)
    text = prose(rng, 5000) + item + prose(rng, 100)
    finder = dc.Finder(dc.build_index([4], [" ".join(item)]))
    cut = dc.Words(pa.array([" ".join(text)]))
    assert finder.find(cut.hash, cut.first) == [(0, 0, 0, 5000, 5020)]
