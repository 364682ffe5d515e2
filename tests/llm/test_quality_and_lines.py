import collections
import random
import re

from pyspark.sql import functions as F

from scoreloom.llm import line_winnow, quality_cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    t = text or ""
    words = WORD.findall(t)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n\t ", "one", "the cat and the dog sat on a mat by the door",
    "a b c d e f a b c d e f a b", "x " * 300, "the " + "é中 " * 40, "\x0b\x0c\rtab\tnl\nnl\n\nnl", "# * $ % & | < > the of and to in " * 3,
    "...\n…\n- a\n* b\n• c", "the   nbsp   wide", "a\x1cb the",
]


def test_measures_and_order_of_rules(docs_of):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(80))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (4, TEXTS[4])]
    df = docs_of(rows).withColumn("n_words", F.lit("clash"))
    results = []
    names = list(quality_cascade.rules())
    for order in (names, names[::-1], None):
        out = quality_cascade.quality_cascade(df, order=order).collect()
        assert len(out) == len(rows)
        for r in out:
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert got == measures(r["text"]), r["text"]
            n, rep = got[0], got[4]
            assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
            assert r["kept"] == (r["failed_rule"] is None) and (not r["base_failed"] or not r["kept"])
        results.append(sorted((r["doc_id"], r["kept"]) for r in out))
    assert results[0] == results[1] == results[2]


def test_filter_on_the_verdict(docs_of):
    rows = [(1, "the cat and the dog sat on a mat by the door"), (2, "no")]
    kept = quality_cascade.quality_cascade(docs_of(rows), order=list(quality_cascade.rules())).where("kept")
    assert [r["doc_id"] for r in kept.collect()] == [1]
    assert quality_cascade.quality_cascade(docs_of([])).count() == 0


def test_rules_with_most_rejections_per_second_come_first():
    assert quality_cascade.order_rules({"a": (2.0, 0.5), "b": (0.1, 0.1), "c": (1.0, 0.0)}) == ["b", "a", "c"]


def brute_lines(rows, run, words=line_winnow.WORDS):
    """Delete lines in runs that occurred before and are long enough, by looking at runs of every length."""
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    seen, out = set(), {}
    for place in order:
        lines = place[2].split("\n")
        full = [(k, x.strip(" \t\r")) for k, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                if b - a < run and sum(len(WORD.findall(x)) for _, x in full[a:b]) < words:
                    continue
                key = tuple(x for _, x in full[a:b])
                if key in seen:
                    gone |= {k for k, _ in full[a:b]}
                seen.add(key)
                if b - a >= run:
                    break
        out[place[1] if place[0] else None, place[2]] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return sorted((str(i), t, None if t is None else out[i, t]) for i, t in rows)


def test_same_as_every_run(docs_of):
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(25)] + ["six words are in this line", "and seven words are in this one", "x " * 9]
    rows = [(i, "\n".join(rng.choice(pool + ["", "  "]) for _ in range(rng.randrange(25)))) for i in range(60)]
    block = "\n".join(f"shared {k}" for k in range(7))
    rows += [(100 + i, f"own {i}\n{block}\n  tail {i}") for i in range(20)]
    rows += [(200, None), (201, ""), (202, "a\na\na\na\na\na"), (203, "one\ntwo"), (204, "one\ntwo"), (None, block), (60, rows[3][1]), (60, rows[3][1])]
    df = docs_of([r for r in rows])
    for run, words in ((2, 50), (3, 50), (3, 7), (3, 9), (4, 6), (1, 50)):
        out = line_winnow.dedup_lines(df.withColumn("before", F.col("text")), run=run, words=words)
        assert sorted((str(r["doc_id"]), r["before"], r["text"]) for r in out.collect()) == brute_lines(rows, run, words)
    assert line_winnow.dedup_lines(docs_of([])).count() == 0


def test_lines_of_fifty_words_go_alone_or_in_pairs(docs_of):
    long, half, short = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(25)), " ".join(f"c{k}" for k in range(24))
    rows = [(1, f"{long}\nhead"), (2, f"own\n\n {long} \nown too"), (3, f"{half}\n{half}"), (4, f"{half}\nx\n{half}\n{half}"),
            (5, f"{half}\n{short}\ny"), (6, f"{half}\n{short}\nz"), (7, f"{long}\nhead")]
    out = {r["doc_id"]: r["text"] for r in line_winnow.dedup_lines(docs_of(rows)).collect()}
    assert out == {1: rows[0][1], 2: "own\n\nown too", 3: rows[2][1], 4: f"{half}\nx", 5: rows[4][1], 6: rows[5][1], 7: ""}


def test_only_selected_places_become_rows(docs_of):
    text = "\n".join(f"line {k}" for k in range(1000))
    prints = line_winnow.fingerprints(docs_of([(1, text), (2, "other\n" + text)])).collect()
    places = {i: {r["at"] for r in prints if r["id"] == i} for i in (1, 2)}
    assert 400 < len(places[1]) < 600 and len(prints) == len(places[1]) + len(places[2])
    assert {p + 1 for p in places[1]} <= places[2]                     # the same lines, up to the foreign edge
    assert all(b - a <= 3 for a, b in zip(sorted(places[1]), sorted(places[1])[1:]))


def test_long_text_and_filter(docs_of):
    text = "\n".join(f"line {k}" for k in range(20_000))
    out = line_winnow.dedup_lines(docs_of([(1, text), (2, text + "\nlast")]), removed="gone").where("text != 'x'")
    assert {r["doc_id"]: (len(r["gone"]), len(r["text"].split("\n"))) for r in out.collect()} == {1: (0, 20_000), 2: (20_000, 1)}
