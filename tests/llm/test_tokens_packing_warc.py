import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import packing, token_counts, warc
from scoreloom.session import scratch_path


def brute_counts(text, spans):
    """Tokens of each section by trying all sections for every token."""
    encoding, sizes = token_counts._encoding(token_counts.default_vocabulary(), token_counts.split_pattern())
    data = text.encode()
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    order = sorted(range(len(spans)), key=lambda k: spans[k][0])
    own, done = {}, 0
    for k in order:
        a, b = (min(max(x, 0), len(text)) for x in spans[k])
        if b > a:
            own[k] = (max(at[a], done), at[b])
            done = max(done, at[b])
    counts, outside, begin = [0] * len(spans), 0, 0
    for token in encoding.encode_ordinary(text):
        end = begin + int(sizes[token])
        held = [(min(end, b) - max(begin, a), -a, k) for k, (a, b) in own.items() if min(end, b) > max(begin, a)]
        if held:
            counts[max(held)[2]] += 1
        else:
            outside += 1
        begin = end
    assert begin == len(data)
    return counts, outside


def test_attribution(spark):
    rng = random.Random(2)
    texts = ["", "Hello world, hello.", "é" * 30 + "中文字 test", "a  b\n\n  c\r\n\tdone!", "<|endoftext|> plain", "x" * 5000, "emoji 😀😀 end"]
    rows = []
    for i in range(120):
        t = rng.choice(texts)
        spans = [(rng.randrange(-3, 40), rng.randrange(-3, 60)) for _ in range(rng.randrange(5))]
        rows.append((i, t, spans))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>").withColumn("n_tokens", F.lit("x"))
    out = {r["doc_id"]: r for r in token_counts.count_tokens(df, "parts").collect()}
    for i, t, spans in rows:
        want, outside = brute_counts(t, spans)
        assert (out[i]["section_tokens"], out[i]["outside_tokens"]) == (want, outside)
        assert out[i]["n_tokens"] == sum(want) + outside


def test_lines_and_edges(docs_of, spark):
    rows = [(1, None), (2, ""), (3, "one\ntwo three\n"), (3, "one\ntwo three\n"), (None, "\n\n")]
    out = token_counts.count_tokens(docs_of(rows)).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["outside_tokens"], tuple(r["section_tokens"])) for r in out)
    assert got == [("1", 0, 0, ()), ("2", 0, 0, (0,)), ("3", 5, 2, (1, 2, 0)), ("3", 5, 2, (1, 2, 0)), ("None", 1, 1, (0, 0, 0))]
    odd = spark.createDataFrame([(1, "ab cd", None), (2, "ab cd", [None, {"start": None, "end": 3}, {"start": 0, "end": 5}])],
                                "doc_id long, text string, s array<struct<start:int,end:int>>")
    assert {r["doc_id"]: r["section_tokens"] for r in token_counts.count_tokens(odd, "s").collect()} == {1: [], 2: [0, 0, 2]}
    assert token_counts.count_tokens(docs_of([])).count() == 0


ODD_TEXTS = [
    "ÀÉ Straße ʼn İx Σας ΑΣ. a\tb\r\nc\x1cd", "<|endoftext|> x<|startoftext|>", "éa", "it's they'RE I'd '' 'S", "x y\u0085q\xa0z",
    "1234 ½ ²  𝕏 日本語", "don’t…—", "ſ'ſ ŉ'll", "a'ſ 'LL'd ª º µ", "", " ", "\n\n", "x" * 500, "Ǆ ǅ Ⱥ ɏ ×÷",
]


def ids_of(text):
    tokenizer = packing._encoder(packing.default_vocabulary()).tokenizer
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_gives_the_tokenizers_ids(spark):
    encoder = packing.WordEncoder(packing.default_vocabulary())
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts * 2:
        assert encoder.encode(text) == np.array(ids_of(text)[:-1], dtype="<u4").tobytes()


def check_packing(rows, out, capacity):
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for i, text in rows:
        ids = np.array(ids_of(text), dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at: at + capacity]
            want.append((str(i), k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_packs_everything_into_few_sequences(spark, docs_of):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t) for i, t in enumerate(texts + ODD_TEXTS)] + [(0, texts[0]), (None, None), (7, "same"), (8, "same")]
    for capacity in (4096, 64):
        used, least = check_packing(rows, packing.pack(docs_of(rows), capacity=capacity).collect(), capacity)
        assert used <= least * 1.02 + 1
    assert packing.pack(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = [4096, 100, 64, 7][seed]
    counts = np.bincount(np.minimum(rng.pareto(1.2, 5000) * capacity / 9 + 1, capacity).astype(int), minlength=capacity + 1)
    if seed == 3:
        counts[4] += 10**9
    plan = packing.round_plan(counts, capacity)
    got = np.zeros_like(counts)
    for config, times in plan:
        assert sum(a * b for a, b in config.items()) <= capacity and times > 0
        for a, b in config.items():
            got[a] += b * times
    assert (got == counts).all()
    lp = sum(x for _, x in packing.solve_lp(counts, capacity))
    best = sum(t for _, t in packing.best_fit(counts, capacity))
    assert sum(t for _, t in plan) <= 1.005 * best + 1 and lp <= 1.01 * best + 1


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 12, 4))[::-1]
        worth, most, capacity = rng.random(len(sizes)), rng.integers(1, 4, len(sizes)), int(rng.integers(1, 25))
        config = packing.price(sizes, worth, most, capacity)
        grids = np.meshgrid(*[np.arange(m + 1) for m in most], indexing="ij")
        size = sum(g * s for g, s in zip(grids, sizes))
        best = np.where(size <= capacity, sum(g * w for g, w in zip(grids, worth)), 0).max()
        value = dict(zip(sizes.tolist(), worth))
        assert sum(k * b for k, b in config.items()) <= capacity
        assert sum(value[k] * b for k, b in config.items()) == pytest.approx(best)


@pytest.mark.parametrize("lengths, times, least", [
    ((2049, 1365, 680), (3000, 3000, 3000), 3000),      # no sequence holds two of the longest
    ((1500, 1298), (2000, 4000), 2000),                 # tokens of 2000 full sequences
    ((2049, 1365, 680), (3000, 1000, 5000), 3000),
    ((2100, 1996, 1100, 896), (700, 1700, 500, 500), 1200 + 250),
])
def test_few_hot_lengths_come_near_the_bound(lengths, times, least):
    counts = np.zeros(4097, dtype=np.int64)
    counts[list(lengths)] = times
    plan = packing.round_plan(counts, 4096)
    assert sum(t for _, t in plan) <= least * 1.005 + 1
    assert sum(x for _, x in packing.solve_lp(counts, 4096)) <= least * 1.01
    for a, n in zip(lengths, times):
        assert sum(t * c.get(a, 0) for c, t in plan) == n


PAGES = [
    (1, "http://a/1", "<p>" + "long " * 40), (2, "http://a/2", "<p>" + "long " * 40), (3, "http://a/3", "short"), (4, "http://a/4", "short"),
    (5, None, None), (6, "http://a/6\r\nX: y", ""), (7, "http://a/é", "é" * 100_000), (0, "http://a/0", "<p>" + "long " * 40), (8, "http://a/8", "WARC/1.1\r\n\r\n\r\n" * 20),
    (3, "http://a/3", "short"),
]


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("size", F.lit(2))
    warc.write_warc(warc.page_records(pages.repartition(3)), path)
    return path


def test_round_trip(spark, archive):
    rows = {}
    for r in warc.read_warc(spark, archive).collect():
        rows.setdefault(int(r["record_id"].split(":")[-1][:-1]), []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    for i, url, html in PAGES:
        r, data = rows[i][0], (html or "").encode()
        assert r["payload_digest"] == "sha256:" + hashlib.sha256(data).hexdigest() and int(r["full_length"]) == len(data)
        again = i in (1, 2)
        assert (r["record_type"], r["refers_to"]) == (("revisit", "<urn:page:0>") if again else ("response", None))
        assert bytes(r["payload"]) == (b"" if again else data)
        assert r["target_uri"] == (url if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))


def test_pushdown_and_pruning(spark, archive, monkeypatch):
    df = warc.read_warc(spark, archive, ["record_id", "record_type"]).where("record_type = 'revisit' AND record_id LIKE '<urn:page:%'")
    assert sorted(r["record_id"] for r in df.collect()) == ["<urn:page:1>", "<urn:page:2>"]
    reader = warc.WarcReader(archive, ["record_id"], 1 << 20)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.In(("date",), (warc.DATE,)), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and len(reader.tests) == 2
    monkeypatch.setattr(warc.Member, "payload", lambda self: pytest.fail("a payload was decoded"))
    found = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pydict()["record_id"]]
    assert sorted(found) == ["<urn:page:1>", "<urn:page:2>"]


def test_plain_gzip_and_uncompressed_archives(spark):
    import os
    import tempfile

    folder = tempfile.mkdtemp()
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(p)) + p + b"\r\n\r\n"
               for k, p in enumerate([b"", b"x" * 100_000, b"\r\n\r\nWARC/1.1\r\n", b"last"])]
    with open(os.path.join(folder, "a.warc"), "wb") as f:
        f.write(b"".join(records))
    with open(os.path.join(folder, "b.warc.gz"), "wb") as f:
        for r in records:
            f.write(gzip.compress(r))
    out = warc.read_warc(spark, folder).collect()
    assert sorted((r["record_id"], len(r["payload"])) for r in out) == sorted([("<r0>", 0), ("<r1>", 100_000), ("<r2>", 14), ("<r3>", 4)] * 2)
    names = warc.read_warc(spark, folder, ["record_id"]).where("record_id = '<r3>'")
    assert names.count() == 2
    assert warc.read_warc(spark, tempfile.mkdtemp()).count() == 0
    member = warc.encode_record({"record_type": "response", "payload": b"abc"})
    assert gzip.decompress(member).endswith(b"abc\r\n\r\n") and io.BytesIO(member).read(2) == b"\x1f\x8b"


def test_no_pages(spark):
    path = scratch_path(spark, "warc-empty")
    warc.write_warc(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read_warc(spark, path).count() == 0


def test_plan_of_few_hot_lengths_stays_near_the_linear_program():
    for seed, k, low, high in ((1, 6, 500, 2100), (2, 8, 500, 2100), (4, 12, 1100, 2200)):
        rng = np.random.default_rng(seed)
        counts = np.zeros(4097, dtype=np.int64)
        counts[rng.choice(np.arange(low, high), k, replace=False)] = rng.integers(100, 2000, k)
        lp = packing.solve_lp(counts, 4096)
        cover = np.zeros(4097)
        for config, x in lp:
            assert sum(a * b for a, b in config.items()) <= 4096
            for a, b in config.items():
                cover[a] += b * x
        assert (cover >= counts * (1 - 1e-9)).all()
        plan = sum(t for _, t in packing.round_plan(counts, 4096))
        plain = sum(t for _, t in packing.best_fit(counts, 4096))
        assert plan <= np.ceil(sum(x for _, x in lp)) + len(lp) and plan < plain
