"""Learners, encoders, tokens and vectors against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import losses as ls
from scoreloom.functions import vectors as vc
from scoreloom.operators import encode as en
from scoreloom.operators import evaluate as ev
from scoreloom.operators import ranking as rk
from scoreloom.operators import tokens as tk


@pytest.fixture(scope="module")
def embedded(spark):
    rng = np.random.default_rng(2)
    rows = []
    for item, n in ((1, 90), (2, 40), (3, 3)):
        x = rng.normal(size=(n, 6))
        y = np.clip(np.rint(2 + x[:, 0] + rng.normal(0, 0.3, n)), 0, 4)
        rows += [(item, i, "valid" if i % 3 == 0 else "train", int(y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(
        rows, "item int, idx bigint, split string, score int, embedding array<double>").cache()


def preds(df):
    return {(r["item"], r["idx"]): r["pred"] for r in df.collect()}


def test_shards_do_not_matter(embedded):
    small = preds(ev.oof_predict(embedded))
    large = preds(ev.oof_predict(embedded.repartition(7), shards=4))
    assert small.keys() == large.keys() and len(small) == 133
    for key, value in small.items():
        assert large[key] == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("rows", [0, 1, 5, 7, 8, 9, 40])
def test_shipped_sums_are_no_larger_than_rows(rows):
    """Packed, unpacked and merged in any order, sums are those of all rows."""
    rng = np.random.default_rng(rows)
    x, y = rng.normal(size=(rows + 30, 6)).astype(np.float32), rng.normal(size=rows + 30)
    merged = ev._Sums(6)
    for part in (slice(0, rows), slice(rows, rows + 30)):
        if len(x[part]):
            own = ev._Sums(6)
            for i in range(0, len(x[part]), 3):
                own.add(x[part][i:i + 3], y[part][i:i + 3])
            packed = own.packed()
            assert len(packed[2]) <= max(x[part].nbytes + y[part].nbytes, 8 * 36)
            merged.unpack(*packed)
    assert np.allclose(merged.total(), ev.products(x.astype(float), y))


def test_wide_embeddings_ship_less_than_their_rows(spark):
    """The shipped bytes of many dimensions, and predictions that equal a plain fit."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2500, 512)).astype(np.float32), rng.integers(0, 5, 2500)
    df = spark.createDataFrame([(1, i, int(y[i]), x[i].tolist()) for i in range(2500)],
                               "item int, idx bigint, score int, embedding array<float>").coalesce(1)
    folds = df.withColumns({"fold": F.lit(0), "split": F.lit("train")})
    shipped = ev._ship(folds, ["item"], 1).agg(F.sum(F.length("data"))).head()[0]
    assert shipped < 0.5 * x.nbytes
    out = {r["idx"]: r for r in ev.oof_predict(df, 2).collect()}
    fold = np.array([out[i]["fold"] for i in range(2500)])
    z = np.column_stack([x.astype(float), np.ones(2500)])
    for f in (0, 1):
        a = z[fold != f]
        w = np.linalg.solve(a.T @ a + np.diag([0.1] * 512 + [0]), a.T @ y[fold != f])
        assert np.allclose([out[i]["pred"] for i in np.nonzero(fold == f)[0]], z[fold == f] @ w, atol=1e-6)


def test_fold_is_predicted_from_the_others(embedded):
    out = ev.oof_predict(embedded.where("item = 2")).toPandas().set_index("idx")
    data = embedded.where("item = 2").toPandas().set_index("idx")
    x = np.stack(data["embedding"].to_numpy())
    fold = out["fold"].reindex(data.index).to_numpy()
    y = data["score"].to_numpy(float)
    for f in range(5):
        z = np.column_stack([x[fold != f], np.ones((fold != f).sum())])
        w = np.linalg.solve(z.T @ z + np.diag([0.1] * 6 + [0]), z.T @ y[fold != f])
        want = np.column_stack([x[fold == f], np.ones((fold == f).sum())]) @ w
        assert out["pred"].reindex(data.index).to_numpy()[fold == f] == pytest.approx(want)


def test_holdout(embedded):
    small, large = (ev.holdout_predict(embedded, shards=n) for n in (1, 3))
    assert {r["split"] for r in small.collect()} == {"valid"}
    a, b = preds(small), preds(large)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    quality = {r["item"]: r["qwk"] for r in ev.item_qwk(small).collect()}
    assert quality[1] > 0.7


def mean_learner():
    class Mean:
        def fit(self, x, y):
            return y.mean(), len(y)

        def predict(self, model, x):
            return np.full(len(x), model[0])

    return Mean()


def test_other_learners(embedded):
    """All rows of a small item are drawn; a bounded draw still predicts every row."""
    got = preds(ev.oof_predict(embedded, learner=mean_learner()))
    rows = {(r["item"], r["idx"]): r for r in ev.oof_predict(embedded).collect()}
    assert got.keys() == rows.keys()
    for (item, idx), value in got.items():
        others = [r["score"] for r in rows.values() if r["item"] == item and r["fold"] != rows[item, idx]["fold"]]
        assert value == pytest.approx(np.mean(others))
    some = ev.predict_folds(
        embedded.withColumn("fold", (F.col("idx") % 4).cast("int")), mean_learner(), fit_rows=7, part_rows=5)
    assert some.count() == 133 and some.where("pred IS NOT NULL AND NOT isnan(pred)").count() >= 130


def test_batches_by_length():
    sizes = np.array([5, 1, 900, 2, 2, 700, 1, 40])
    parts = list(en.batches_by_length(sizes, 100))
    assert sorted(i for p in parts for i in p) == list(range(8))
    assert all(len(p) * sizes[p].max() <= 100 or len(p) == 1 for p in parts)
    assert len(parts) == 4
    assert list(en.batches_by_length(sizes[:0], 100)) == []


def test_vectors_do_not_depend_on_batches(spark):
    """Texts from one word to a megabyte; the encoder sees a bounded number of words, or one text."""
    class Watched(en.HashEncoder):
        def encode_prepared(self, prepared):
            if prepared[0] > 1 and prepared[0] * np.bincount(prepared[1]).max() > 3000:
                raise AssertionError("too many words at once")
            return super().encode_prepared(prepared)

    rows = [(1, i, 0, f"w{i} " * n) for i, n in enumerate([1, 200_000, 3, 0, 50, 2000, 7, 1, 900])]
    df = spark.createDataFrame([(a, b, c, t.strip()) for a, b, c, t in rows], "item int, idx int, score int, text string")
    got = {r["idx"]: r["embedding"] for r in en.embed_table(df, Watched(16), batch_tokens=3000).collect()}
    for _, i, _, text in rows:
        assert np.allclose(got[i], en.HashEncoder(16).encode([text])[0])


def test_one_pass_for_all_checkpoints(spark):
    rows = [(i % 2, i, i % 3, f"word{i % 3} and {i % 5} more {i}") for i in range(80)]
    df = spark.createDataFrame(rows, "item int, idx bigint, score int, text string")
    encoders = {50: en.HashEncoder(4), 100: en.HashEncoder(8), 150: en.HashEncoder(8)}
    many = {r["idx"]: r["vectors"] for r in en.embed_many(df, encoders).collect()}
    for number, encoder in encoders.items():
        assert all(np.allclose(many[i][number], encoder.encode([t])[0]) for _, i, _, t in rows)
    got = {(r["checkpoint"], r["item"]): (r["n"], r["qwk"]) for r in ev.scan_checkpoints(df, encoders).collect()}
    want = {}
    for number, encoder in encoders.items():
        scores = ev.item_qwk(ev.generate_predictions(df, encoder))
        want |= {(number, r["item"]): (r["n"], r["qwk"]) for r in scores.collect()}
    assert got == want and len(got) == 6
    plan = en.embed_many(df, encoders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_saved_predictions_are_not_made_again(spark, embedded):
    from scoreloom.session import scratch_path
    from scoreloom.sources.readers import scan_predictions

    df = spark.createDataFrame([(i % 3, i, i % 4, f"word{i % 4} text {i}") for i in range(60)], "item int, idx long, score int, text string")
    root = scratch_path(spark, "saved")
    first = ev.generate_predictions(df.where("item < 2"), root=root, model="m")
    assert first.count() == 40
    assert {r["item"] for r in ev.generate_predictions(df, root=root, model="m").select("item").distinct().collect()} == {2}
    assert ev.generate_predictions(df, root=root, model="m").count() == 0
    assert scan_predictions(spark, root, "m").count() == 60
    assert ev.generate_predictions(df, root=root, model="other").count() == 60


def test_a_stopped_run_resumes(spark):
    """The encoder fails at one item: batches before it stay, the next run makes only the rest."""
    from scoreloom.session import scratch_path
    from scoreloom.sources.readers import finished_items, scan_predictions

    class Fails(en.HashEncoder):
        def encode_prepared(self, prepared):
            raise ValueError("stopped")

    df = spark.createDataFrame([(i % 6, i, i % 4, f"word{i % 4} text {i}") for i in range(120)],
                               "item int, idx long, score int, text string")
    at = {r["item"]: r["n"] for r in df.select("item", F.pmod(F.xxhash64("item"), F.lit(3)).alias("n")).distinct().collect()}
    root = scratch_path(spark, "resumed")
    first = df.where(F.col("item").isin([i for i, n in at.items() if n == at[0]]))
    ev.generate_predictions(first, root=root, model="m", step=1)
    with pytest.raises(Exception, match="stopped"):
        ev.generate_predictions(df, Fails(64), root=root, model="m", batches=3)
    assert {r["item"] for r in finished_items(spark, root, "m").collect()} == {i for i, n in at.items() if n == at[0]}
    rest = ev.generate_predictions(df, root=root, model="m", batches=3)
    assert {r["item"] for r in rest.collect()} == {i for i, n in at.items() if n != at[0]}
    want = {(r["item"], r["idx"]): r["pred"] for r in ev.generate_predictions(df).collect()}
    assert {(r["item"], r["idx"]): r["pred"] for r in scan_predictions(spark, root, "m").collect()} == want
    assert {r["item"]: r["step"] for r in finished_items(spark, root, "m").collect()} == {
        i: 1 if n == at[0] else None for i, n in at.items()}


def test_hash_encoder_and_registry(spark):
    model = en.make_encoder("hash", dim=16)
    got = model.encode(["a b a", "", "b a a"])
    assert got.shape == (3, 16) and got.dtype == np.float32
    assert np.allclose(got[0], got[2]) and not got[1].any()
    assert np.linalg.norm(got[0]) == pytest.approx(1)
    with pytest.raises(ValueError):
        en.make_encoder("unheard-of")
    df = spark.createDataFrame([(1, 1, 0, "a b"), (1, 2, 0, None)], "item int, idx int, score int, text string")
    rows = {r["idx"]: r["embedding"] for r in en.embed_table(df, model).collect()}
    assert np.allclose(rows[1], model.encode(["a b"])[0]) and not any(rows[2])


def test_generate_skips_finished_items(spark):
    rows = [(i % 3, i, i % 4, f"word{i % 4} and word{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "item int, idx bigint, score int, text string")
    done = df.where("item = 1").select("item")
    assert {r["item"] for r in ev.generate_predictions(df, done=done).collect()} == {0, 2}
    assert ev.generate_predictions(df, done=done, overwrite=True).count() == 60


def test_tokenizers(spark):
    class Letters:
        def encode_batch(self, texts):
            return [[ord(c) for c in t] for t in texts]

    df = spark.createDataFrame([(1, "ab c"), (2, ""), (3, None)], "id int, text string")
    rows = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in tk.tokenize_text(df, tokenizer=Letters(), max_length=3).collect()}
    assert rows[1] == ([97, 98, 32], [1, 1, 1]) and rows[2] == ([], []) and rows[3] == ([], [])
    once = tk.tokenize_text(df)
    assert tk.tokenize_text(once) is once


@pytest.mark.parametrize("limit", [0, 150, 1 << 20])
def test_vocabulary(spark, limit):
    """Frequent words by broadcast, rare ones by shuffle, or all either way: the same dense ids."""
    texts = ["b a a c", "a  b\tz", "", None, "c " * 300, "new a", "b a a c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    known = tk.build_vocabulary(df.where("id <> 5"))
    table = {r["word"]: (r["n"], r["id"]) for r in known.collect()}
    assert table == {"c": (302, 16), "a": (5, 17), "b": (3, 18), "z": (1, 19)}
    assert tk.frequent_below(known, limit) == (1 if limit == 0 else 32)
    got = {r["id"]: r["ids"] for r in tk.vocabulary_ids(df, known, "text", "ids", limit=limit).collect()}
    ids = {w: i for w, (_, i) in table.items()}
    assert got == {i: None if t is None else [ids.get(w, tk.UNKNOWN) for w in t.split()] for i, t in enumerate(texts)}
    cut = tk.vocabulary_ids(df, known, "text", "ids", max_length=2, limit=limit).where("id = 4").head()
    assert cut["ids"] == [16, 16]


def test_vocabulary_in_bands(spark):
    """A bound between two bands splits the words; ids do not change."""
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i))) for i in range(120)], "id int, text string")
    known = tk.build_vocabulary(df)
    below = tk.frequent_below(known, 60 * (tk.WORD_BYTES + 3))
    assert below == 64
    rows = tk.vocabulary_ids(df, known, "text", "ids", limit=60 * (tk.WORD_BYTES + 3)).collect()
    assert all(r["ids"] == [16 + j for j in range(r["id"])] for r in rows)


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [1] * 3), (0, [4] * 5, [1] * 5), (1, [6], [1])],
                               "batch int, input_ids array<int>, attention_mask array<int>")
    rows = tk.pad_batch(df, suffixes=("",), side="left", pad_id=9).collect()
    got = sorted((r["batch"], r["input_ids"], r["attention_mask"]) for r in rows)
    assert got == [(0, [9, 9, 9, 4, 4, 4, 4, 4], [0] * 3 + [1] * 5),
                   (0, [9] * 5 + [1, 2, 3], [0] * 5 + [1] * 3), (1, [9, 9, 9, 6], [0, 0, 0, 1])]
    right = tk.pad_batch(df, suffixes=("",), side="right").where("batch = 1")
    assert right.select(tk.mask_labels("input_ids", "attention_mask")).head()[0] == [6, -100, -100, -100]


@pytest.mark.parametrize("lengths", [
    [5] * 9, [3, 4, 5, 6, 9], list(range(10, 200)), [10] * 50 + [12] * 60 + [400], [7, 8],
])
def test_length_histogram(spark, lengths):
    df = spark.createDataFrame([([0] * n, [0] * n) for n in lengths], "input_ids_1 array<int>, input_ids_2 array<int>")
    got = [(r["n"]) for r in sorted(tk.length_histogram(df).collect())]
    x = np.array(lengths * 2)

    def bars(nb, again=True):
        if np.ptp(x) == 0:
            return [len(x)]
        w = np.ptp(x) / nb
        hist, _ = np.histogram(x, np.arange(x.min(), x.max() + 1, w))
        last = np.nonzero((100 / hist.max() * hist).astype(int))[0][-1]
        if again and last < 0.8 * nb:
            return bars(int(nb * nb / (last + 1)), False)
        return hist[: last + 1].tolist()

    assert got == bars(20)


def test_start_token(spark):
    rows = [("ok", [5, 1, 2]), ("ok", [5]), ("mixed", [5, 1]), ("mixed", [6, 1]), ("again", [5, 1, 5]), ("empty", [])]
    df = spark.createDataFrame(rows, "g string, input_ids array<int>")
    got = {r["g"]: r["start_token"] for r in tk.start_token_check(df, ["g"]).collect()}
    assert got == {"ok": 5, "mixed": None, "again": None, "empty": None}


def test_losses_and_angles(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.5, 2.0, 1.2), (-1.0, 1.0, 0.1)], "cos double, label double, d double")
    cos, label, d = (F.col(c) for c in ("cos", "label", "d"))
    got = df.select(ls.contrastive_cosine(cos, label), ls.contrastive_euclid(d, label, 2.0, 1.0),
                    ls.angular_loss(cos, (label == 0).cast("int")), vc.angular(cos * 1.0000001)).collect()
    assert [r[0] for r in got] == pytest.approx([0, 2.5, 0])
    assert [r[1] for r in got] == pytest.approx([0, 1.8 ** 2, 1.9 ** 2])
    assert [r[2] for r in got] == pytest.approx([0, 0, 0])
    assert [r[3] for r in got] == pytest.approx([0, np.arccos(0.5), np.pi], abs=1e-6)


@pytest.mark.parametrize("method", range(4))
def test_layer_plan(method):
    plan = vc.layer_plan(3, 30, method)
    assert plan == vc.layer_plan(3, 30, method) and len(plan) == 3
    if method in (0, 1):
        assert sorted(d for own in plan for d in own) == list(range(30))
        if method == 0:
            sizes = [len(own) for own in vc.layer_plan(4, 4000, 0)]
            assert sizes == sorted(sizes) and sizes[3] > 3 * sizes[0]
    if method == 2:
        assert [len(set(own)) for own in plan] == [15] * 3
    if method == 3:
        assert all(len(set(own)) == len(own) >= 10 for own in plan)
    with pytest.raises(ValueError):
        vc.layer_plan(2, 4, 7)


def test_ranking_edges(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 0), (0.3, 2), (0.1, 0)], "logit double, diff int")
    curve = rk.precision_recall_curve(df)
    rows = {r["threshold"]: (r["precision"], r["recall"]) for r in curve.collect()}
    assert rows[0.8] == pytest.approx((2 / 3, 2 / 3)) and rows[0.1] == pytest.approx((0.6, 1))
    assert rows[0.9] == (0.0, 0.0) and rows[None] == (1.0, 0.0)
    best = rk.best_f1(curve).head()
    assert (best["threshold"], best["f1"]) == (0.1, pytest.approx(0.75))
    assert rk.average_precision(curve).head()["ap"] == pytest.approx(2 / 3 * 2 / 3 + 0.6 / 3)
    none = df.where("diff > 0").withColumn("dist", 1 - F.col("logit"))
    report = rk.pair_eval_report(none).head()
    assert report["AP"] is None and report["F1"] is None and report["QWK"] is None


def test_checkpoints(spark):
    q = spark.createDataFrame([(50, None), (100, 0.7), (150, None), (200, 0.9), (250, None), (300, 0.9), (350, None)],
                              "checkpoint int, qwk double")
    assert tuple(ev.next_checkpoint(q).head()) == (150, 0.9)
    assert ev.next_checkpoint(q.where("qwk IS NULL")).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 1 << 14])
def test_lines_search_no_value_among_all_items(spark, monkeypatch, piece):
    """Gaps before, inside, between and after pieces of items; the work does not grow with the square of the items."""
    monkeypatch.setattr(ev, "LINE_ITEMS", piece, raising=False)
    values = {(50, "a"): 0.5, (50, "k"): -0.25, (100, "c"): None, (100, "d"): 1.0, (150, "e"): None, (150, "k"): 0.12344}
    values |= {(200, i): 0.1 for i in "bfghij"}
    df = spark.createDataFrame([(c, i, q) for (c, i), q in values.items()], "checkpoint int, item string, qwk double")
    out = ev.leaderboard_lines(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "element_at" not in plan and "collect_set" not in plan

    def shown(q):
        return "nan" if q is None else f"{q:.4f}"

    want = []
    for c in (50, 100, 150, 200):
        known = [q for (d, _), q in values.items() if d == c and q is not None]
        line = "\t".join(shown(values.get((c, i))) for i in "abcdefghijk")
        want.append((c, f"checkpoint-{c}\t{shown(sum(known) / len(known) if known else None)}\t\t{line}"))
    assert [tuple(r) for r in out.collect()] == want
    assert ev.leaderboard_lines(df.where("item IS NULL")).count() == 0
    unknown = ev.leaderboard_lines(df.where("item = 'c'")).head()
    assert unknown["line"] == "checkpoint-100\tnan\t\tnan"


def test_lines_take_one_score_per_item(spark):
    for rows in ([(50, 1, 0.5), (50, 1, 0.5), (50, 2, 0.1)], [(50, None, 0.5), (50, 2, 0.1)]):
        df = spark.createDataFrame(rows, "checkpoint int, item int, qwk double")
        with pytest.raises(Exception):
            ev.leaderboard_lines(df).collect()


def test_known_words_do_not_move(spark):
    """With a vocabulary that fits the bound, ids need no shuffle; rare words keep their places among frequent ones."""
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "z a y b x a")], "id int, text string")
    known = spark.createDataFrame([("a", 9, 16), ("b", 5, 17), ("x", 1, 32), ("y", 1, 33)], "word string, n bigint, id int")
    want = {1: [16, 17, 16], 2: None, 3: [], 4: [tk.UNKNOWN, 16, 33, 17, 32, 16]}
    light = tk.vocabulary_ids(df, known, "text", "ids")
    assert "Exchange" not in light._jdf.queryExecution().executedPlan().toString()
    split = tk.vocabulary_ids(df, known, "text", "ids", limit=2 * (tk.WORD_BYTES + 1))
    assert all({r["id"]: r["ids"] for r in d.collect()} == want for d in (light, split))


def test_packed_ids_come_back():
    import pyarrow as pa

    edges = [None, -1, 0, 1, 126, 127, 128, 16382, 16383, 1 << 21, 1 << 28, (1 << 31) - 1, -(1 << 31)]
    lists = [None, [], edges, [None], *[[i, None, i + 1] for i in range(2 * tk.PACKED_ROWS)], None, edges[::-1]]
    for cut in (lists, lists[:1], lists[1:2], []):
        plain = pa.array([[5], *cut], pa.list_(pa.int32())).slice(1)
        held = tk.packed(plain, plain.flatten())
        held.validate(full=True)
        assert tk.unpacked(held).to_pylist() == cut


def test_pairs_store_no_texts(spark, monkeypatch):
    """With words that must be joined, rows wait with packed ids only, and the shuffles that made them are gone."""
    import glob
    import time

    from scoreloom import session

    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}

    rng = np.random.default_rng(5)

    def text():
        return None if rng.random() < 0.1 else " ".join(f"w{j}" for j in rng.integers(0, 400, rng.integers(0, 30)))

    rows = [(text(), text(), i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "txt1 string, txt2 string, diff int").repartition(3)
    known = tk.build_vocabulary(df.where("diff < 4"), "txt1", "txt2")
    ids = {r["word"]: r["id"] for r in known.collect()}
    monkeypatch.setattr(tk, "frequent_below", lambda *_: 40)
    made = []
    monkeypatch.setattr(tk, "stored", lambda *parts: made.append(session.stored(*parts)) or made[-1], raising=False)
    before = shuffled()
    out = tk.tokenize_pairs(df, vocabulary=known)
    for _ in range(50):   # they are deleted in the background
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert [m.columns for m in made] == [["diff", "_row", "_ids_0", "_ids_1"], ["_row", "_others_0", "_others_1"]]
    assert spark.conf.get(session.RELEASE) == "false" and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"

    def coded(t):
        return None if t is None else [ids.get(w, tk.UNKNOWN) for w in t.split()]

    def ones(t):
        return None if t is None else [1] * len(t.split())

    assert out.columns == ["input_ids_1", "attention_mask_1", "input_ids_2", "attention_mask_2", "diff_abs"]
    want = [(coded(a), ones(a), coded(b), ones(b), d) for a, b, d in rows]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("most", [0, 64])
def test_text_pairs_of_repeated_ids(spark, monkeypatch, tmp_path, most):
    """Each row of an id beside each of the next, null texts too, over the borders of blocks; null ids have no pair."""
    from scoreloom.plans import tokens as pt

    monkeypatch.setattr(pt, "ID_ROWS", most, raising=False)
    ids = [-65, -64, -1, 0, 0, 62, 63, 63, 64, 64, 64, 65, 127, 128, 300, None, None]
    rows = [(d, None if n % 4 == 0 else f"text {n}") for n, d in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = pt.text_pairs(spark, str(tmp_path))
    assert pairs.columns == ["doc_id", "txt1", "txt2", "diff"]
    want = [(d, a, b, int(np.fmod(d, 4))) for d, a in rows for e, b in rows if d is not None and e == d + 1]
    assert sorted(map(repr, map(tuple, pairs.collect()))) == sorted(map(repr, want))
