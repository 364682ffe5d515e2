import random
import re

import corpus_pipeline
from scoreloom.llm import language_id, line_winnow, queries
from test_decontaminate import brute as brute_matches
from test_ngram_join import brute as brute_groups
from test_quality_and_lines import brute_lines
from test_tokens_packing_warc import check_packing


def corpus(spark, folder):
    """Real prose with planted copies, passages, runs of lines and texts without letters."""
    rng = random.Random(6)
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(150)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in source.collect()]
    items = [(i, " ".join(f"b{rng.randrange(10**6)}" for _ in range(20))) for i in range(6)]
    texts = [r[1] for r in rows]
    block = "\n".join(f"Repeated line number {k} of a page." for k in range(5))
    extra = [texts[3], texts[4], texts[5].replace(" ", "  ", 1) + " more", texts[6] + "\n" + block, texts[7] + "\n" + block + "\nend",
             texts[8][:900] + " " + items[2][1] + " tail of it", "12 34 !!", "", None, block, texts[9].upper()]
    rows += [(5000 + k, t, "en", "src1", len(t or "")) for k, t in enumerate(extra)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(r[0], r[1]) for r in rows], items


def test_stages_as_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = corpus(spark, folder)
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.language_model(documents)
    rows = [r for r in rows if not model.predict(None if r[1] is None else language_id.gram_counts(r[1]))[2]]
    assert len(rows) >= 150
    rows = [(int(i), new) for i, _, new in brute_lines(rows, line_winnow.RUN) if re.search(r"\S", new)]
    groups = brute_groups(rows)
    rows = [r for r in rows if groups[r[0]][0] == r[0]]
    hit = {d for d, _ in brute_matches(rows, items)}
    assert hit
    rows = [r for r in rows if r[0] not in hit]

    used, least = check_packing(rows, corpus_pipeline.run(spark, folder).collect(), 4096)
    assert used <= least * 1.02 + 1


def test_stages_keep_the_columns(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_line_stage_drops_only_what_it_emptied(spark, docs_of):
    block = "\n".join(f"line {k}" for k in range(4))
    docs = docs_of([(1, block), (2, block), (3, None), (4, ""), (5, " \n\t"), (6, block + "\nown")])
    out = corpus_pipeline.remove_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: block, 3: None, 4: "", 5: " \n\t", 6: "own"}
