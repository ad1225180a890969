"""The pipeline: every stage by itself against plain Python, and all of them in a row."""

import random

import corpus_pipeline
import pytest
from conftest import make_docs, prose, vocabulary
from test_free import brute_components
from test_native import brute_lines

import __spark_entry__ as entry_points
from tidemark import llm


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, vocab = random.Random(12), vocabulary()
    items = [prose(rng, 40, vocab) for _ in range(3)]
    base = prose(rng, 200, vocab)
    near = base.split()
    near[100] = "other"
    texts = [prose(rng, rng.randint(60, 300), vocab) + "\na line that many texts share\n" + prose(rng, 30, vocab) for _ in range(80)]
    texts += [base, " ".join(near), base, prose(rng, 50, vocab) + " " + items[1] + " " + prose(rng, 20, vocab), None, "", "too short", "same words " * 60]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    make_docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    kept = stages["quality rules"](spark, docs, folder).cache()
    assert kept.columns == docs.columns
    assert rows_of(kept) == [(i, t) for i, t in enumerate(texts) if i < 84]
    lines = stages["line dedup"](spark, kept, folder).cache()
    assert lines.columns == docs.columns
    assert rows_of(lines) == sorted(brute_lines(rows_of(kept)))
    assert lines.where("n_chars <> length(text)").count() == 0
    single = stages["n-gram Jaccard join"](spark, lines, folder).cache()
    assert single.columns == docs.columns
    firsts = {i for i, _, c in brute_components(rows_of(lines), 5, 80, 100) if c == i}
    assert rows_of(single) == [r for r in rows_of(lines) if r[0] in firsts]
    clean = stages["benchmark decontamination"](spark, single, folder).cache()
    assert clean.columns == docs.columns
    assert rows_of(clean) == [r for r in rows_of(single) if r[0] != 83]
    packed = stages["packing"](spark, clean, folder)
    assert sorted(r["doc_id"] for r in packed.collect()) == [i for i, _ in rows_of(clean)]
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, packed.collect()))


def test_stages_take_hard_and_empty_tables(spark, tables, hard_docs, no_docs):
    folder, _ = tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, hard_docs, folder).count() > 0
        assert stage(spark, no_docs, folder).count() == 0


def test_registration():
    names = entry_points.queries()
    assert set(llm.QUERIES) | {"pipeline"} <= set(names)
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert {"op7_line_dedup", "op10_jaccard_join"} <= set(entry_points.oracle_sql())
