"""The pipeline: every stage over awkward rows, near-dedup against brute force, and the registered queries as they are."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from taintloom.llm import langcrf, simhash, toxicity

from .helpers import awkward, united

corpus_pipeline = pytest.importorskip("corpus_pipeline")
CLASH = ["p_toxic", "toxic", "lang_pred", "lang_score", "__found", "__v", "__d", "removed", "root", "h", "low", "node", "shingles"]


def clashing(docs):
    """Documents with extra columns named as operators name theirs."""
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def corpus(spark, sf):
    """Documents to learn from, and awkward rows without keys that theirs use."""
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = awkward(spark).select(*real.columns).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    return real.unionByName(odd).cache()


def rows_of(df):
    return sorted((r.doc_id, r.text or "", r.text is None) for r in df.select("doc_id", "text").collect() if r.doc_id is None or r.doc_id >= 10_000_000)


@pytest.mark.parametrize("k", range(4))
def test_stages_over_awkward_rows(spark, sf, corpus, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = clashing(corpus)
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns
    assert [r[0] for r in out.select("p_toxic").distinct().collect()] == ["own p_toxic"]
    kept = {}
    for r in out.where("doc_id is null or doc_id >= 10000000").collect():
        kept.setdefault(None if r.doc_id is None else r.doc_id - 10_000_000, []).append(r.text)
    all_ids = {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    if name == "toxicity":
        assert set(kept) == all_ids and len(kept[1]) == 2
    elif name == "language_id":
        assert set(kept) & {2, 3, 5, 6} == set() and {1, 9} <= set(kept) and len(kept[1]) == 2
    elif name == "simhash_near_dedup":
        assert set(kept) == all_ids - {9} and len(kept[1]) == 2  # 9 is a copy of 1; both rows of 1 stay
    else:
        assert set(kept) == all_ids and kept[2] == [None] and kept[3] == [""] and kept[9] == [""]
        assert {r.n_chars for r in out.where("doc_id = 10000002").collect()} == {None}


def test_near_dedup_keeps_one_of_each_group_of_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.text and r.text.strip())
    sets = [set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w := t.encode().lower().split()) > 5 else {tuple(w)} for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = united(len(rows), pairs)
    gone = {rows[i][0] for i in range(len(rows)) if roots[i] != i}
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).select("doc_id").collect()}
    assert {d for d, _ in rows} - got == gone and gone


def test_texts_of_one_key_are_one_document(spark):
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(1, base), (2, base), (2, "quite another text that stands for itself " * 3), (3, base + " end"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.root for r in simhash.near_copies(docs).collect()}
    assert got[3] == 1 and None not in got
    assert got == {r.doc_id: r.root for r in simhash.near_copies(docs.orderBy(F.desc("text"))).collect()}


def test_queries_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, n_vec = docs.count(), spark.read.parquet(f"{sf}/embeddings.parquet").count()
    made = {name: q(spark, sf) for name, q in entry.queries().items() if name.startswith("op")}
    assert len(made) == 10
    counts = {name: df.count() for name, df in made.items()}
    assert counts["op1_embedding_near_dedup"] == n_vec
    assert all(counts[q] == n for q in ("op3_substring_dedup", "op4_sentencepiece_codec", "op5_toxicity", "op7_license_scan", "op8_token_counts", "op9_language_id", "op10_simhash_near_dedup"))
    assert made["op2_best_fit_packing"].select("doc_id").distinct().count() == n
    out = entry.queries()["pipeline"](spark, sf)
    assert 0.7 * n <= out.select("doc_id").distinct().count() <= n
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_training_in_a_task_gives_the_models_of_the_driver(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one, two = (toxicity.fit(docs, labels, on_executor=x) for x in (False, True))
    assert (one is None) == (two is None)
    if one is not None:
        assert (one.lexicon.chosen == two.lexicon.chosen).all() and all(np.allclose(a, b) for a, b in zip(one.weights, two.weights, strict=True))
    few = docs.where("doc_id < 60")
    texts = few.select("doc_id", "text")
    a, b = (langcrf.languages(texts, langcrf.fit(few, per_lang=5, on_executor=x)).collect() for x in (False, True))
    assert sorted((r.doc_id, r.lang_pred) for r in a) == sorted((r.doc_id, r.lang_pred) for r in b)
    assert toxicity.fit(docs, labels.limit(0), on_executor=True) is None
