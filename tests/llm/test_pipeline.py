"""The registered queries over whole small tables, and the pipeline's stages."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from compare import difference, oracle_connection
from test_operators import brute_contamination, brute_exact, brute_groups, brute_repeats, library

import corpus_pipeline
from lakejobs.llm import queries, tables
from lakejobs.plans.registry import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    assert difference(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name], oracle_connection(sf_dir)) is None


def rows(spark, sf_dir, name="documents", key="doc_id"):
    return [tuple(r) for r in table(spark, sf_dir, name).select(key, "text").collect()]


def test_op2(spark, sf_dir):
    lib, got = library(), {r.doc_id: r for r in queries.QUERIES["op2_bpe"](spark, sf_dir).collect()}
    for i, t in rows(spark, sf_dir):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op7(spark, sf_dir):
    docs = rows(spark, sf_dir)
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()}
    for i, n, removed, spans, kept in brute_repeats(docs, 400):
        assert got[i] == (i, n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    items = rows(spark, sf_dir, "benchmark", "item_id")
    before, columns = docs, docs.columns
    for name, stage in list(stages.items())[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == columns
        given = [(r.doc_id, r.text) for r in before.collect()]
        left = {r.doc_id for r in after.collect()}
        if name == "exact_dedup":
            assert left == {k[0] for k in brute_exact(given) if k[3]}
        if name == "near_dedup":
            assert left == {k[1] for k in brute_groups(given)}
        if name == "decontaminate":
            assert left == {k[0] for k in brute_contamination(given, items) if not k[2]}
        assert 0 < len(left) <= len(given)
        path = f"{spark.sparkContext.getCheckpointDir()}/stage-{name}-{id(after)}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
    last = stages["tokenise"](spark, before, sf_dir)
    assert last.where("round_trip").count() == before.count() == corpus_pipeline.run(spark, sf_dir).count()


def test_the_driver_gives_memory_back_after_every_stage(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    seen = []
    same = lambda name: (name, lambda spark, docs, sf_dir: seen.append(name) or docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [same("one"), same("two")])
    monkeypatch.setattr(corpus_pipeline, "hand_back", lambda: seen.append("back"))
    assert corpus_pipeline.run(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert seen == ["one", "back", "two", "back"]


def test_executors_give_heap_back(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collections = lambda: sum(b.getCollectionCount() for b in beans)
    before = collections()
    tables.executors_hand_back(spark)  # the executor is this process
    assert collections() > before


def test_executors_give_heap_back_before_every_stage(spark, sf_dir, monkeypatch):
    seen = []
    for module, name in (
        (corpus_pipeline.quality, "keep_good"), (corpus_pipeline.exact_dedup, "drop_copies"), (corpus_pipeline.jaccard, "drop_similar"),
        (corpus_pipeline.decontaminate, "remove_contaminated"), (corpus_pipeline.bpe, "corpus_lexicon"),
    ):
        monkeypatch.setattr(module, name, lambda docs, *_, name=name: seen.append(name) or docs)
    monkeypatch.setattr(corpus_pipeline.bpe, "encode_and_decode", lambda docs, *_: seen.append("encode") or docs.selectExpr("*", "cast(text as binary) ids", "text decoded"))
    monkeypatch.setattr(corpus_pipeline, "executors_hand_back", lambda spark: seen.append("back"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, table(spark, sf_dir, "documents"), sf_dir)
    assert seen == ["back", "keep_good", "back", "drop_copies", "back", "drop_similar", "back", "remove_contaminated", "back", "corpus_lexicon", "back", "encode"]
