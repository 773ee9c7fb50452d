"""The corpus pipeline on a small table, stage by stage against plain versions."""

import brute
import corpus_pipeline


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark", "mixture", "shards"]
    told = stages["language"](spark, docs, sf)
    texts = {r["doc_id"]: r["text"] for r in told.collect()}
    assert told.columns == docs.columns and len(texts) >= 0.97 * docs.count()
    alone = stages["near_duplicates"](spark, told, sf)
    wanted = {d for d, (_, c) in brute.components(list(texts.items()), 5).items() if c == d}
    assert alone.columns == docs.columns and {r["doc_id"] for r in alone.collect()} == wanted
    clean = stages["benchmark"](spark, alone, sf)
    hits = brute.benchmark_hits([(d, texts[d]) for d in wanted], items)
    wanted -= {d for d, n, h, _ in hits if h and 20 * h >= n}
    assert {r["doc_id"] for r in clean.collect()} == wanted
    mixed = stages["mixture"](spark, clean, sf)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= wanted
    placed = corpus_pipeline.run(spark, sf).collect()
    assert len(placed) == mixed.count() and {r["shard"] for r in placed} == set(range(8))


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
