import random

import corpus_pipeline
from tests.conftest import SF
from yardmaster.llm import quality, simhash, winnowing

from .helpers import frame


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert out.columns == docs.columns and 0 < out.count() < docs.count(), name
        seen[name], docs = {r.doc_id: r.text for r in out.collect()}, out
    context, net = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.with_score(spark.read.parquet(f"{SF}/documents.parquet"), context, net)
    assert set(seen["quality classifier"]) == {r.doc_id for r in scored.filter("score >= 0.3").collect()}
    hit = winnowing.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert hit.filter("contaminated").count() == 0
    texts = list(seen["simhash near-dedup"].values())
    assert len(texts) == len(set(texts))  # of exact copies one stays
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["benchmark decontamination"])


def test_stages_on_odd_tables(spark):
    for rows in (None, []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).count()


def test_near_copy_stage_keeps_one_of_each(spark):
    docs = frame(spark)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert 1 in ids and 3 not in ids and ids.count(4) == 1 and 8 in ids and 9 in ids
    assert sum(r.doc_id is None for r in kept) == 2


def test_near_copy_stage_links_by_fingerprints_and_by_sets(spark):
    rng = random.Random(5)
    print_ = lambda ws: simhash.fingerprint(simhash.shingles_of(ws, 3))
    apart, alike = None, None
    while not (apart and alike):
        words = [b"w%d" % rng.randrange(5000) for _ in range(120)]
        copy = list(words)
        for at in rng.sample(range(120), rng.choice((2, 5, 6))):
            copy[at] = b"x%d" % rng.randrange(5000)
        bits = (print_(words) ^ print_(copy)).bit_count()
        x, y = (set(simhash.shingles_of(w, 5)) for w in (words, copy))
        similarity = len(x & y) / len(x | y)
        if bits <= 3 and similarity < 0.8:
            apart = (words, copy)
        if bits > 3 and similarity >= 0.8:
            alike = (words, copy)
    rows = [(i, b" ".join(w).decode(), "", 1, 1, "") for i, w in enumerate((*apart, *alike))]
    assert {r.doc_id for r in simhash.similar_groups(frame(spark, rows)).filter("doc_id = component_id").collect()} == {0, 1, 2}
    assert {r.doc_id for r in simhash.near_duplicates(frame(spark, rows)).filter("doc_id = component_id").collect()} == {0, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), SF).collect()} == {0, 2}
