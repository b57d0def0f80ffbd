"""The pipeline keeps one document of each group of near fingerprints, and of similar texts."""

import random


import corpus_pipeline
from tablewright.llm import simhash


def test_no_two_documents_stay_that_share_a_group(spark):
    rng = random.Random(3)
    line = " ".join(f"l{i}" for i in range(12))
    # One line many times before few other words: equal fingerprints but different sets of shingles.
    texts = [" ".join([line] * 40 + [f"r{rng.randrange(9999)}" for _ in range(30)]) for _ in range(6)]
    words = [f"w{i}" for i in range(300)]
    texts += [" ".join(words), " ".join(words[:270]), " ".join(words[:250] + ["x"] * 3), " ".join(f"v{i}" for i in range(80)), None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    near = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    groups = [near[r.doc_id].component_id for r in rows]
    assert len(set(groups)) == len(groups)
    assert len({r.component_id for r in near.values()}) < len(simhash.one_of_each_group(docs).collect())
    assert {r.doc_id for r in rows} <= {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    assert simhash.one_of_each_near(kept).count() == len(rows)
