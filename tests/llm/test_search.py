"""Ranked search and nearest vectors against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import hamming, lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def best_documents(docs, items, k):
    counted = [(doc, Counter(found)) for doc, found in ((doc, terms(text)) for doc, text in docs) if found]
    total, length = len(counted), sum(sum(c.values()) for _, c in counted)
    frequent = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 50 + 50 * sum(c.values()) * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * frequent[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return out


def ordered(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("postings, block", [(2_000_000, 4 << 20), (40, 300)])
def test_ranked_search_equals_brute_force(spark, odd, monkeypatch, postings, block):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    draw = random.Random(13)
    words = [f"w{int(draw.paretovariate(0.7)) % 60}" for _ in range(400)] + ["Été", "straße", "日本", "A-b", "x_y"]
    made = [(100 + i // 2, " ".join(draw.choices(words, k=draw.choice([0, 3, 20, 80])))) for i in range(160)]
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).repartition(4)
    docs = docs.withColumns({c: F.lit("clash") for c in ("item_key", "score", "rank", "n", "terms", "tfs", "salt")})
    asked = [(i, " ".join(draw.choices(words, k=8))) for i in range(12)] + [(3, "W1 w2 été ÉTÉ"), (3, "w1"), (None, "brown fox w3"), (5, None), (6, ""), (7, "!?"), (8, "zzz"), (9, "w1")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("item_key", "one", "rank")})
    got = lexical.search(docs, items, 7, block).collect()
    want = best_documents([tuple(r) for r in docs.select("doc_id", "text").collect()], asked, 7)
    assert ordered(got) == ordered(want)


def test_ranked_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "the end")], "item_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), items).count() == 0


def test_nra_stops_before_the_end_and_gives_final_scores():
    draw = np.random.default_rng(4)
    for _ in range(30):
        size = int(draw.integers(1, 300))
        lists = []
        for _ in range(int(draw.integers(0, 6))):
            doc = draw.permutation(size)[: int(draw.integers(0, size + 1))]
            impact = np.sort((draw.pareto(1.0, len(doc)) * 100).astype(np.int64))[::-1]
            lists.append((doc, impact))
        whole = np.zeros(size, np.int64)
        for doc, impact in lists:
            whole[doc] += impact
        at, score = lexical.nra(lists, size, 5)
        assert np.array_equal(score, whole[at])
        bar = max(1, np.sort(whole)[-5] if size >= 5 else 1)
        assert set(np.flatnonzero(whole >= bar)) <= set(at)


def test_nearest_vectors_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = hamming.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[at]
        mine = sorted((r for r in got if r.query_id == ids[at]), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 for r in mine)
        score[at] = -2
        hits += len({r.vec_id for r in mine} & set(ids[np.argsort(-score)[:5]]))
    assert hits / 200 >= 0.9


def test_codes_within_a_radius_are_all_found():
    draw = np.random.default_rng(5)
    code = draw.integers(0, 256, (3000, 8), np.uint8)
    code[:200] = code[0] ^ (draw.random((200, 8)) < 0.2) * np.uint8(5)
    tables = hamming.Tables(code)
    for query in (code[0], code[2999]):
        apart = np.bitwise_count(code ^ query).sum(1)
        for r in (0, 1, 7, 8, 12, 20, 31, 45, 64):
            assert np.array_equal(tables.within(query, r), np.flatnonzero(apart <= r))


def test_radius_is_a_binomial_quantile():
    draw = np.random.default_rng(6).binomial(64, math.acos(0.6) / math.pi, 100_000)
    r = hamming.radius(0.6, 64, 0.9)
    assert (draw <= r).mean() >= 0.89 and (draw <= r - 1).mean() < 0.91
    assert hamming.radius(1.0, 64, 0.9) == 0 and hamming.radius(-1.0, 64, 0.9) == 64


def test_nearest_ties_repeats_nulls_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [1.0, 1.0, 0.0]), (None, [1.0, 1.0, 0.0])]
    rows += [(4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1.0, None, 0.0]), (50, [1.0, 2.0]), (51, [1e300, 2e300])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("query", "score", "same", "rank", "own", "of", "salt")})
    got = hamming.nearest(vectors, vectors.where("vec_id % 50 = 0"), 4).collect()
    first = [(1, 0, 1.0), (2, 1, 1.0), (3, None, 0.5**0.5), (4, 2, 0.5**0.5)]
    found = sorted((r.query_id, r["rank"], -1 if r.vec_id is None else r.vec_id, round(r.score, 12)) for r in got)
    assert found == sorted([(0, a, -1 if b is None else b, round(c, 12)) for a, b, c in first] * 2 + [(50, 1, 51, 1.0)])
    assert hamming.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    assert hamming.nearest(vectors, vectors.where("vec_id = 4")).count() == 0


def test_nearest_blocks_chunks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(hamming, "CHUNK", 64)
    draw = np.random.default_rng(7)
    x = draw.normal(size=(500, 20))
    x[100:400] = x[0]  # a hot vector
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = hamming.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5, block=3, sample=200).collect()
    assert len(got) == 50
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 150] == [0, 100, 101, 102, 103]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [100, 101, 102, 103, 104]
