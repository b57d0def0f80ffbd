"""Trained operators by held-out accuracy, matching operators by brute force, and the pipeline."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import decontam, lattice, quality, secrets, toxicity

LABELS = "doc_id long, quality int, toxic int"
LARGER = "/root/testdata/sf0.1"


def read(spark, name):
    return spark.read.parquet(f"{LARGER}/{name}.parquet")


def test_toxicity_on_held_out_labels(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    scored = toxicity.classify_toxicity(docs, labels)
    rows = scored.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert scored.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    caught = [r for r in rows if r.predicted]
    assert sum(r.toxic for r in caught) / len(caught) > 0.9
    assert sum(r.toxic for r in caught) / sum(r.toxic for r in rows) > 0.6


def test_toxicity_does_not_see_ids_languages_or_sources(spark, docs):
    model = toxicity.fit(read(spark, "documents").where("doc_id < 1500"), read(spark, "labels"))
    moved = docs.withColumns({"doc_id": F.col("doc_id") + 10**6, "lang": F.lit("xx"), "source": F.lit("s")})
    a = sorted(r.score for r in toxicity.score_documents(docs, model).collect())
    b = sorted(r.score for r in toxicity.score_documents(moved, model).collect())
    assert a == b


def test_slices_do_not_change_scores():
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 500, (n, 2)).astype(np.uint16) for n in rng.integers(0, 40, 300)]
    labels = np.array([int(len(d) and d[:, 0].min() < 5) for d in documents])
    model = toxicity.train(documents, labels, ["en"] * 300)
    counts = np.array([len(d) for d in documents])
    whole = model.scores(np.concatenate(documents), counts)
    one = [model.scores(d, np.array([len(d)]))[0] for d in documents]
    np.testing.assert_allclose(whole, one, rtol=1e-5)


def _toxic_rows(spark, texts):
    """Documents of the learnt rows and their labels, from (text, toxic) pairs."""
    ids = [r.id for r in spark.range(4 * len(texts)).withColumnRenamed("id", "doc_id").where(~toxicity.held_out()).selectExpr("doc_id id").sort("id").limit(len(texts)).collect()]
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in zip(ids, texts)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, 1, y) for i, (_, y) in zip(ids, texts)], LABELS)


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """All labelled documents are counted, in any number of shards, and long ones are read whole."""
    counted, begun, rounds = [], toxicity.beginning, []
    monkeypatch.setattr(toxicity, "beginning", lambda seen, n, rng: (counted.append((seen[0].sum(), n.sum())), begun(seen, n, rng))[1])
    mean = toxicity._round
    monkeypatch.setattr(toxicity, "_round", lambda rows, net: (rounds.append(rows.select("shard").distinct().count()), mean(rows, net))[1])
    monkeypatch.setattr(toxicity, "SHARD", 6000)
    monkeypatch.setattr(toxicity, "LABEL_BLOCK", 9000)
    n = 30_000
    docs, labels = _toxic_rows(spark, [(f"vile w{i}" if i % 3 == 0 else f"w{i}", int(i % 3 == 0)) for i in range(n)])
    model = toxicity.fit(docs, labels)
    learnt = docs.where("pmod(xxhash64(doc_id, 'checked'), 5) <> 0")
    assert counted == [(learnt.selectExpr("sum(size(split(text, ' ')))").first()[0], learnt.count())]
    assert counted[0][1] > 0.78 * n and rounds == [4] * toxicity.EPOCHS
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id")
    assert scored.where("predicted = toxic").count() > 0.99 * n


def test_toxicity_learns_from_long_documents(spark):
    filler = "plain words go on " * 6000
    docs, labels = _toxic_rows(spark, [(filler + ("vile" if i % 2 else "fine"), i % 2) for i in range(120)])
    model = toxicity.fit(docs, labels)
    assert model.constant is None
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id")
    assert scored.where("predicted = toxic").count() > 110


def test_pieces_of_a_long_document_have_its_strongest_windows(monkeypatch):
    rng = np.random.default_rng(2)
    net = toxicity.beginning([np.ones((2, toxicity.BUCKETS + 1))] * 2, np.array([2, 2]), rng)
    documents = [rng.integers(0, 500, (n, 2)).astype(np.uint16) for n in (0, 1, 7, 20, 21, 22, 45, 400, 3)]
    whole = toxicity.strongest(documents, net)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 20)
    pieces = toxicity.strongest(documents, net)
    np.testing.assert_allclose(whole[0], pieces[0])
    filled = whole[0].reshape(len(documents), len(toxicity.WIDTHS), toxicity.FILTERS) > 0
    for k, (a, b) in enumerate(zip(whole[1], pieces[1])):
        assert (a[filled[:, k]] == b[filled[:, k]]).all()


def test_quality_on_labels_not_trained_on(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    known, apart = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = quality.fit(docs, known)
    assert model.exchanged > 0
    rows = quality.score_documents(docs, model).join(apart, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) / len(good) > 0.99
    assert sum(r.keep for r in bad) / len(bad) < 0.1


def test_models_without_labels_of_both_kinds(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, None, 0)], LABELS)
    for labels in (none, one):
        assert {r.score for r in toxicity.classify_toxicity(odd, labels).collect()} == {0.0}
        model = quality.fit(odd, labels)
        assert quality.score_documents(odd, model).count() == odd.count()
        assert quality.keep_good(odd, model).count() == odd.count()
        assert toxicity.classify_toxicity(empty, labels).count() == 0
        assert quality.score_documents(empty, quality.fit(empty, labels)).count() == 0


def test_models_score_odd_rows(spark, odd):
    docs, labels = read(spark, "documents").where("doc_id < 1500"), read(spark, "labels")
    scores = toxicity.score_documents(odd, toxicity.fit(docs, labels)).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    model = quality.fit(docs, labels)
    assert quality.score_documents(odd, model).count() == odd.count()
    assert quality.keep_good(odd, model).columns == odd.columns


def test_leaks_against_word_windows(spark, docs):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    split = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t).split()

    def windows(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    items = {r.item_id: windows(split(r.text)) for r in benchmark.collect()}
    want = set()
    for r in docs.collect():
        mine = windows(split(r.text))
        want |= {(r.doc_id, i) for i, w in items.items() if len(w & mine) >= 0.8 * len(w)}
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark).collect()}
    assert got == want and want
    clean = decontam.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in want})


def test_other_numbers_names_and_units_are_the_same_question(spark):
    item = "If Anna has 12 apples and gives Bob 5 kg of them then Anna has how many apples left in total"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = [
        (1, "So. If Maria has 3.5 apples and gives Tom 7 lb of them then Maria has how many apples left in total. Bye"),
        (2, item.upper()),
        (3, "If Maria has 33 apples and gives Tom 7 lb of nothing but Karl would never ask how many apples there are"),
        (4, "completely different words that have nothing to do with the question at all"),
        (5, None),
    ]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {r.doc_id for r in got.collect()} >= {1} and not {3, 4, 5} & {r.doc_id for r in got.collect()}


def test_slots_must_agree(spark):
    names = " ".join(f"when Ann meets Ben near the tree{i} then Ann tells Ben about tree{i}" for i in range(5))
    steady = names.replace("Ann", "Zoe").replace("Ben", "Kim")
    people = iter(f"Q{c}{d}" .capitalize() for c in "abcdefghij" for d in "uvwxyz")
    mixed = " ".join(next(people) if w in ("Ann", "Ben") else w for w in names.split())
    benchmark = spark.createDataFrame([(1, names)], "item_id long, text string")
    docs = spark.createDataFrame([(1, steady), (2, mixed)], "doc_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(docs, benchmark).collect()] == [1]


def test_leaks_of_odd_and_empty_tables(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "no id here but some words all the same"), (None, None), (2, "tiny item")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(odd, benchmark).collect()] == [None]
    assert decontam.without_leaks(odd, benchmark).count() == odd.count() - 1
    assert decontam.find_leaks(odd, none).count() == 0 and decontam.find_leaks(empty, benchmark).count() == 0


def test_secrets(spark):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, planted = [], {}
    for i in range(300):
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(30))
        kind, secret = i % 6, None
        if kind == 0:
            secret = "AKIA" + "".join(rng.choice(letters) for _ in range(16))
            rows.append((i, f"{words} {secret} {words}"))
        elif kind == 1:
            secret = f"{rng.getrandbits(160):040x}"
            rows.append((i, f'{words} token = "{secret}" {words} "{secret}"'))
        elif kind == 2:
            secret = f"{rng.getrandbits(72):018x}"
            rows.append((i, f"{words} password={secret}. {words}"))
        elif kind == 3:
            rows.append((i, f"{words} alpha.{i:02d}@mail{i % 9}.example.com {words}"))
        elif kind == 4:
            rows.append((i, f"{words} {rng.randrange(10**15, 10**16)} https://example.com/alpha/{i}/index.html"))
        else:
            rows.append((i, f"{words} gamma_delta_sigma_{i % 7} {words}"))
        if secret:
            planted[i] = secret
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = secrets.find_secrets(docs).where("is_secret").collect()
    assert {r.doc_id: r.value for r in found} == planted
    clean = {r.doc_id: r for r in secrets.without_secrets(docs).collect()}
    for i, text in rows:
        assert clean[i].text == (text.replace(planted[i], secrets.MARK) if i in planted else text)
        assert clean[i].n_chars == len(clean[i].text)


def test_short_and_letters_only_secrets_behind_names_and_keys_inside_runs(spark):
    rng = random.Random(8)
    both = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows, planted = [], {}
    for i in range(400):
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(30))
        key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        short = "".join(rng.choice(both[:26]) for _ in range(6)) + f"{rng.randrange(10, 100)}x"
        letters = "kJ" + "".join(rng.choice(both) for _ in range(14))
        text, secret = [
            (f'password: "{short}"', short),
            (f'secret = "{letters}"', letters),
            (f"key2={key}", key),
            (f"x/{key}", key),
            (f"the getAlphaBetaGamma{'Delta' * (i % 2)} and mail alpha.{i:02d}@mail.example.com", None),
            ("the token: everything, or password = alphabetagamma", None),
            (f"https://example.com/alpha/{i}/index.html", None),
            (f'{{"api_key": "{short}"}}', short),
        ][i % 8]
        rows.append((i, f"{words} {text} {words} everything"))
        if secret:
            planted[i] = secret
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = secrets.find_secrets(docs).where("is_secret").collect()
    assert {(r.doc_id, r.value) for r in found} == set(planted.items())


def test_places_of_candidates(spark):
    """Places and texts to the left agree with the text itself, over many strides, non-ASCII letters, quotes and repeats."""
    rng = random.Random(12)
    many = " ".join(f"é w{rng.getrandbits(64):016x}," for _ in range(3 * secrets.STRIDE + 5))
    named = "ß password: 'hunter2x9' and pwd=abcd!efgh, again 'hunter2x9' token = \"kJqWeRtYuIoPzXcV\""
    rows = [(1, many), (1, many), (2, named), (None, named), (3, f"{named} {many} {named}"), (4, "plain words only"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.candidates(docs).collect()
    texts = {i: t for i, t in rows}
    for r in found:
        text = texts[r.doc_id]
        assert text[r.position - 1 :].startswith(r.run) and r.value in r.run
        assert r.left_text == text[max(0, r.position - 1 - secrets.LEFT) : r.position - 1]
    count = collections.Counter(r.doc_id for r in found)
    assert count == {1: 3 * secrets.STRIDE + 5, 2: 3, None: 3, 3: 3 * secrets.STRIDE + 8}
    assert len({(r.doc_id, r.run, r.value) for r in found}) == len(found)
    assert {r.value: r.position for r in found if r.doc_id == 2} == {
        "hunter2x9": named.index("hunter2x9") + 1, "abcd!efgh": named.index("abcd!efgh") + 1, "kJqWeRtYuIoPzXcV": named.index("kJqWeRt") + 1
    }


def test_secrets_of_odd_and_empty_tables(odd, empty):
    assert secrets.find_secrets(empty).count() == 0
    kept = secrets.without_secrets(odd)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert kept.columns == odd.columns
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(map(tuple, odd.collect()), key=key)


def test_fragments_of_copied_secrets_are_no_words(spark):
    rows = [f'{word} {word}. ({word}): token = "aB3xYzQwErTy7LmNoPqRs" or Abcdefgh9Ijklmnop {i}' for i in range(9) for word in ["plain"]]
    rows += ["plain", "same text twelve times"] + ["copied once1234567890 once"] * 12
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    found = secrets.described(secrets.candidates(docs), docs).withColumn("label", secrets.sure_label())
    got = {(r.value, r.coverage, r.label) for r in found.collect()}
    assert got == {("aB3xYzQwErTy7LmNoPqRs", 0, 1), ("Abcdefgh9Ijklmnop", 0, 0), ("once1234567890", 0, None)}


def brute_vectors(rows, threshold):
    n, links = len(rows), {i: set() for i in range(len(rows))}
    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if x is None or x != y or not a or not b or len(a) != len(b) or None in a or None in b:
                continue
            a, b = np.array(a, float), np.array(b, float)
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        reached, new = {i}, {i}
        while new:
            new = {k for j in new for k in links[j]} - reached
            reached |= new
        out.append((rows[i][0], len(links[i]), min(rows[k][0] for k in reached)))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_vectors(spark, block):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), [float(v) for v in centre + rng.normal(size=16) * 0.08], int(c % 3)))
    rows += [(len(rows) + i, list(rows[i][1]), rows[i][2]) for i in range(12)]  # copies
    rows += [(len(rows) + i, v, label) for i, (v, label) in enumerate([(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0, None], 1), (rows[0][1], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([float("inf"), 1.0], 1)])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_vectors(table, 0.93, block).collect())
    want = brute_vectors(rows, 0.93)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert 0.97 * there <= found <= there and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_lattice_points_are_nearest():
    x = np.random.default_rng(2).normal(size=(200, 8)) * 2
    points = lattice.decode(x)
    assert np.allclose(points * 2, np.rint(points * 2)) and (points.sum(1) % 2 == 0).all()
    away = ((x - points) ** 2).sum(1)
    for root in lattice.roots():
        assert (((x - points - root) ** 2).sum(1) >= away - 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    salt = np.zeros(len(a), np.uint64)
    x, y = lattice.cell_keys(a, salt), lattice.cell_keys(b, salt)
    met = (x == y[:, :, :1]).any((1, 2)) | (y == x[:, :, :1]).any((1, 2))
    assert met.mean() >= 0.93


def test_vectors_of_an_empty_table(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark):
    folder, seen = "/root/testdata/sf0.01", {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_table(stage(spark, docs, folder), name)
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    counts = [seen[n].count() for n, _ in corpus_pipeline.STAGES[:-1]]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    assert seen["secrets"].where(F.col("text").rlike("AKIA[0-9A-Z]{16}|[0-9a-f]{40}")).count() == 0
    texts = [r.text for r in seen["near_duplicates"].collect()]
    assert len(set(texts)) == len(texts)
    packed = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of"))
    assert packed.count() == counts[3] and packed.where("n <> of").count() == 0
    assert {n for n, _ in corpus_pipeline.STAGES} == set(seen)


def test_pipeline_stages_take_empty_tables(spark, empty, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    empty.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
