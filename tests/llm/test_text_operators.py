"""Operators on whole texts against brute force, on the small tables and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import arrowfile, decontam, minhash, packing, sharding, simhash, suffixes
from tablewright.llm.textbytes import slices
from tablewright.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "B", "é", "'s", "'", "1", "!", "\t", "日", "́", "　", "-", "\U0001f600", "×", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", None]
    encoder = Encoder(TOKENIZER)
    for limit in (1, 200, 1 << 20):
        got = []
        for _, data, starts in slices(pa.record_batch({"text": pa.array(texts, pa.string())}), limit=limit):
            ids, counts = encoder.encode(data, starts)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_token_files(request, tokenizer, name):
    docs = request.getfixturevalue(name)
    got = sorted(tuple(r) for r in arrowfile.token_files(docs, TOKENIZER, 2).where("doc_id IS NOT NULL").collect())
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: r[:2] if r[0] else r[:1])
    start, want = 0, []
    for known, doc_id, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        if known:
            want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(want)


def test_sequences_are_views_with_masks(spark, docs, tmp_path):
    files = arrowfile.write_sequences(docs, TOKENIZER, 2, f"file://{tmp_path}/seq", length=64)
    for r in files.collect():
        file = arrowfile.SequenceFile(r.path)
        ids, mask = file.sequence((r.tokens - 1) // 64)
        assert len(ids) == 64 and sum(mask.to_pylist()) == (r.tokens - 1) % 64 + 1
        assert not ids.flags.owndata
    assert sum(r.docs for r in files.collect()) == docs.count()


@pytest.mark.parametrize("name,mixture", [("docs", None), ("odd", None), ("docs", {"src1": 3, "src2": 1})])
def test_packing(request, tokenizer, name, mixture):
    docs = request.getfixturevalue(name)
    got = packing.pack_documents(docs, TOKENIZER, 1, mixture, length=256, window_sequences=4).collect()
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    total, at = sum(r.length for r in got), 0
    for sequence, offset, length in spots:  # one after the other without a gap
        assert sequence * 256 + offset == at and offset + length <= 256
        at += length
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    ids = [(i, tokenizer.encode(t, add_special_tokens=False).ids + [1]) for i, t in texts]
    assert total == sum(len(x) for _, x in ids)
    known = {}
    for i, x in ids:
        known.setdefault(i, []).append(x)
    for r in got:
        assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 and len(x) == r.doc_tokens for x in known[r.doc_id])
    covered = {}
    for r in got:
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {i: sum(map(len, x)) for i, x in known.items()}


def test_windows_keep_the_mixture():
    schedule = packing.Schedule([1000, 3000, 500], [1, 1, 2], 100)
    before = [0, 0, 0]
    for w in range(schedule.windows):
        low, high, places = schedule.edges(w)
        assert low == before and places[0] == sum(low)
        taken = [b - a for a, b in zip(low, high)]
        if w < 9:  # while all queues hold
            assert all(abs(t - s) <= 1 for t, s in zip(taken, (25, 25, 50), strict=True)) or high[2] == 500
        assert abs(sum(taken) - 100) <= 2
        before = high
        for queue in range(3):
            if low[queue] < high[queue]:
                assert schedule.find(queue, low[queue], 0) == w == schedule.find(queue, high[queue] - 1, 0)
    assert before == [1000, 3000, 500]


def brute_shards(sizes, shards):
    """Smallest largest shard over all contiguous partitions."""
    best = [[0] + [float("inf")] * len(sizes)]
    total = np.append(0, np.cumsum(sizes))
    for _ in range(shards):
        row = [min(max(best[-1][j], total[i] - total[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
        best.append(row)
    return best[shards][len(sizes)]


def test_minimax_cuts():
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted((rng.choice([1, 2, 3, 8, 20, 90]) for _ in range(rng.randint(1, 14))), reverse=True)
        shards = rng.randint(1, 5)
        runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        begins = [0] + [sum(n for _, n in runs[:r]) + k for r, k in sharding.minimax_cuts(runs, shards)] + [len(sizes)]
        assert begins == sorted(begins)
        assert max(sum(sizes[a:b]) for a, b in zip(begins, begins[1:])) == brute_shards(sizes, shards)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    got = sharding.shard_documents(docs, 24).collect()
    rows = docs.select("doc_id", "text").collect()
    want = sorted((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == want
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    places = {}
    for r in got:
        places.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    if name == "docs":
        assert all(len(s) == 1 for s in places.values())


def brute_fingerprint(text, width=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(marks, distance):
    root = list(range(len(marks)))
    changed = True
    while changed:
        changed = False
        for i in range(len(marks)):
            for j in range(i):
                if bin(marks[i] ^ marks[j]).count("1") <= distance and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


@pytest.mark.parametrize("name", ["docs", "odd"])
@pytest.mark.parametrize("crowd", [2048, 2])
def test_simhash(request, name, crowd):
    docs = request.getfixturevalue(name)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    marks = [brute_fingerprint(t) for _, t in rows]
    root = brute_groups(marks, 4)
    want = [(i, f"{m:016x}", rows[r][0]) for (i, _), m, r in zip(rows, marks, root, strict=True)]
    got = simhash.near_duplicates(docs, crowd=crowd).select("doc_id", "fingerprint", "component_id").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("distance,segments", [(4, 2), (6, 3), (2, 4)])
@pytest.mark.parametrize("crowd", [2048, 1])
def test_fingerprint_links(spark, distance, segments, crowd):
    rng = random.Random(distance * 10 + segments)
    marks = {rng.getrandbits(64) for _ in range(40)}
    for m in list(marks):
        for _ in range(rng.randint(0, 6)):
            m ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance + 1)))
            marks.add(m)
    marks = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    table = spark.createDataFrame([(m,) for m in marks], "fingerprint long")
    got = simhash.components(simhash.fingerprint_links(table, distance, segments, crowd)).collect()
    root = brute_groups([m & (1 << 64) - 1 for m in marks], distance)
    want = {(marks[i], marks[r]) for i, r in enumerate(root) if root.count(r) > 1}
    assert {(r.node, r.root) for r in got} == want


def test_one_of_each_group(spark, odd):
    words = [f"w{i}" for i in range(400)]
    near = list(words)
    near[200] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words).upper()), (4, " ".join(f"v{i}" for i in range(400))), (5, " ".join(words[:200] + near[200:]))]
    for crowd in (2048, 1):
        kept = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect() if r.text and r.text.strip()) == [-9, 0, 1, 6, 7, 8]


def brute_cut(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        data, gone = text.encode(), bytearray(len(text.encode()))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeats(spark, docs, crowd):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(180))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + line[rng.randint(0, 60) :] + "".join(rng.choice("xy") for _ in range(rng.randint(0, 150)))) for i in range(60)]
    rows += [(100, "ab" * 200), (101, "a" * 350), (102, "b" + "a" * 120), (103, "é" * 99), (104, "é" * 99)]
    rows += [(200 + r.doc_id, r.text) for r in docs.limit(60).collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffixes.remove_repeats(table, crowd).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute_cut(sorted(rows))


def test_repeats_of_odd_rows(odd):
    got = suffixes.remove_repeats(odd).select(*COLUMNS).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    want = brute_cut(sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=key))
    none_first = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=none_first) == sorted(want, key=none_first)


def test_loser_tree_gives_order_and_shared_lengths():
    rng = random.Random(5)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 60))]
        k = rng.randint(1, 7)
        runs = [suffixes.front_code([(t, b"", i, 0) for i, t in sorted(enumerate(texts), key=lambda x: x[1]) if i % k == j]) for j in range(k)]
        merged = list(suffixes.merge([suffixes.decoded(r) for r in runs]))
        assert [m[1] for m in merged] == sorted(texts)
        for a, b in zip(merged, merged[1:]):
            assert b[0] == suffixes.shared(a[1], b[1])


def test_empty_tables(empty):
    assert sharding.shard_documents(empty, 24).count() == 0
    assert arrowfile.token_files(empty, TOKENIZER).count() == 0
    assert packing.pack_documents(empty, TOKENIZER, 1).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each_group(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0


def brute_similar(texts, similarity=0.8):
    """For each text the least place that it reaches by steps of that Jaccard similarity of five-word shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def copies(rng, kinds, low, high, n):
    """Pairs of a text and its copy, their similarity between low and high on average."""
    out = []
    for i in range(n):
        size = rng.randint(100, 600)
        words = [f"w{rng.randrange(3000)}" for _ in range(size)]
        j, kind = rng.uniform(low, high), kinds[i % len(kinds)]
        copy = list(words)
        if kind == "appended":
            copy += [f"w{rng.randrange(3000)}" for _ in range(round(size * (1 / j - 1)))]
        elif kind == "truncated":
            copy = copy[: round(size * j)]
        else:
            for at in rng.sample(range(size), max(1, round(size * (1 - j) / (1 + j) / 5))):
                copy[at] = "changed"
        out += [" ".join(words), " ".join(copy)]
    return out


def test_copies_with_more_or_fewer_words_are_found(spark):
    texts = copies(random.Random(21), ["appended", "truncated", "edited"], 0.8, 0.9, 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, r in enumerate(brute_similar(texts)) if r == i}
    got = {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    assert want <= got
    linked = len(texts) - len(want)
    assert linked > 100 and len(texts) - len(got) >= 0.99 * linked


@pytest.mark.parametrize("crowd", [2048, 5])
def test_texts_below_the_limit_stay(spark, crowd):
    """Edits just below the limit, texts of one repeated line with different rests, and a family whose members are linked over others."""
    rng = random.Random(22)
    texts = copies(rng, ["edited"], 0.55, 0.72, 60)
    line = " ".join(f"l{i}" for i in range(12))
    texts += [" ".join([line] * 30 + [f"r{rng.randrange(9999)}" for _ in range(40)]) for _ in range(10)]
    words = [f"f{i}" for i in range(300)]
    for _ in range(40):
        words = list(words)
        words[rng.randrange(300)] = f"g{rng.randrange(9999)}"
        texts += [" ".join(words)] * rng.randint(1, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each_group(docs, crowd=crowd).collect()}
    assert got == {i for i, r in enumerate(brute_similar(texts)) if r == i}


def test_repeats_of_an_id_with_very_many_rows(spark):
    rng = random.Random(23)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(30)]
    rows = [(None, f"row {i:05d}" + (lines[i % 30] if i < 40 or i >= 32_768 else "")) for i in range(32_900)]
    rows += [(5, lines[0]), (5, lines[1] + " other"), (4, "x" + lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r[0] or 0, *r[1:]) for r in suffixes.remove_repeats(docs).select(*COLUMNS).collect())
    want = brute_cut(sorted(((i or 0, t) for i, t in rows)))
    assert got == sorted(want)


def test_number_dense_items_and_item_ids(spark):
    """All windows of an item count; those of few literal words only beside others or with their values; items are told apart by id and text."""
    items = [
        (1, "what is 3 4 5 6 7 8"),
        (2, "12 + 7 = 19 and 4 * 5 = 20 so the sum of both is 39"),
        (3, "10 20 30 40 50 60 70 80"),
        (4, "a train leaves the station at 9 and goes 80 km to the north"),
        (4, "every clerk in the office wrote 12 letters before lunch on monday"),
        (None, "the baker sold 40 loaves of rye bread and 15 cakes that day"),
    ]
    texts = [
        "tell me what is 99 88 77 66 55 pieces of other text entirely",  # a shared phrase only
        "tell me what is 99 88 77 66 55 44 then",  # the question with other numbers
        "first 13 + 8 = 21 and 5 * 6 = 30 so the sum of both is 51 indeed",
        "the row 10 20 30 40 50 60 70 80 as it stands",
        "the row 11 21 31 41 51 61 71 81 is another one",
        "yes a train leaves the station at 7 and goes 65 km to the north today",
        "and every clerk in the office wrote 31 letters before lunch on monday",
        "the baker sold 33 loaves of rye bread and 12 cakes that day",
        "a train leaves the station. much later and after very many other words " + "filler " * 60 + " it goes 80 km to the north",
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "item", "place", "kind")})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark.union(benchmark)).collect()}
    assert found == {(1, 1), (2, 2), (3, 3), (5, 4), (6, 4), (7, None)}
    assert {r.doc_id for r in decontam.without_leaks(docs, benchmark).collect()} == {0, 4, 8}


def test_a_family_of_one_template_sends_links_in_proportion(spark, monkeypatch):
    rng = random.Random(24)
    words = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(300):
        changed = list(words)
        for at in rng.sample(range(60), 2):
            changed[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    written = {}
    monkeypatch.setattr(minhash, "write_table", lambda df, name, keep=minhash.write_table: written.setdefault(name, keep(df, name)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    assert got == {i for i, r in enumerate(brute_similar(texts)) if r == i}
    assert written["still_apart"].count() <= written["shared_keys"].count()
