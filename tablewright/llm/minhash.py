"""Texts whose sets of word shingles are similar: pairs found by MinHash bands, every link verified by the exact Jaccard similarity.

A text has BANDS keys, each of the least values of ROWS hashes over its distinct shingles. Two texts of similarity j share a key with
probability 1 - (1 - j ** ROWS) ** BANDS: 0.999 at 0.8, wherever in the text they differ. Texts that share a key are judged twice:

1. Each text against the least id of every key of its own; this joins a group of near copies by as many pairs as it has members.
2. Keys whose members are still apart: within a task, the pairs of members in different groups, but those that a sketch of one byte of each
   hash puts far below the limit. First the sketches tell which members have such a pair; then their shingles come to the same
   runs, where pairs are judged until a run's members are in one group. No pair leaves a task: a run sends one link a member at most.
   Members of a crowded key are dealt into blocks, and each pair of blocks is compared on its own.

What is judged is the number of common shingles, of all shingles of either. Texts with the same shingles are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import write_table
from .components import components
from .textbytes import mix, slices

SEED = 42
BANDS, ROWS = 24, 6
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TIMES, _PLUS = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Hashes of the different ``width``-word shingles in order; a shorter text is one shingle, a text without words has none."""
    found = text.translate(_LOWER).split()  # at 09 to 0D and 20, and nowhere else
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(found) - width + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def keys_and_sketch(shingles: np.ndarray) -> tuple[list[int], bytes]:
    if not len(shingles):
        return [], b""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024] * _TIMES + _PLUS).min(1), out=least)
    key = np.arange(BANDS).astype(np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key + mix(row))
    return key.view(np.int64).tolist(), mix(least).astype(np.uint8).tobytes()


def marked(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, id, keys, sketch) of each row; the id is that of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts in slices(batch):
                raw = data.tobytes()
                sets = [shingle_set(raw[a:b], width) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                keys, sketches = zip(*map(keys_and_sketch, sets), strict=True)
                columns = [pa.array(ids), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.record_batch([rows.column("doc_id"), rows.column("text_key"), *columns], names=["doc_id", "text_key", "id", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, text_key long, id long, keys array<long>, sketch binary")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts in slices(batch):
                raw = data.tobytes()
                sets = [shingle_set(raw[a:b], width).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.record_batch([rows.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Exact: common shingles of all shingles of either; both sets are sorted."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < similarity * len(y) - 1e-9:
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def _judge(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                ok.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(_judge(similarity), "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], held_bytes: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Whole runs of one key and pair of blocks, some at a time, of rows sorted by these."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: np.array(batch.column(c).to_pylist(), object) if c in held_bytes else batch.column(c).to_numpy() for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], v]) for c, v in now.items()}
        open_ = np.logical_and.reduce([now[c] == now[c][-1] for c in ("key", "low", "high")])
        held = {c: v[open_] for c, v in now.items()}
        if not open_.all():
            yield {c: v[~open_] for c, v in now.items()}
    if held is not None:
        yield held


def _pairs(at: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a run that are in different groups and that the sketch does not rule out, one distance of places at a time."""
    hashes = BANDS * ROWS
    # 4.5 deviations below what texts at the limit have on average.
    enough = hashes * similarity - 4.5 * np.sqrt(hashes * similarity * (1 - similarity))
    sketch = np.frombuffer(b"".join(at["sketch"]), np.uint8).reshape(-1, hashes)
    run = np.cumsum(np.append(True, (at["key"][1:] != at["key"][:-1]) | (at["low"][1:] != at["low"][:-1]) | (at["high"][1:] != at["high"][:-1])))
    here, step = np.arange(len(run)), 1
    while len(here := here[here < len(run) - step]) and len(here := here[run[here] == run[here + step]]):
        i = here[at["root"][here] != at["root"][here + step]]
        i = i[(at["low"][i] == at["high"][i]) | (at["block"][i] != at["block"][i + step])]
        i = i[(at["id"][i] != at["leader"][i]) & (at["id"][i + step] != at["leader"][i])]  # those are judged already
        i = i[(sketch[i] == sketch[i + step]).sum(1) >= enough]
        if len(i):
            yield i, i + step
        step += 1


def _apart(similarity: float):
    """Task function over rows sorted by key and blocks: the members of each run that have a pair to be judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "low", "high", "block", "id", "root", "leader", "sketch"]
        for at in _runs(batches, ("sketch",)):
            wanted = np.zeros(len(at["id"]), bool)
            for i, j in _pairs(at, similarity):
                wanted[i] = wanted[j] = True
            yield pa.record_batch([pa.array(at[c][wanted].tolist(), pa.binary() if c == "sketch" else pa.int64()) for c in names], names=names)

    return run


def _stars(similarity: float):
    """Task function over the same runs with the sets of shingles: links (a, b) of each member to the least of its group within the run.

    A pair is judged only while its members are in different groups, and as many links go out as there are members, at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in _runs(batches, ("sketch", "shingles")):
            group = dict(zip(at["root"].tolist(), at["root"].tolist(), strict=True))

            def top(x: int, group: dict[int, int] = group) -> int:
                while group[x] != x:
                    group[x] = group[group[x]]
                    x = group[x]
                return x

            root, sets = at["root"].tolist(), [np.frombuffer(b, np.uint64) for b in at["shingles"]]
            links = set()
            for firsts, seconds in _pairs(at, similarity):
                for i, j in zip(firsts.tolist(), seconds.tolist(), strict=True):
                    a, b = top(root[i]), top(root[j])
                    if a != b and _similar(sets[i], sets[j], similarity):
                        group[max(a, b)] = min(a, b)
                        links.add((max(a, b), min(a, b)))
            a, b = zip(*sorted(links), strict=True) if links else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def similar_groups(docs: DataFrame, marks: DataFrame, width: int, similarity: float, crowd: int) -> DataFrame:
    """(node, root) of the ids that are linked, directly or over others; ``docs``: (doc_id, text, text_key), ``marks``: :func:`marked`."""
    sources = F.min(F.struct("doc_id", "text_key")).alias("source")
    texts = write_table(marks.groupBy("id").agg(sources, F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "different_texts")
    keyed = texts.select(F.explode("keys").alias("key"), "id")
    least = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    shared = write_table(keyed.join(least, "key"), "shared_keys")

    wanted = texts.join(shared.select("id").distinct(), "id", "left_semi").select("id", "source.*")
    wanted = wanted.select("id", F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    found = docs.join(wanted, same).select("id", "text").mapInArrow(_sets(width), "id long, shingles binary")
    repeated = not marks.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    sets = write_table(found.dropDuplicates(["id"]) if repeated else found, "shingle_sets")

    first = shared.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    links = write_table(_alike(first, sets, similarity), "similar")
    groups = components(links)
    placed = shared.join(groups, F.col("id") == F.col("node"), "left").select("key", "id", "leader", F.coalesce("root", "id").alias("root"))
    placed = write_table(placed, "placed")
    apart = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1 AND n > 2")
    zero = F.lit(0).cast("long")
    dealt = placed.join(apart.select("key", F.ceil(F.col("n") / crowd).alias("blocks")), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    order = ["key", "low", "high"]
    kinds = "key long, low long, high long, block long, id long, root long, leader long, sketch binary"
    dealt = dealt.join(texts.select("id", "sketch"), "id").repartition(*order).sortWithinPartitions(*order, "id")
    second = write_table(dealt.mapInArrow(_apart(similarity), kinds), "still_apart")
    if second.isEmpty():
        return groups
    whole = second.join(sets, "id").repartition(*order).sortWithinPartitions(*order, "id")
    return components(links.union(whole.mapInArrow(_stars(similarity), "a long, b long").distinct()))
