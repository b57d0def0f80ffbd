"""SimHash fingerprints and their near-duplicate groups by multi-index hashing.

A fingerprint has as many segments as make each a good key. Fingerprints within the distance agree, up to a few bits, in one
segment; so two that are linked have a common point in the small Hamming balls around that segment of each. Both balls are
enumerated (half of the bits on either side), points are the table keys, and full distances are verified among the
fingerprints that meet at a key. Equal fingerprints are one entry, so copies of a text never make pairs.

At a key with very many different fingerprints no pairs are compared: there the balls of half the distance around the whole
fingerprints are enumerated; two are linked exactly if these balls meet, and those that meet at a point are linked to
the least of them, so the rows stay in proportion to the fingerprints.

Null and empty texts, and texts of white space, have fingerprint zero; repeated rows and ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_table
from . import minhash
from .components import components
from .textbytes import slices

SEED = 42
CROWD = 2048  # different fingerprints at one key up to which they are compared with each other
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _ones(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def simhash(text: bytes, width: int) -> int:
    """Bit is 1 if set in over half of the hashes of the ``width``-word shingles, repeats included."""
    found = text.translate(_LOWER).split()  # without an argument it splits at 09 to 0D and 20, and nowhere else
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(found) - width + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return _ones(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def fingerprints(docs: DataFrame, width: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of each document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts in slices(batch):
                raw = data.tobytes()
                marks = [simhash(raw[a:b], width) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.record_batch([rows.column(key), pa.array(marks, pa.int64())], names=[key, "fingerprint"])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, fingerprint long")


def _ball(bits: int, radius: int) -> list[int]:
    """All numbers of that many bits with at most ``radius`` ones."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _points(column: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: column.bitwiseXOR(m)))


def _keys(distinct: DataFrame, distance: int, segments: int) -> DataFrame:
    """(key, fingerprint): the points around each segment, as many bits away as both sides need to meet."""
    bits = 64 // segments
    # Both sides enumerate the same ball: two segments that differ in r bits meet half way.
    masks = _ball(bits, -(-(distance // segments) // 2))
    parts = []
    for s in range(segments):
        segment = F.shiftrightunsigned("fingerprint", s * bits).bitwiseAND(F.lit((1 << bits) - 1))
        parts += [F.shiftleft(F.lit(s).cast("long"), bits) + segment.bitwiseXOR(F.lit(m)) for m in masks]
    return distinct.select(F.explode(F.array(*parts)).alias("key"), "fingerprint")


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as links to the least member of each local group: as many as there are members, at most."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if np.array_equal(new, root):
            return nodes[root != np.arange(len(nodes))], nodes[root[root != np.arange(len(nodes))]]
        root = new


def _compare(distance: int, crowd: int):
    """Task function over rows sorted by key: verified links (a, b) within each key, and crowded members as (a, null)."""

    def links(key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = key[1:] == key[:-1]
        several = np.append(same, False) | np.append(False, same)
        key, mark = key[several], mark[several]
        found = [(np.zeros(0, np.int64),) * 2]
        at, step = np.arange(len(key)), 1
        while len(at := at[at < len(key) - step]) and len(at := at[key[at] == key[at + step]]):
            near = at[np.bitwise_count((mark[at] ^ mark[at + step]).view(np.uint64)) <= distance]
            if len(near):
                found.append(_star(mark[near], mark[near + step]))
            step += 1
        return _star(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["a", "b"])

        held, marks, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key, mark = batch.column("key").to_numpy(), batch.column("fingerprint").to_numpy()
            key, mark = np.concatenate([held, key]), np.concatenate([marks, mark])
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(edges, len(key)))
            # A crowded run may go on for many batches; its members go on at once, so what is held stays below the limit.
            crowds = (size > crowd) | (key[edges] == crowded if crowded is not None else False)
            inside = np.repeat(crowds, size)
            if inside.any():
                yield rows(np.unique(mark[inside]), None)
            crowded = key[-1] if len(key) and crowds[-1] else None
            last = np.zeros(len(key), bool)
            if len(key) and not crowds[-1]:
                last[edges[-1] :] = True
            held, marks = key[last], mark[last]
            yield rows(*links(key[~inside & ~last], mark[~inside & ~last]))
        if len(held):
            yield rows(*links(held, marks))

    return run


def _least_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: every member linked to the first of its key."""
    key0 = mark0 = None
    for batch in batches:
        key, mark = batch.column("key").to_numpy(), batch.column("fingerprint").to_numpy()
        if not len(key):
            continue
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        first = np.repeat(mark[edges], np.diff(np.append(edges, len(key))))
        if key0 is not None and key[0] == key0:
            first[: edges[1] if len(edges) > 1 else len(key)] = mark0
        key0, mark0 = key[-1], first[-1]
        several = first != mark
        pairs = np.unique(np.stack([mark[several], first[several]]), axis=1)
        yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, distance: int, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints reachable by steps of at most ``distance`` bits."""
    if segments < 2 or distance % 2:
        raise ValueError("two segments or more, and an even distance, so that balls of half of it meet")
    sorted_keys = _keys(distinct, distance, segments).repartition("key").sortWithinPartitions("key", "fingerprint")
    found = write_table(sorted_keys.mapInArrow(_compare(distance, crowd), "a long, b long"), "fingerprint_links")
    members = found.where("b IS NULL").select(F.col("a").alias("fingerprint")).distinct()
    near = found.where("b IS NOT NULL")
    if members.isEmpty():
        return near
    points = members.select(_points(F.col("fingerprint"), _ball(64, -(-distance // 2))).alias("key"), "fingerprint")
    met = points.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(_least_of_runs, "a long, b long")
    return near.union(met)


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest id that is reachable), kept."""
    marks = write_table(fingerprints(docs, width), "fingerprints")
    distinct = write_table(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    groups = components(fingerprint_links(distinct, distance, segments, crowd))
    linked = write_table(groups.join(distinct, groups.node == distinct.fingerprint).select("node", "root", "first_id"), "groups")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component")).withColumnRenamed("root", "of")
    by_mark = linked.join(least, F.col("root") == F.col("of")).select("node", "component")
    named = distinct.join(by_mark, F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("mark"), F.coalesce("component", "first_id").alias("component_id")
    )
    # One row a fingerprint on the right; a fingerprint that very many documents share is split by the skew join.
    return marks.join(named, F.col("fingerprint") == F.col("mark")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


SIMILAR = 0.8
GROUP = 1024  # different texts at one key up to which one task judges them


def one_of_each_group(docs: DataFrame, width: int = 5, similarity: float = SIMILAR, crowd: int = GROUP) -> DataFrame:
    """The documents with the smallest id of each group of similar texts, with all their columns.

    Similarity is the Jaccard similarity of the different shingles, verified for every link (:mod:`.minhash`). Documents are told apart
    by id and text; of repeated rows one stays.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    marks = write_table(minhash.marked(slim, width), "text_marks")
    groups = minhash.similar_groups(slim, marks, width, similarity, crowd)
    return _first_of_groups(docs, marks, groups)


def one_of_each_near(docs: DataFrame, width: int = 4, distance: int = 4, segments: int = 2) -> DataFrame:
    """The documents with the smallest id of each group, with all their columns; what links two is either of

    - fingerprints within the distance, as in :func:`near_duplicates`,
    - similar sets of shingles, as in :func:`one_of_each_group`; these find copies with more changes than few bits show.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    marks = write_table(minhash.marked(slim, 5), "text_marks")
    similar = minhash.similar_groups(slim, marks, 5, SIMILAR, GROUP)
    # Equal texts have one set of shingles and one fingerprint, so a set stands for its texts.
    prints = fingerprints(slim, width, "text_key").distinct()
    sets = marks.select("id", "text_key").distinct().join(prints, "text_key").select("id", "fingerprint").distinct()
    sets = write_table(sets, "fingerprints")
    counts = write_table(sets.groupBy("fingerprint").agg(F.count("*").alias("n")), "distinct_fingerprints")
    near = write_table(fingerprint_links(counts.select("fingerprint"), distance, segments), "near_fingerprints")
    several = counts.where("n > 1").select("fingerprint").union(near.select("a")).union(near.select("b")).distinct()
    sets = sets.join(several, "fingerprint", "left_semi")
    # Fingerprints are nodes beside the sets; the mark keeps equal numbers apart.
    node = lambda c: F.xxhash64(F.lit("fingerprint"), F.col(c))
    links = similar.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = links.union(sets.select(F.col("id").alias("a"), node("fingerprint").alias("b"))).union(near.select(node("a").alias("a"), node("b").alias("b")))
    return _first_of_groups(docs, marks, components(write_table(links, "links")))


def _first_of_groups(docs: DataFrame, marks: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents with the smallest id of each group (node, root) of the ids of ``marks``; of repeated rows one."""
    named = marks.select("doc_id", "text_key", "id").join(groups, F.col("id") == F.col("node"), "left")
    kept = named.groupBy(F.coalesce("root", "id").alias("of")).agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
    kept = write_table(kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_key").alias("kept_key")), "kept")
    whole = docs.select(F.struct("*").alias("d"))  # so that no column of the documents meets one of the groups
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64("d.text") == F.col("kept_key"))
    stay = whole.join(kept, same, "left_semi").select("d.*")
    repeated = not marks.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    return stay.dropDuplicates(["doc_id", "text"]) if repeated else stay
