"""Near-duplicate vectors by lattice hashing: random projections to eight dimensions, decoded to points of the E8 lattice.

A table's key is the label with the lattice points of ``BLOCKS`` projections. A vector is filed in every table under its own cell, and
probes the nearest neighbouring cells of each projection. Vectors that meet at a key have their cosine computed in double precision, and only
pairs of at least the threshold are links. Vectors that are equal are one entry with a count, so copies never make pairs.

A key with more than ``BLOCK`` vectors is split: its vectors are dealt into blocks, and every pair of blocks is a task's work of its
own, so no task holds more than two blocks and no pair is left out.

Only vectors of one label and one length are compared. Vectors that are null, zero, empty or hold null or non-finite parts, and those without
a label, link with nothing. Repeated rows count as vectors of their own; a null id is never the smallest; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import write_table
from .components import components
from .textbytes import mix, signed

TABLES = 8
BLOCKS = 2
PROBES = 2  # neighbouring cells of each projection
SCALE = 0.55  # of the projected unit vectors; the lattice has minimal distance 1.41
BLOCK = 4096


@lru_cache(1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    whole = [[(s if i == a else t if i == b else 0) for i in range(8)] for a, b in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    half = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, float)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: integer points of even sum, or those shifted by one half."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(1) % 2 != 0)
        worst = np.abs(off[odd]).argmax(1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    a, b = even(x), even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


@lru_cache(64)
def _projections(dimensions: int) -> np.ndarray:
    return np.random.default_rng([8, dimensions]).normal(0, SCALE, (TABLES * BLOCKS, dimensions, 8))


def cell_keys(unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys of unit vectors: by row and table the own cell, then the probed ones. ``salt``: a hash of what must agree besides."""
    found = np.zeros((len(unit), TABLES, 1 + BLOCKS * PROBES), np.uint64)
    multiply = np.random.default_rng(9).integers(1, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)

    def hashed(points: np.ndarray) -> np.ndarray:
        return mix(((2 * points).astype(np.int64).view(np.uint64) * multiply).sum(-1, dtype=np.uint64))

    for table in range(TABLES):
        own, beside = [], []
        for block in range(BLOCKS):
            y = unit @ _projections(unit.shape[1])[table * BLOCKS + block]
            point = decode(y)
            toward = (y - point) @ roots().T
            steps = np.argpartition(-toward, PROBES, axis=1)[:, :PROBES]
            own.append(hashed(point))
            beside.append(hashed(point[:, None, :] + roots()[steps]))
        start = mix(salt + np.uint64(table))
        found[:, table, 0] = mix(mix(start + own[0]) + own[1])
        found[:, table, 1 : 1 + PROBES] = mix(mix(start[:, None] + beside[0]) + own[1][:, None])
        found[:, table, 1 + PROBES :] = mix(mix(start + own[0])[:, None] + beside[1])
    return found


def _classes(vectors: DataFrame) -> DataFrame:
    """Different vectors that can link, with the rows that hold them."""
    e = F.col("embedding")
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(usable & F.exists(e, lambda x: x != 0))
    grouped = good.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return grouped.withColumn("cid", F.monotonically_increasing_id())


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = batch.slice(at, 2000)
            lists = rows.column("embedding")
            size = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
            for dimensions in np.unique(size):
                mine = np.flatnonzero(size == dimensions)
                flat = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(mine), -1)
                unit = _unit(flat)
                salt = mix(rows.column("salt").take(pa.array(mine)).to_numpy().view(np.uint64) + np.uint64(dimensions))
                keys = cell_keys(unit, salt)
                cids = rows.column("cid").take(pa.array(mine)).to_numpy()
                own = np.zeros(keys.shape, bool)
                own[:, :, 0] = True
                each = keys.shape[1] * keys.shape[2]
                yield pa.record_batch([pa.array(signed(keys.ravel())), pa.array(np.repeat(cids, each)), pa.array(own.ravel())], names=["key", "cid", "own"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compare(threshold: float):
    """Task function over rows sorted by key and blocks: the verified links (a, b) of each run."""

    def run_links(cid: np.ndarray, own: np.ndarray, block: np.ndarray, unit: np.ndarray, within: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for at in range(0, len(cid), 512):
            near = unit[at : at + 512] @ unit[at:].T >= threshold
            near &= own[at : at + 512, None] | own[None, at:]
            if not within:
                near &= block[at : at + 512, None] != block[None, at:]
            i, j = np.nonzero(np.triu(near, 1))
            found.append((cid[at + i], cid[at + j]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def links(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            columns = {c: rows.column(c).to_numpy() for c in ("key", "low", "high", "cid", "own", "block", "group")}
            vectors = rows.column("embedding").combine_chunks()
            changed = np.zeros(len(rows) - 1, bool)
            size = np.diff(np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(rows) + 1])
            for c in (columns["key"], columns["low"], columns["high"], columns["group"], size):
                changed |= c[1:] != c[:-1]
            edges = np.append(0, np.flatnonzero(changed) + 1)
            found = [(np.zeros(0, np.int64),) * 2]
            for a, b in zip(edges, np.append(edges[1:], len(rows)), strict=True):
                if b - a > 1:
                    unit = _unit(vectors.slice(a, b - a).flatten().to_numpy().astype(float).reshape(b - a, -1))
                    found += run_links(columns["cid"][a:b], columns["own"][a:b], columns["block"][a:b], unit, columns["low"][a] == columns["high"][a])
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
            changes = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if last is not None and (key[:, 0] != last).any() and held:
                yield links(pa.Table.from_batches(held))
                held = []
            if len(changes):
                yield links(pa.Table.from_batches([*held, batch.slice(0, changes[-1])]))
                held = []
            held.append(batch.slice(changes[-1] if len(changes) else 0))
            last = key[:, -1]
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def class_links(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Distinct verified links (a, b), a < b, between classes."""
    filed = classes.select("cid", "embedding", F.xxhash64("label").alias("salt")).mapInArrow(_file, "key long, cid long, own boolean")
    keys = write_table(filed, "cells")
    counted = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("filed"))
    useful = counted.where("n > 1 AND filed").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = keys.join(useful, "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "cid", "own", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    vectors = classes.select("cid", F.xxhash64("label").alias("group"), "embedding")
    dealt = met.join(vectors, "cid").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "group", F.size("embedding"), "cid")
    ordered = dealt.select("key", "low", "high", "cid", "own", "block", "group", "embedding")
    return ordered.mapInArrow(_compare(threshold), "a long, b long").distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    kind = vectors.schema["embedding"].dataType
    part = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{part}>").alias("embedding"), "label")
    classes = write_table(_classes(rows), "classes")
    links = write_table(class_links(classes, threshold, block), "links")

    both = links.select(F.col("a").alias("of"), F.col("b").alias("to")).union(links.select("b", "a"))
    copies = classes.select(F.col("cid").alias("to"), "copies")
    degree = both.join(copies, "to").groupBy("of").agg(F.sum("copies").alias("others"))
    groups = components(links)
    first = classes.select(F.col("cid").alias("node"), "first_id")
    least = groups.join(first, "node").groupBy("root").agg(F.min("first_id").alias("component"))
    named = groups.join(least, "root").select(F.col("node").alias("cid"), "component")
    known = (
        classes.join(degree, F.col("cid") == F.col("of"), "left")
        .join(named, "cid", "left")
        .select(
            F.col("label").alias("group"),
            F.col("embedding").alias("held"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "first_id").alias("component"),
        )
    )
    # One row a class on the right; a vector that very many rows hold is split by the skew join.
    joined = rows.join(known, (F.col("label") == F.col("group")) & (F.col("embedding") == F.col("held")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
