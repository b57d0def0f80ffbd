"""Approximate nearest vectors by multi-index hashing of learned binary codes.

A code is the signs of the vector after a learned rotation (alternating rotations and codes on a sample of at most ``SAMPLE`` vectors), cut
into substrings of eight bits. Every row is indexed: a task files its rows under the value of each substring, ``CHUNK`` rows at a time.
Two codes that differ in at most r bits differ in few bits in one of the substrings, so probing the values near the query's own
substrings retrieves every code within r; whole distances are verified, and the vectors that stay are ranked by their cosines.

The radius of a query is that in which a vector as near as its last one of the ``k`` best so far lies with probability ``CONFIDENCE``: the
bits of two vectors at an angle differ as independent draws would. Before it has ``k`` rows, its radius grows until it has them. So
near neighbours keep the probes few, and no query is left with fewer rows than there are.

Queries are a set against all rows, in blocks of at most ``BLOCK``; a block's vectors travel with the tasks, rows are not moved.

Vectors that are null, empty or zero, or hold null or non-finite parts, take no part, and only vectors of one length are compared. A null id
is no query and comes first among equal cosines. Repeated rows are vectors and queries of their own: a query leaves out one row that
has its id and vector. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import write_table

SAMPLE = 10_000
ROUNDS = 20
CHUNK = 50_000
BLOCK = 10_000
CONFIDENCE = 0.9
SALTS = 64
_MASKS = np.array(sorted(range(256), key=lambda m: (m.bit_count(), m)), np.uint8)
_BALL = np.cumsum([math.comb(8, r) for r in range(9)])  # masks of at most r ones


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn_rotation(unit: np.ndarray, dimensions: int) -> np.ndarray:
    """Rotations whose signs keep the sample's vectors best, side by side until there are 64 columns or more, a multiple of eight."""
    found = []
    for turn in range(max(1, -(-64 // dimensions))):
        rotation = np.linalg.qr(np.random.default_rng([12, dimensions, turn]).normal(size=(dimensions, dimensions)))[0]
        for _ in range(ROUNDS if len(unit) >= dimensions else 0):
            left, _, right = np.linalg.svd(unit.T @ np.where(unit @ rotation > 0, 1.0, -1.0))
            rotation = left @ right
        found.append(rotation)
    columns = np.concatenate(found, axis=1)
    spare = -columns.shape[1] % 8
    return np.concatenate([columns, columns[:, :spare]], axis=1)


def codes(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """One byte a substring."""
    return np.packbits(unit @ rotation > 0, axis=1)


@lru_cache(65536)
def radius(cosine: float, bits: int, confidence: float) -> int:
    """Bits within which a code at this cosine lies with the given probability."""
    share = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    if share <= 0:
        return 0
    total, each = 0.0, (1 - share) ** bits
    for r in range(bits):
        total += each
        if total >= confidence:
            return r
        each *= (bits - r) / (r + 1) * share / (1 - share) if share < 1 else 0.0
    return bits


class Tables:
    """The rows of a chunk filed under the value of each substring of their codes."""

    def __init__(self, code: np.ndarray) -> None:
        self.code = code
        self.order = np.argsort(code, axis=0, kind="stable")
        self.edge = np.stack([np.searchsorted(code[self.order[:, j], j], np.arange(257)) for j in range(code.shape[1])])

    def within(self, query: np.ndarray, r: int) -> np.ndarray:
        """All rows whose code is at most ``r`` bits from the query's."""
        tables = len(query)
        near, extra = divmod(r, tables)
        met = np.zeros(len(self.code), bool)
        for j in range(tables):
            # Codes r apart: one of the first extra + 1 substrings is at most near bits apart, or one of the others at most near - 1.
            ball = near if j <= extra else near - 1
            if ball >= 8:
                return np.flatnonzero(self._distance(query, slice(None)) <= r)
            if ball >= 0:
                values = (query[j] ^ _MASKS[: _BALL[ball]]).astype(np.int64)
                start, size = self.edge[j, values], self.edge[j, values + 1] - self.edge[j, values]
                at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                met[self.order[at, j]] = True
        rows = np.flatnonzero(met)
        return rows[self._distance(query, rows) <= r]

    def _distance(self, query: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        return np.bitwise_count(self.code[rows] ^ query).sum(1, dtype=np.int64)


class Nearest:
    """The rows found for one query: highest cosine first, then the smallest id, a null id before all."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.id, self.known, self.same = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)

    def radius(self, bits: int, confidence: float) -> int | None:
        """None before there are enough rows."""
        return radius(round(float(self.score[-1]), 3), bits, confidence) if len(self.score) == self.k else None

    def with_rows(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray, same: np.ndarray) -> Nearest:
        out = Nearest(self.k)
        score, ids, known, same = np.append(self.score, score), np.append(self.id, ids), np.append(self.known, known), np.append(self.same, same)
        if len(score) > 64 + self.k:  # what ties with the last of the best stays
            keep = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
            score, ids, known, same = score[keep], ids[keep], known[keep], same[keep]
        order = np.lexsort((ids, known, -score))[: self.k]
        out.score, out.id, out.known, out.same = score[order], ids[order], known[order], same[order]
        return out


def _search(queries: dict[int, tuple], rotations: dict[int, np.ndarray], k: int, confidence: float):
    """Task function over vectors: (query, vec_id, score, same) of the task's ``k`` best for each query; ``same`` marks rows like the query."""

    def chunk(vectors: list[np.ndarray], ids: np.ndarray, known: np.ndarray, dimensions: int, best: list[Nearest]) -> None:
        unit = _unit(np.stack(vectors))
        tables = Tables(codes(unit, rotations[dimensions]))
        _, asked_id, asked, asked_code = queries[dimensions]
        bits = asked_code.shape[1] * 8
        for q in range(len(asked)):
            r = best[q].radius(bits, confidence)
            reach = r if r is not None else asked_code.shape[1] - 1
            while True:
                rows = tables.within(asked_code[q], reach)
                score = (unit[rows] * asked[q]).sum(1)
                same = known[rows] & (ids[rows] == asked_id[q]) & (unit[rows] == asked[q]).all(1)
                now = best[q].with_rows(score, ids[rows], known[rows], same)
                wanted = now.radius(bits, confidence)
                wanted = bits if wanted is None else wanted
                if reach >= wanted or r is not None:
                    break
                reach = min(wanted, reach + asked_code.shape[1] // 2)
            best[q] = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: [Nearest(k) for _ in range(len(q[0]))] for d, q in queries.items()}
        held: dict[int, list] = {d: [] for d in queries}

        def settle(dimensions: int) -> None:
            rows, held[dimensions] = held[dimensions], []
            if rows:
                ids = np.array([0 if i is None else i for i, _ in rows], np.int64)
                chunk([v for _, v in rows], ids, np.array([i is not None for i, _ in rows]), dimensions, best[dimensions])

        for batch in batches:
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                values = vector.values.to_numpy(zero_copy_only=False).astype(float)
                if len(values) in held:
                    held[len(values)].append((vec_id, values))
                    if len(held[len(values)]) >= CHUNK:
                        settle(len(values))
        for d in held:
            settle(d)
            for n, found in zip(queries[d][0], best[d], strict=True):
                columns = [pa.array(np.full(len(found.score), n)), pa.array(found.id, mask=~found.known), pa.array(found.score), pa.array(found.same)]
                yield pa.record_batch(columns, names=["query", "vec_id", "score", "same"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that can be compared, in double precision."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """A rotation for each length of vector, learned on at most ``sample`` rows chosen by hash."""
    n = vectors.count()
    share = F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * sample / max(n, 1)))
    found: dict[int, list] = {row[0]: [] for row in vectors.select(F.size("embedding")).distinct().collect()}
    for row in vectors.where(share).limit(sample).toLocalIterator():
        found[len(row.embedding)].append(row.embedding)
    return {d: learn_rotation(_unit(np.array(rows)) if rows else np.zeros((0, d)), d) for d, rows in found.items()}


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("vec_id"), F.desc("same"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, wanted: DataFrame, k: int = 5, block: int = BLOCK, confidence: float = CONFIDENCE, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` for each row of ``wanted``, both (vec_id, embedding)."""
    rows = usable(vectors)
    asked = write_table(usable(wanted).where("vec_id IS NOT NULL").withColumn("query", F.monotonically_increasing_id()), "queries")
    rotations, blocks = fit(rows, sample), -(-asked.count() // block)
    found = vectors.sparkSession.createDataFrame([], "query long, vec_id long, score double, same boolean")
    for b in range(blocks):
        queries: dict[int, list] = {}
        for row in asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect():
            queries.setdefault(len(row.embedding), []).append(row)
        packed = {}
        for d in queries.keys() & rotations.keys():
            unit = _unit(np.array([row.embedding for row in queries[d]]))
            ids = np.array([[row.query, row.vec_id] for row in queries[d]], np.int64)
            packed[d] = (ids[:, 0], ids[:, 1], unit, codes(unit, rotations[d]))
        task = _search(packed, {d: rotations[d] for d in packed}, k + 1, confidence)
        found = found.union(rows.mapInArrow(task, "query long, vec_id long, score double, same boolean"))
    best = _ranked(found.withColumn("salt", F.spark_partition_id() % SALTS), k + 1, "query", "salt").drop("rank", "salt")
    best = _ranked(best, k + 1, "query")
    # One of the rows that are like the query is the query itself.
    own = F.first(F.when(F.col("same"), F.col("rank")), True).over(
        Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    others = best.withColumn("own", own).where("own IS NULL OR rank <> own").withColumn("rank", (F.col("rank") - F.coalesce((F.col("own") < F.col("rank")).cast("int"), F.lit(0))))
    names = asked.select(F.col("vec_id").alias("query_id"), F.col("query").alias("of"))
    return others.where(F.col("rank") <= k).join(names, F.col("query") == F.col("of")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
