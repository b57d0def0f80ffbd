"""Exact nearest rows in a vector space.

Both sides are dealt into blocks, and every pair of blocks is searched by a task of its own that keeps the k nearest rows of each query.
With many donors of few dimensions the donors are cut into cells around sampled centres instead; the centre
distances bound how far a query's k-th neighbour can be, and a query only visits cells that reach
inside this bound. (With many dimensions such bounds exclude nothing, and blocks read less.) Every search returns at most k rows
per query, so all pairs are never produced. No donor rows come to the driver but the sampled centres.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_column
from ..functions.hashing import row_hash


CELL_DONORS = 20_000
CELL_DIMENSIONS = 12
BLOCK_ROWS = 8_192
CELL_ROWS = 4_000
MAX_CELLS = 4_096
VISIT_ROWS = 20_000
CHUNK = 256
ANY, OTHER, LATER = "any", "other", "later"
OUT = "q {q}, item {item}, n bigint, dist2 double"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; sums of squared differences below ten dimensions, dot products above."""
    if a.shape[1] <= 10:
        out = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            out += (a[:, j, None] - b[None, :, j]) ** 2
        return out
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.maximum(out, 0.0)


def _selected(ids, dist, item, n, k: int, take: int) -> tuple[np.ndarray, ...]:
    """Of each row of ``dist`` the nearest donors by (distance, item) until k copies are reached; items in rising order, ``take`` are enough."""
    if take < len(item):
        # Keep every donor as near as the k-th one, then order those by distance and item.
        bound = np.partition(dist, take - 1, axis=1)[:, take - 1]
        rows, cols = np.nonzero((dist <= bound[:, None]) & np.isfinite(dist))
    else:
        rows, cols = np.nonzero(np.isfinite(dist))
    near = dist[rows, cols]
    order = np.lexsort((cols, near, rows))
    rows, cols, near = rows[order], cols[order], near[order]
    copies = n[cols]
    upto = np.cumsum(copies)
    first = np.searchsorted(rows, np.arange(len(ids)))
    base = np.concatenate([[0], upto])[first]
    keep = upto - copies - base[rows] < k
    return ids[rows[keep]], item[cols[keep]], copies[keep], near[keep]


def _nearest(q, qv, item, dv, n, k: int, mode: str) -> pd.DataFrame:
    """For each query its nearest donors by (distance, item) until k copies are reached."""
    parts = []
    order = np.argsort(item, kind="stable")
    item, dv, n = item[order], dv[order], n[order]
    take = min(k + (mode != ANY), len(item))
    for start in range(0, len(q), CHUNK):
        ids, dist = q[start : start + CHUNK], _distances(qv[start : start + CHUNK], dv)
        if mode == LATER:
            dist[item[None, :] <= ids[:, None]] = np.inf
        elif mode == OTHER:
            dist[item[None, :] == ids[:, None]] = np.inf
        parts.append(_selected(ids, dist, item, n, k, take))
    if not parts:
        return pd.DataFrame({"q": [], "item": [], "n": [], "dist2": []})
    return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(["q", "item", "n", "dist2"])})


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float)


def nearest_rows(
    queries: DataFrame, donors: DataFrame, k: int, mode: str = ANY, cell_donors: int | None = None, cell_rows: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """``q, item, n, dist2``: each query's k nearest donors, ties by the smaller item.

    ``queries`` has ``q`` and ``vec``; ``donors`` has ``item``, ``vec`` and ``n``, the number of equal rows
    it stands for. ``mode`` ``later`` only takes donors with ``item > q`` and ``other`` only ``item != q``. More than ``cell_donors``
    donors of at most ``CELL_DIMENSIONS`` dimensions are searched by cells, all others by blocks of ``block_rows``.
    """
    types = {"q": queries.schema["q"].dataType.simpleString(), "item": donors.schema["item"].dataType.simpleString()}
    out = OUT.format(**types)
    size = donors.agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("dimensions")).first()
    if not size.rows:
        return queries.sparkSession.createDataFrame([], out)
    if size.rows > (CELL_DONORS if cell_donors is None else cell_donors) and size.dimensions <= CELL_DIMENSIONS:
        found = _by_cells(queries, donors, k, mode, out, cell_rows or CELL_ROWS)
    else:
        found = _by_blocks(queries, donors, size.rows, k, mode, out, block_rows or BLOCK_ROWS)
    nearest = Window.partitionBy("q").orderBy("dist2", "item")
    before = F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return found.withColumn("_before", before).filter(F.col("_before") < k).drop("_before")


def _search(k: int, mode: str):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "item": [], "n": [], "dist2": []})
        return _nearest(
            left["q"].to_numpy(), _matrix(left["vec"]), right["item"].to_numpy(), _matrix(right["vec"]), right["n"].to_numpy(), k, mode
        )

    return search


def _by_blocks(queries: DataFrame, donors: DataFrame, size: int, k: int, mode: str, out: str, block_rows: int) -> DataFrame:
    """Every pair of a block of queries and a block of donors is one group; small tables still make work for all cores."""
    asked = queries.count()
    spread = min(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(asked / CHUNK))
    rows, cols = max(1, math.ceil(asked / block_rows), spread), max(1, math.ceil(size / block_rows))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("q", "vec", F.pmod(F.xxhash64("q"), F.lit(rows)).cast("int").alias("a")).withColumn("b", every(cols))
    right = donors.select("item", "vec", "n", F.pmod(F.xxhash64("item", "vec"), F.lit(cols)).cast("int").alias("b")).withColumn("a", every(rows))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_search(k, mode), out)


def _by_cells(queries: DataFrame, donors: DataFrame, k: int, mode: str, out: str, cell_rows: int) -> DataFrame:
    size = donors.count()
    wanted = min(MAX_CELLS, math.ceil(size / cell_rows))
    picked = donors.select("vec").orderBy(row_hash(F.col("item"), F.to_json(F.array(F.element_at("vec", 1))))).limit(wanted)
    centres = np.unique(np.array([r["vec"] for r in picked.collect()], dtype=float), axis=0)

    def place(frames):
        for f in frames:
            vectors = _matrix(f["vec"])
            for start in range(0, len(f), 4096):
                d = _distances(vectors[start : start + 4096], centres)
                part = f.iloc[start : start + 4096].copy()
                part["cell"] = d.argmin(1).astype("int32")
                part["reach"] = np.sqrt(d.min(1))
                yield part

    item_type = donors.schema["item"].dataType.simpleString()
    placed = donors.select("item", "vec", "n").mapInPandas(
        place, f"item {item_type}, vec array<double>, n bigint, cell int, reach double"
    )
    needed = k + (mode == OTHER)
    last = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("item").desc()))
    stats = (
        placed.groupBy("cell")
        .agg(F.max("reach").alias("reach"), F.sum("n").alias("n"), F.count("*").alias("rows"), F.max("item").alias("top"))
        .collect()
    )
    cells = np.array([r["cell"] for r in stats])
    reach = np.array([r["reach"] for r in stats]) * (1 + 1e-9) + 1e-9
    enough = np.array([r["n"] >= needed for r in stats])
    tops = np.array([r["top"] for r in stats])
    kth = np.full(len(cells), -np.inf)
    if mode == LATER:
        ranked = placed.select("cell", "item").withColumn("_r", last).filter(F.col("_r") == k)
        at = {r["cell"]: r["item"] for r in ranked.collect()}
        kth = np.array([at.get(c, -np.inf) for c in cells], dtype=float)
    parts = {int(r["cell"]): max(1, math.ceil(r["rows"] / (4 * cell_rows))) for r in stats}
    heads = centres[cells]

    def visit(frames):
        for f in frames:
            vectors, q = _matrix(f["vec"]), f["q"].to_numpy()
            for start in range(0, len(f), CHUNK):
                d = np.sqrt(_distances(vectors[start : start + CHUNK], heads))
                ids = q[start : start + CHUNK]
                usable = (kth[None, :] > ids[:, None]) if mode == LATER else np.broadcast_to(enough, d.shape)
                bound = np.where(usable, d + reach, np.inf).min(1)
                go = d - reach <= bound[:, None] + 1e-9
                if mode == LATER:
                    go &= tops[None, :] > ids[:, None]
                rows, cols = np.nonzero(go)
                pieces = np.array([parts[int(c)] for c in cells])[cols]
                rows, cols, piece = (
                    np.repeat(rows, pieces), np.repeat(cols, pieces), np.concatenate([np.arange(p) for p in pieces] or [[]]),
                )
                yield pd.DataFrame(
                    {
                        "q": ids[rows],
                        "vec": [vectors[start + r] for r in rows],
                        "cell": cells[cols].astype("int32"),
                        "part": piece.astype("int32"),
                    }
                )

    q_type = queries.schema["q"].dataType.simpleString()
    visits = queries.select("q", "vec").mapInPandas(visit, f"q {q_type}, vec array<double>, cell int, part int")
    loads = visits.groupBy("cell", "part").agg(F.ceil(F.count("*") / VISIT_ROWS).cast("int").alias("copies"))
    # At most MAX_CELLS cells times their parts, so this table is small by construction.
    loads = F.broadcast(loads)
    visits = visits.join(loads, ["cell", "part"]).withColumn(
        "copy", F.pmod(F.xxhash64("q", F.lit("copy")), F.col("copies")).cast("int")
    )
    piece_count = _lookup({int(c): p for c, p in parts.items()}, F.col("cell"))
    homes = (
        placed.withColumn("part", F.pmod(F.xxhash64("item", "vec"), piece_count).cast("int"))
        .join(loads, ["cell", "part"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    )

    by = ["cell", "part", "copy"]
    return (
        visits.select("q", "vec", *by).groupBy(*by).cogroup(homes.select("item", "vec", "n", *by).groupBy(*by)).applyInPandas(_search(k, mode), out)
    )


def _lookup(mapping: dict[int, int], key: Column) -> Column:
    special = {c: p for c, p in mapping.items() if p > 1}
    if not special:
        return F.lit(1)
    pairs = [F.lit(x) for item in special.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(1))


def nearest_incomplete(rows: DataFrame, size: int, k: int, max_cells: int | None = None, part_rows: int | None = None) -> DataFrame:
    """``id, target, item, n, dist2``: for every missing place of every vector the values at that place of the k nearest rows that have it.

    ``rows`` has ``id``, ``v`` (``size`` places, missing ones NULL) and ``n``, the number of equal rows. Squared distances run over the places both
    vectors have and are scaled up by (size / places in common); equal ones prefer the smaller value; rows without a common place are not compared.

    All kinds of incomplete vectors are searched at once. Donors are cut into cells by which places they have and by quantiles of these. The
    corners of a cell's box bound the distance from below and above over the places in common; a query visits the cells that may be nearer
    than the upper bound that holds k donors. Cells of many rows are dealt into parts; at most ``max_cells`` boxes come to the driver.
    """
    part = part_rows or BLOCK_ROWS
    have = F.concat_ws("", F.transform("v", lambda x: F.when(x.isNull(), "0").otherwise("1")))
    rows = rows.withColumn("have", have)
    known = rows.agg(F.count("*").alias("rows"), F.countDistinct("have").alias("kinds"), F.count_if(F.col("have").contains("0") & F.col("have").contains("1")).alias("asked")).first()
    out = "id bigint, target int, item double, n bigint, dist2 double"
    if not known.asked:
        return rows.sparkSession.createDataFrame([], out)
    limit = max_cells or min(MAX_CELLS, max(known.kinds, known.rows // CHUNK))
    cuts = max(1, int((limit / known.kinds) ** (1 / size) + 1e-9))
    shares = [i / cuts for i in range(1, cuts)]
    edges = rows.agg(*[F.percentile_approx(F.col("v")[i], shares, 1000).alias(f"e{i}") for i in range(size)]).first() if shares else None

    def bin_of(i: int) -> Column:
        x = F.col("v")[i]
        return F.coalesce(sum(((x > e).cast("int") for e in sorted(set(edges[i] or []))), F.lit(0)), F.lit(-1)) if edges else F.lit(0)

    # With more kinds of vectors than cells, several kinds share a cell, and its box bounds nothing.
    place = F.xxhash64("have", *[bin_of(i) for i in range(size)]) if known.kinds <= limit else F.pmod(F.xxhash64("have"), F.lit(limit))
    placed = rows.filter(F.col("have").contains("1")).withColumn("cell", place)
    stats = placed.groupBy("cell").agg(
        F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("have").alias("least"), F.max("have").alias("most"),
        *[f(F.col("v")[i]).alias(f"{name}{i}") for i in range(size) for name, f in (("lo", F.min), ("hi", F.max))],
    ).collect()
    cell = np.array([r["cell"] for r in stats])
    count = np.array([r["n"] for r in stats])
    parts = np.array([math.ceil(r["rows"] / part) for r in stats])
    fixed = np.array([r["least"] == r["most"] for r in stats])
    owned = np.array([[r[f"lo{i}"] is not None for i in range(size)] for r in stats])
    low, high = (np.array([[r[f"{b}{i}"] if r[f"{b}{i}"] is not None else 0.0 for i in range(size)] for r in stats]) for b in ("lo", "hi"))

    def visit(frames):
        for f in frames:
            vectors, ids = _matrix(f["v"]), f["id"].to_numpy()
            for start in range(0, len(f), CHUNK):
                x = vectors[start : start + CHUNK]
                mine = ~np.isnan(x)
                near, far = np.zeros((2, len(x), len(cell)))
                common = (mine[:, None, :] & owned[None]).sum(2)
                for j in range(size):
                    both = mine[:, j, None] & owned[None, :, j]
                    below, above = low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]
                    near += np.where(both, np.maximum(np.maximum(below, above), 0.0) ** 2, 0.0)
                    far += np.where(both, np.maximum(np.abs(below), np.abs(above)) ** 2, 0.0)
                scale = size / np.maximum(common, 1)
                near = np.where(common > 0, np.where(fixed, near * scale, 0.0), np.inf)
                far = np.where((common > 0) & fixed, far * scale, np.inf)
                for target in range(size):
                    at = np.flatnonzero(~mine[:, target] & mine.any(1))
                    there = np.flatnonzero(owned[:, target])
                    if not len(at) or not len(there):
                        continue
                    worst = far[np.ix_(at, there)]
                    order = np.argsort(worst, axis=1)
                    enough = np.cumsum(count[there][order], axis=1) >= k
                    bound = np.where(enough, np.take_along_axis(worst, order, 1), np.inf).min(1)
                    q, c = np.nonzero(near[np.ix_(at, there)] <= bound[:, None] * (1 + 1e-9) + 1e-12)
                    q, c = at[q], there[c]
                    finite = np.isfinite(near[q, c])
                    q, c = q[finite], c[finite]
                    q, piece, c = np.repeat(q, parts[c]), np.concatenate([np.arange(p) for p in parts[c]] or [np.zeros(0, int)]), np.repeat(c, parts[c])
                    yield pd.DataFrame({"id": ids[start + q], "target": np.full(len(q), target, "int32"), "x": list(x[q]), "cell": cell[c], "part": piece.astype("int32")})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        donors, n = (_matrix(right["v"]), right["n"].to_numpy()) if len(right) else (np.zeros((0, size)), np.zeros(0))
        for target, wanted in left.groupby("target"):
            use = np.flatnonzero(~np.isnan(donors[:, target]))
            if not len(use):
                continue
            use = use[np.argsort(donors[use, target], kind="stable")]
            y, asked = donors[use], _matrix(wanted["x"])
            for start in range(0, len(asked), CHUNK):
                x, dist, common = asked[start : start + CHUNK], 0.0, 0
                for j in range(size):
                    both = ~np.isnan(x[:, j, None]) & ~np.isnan(y[None, :, j])
                    dist = dist + np.where(both, (x[:, j, None] - y[None, :, j]) ** 2, 0.0)
                    common = common + both
                dist = np.where(common > 0, dist * (size / np.maximum(common, 1)), np.inf)
                ids = wanted["id"].to_numpy()[start : start + CHUNK]
                q, item, copies, near = _selected(ids, dist, y[:, target], n[use], k, min(k, len(use)))
                found.append(pd.DataFrame({"id": q, "target": np.full(len(q), target, "int32"), "item": item, "n": copies, "dist2": near}))
        return pd.concat(found) if found else pd.DataFrame({"id": [], "target": [], "item": [], "n": [], "dist2": []})

    incomplete = rows.filter(F.col("have").contains("0") & F.col("have").contains("1")).select("id", "v")
    visits = incomplete.repartition("id").mapInPandas(visit, "id bigint, target int, x array<double>, cell bigint, part int")
    copies = math.ceil(known.asked / VISIT_ROWS)
    visits = visits.withColumn("copy", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    homes = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    homes = homes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    by = ["cell", "part", "copy"]
    found = visits.groupBy(*by).cogroup(homes.select("v", "n", *by).groupBy(*by)).applyInPandas(search, out)
    nearest = Window.partitionBy("id", "target").orderBy("dist2", "item")
    before = F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return found.withColumn("before", before).filter(F.col("before") < k)


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``item, vec, n``: the vectors as unit-length doubles; a zero vector stays zero."""
    vec = F.transform(as_column(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(x))
    return df.select(as_column(key).alias("item"), unit.alias("vec"), F.lit(1).cast("bigint").alias("n"))


def similar_pairs(df: DataFrame, key: str, vector: str, k: int = 10, **sizes) -> DataFrame:
    """``i, j, similarity``: per row its k most similar later rows (j > i) by cosine, positive ones only."""
    items = unit_vectors(df, key, vector)
    near = nearest_rows(items.select(F.col("item").alias("q"), "vec"), items, k, LATER, **sizes)
    return _cosine(near).filter(F.col("similarity") > 0)


def topk_neighbours(df: DataFrame, key: str, vector: str, k: int = 10, **sizes) -> DataFrame:
    """``i, j, similarity``: per row its k most similar other rows by cosine."""
    items = unit_vectors(df, key, vector)
    return _cosine(nearest_rows(items.select(F.col("item").alias("q"), "vec"), items, k, OTHER, **sizes))


def _cosine(near: DataFrame) -> DataFrame:
    return near.select(F.col("q").alias("i"), F.col("item").alias("j"), (1 - F.col("dist2") / 2).alias("similarity"))
