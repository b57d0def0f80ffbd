"""A convolutional text classifier for toxicity, trained in numpy inside Spark tasks on all labelled documents.

A word is a letter or digit run, lower-cased and hashed twice; its embedding is the sum of both buckets' rows, so two words are
mixed up only if they share both. Filters of several widths run over the words, the largest response of each in the whole
text goes to a logistic unit, and its output is calibrated on labelled rows that were not trained on. Language is never an
input of the score; it only picks the threshold of the extra column ``flagged``.

Training reads every whole labelled text, long ones in pieces of ``PIECE_WORDS`` words. Scoring reads every whole text in slices.

Null and empty texts have no words and get the score of the bias; without labels of both kinds the score is the share of
toxic labels (0 without any); null languages have the common threshold; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, write_table
from .textbytes import lowered, prefix_sums, segment_hash, slices, words

BUCKETS = 1 << 16
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 4  # of each width
SHARD = 10_000  # documents that one task learns from by itself between two means
LABEL_BLOCK = 2_000_000  # labels that a pass over the documents looks up
PIECE_WORDS = 20_000  # words at a time of a long document
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.05, 7
CALIBRATION_ROUNDS = 50
TRIED, LEAST_TOXIC = np.arange(0.3, 0.95, 0.05), 10  # thresholds of a language, and the toxic rows it needs
SURE = 3.0  # standard errors that a bucket's counts must differ by to count at the start
THRESHOLD = 0.7
SCORE_SLICE = 1 << 19
_PADS = max(WIDTHS) - 1


def word_buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both buckets of each word (n, 2), and the words of each text."""
    data = lowered(data)
    first, end, row = words(data, starts)
    hashes = segment_hash(prefix_sums(data), first, end)
    pairs = np.stack([hashes & np.uint64(BUCKETS - 1), (hashes >> np.uint64(32)) & np.uint64(BUCKETS - 1)], axis=1)
    return pairs.astype(np.uint16), np.bincount(row, minlength=len(starts) - 1)


def padded(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with empty places behind each text, the places that are empty, and where texts begin."""
    starts = np.append(0, np.cumsum(counts + _PADS))[:-1]
    out = np.full((int((counts + _PADS).sum()), 2), BUCKETS, np.int32)
    real = np.arange(len(pairs)) + np.repeat(np.arange(len(counts)) * _PADS, counts)
    out[real] = pairs
    empty = np.ones(len(out), bool)
    empty[real] = False
    return out, empty, starts


@dataclass
class Model:
    """Weights; ``tables`` holds each bucket's contribution to every filter place, ready for scoring."""

    embeddings: list[np.ndarray]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    tables: list[np.ndarray] | None = None

    def finish(self) -> Model:
        flat = np.concatenate([w[j] for w in self.filters for j in range(len(w))], axis=1)
        self.tables = [(e @ flat).astype(np.float32) for e in self.embeddings]
        self.embeddings = []
        return self

    def scores(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of documents given by their word buckets and numbers of words."""
        if self.constant is not None or not len(counts):
            return np.full(len(counts), self.constant or 0.0)
        pairs, empty, begins = padded(pairs, counts)
        parts = self.tables[0][pairs[:, 0]] + self.tables[1][pairs[:, 1]]
        pooled, column, n = [], 0, len(parts)
        for width, bias in zip(WIDTHS, self.biases, strict=True):
            out = parts[:, column : column + FILTERS].copy()
            for j in range(1, width):
                out[: n - j] += parts[j:, column + j * FILTERS : column + (j + 1) * FILTERS]
            out[empty] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(out, begins, axis=0) + bias, 0))
            column += width * FILTERS
        logits = np.concatenate(pooled, axis=1) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


@dataclass
class Network:
    """What training changes: both tables of bucket embeddings, filters, biases and the logistic unit, with the sums of squared gradients."""

    embeddings: list[np.ndarray]
    dense: list[np.ndarray]
    squares: list[np.ndarray]
    steps: list[np.ndarray]

    def model(self) -> Model:
        n = len(WIDTHS)
        return Model(self.embeddings, self.dense[:n], self.dense[n : 2 * n], self.dense[-2], float(self.dense[-1][0]))


def bucket_counts(documents: list[np.ndarray], labels: np.ndarray, seen: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """By side, the number of documents of either label that hold each bucket, added to ``seen``."""
    seen = [np.zeros((2, BUCKETS + 1)) for _ in range(2)] if seen is None else seen
    for words_, label in zip(documents, labels, strict=True):
        for side in (0, 1):
            seen[side][label, np.unique(words_[:, side])] += 1
    return seen


def beginning(seen: list[np.ndarray], n: np.ndarray, rng: np.random.Generator) -> Network:
    """Random weights, but the first dimension starts from how surely toxic documents hold the bucket more often than others."""
    embeddings = [rng.normal(0, 0.05, (BUCKETS + 1, DIMENSIONS)) for _ in range(2)]
    for held, table in zip(seen, embeddings, strict=True):
        share = held.sum(0) / n.sum()
        surely = (held[1] / n[1] - held[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n).sum() + 1e-12)
        table[:, 0] = np.sign(surely) * np.clip(np.abs(surely) - SURE, 0, 6) / 2
        table[BUCKETS] = 0
    filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.5
    biases = [np.zeros(FILTERS) for _ in WIDTHS]
    dense = [*filters, *biases, np.abs(rng.normal(0.3, 0.1, FILTERS * len(WIDTHS))), np.array([-1.0])]
    return Network(embeddings, dense, [np.full(BUCKETS + 1, 1e-2) for _ in embeddings], [np.full_like(p, 1e-2) for p in dense])


def _pieces(documents: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray], list[bool]]]:
    """Groups of whole documents, or of one piece of a long one with the words its last windows reach into (True: more follow)."""
    owners, parts, size = [], [], 0
    for i, d in enumerate(documents):
        if owners and size + len(d) > PIECE_WORDS:
            yield owners, parts, [False] * len(owners)
            owners, parts, size = [], [], 0
        if len(d) <= PIECE_WORDS:
            owners, parts, size = [*owners, i], [*parts, d], size + len(d)
            continue
        for at in range(0, len(d), PIECE_WORDS):
            yield [i], [d[at : at + PIECE_WORDS + _PADS]], [at + PIECE_WORDS < len(d)]
    if owners:
        yield owners, parts, [False] * len(owners)


def strongest(documents: list[np.ndarray], net: Network) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each filter's largest response in each whole document, and by width the buckets of the window that gave it."""
    n = len(WIDTHS)
    best = [np.full((len(documents), FILTERS), -np.inf) for _ in WIDTHS]
    windows = [np.full((len(documents), FILTERS, w, 2), BUCKETS) for w in WIDTHS]
    for owners, parts, more in _pieces(documents):
        counts = np.array([len(d) for d in parts])
        pairs, empty, begins = padded(np.concatenate(parts), counts)
        if more[0]:
            empty[PIECE_WORDS:] = True  # windows that begin in the next piece
        x = net.embeddings[0][pairs[:, 0]] + net.embeddings[1][pairs[:, 1]]
        for k, f in enumerate(net.dense[:n]):
            out = x @ f[0]
            for j in range(1, len(f)):
                out[: len(x) - j] += x[j:] @ f[j]
            out[empty] = -1e9
            at = np.stack([out[s : s + c + _PADS].argmax(0) + s for s, c in zip(begins, counts, strict=True)])
            value = np.take_along_axis(out, at, 0)
            window = pairs[np.minimum(at[..., None] + np.arange(len(f)), len(x) - 1)]
            better = value > best[k][owners]
            best[k][owners] = np.where(better, value, best[k][owners])
            windows[k][owners] = np.where(better[..., None, None], window, windows[k][owners])
    return np.concatenate([np.maximum(v + b, 0) for v, b in zip(best, net.dense[n : 2 * n], strict=True)], axis=1), windows


def descend(documents: list[np.ndarray], labels: np.ndarray, net: Network) -> None:
    """One step of gradient descent on a few documents, in place."""
    n, weights, bias = len(WIDTHS), net.dense[-2], net.dense[-1]
    pooled, windows = strongest(documents, net)
    error = (1 / (1 + np.exp(-np.clip(pooled @ weights + bias[0], -30, 30))) - labels) / len(labels)
    back = error[:, None] * weights * (pooled > 0)
    gradients = [np.zeros_like(p) for p in net.dense]
    gradients[-2][:], gradients[-1][:] = pooled.T @ error, error.sum()
    touched, pushes = [], []
    for k, f in enumerate(net.dense[:n]):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        gradients[n + k][:] = g.sum(0)
        for j in range(len(f)):
            buckets = windows[k][:, :, j]
            x = net.embeddings[0][buckets[..., 0]] + net.embeddings[1][buckets[..., 1]]
            gradients[k][j] = np.einsum("df,dfe->ef", g, x)
            touched.append(buckets.reshape(-1, 2))
            pushes.append((g[..., None] * f[j].T[None]).reshape(-1, DIMENSIONS))
    touched, pushes = np.concatenate(touched), np.concatenate(pushes)
    for side, table in enumerate(net.embeddings):
        rows, where = np.unique(touched[:, side], return_inverse=True)
        push = np.zeros((len(rows), DIMENSIONS))
        np.add.at(push, where, pushes)
        net.squares[side][rows] += (push**2).mean(1)
        table[rows] -= RATE * push / np.sqrt(net.squares[side][rows])[:, None]
        table[BUCKETS] = 0
    for p, s, g in zip(net.dense, net.steps, gradients, strict=True):
        s += g * g
        p -= RATE * g / np.sqrt(s)


def logits_of(documents: list[np.ndarray], net: Network) -> np.ndarray:
    parts = [strongest(documents[i : i + BATCH], net)[0] @ net.dense[-2] + net.dense[-1][0] for i in range(0, len(documents), BATCH)]
    return np.concatenate(parts) if parts else np.zeros(0)


def train(documents: list[np.ndarray], labels: np.ndarray, languages: list[str | None], seed: int = SEED) -> Model:
    """Fit the network on word buckets (n, 2) of documents in memory; a fifth of them calibrates its output and the thresholds."""
    rng = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        return constant_model(float(labels.mean()) if len(labels) else 0.0)
    held = rng.random(len(labels)) < 0.2
    if held.all() or len(set(labels[~held])) < 2:
        held[:] = False
    fit_on = np.flatnonzero(~held)
    seen = bucket_counts([documents[i] for i in fit_on], labels[fit_on])
    net = beginning(seen, np.array([(labels[fit_on] == k).sum() for k in (0, 1)]), rng)
    for _ in range(EPOCHS):
        order = rng.permutation(fit_on)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            descend([documents[i] for i in chosen], labels[chosen], net)
    model = net.model()
    checked = np.flatnonzero(held) if held.any() else fit_on
    logits = logits_of([documents[i] for i in checked], net)
    model.scale, model.shift = calibrate(logits, labels[checked])
    scores = 1 / (1 + np.exp(-np.clip(model.scale * logits + model.shift, -30, 30)))
    model.thresholds = language_thresholds(scores, labels[checked], [languages[i] for i in checked])
    return model.finish()


def constant_model(share: float) -> Model:
    return Model([], [], [], np.zeros(0), 0.0, constant=share)


def calibrate(logits: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Scale and shift of the logits by logistic regression with smoothed targets."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    center, spread = logits.mean(), logits.std() + 1e-6
    x = (logits - center) / spread

    def sums(a: float, b: float) -> tuple[float, ...]:
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        return ((p - target) * x).sum(), (p - target).sum(), (w * x * x).sum(), (w * x).sum(), w.sum()

    a, b = newton(sums, rounds)
    return a / spread, b - a * center / spread


def newton(sums: Callable[[float, float], tuple[float, ...]], rounds: int) -> tuple[float, float]:
    """Newton steps with a little weight decay, from the sums over all rows of the gradient and of the second derivatives."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        ga, gb, haa, hab, hbb = sums(a, b)
        g = np.array([ga + 1e-3 * a, gb])
        h = np.array([[haa + 1e-3, hab], [hab, hbb + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def language_thresholds(scores: np.ndarray, labels: np.ndarray, languages: list[str | None]) -> dict[str, float]:
    """By language, the threshold of best F1 on the checked rows; languages with few toxic rows keep the common one."""
    found = {}
    for language in sorted({x for x in languages if x}):
        mine = np.array([x == language for x in languages])
        if labels[mine].sum() < LEAST_TOXIC:
            continue
        s, y = scores[mine], labels[mine]
        found[language] = _best([2 * ((s >= t) & (y == 1)).sum() / max(1, (s >= t).sum() + y.sum()) for t in TRIED])
    return found


def _best(f1: list[float]) -> float:
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    return float(TRIED[best[len(best) // 2]])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["place", "shard", "checked", "toxic", "lang"]
    for batch in batches:
        for rows, data, starts in slices(batch):
            pairs, counts = word_buckets(data, starts)
            ends = np.cumsum(counts)
            packed = [pairs[e - c : e].astype("<u2").tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.record_batch([*[rows.column(c) for c in names], pa.array(packed, pa.binary())], names=[*names, "words"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, pa.RecordBatch]]:
    """BATCH rows at a time, all of one shard: the shard, the documents, their labels, and the rows."""
    for batch in batches:
        shards, labels = batch.column("shard").to_numpy(), batch.column("toxic").to_numpy()
        borders = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
        for first, end in zip(borders, borders[1:]):
            for at in range(first, end, BATCH):
                rows = batch.slice(at, min(BATCH, end - at))
                documents = [np.frombuffer(w, "<u2").reshape(-1, 2) for w in rows.column("words").to_pylist()]
                yield int(shards[at]), documents, labels[at : at + len(documents)], rows


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = None
    for _, documents, labels, _ in _steps(batches):
        seen = bucket_counts(documents, labels, seen)
    for side, counts in enumerate(seen or []):
        rows = np.flatnonzero(counts.any(0))
        columns = [np.full(len(rows), side), rows, counts[0][rows], counts[1][rows]]
        yield pa.record_batch([pa.array(c) for c in columns], names=["side", "bucket", "n0", "n1"])


def _moved(start: Network, end: Network) -> Iterator[pa.RecordBatch]:
    """What a shard changed: a row for each bucket it touched, and for each dense number (side 2) with its sum of squares."""
    values = [f"v{i}" for i in range(DIMENSIONS + 1)]
    for side in (0, 1):
        grown = end.squares[side] - start.squares[side]
        rows = np.flatnonzero(grown[:BUCKETS])
        changes = end.embeddings[side][rows] - start.embeddings[side][rows]
        columns = [np.full(len(rows), side), rows, grown[rows], *changes.T]
        yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=["side", "bucket", *values])
    flat = [np.concatenate([(x - y).ravel() for x, y in zip(a, b, strict=True)]) for a, b in ((end.steps, start.steps), (end.dense, start.dense))]
    columns = [np.full(len(flat[0]), 2), np.arange(len(flat[0])), *flat, *[np.zeros(len(flat[0]))] * (DIMENSIONS - 1)]
    yield pa.record_batch([pa.array(c) for c in columns], names=["side", "bucket", *values])


def _round(rows: DataFrame, net: Network) -> Network:
    """Every shard descends through all its documents from the same network; a number moves by the mean over the shards that moved it."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, None
        for at, documents, labels, _ in _steps(batches):
            if at != shard:
                if own is not None:
                    yield from _moved(shared.value, own)
                shard, own = at, deepcopy(shared.value)
            descend(documents, labels, own)
        if own is not None:
            yield from _moved(shared.value, own)

    values = [f"v{i}" for i in range(DIMENSIONS + 1)]
    moved = rows.mapInArrow(run, "side long, bucket long, " + ", ".join(f"{v} double" for v in values))
    # At most one row a bucket and a dense number, however many shards there are.
    mean = moved.groupBy("side", "bucket").agg(*[F.avg(v).alias(v) for v in values]).toArrow()
    side, bucket = (mean.column(c).to_numpy() for c in ("side", "bucket"))
    change = np.stack([mean.column(v).to_numpy() for v in values], axis=1)
    out = deepcopy(net)
    for k in (0, 1):
        out.squares[k][bucket[side == k]] += change[side == k, 0]
        out.embeddings[k][bucket[side == k]] += change[side == k, 1:]
    order = np.argsort(bucket[side == 2])
    squares, dense = change[side == 2][order, :2].T
    at = 0
    for p, s in zip(out.dense, out.steps, strict=True):
        s += squares[at : at + p.size].reshape(p.shape)
        p += dense[at : at + p.size].reshape(p.shape)
        at += p.size
    shared.unpersist()
    return out


def _logits(rows: DataFrame, net: Network) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, documents, _, kept in _steps(batches):
            columns = [kept.column("toxic"), kept.column("lang"), pa.array(logits_of(documents, shared.value))]
            yield pa.record_batch(columns, names=["toxic", "lang", "logit"])

    return write_table(rows.mapInArrow(run, "toxic int, lang string, logit double"), "logits")


def _calibrated(logits: DataFrame) -> tuple[float, float]:
    """:func:`calibrate` with its sums over the rows made by Spark."""
    about = logits.agg(F.sum("toxic").alias("positive"), F.count("*").alias("n"), F.avg("logit").alias("m"), F.stddev_pop("logit").alias("s")).first()
    center, spread = about.m, about.s + 1e-6
    target = F.when(F.col("toxic") == 1, (about.positive + 1) / (about.positive + 2)).otherwise(1 / (about.n - about.positive + 2))
    rows = logits.select(((F.col("logit") - center) / spread).alias("x"), target.alias("t"))

    def sums(a: float, b: float) -> tuple[float, ...]:
        p = rows.select("x", "t", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("x") + b))))).alias("p"))
        x, gap, w = F.col("x"), F.col("p") - F.col("t"), F.col("p") * (1 - F.col("p")) + 1e-6
        return tuple(p.agg(F.sum(gap * x), F.sum(gap), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first())

    a, b = newton(sums, CALIBRATION_ROUNDS)
    return a / spread, b - a * center / spread


def _thresholds(logits: DataFrame, model: Model) -> dict[str, float]:
    """:func:`language_thresholds` from counts made by Spark."""
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.scale * F.col("logit") + model.shift))))
    tried = [float(t) for t in TRIED]
    counts = []
    for i, t in enumerate(tried):
        counts += [F.count_if(F.col("score") >= t).alias(f"n{i}"), F.count_if((F.col("score") >= t) & (F.col("toxic") == 1)).alias(f"y{i}")]
    by = logits.where("lang <> ''").withColumn("score", score).groupBy("lang").agg(F.sum("toxic").alias("toxic"), *counts).where(f"toxic >= {LEAST_TOXIC}")
    found = {}
    for row in by.collect():
        f1 = [2 * row[f"y{i}"] / max(1, row[f"n{i}"] + row.toxic) for i in range(len(tried))]
        found[row.lang] = _best(f1)
    return dict(sorted(found.items()))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on all labelled documents that are not held out, whole texts; where labels of a document differ, toxic holds.

    A fifth of them, by a hash of the id, calibrates the output and the thresholds. The others are dealt into shards of about
    ``SHARD`` documents. In each of ``EPOCHS`` rounds every shard descends through its documents on its own, and the network moves by the
    mean. The counts that the embeddings start from are those of all training documents. Only sums over rows reach the driver.
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("checked", F.pmod(F.xxhash64("doc_id", F.lit("checked")), F.lit(5)) == 0)
    known = write_table(known, "labels")
    labelled = known.count()
    shards = max(1, math.ceil(0.8 * labelled / SHARD))
    blocks = max(1, math.ceil(labelled / LABEL_BLOCK))
    place, block = F.xxhash64("doc_id", F.lit("place")), F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks))
    # Labels are sent to the texts a block at a time, as the other way would shuffle all texts.
    texts = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    parts = [texts.join(F.broadcast(known.where(block == i)), "doc_id") for i in range(blocks)]
    texts = reduce(DataFrame.unionAll, parts)
    texts = texts.select(place.alias("place"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), "checked", "toxic", "lang", "text")
    rows = texts.mapInArrow(_train_rows, "place long, shard int, checked boolean, toxic int, lang string, words binary")
    # Kept as dealt: a shard is one task's, in an order that does not depend on that of arrival.
    rows = cut_lineage(rows.repartition(shards, "shard").sortWithinPartitions("shard", "place", "words"))
    numbers = rows.groupBy("checked", "toxic").count().collect()
    n = {kept: np.array([sum(r["count"] for r in numbers if r.checked == kept and r.toxic == k) for k in (0, 1)]) for kept in (False, True)}
    total = n[False] + n[True]
    if not total.all():
        return constant_model(float(total[1] / max(1, total.sum())))
    apart = n[False].all() and n[True].any()
    if not apart:
        n[False] = total
    learnt, checked = (rows.where(~F.col("checked")), rows.where("checked")) if apart else (rows, rows)
    counts = learnt.mapInArrow(_count_buckets, "side long, bucket long, n0 double, n1 double")
    counts = counts.groupBy("side", "bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    seen = [np.zeros((2, BUCKETS + 1)) for _ in range(2)]
    side, bucket = (counts.column(c).to_numpy() for c in ("side", "bucket"))
    for k in (0, 1):
        for label in (0, 1):
            seen[k][label, bucket[side == k]] = counts.column(f"n{label}").to_numpy()[side == k]
    net = beginning(seen, n[False], np.random.default_rng(SEED))
    for _ in range(EPOCHS):
        net = _round(learnt, net)
    logits, model = _logits(checked, net), net.model()
    model.scale, model.shift = _calibrated(logits)
    model.thresholds = _thresholds(logits, model)
    return model.finish()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score of THRESHOLD or more), and flagged by the threshold of its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts in slices(batch, limit=SCORE_SLICE):
                scores = shared.value.scores(*word_buckets(data, starts))
                yield pa.record_batch([rows.column("doc_id"), rows.column("lang"), pa.array(scores)], names=["doc_id", "lang", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    scored = slim.mapInArrow(run, "doc_id long, lang string, score double")
    limit = F.lit(THRESHOLD)
    for language, value in model.thresholds.items():
        limit = F.when(F.col("lang") == language, value).otherwise(limit)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= limit).alias("flagged"),
    )


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))
