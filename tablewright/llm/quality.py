"""Quality of documents by co-training a text view and a metadata view.

The text view sees how characters follow each other and how words repeat; the metadata view sees language, source, declared length and
the layout of lines, and never a character or word. Both are logistic regressions trained in numpy. In every round each view
labels unlabelled documents that it is confident of, as many of either class as their share, for the other one. At last each
view is calibrated on labelled documents kept apart, and a logistic unit over both calibrated views scores every document.

At most ``TRAIN_LABELLED`` labelled and ``TRAIN_UNLABELLED`` other documents, chosen by a hash of the id, are trained on; all are scored.

Null and empty texts are texts without characters; null languages and sources are a category of their own, a null length counts
as the real one; without labels of both kinds the score is the share of good labels (1 without any); repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbytes import lowered, prefix_sums, runs, segment_hash, slices, words
from .toxicity import calibrate

TRAIN_LABELLED, TRAIN_UNLABELLED = 8000, 8000
ROUNDS, CONFIDENT, GIVEN = 4, 0.95, 0.1  # rounds, confidence needed, share of the unlabelled given to the other view in a round
KEEP = 0.5
CATEGORIES = 32
_CLASSES = 11


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(256, 10, np.uint8)  # other marks
    table[97:123], table[65:91], table[48:58], table[128:] = 0, 1, 2, 3
    for code, marks in ((4, b" \t\r\f\v"), (5, b"\n"), (6, b".,;:?'"), (7, b"!"), (8, b"|"), (9, b"*#$%&")):
        table[list(marks)] = code
    return table


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def text_view(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shares of character-class pairs, and of repeated words, by text."""
    n, size = len(starts) - 1, np.diff(starts)
    classes = _classes()[data].astype(np.int64)
    row = np.repeat(np.arange(n), size)
    same = row[1:] == row[:-1]
    pairs = np.bincount(((row[1:] * _CLASSES + classes[:-1]) * _CLASSES + classes[1:])[same], minlength=n * _CLASSES**2)
    shares = np.sqrt(pairs.reshape(n, -1) / np.maximum(1, size)[:, None])
    first, end, of = words(data, starts)
    hashes = segment_hash(prefix_sums(lowered(data)), first, end)
    count = np.maximum(1, np.bincount(of, minlength=n))
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) if len(of) else np.zeros(0, bool)
    known = ~pd.Series(hashes ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated().to_numpy()
    length = _sums((end - first).astype(float), of, n) / count
    extra = [_sums(again.astype(float), of, n) / count, _sums(known.astype(float), of, n) / count, np.log1p(length), np.minimum(1, count / 50)]
    return np.column_stack([shares, *extra]).astype(np.float32)


def metadata_view(data: np.ndarray, starts: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
    """Language, source, lengths and line layout, by text."""
    n, size = len(starts) - 1, np.diff(starts).astype(float)
    first, end, of = runs(data != 10, starts)
    lines = np.maximum(1, np.bincount(of, minlength=n))
    length = (end - first).astype(float)
    mean = _sums(length, of, n) / lines
    spread = np.sqrt(np.maximum(0, _sums(length**2, of, n) / lines - mean**2))
    declared = rows.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)
    declared = np.where(np.isnan(declared), size, declared)
    columns = [np.log1p(np.abs(declared)), np.log1p(size) - np.log1p(np.abs(declared)), np.log(lines), np.log1p(mean), spread / (mean + 1)]
    out = np.zeros((n, len(columns) + 2 * CATEGORIES))
    out[:, : len(columns)] = np.column_stack(columns)
    for k, name in enumerate(("lang", "source")):
        place = [zlib.crc32(repr(v).encode()) % CATEGORIES for v in rows.column(name).to_pylist()]
        out[np.arange(n), len(columns) + k * CATEGORIES + np.array(place, np.int64)] = 1
    return out.astype(np.float32)


@dataclass
class View:
    """A standardised logistic regression with the calibration of its logits."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.clip(self.scale * (z @ self.weights[:-1] + self.weights[-1]) + self.shift, -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_view(x: np.ndarray, y: np.ndarray, decay: float = 3.0, steps: int = 8) -> View:
    """Newton steps on the penalised likelihood."""
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = np.column_stack([np.clip((x - mean) / spread, -8, 8), np.ones(len(x))]).astype(float)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], decay)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p) + 1e-4)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 3 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return View(mean, spread, w)


@dataclass
class CoTrained:
    views: tuple[View, View] | None
    weights: np.ndarray
    constant: float = 1.0
    exchanged: int = 0

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(text), self.constant)
        a, b = (v.logits(x) for v, x in zip(self.views, (text, metadata), strict=True))
        return sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def co_train(labelled: list[np.ndarray], y: np.ndarray, unlabelled: list[np.ndarray], seed: int = 8) -> CoTrained:
    """``labelled`` and ``unlabelled``: features of both views, (text, metadata)."""
    if not len(y) or y.min() == y.max():
        return CoTrained(None, np.zeros(3), float(y.mean()) if len(y) else 1.0)
    apart = np.random.default_rng(seed).random(len(y)) < 0.25
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart[:] = False
    checked = apart if apart.any() else ~apart
    own = [[labelled[k][~apart], y[~apart].astype(float)] for k in (0, 1)]
    open_ = [np.ones(len(unlabelled[0]), bool) for _ in (0, 1)]
    exchanged = 0
    for round_ in range(ROUNDS + 1):
        views = [fit_view(*own[k]) for k in (0, 1)]
        for k, view in enumerate(views):
            view.scale, view.shift = calibrate(view.logits(labelled[k][checked]), y[checked])
        if round_ == ROUNDS or not len(unlabelled[0]):
            break
        for k, view in enumerate(views):
            other, p = 1 - k, sigmoid(view.logits(unlabelled[k]))
            good = float(np.clip(y.mean(), 0.05, 0.95))
            for label, sure, share in ((1.0, p, good), (0.0, 1 - p, 1 - good)):
                found = np.flatnonzero(open_[other] & (sure >= CONFIDENT))
                found = found[np.argsort(-sure[found], kind="stable")][: int(len(p) * GIVEN * share)]
                open_[other][found] = False
                own[other][0] = np.concatenate([own[other][0], unlabelled[other][found]])
                own[other][1] = np.concatenate([own[other][1], np.full(len(found), label)])
                exchanged += len(found)
    both = np.column_stack([v.logits(x[checked]) for v, x in zip(views, labelled, strict=True)])
    used = np.array([True, True])
    while True:  # a view may not count against itself
        joint = fit_view(both * used, y[checked].astype(float), decay=1.0, steps=20)
        # The mean and spread of the joint unit go into its weights.
        slope = np.where(used, joint.weights[:-1] / joint.spread, 0.0)
        if (slope >= 0).all() or not used.all():
            weights = np.append(np.maximum(slope, 0), joint.weights[-1] - (slope * joint.mean).sum())
            return CoTrained((views[0], views[1]), weights, exchanged=exchanged)
        used &= slope >= 0


def _inputs(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "lang": "string", "source": "string", "n_chars": "double", "text": "string"}
    return docs.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, starts in slices(batch):
            views = text_view(data, starts), metadata_view(data, starts, rows)
            columns = [pa.array([x.tobytes() for x in view.astype("<f4")], pa.binary()) for view in views]
            yield pa.record_batch([rows.column("doc_id"), rows.column("quality"), *columns], names=["doc_id", "quality", "a", "b"])


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    share = min(1.0, TRAIN_LABELLED / max(1, known.count()))
    chosen = known.where(draw < share * (1 << 20)).dropDuplicates(["doc_id"]).limit(2 * TRAIN_LABELLED)
    rows = _inputs(docs)
    # Both sides that are broadcast are bounded by the parameters above.
    labelled = rows.join(F.broadcast(chosen), "doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    share = min(1.0, TRAIN_UNLABELLED / max(1, docs.count()))
    others = ids.where(draw < share * (1 << 20)).join(known, "doc_id", "left_anti").distinct().limit(2 * TRAIN_UNLABELLED)
    unlabelled = rows.join(F.broadcast(others), "doc_id").withColumn("quality", F.lit(None).cast("int"))
    got = labelled.select(*rows.columns, "quality").unionByName(unlabelled).mapInArrow(_features, "doc_id long, quality int, a binary, b binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.a, r.b, r.quality or 0))

    def part(known_: bool) -> list[np.ndarray]:
        kept = [r for r in got if (r.quality is not None) == known_]
        return [np.array([np.frombuffer(r[name], "<f4") for r in kept]) for name in ("a", "b")]

    return co_train(part(True), np.array([r.quality for r in got if r.quality is not None], np.int64), part(False))


def score_documents(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, score (probability of good quality), keep (score of KEEP or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts in slices(batch):
                score = model.scores(text_view(data, starts), metadata_view(data, starts, rows))
                yield pa.record_batch([rows.column("doc_id"), pa.array(score), pa.array(score >= KEEP)], names=["doc_id", "score", "keep"])

    return _inputs(docs).mapInArrow(run, "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame, model: CoTrained) -> DataFrame:
    """The documents that the model keeps, with all their columns."""
    kinds = {"lang": pa.string(), "source": pa.string(), "n_chars": pa.float64(), "text": pa.large_string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = pa.record_batch([batch.column(name).cast(kind) for name, kind in kinds.items()], names=list(kinds))
            kept = [np.zeros(0, bool)]
            for rows, data, starts in slices(inputs):
                kept.append(model.scores(text_view(data, starts), metadata_view(data, starts, rows)) >= KEEP)
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
