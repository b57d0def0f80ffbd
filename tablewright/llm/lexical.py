"""Ranked lexical search by NRA: impact-sorted lists read in order, with a lower and an upper score for every document.

Items are a query set against all rows, in blocks: a block's terms are at most ``BLOCK_BYTES`` of item text and travel with the tasks.

1. One pass over the texts counts the block's terms in each document and writes them, one row a document. Document counts, total length
   and the documents a term has come from that table.
2. A task reads its rows in shards of at most ``SHARD_POSTINGS`` postings and sorts each shard's lists by impact. For every item it
   reads the lists from the top down: what was read of a document is its lower score, with the next impact of every list it was not yet
   seen in it is the upper score. It goes on until every document that could be among the best has its final score, so membership, ties
   and scores are settled. Documents below the item's last best score so far in this task are out at once.
3. The best of all tasks are merged in two steps.

Null texts hold no term; a document without a term counts nowhere. Repeated rows and ids are documents, and items, of their own; a null
doc_id comes first among equal scores. Items without terms, and empty tables, give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import write_table

BLOCK_BYTES = 4 << 20  # of item text that one pass over the documents searches
SHARD_POSTINGS = 2_000_000
SALTS = 64
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters above ASCII, only A-Z in lower case."""
    return (text or "").encode().translate(_TERM).split()


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: all its terms with repeats, and the counts of the numbered ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, terms, tfs = [], [], []
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                counts = Counter(found)
                here = counts.keys() & numbers.keys()
                size.append(len(found))
                terms.append([numbers[t] for t in here])
                tfs.append([counts[t] for t in here])
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            rows = pa.record_batch(columns, names=["doc_id", "n", "terms", "tfs"])
            yield rows.filter(pa.array(np.array(size, np.int64) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


class Best:
    """The ``k`` best documents of one item: highest scores first, then smallest ids, a null id before all."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.doc, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """A score below this is not among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        score, doc, known = np.append(self.score, score), np.append(self.doc, doc), np.append(self.known, known)
        order = np.lexsort((doc, known, -score))[: self.k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents (0 to ``size`` - 1) that may be among the ``k`` best with at least ``floor``, and their final scores.

    ``lists``: per term the documents and their impacts, highest impact first. All documents that tie with the last of the best are given.
    """
    lower, read = np.zeros(size, np.int64), [0] * len(lists)
    frontier = [int(impact[0]) if len(impact) else 0 for _, impact in lists]
    cut = max(frontier, default=0)
    while True:
        cut //= 2
        for i, (doc, impact) in enumerate(lists):
            to = len(impact) - int(np.searchsorted(impact[::-1], cut)) if frontier[i] else read[i]
            lower[doc[read[i] : to]] += impact[read[i] : to]
            read[i], frontier[i] = to, int(impact[to]) if to < len(impact) else 0
        bar = floor
        if size >= k:
            bar = max(bar, int(np.partition(lower, size - k)[size - k]))
        left = np.full(size, sum(frontier), np.int64)
        for i, (doc, _) in enumerate(lists):
            if frontier[i]:
                left[doc[: read[i]]] -= frontier[i]
        able = np.flatnonzero(lower + left >= bar)
        if not left[able].any():
            return able, lower[able]


def _search(keys: list[int], items: list[list[int]], weight: np.ndarray, docs: int, length: int, k: int):
    """Task function over rows of postings: (item_key, doc_id, score) of the task's best documents."""

    def shard(rows: list[pa.RecordBatch], best: list[Best]) -> None:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = table.column("doc_id")
        known = ids.is_valid().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        norm = 50 + 50 * table.column("n").to_numpy() * docs // length
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(table), dtype=np.int32), lists.value_lengths().to_numpy())
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        gain = 1_000_000_000 * tf // (1000 * tf + 20 * norm[doc])
        order = np.argsort(term << 21 | (1_000_000 - gain))
        doc, impact = doc[order], (weight[term] * gain)[order]
        edge = np.searchsorted(term[order], np.arange(len(weight) + 1))
        for terms, found in zip(items, best, strict=True):
            lists = [(doc[edge[t] : edge[t + 1]], impact[edge[t] : edge[t + 1]]) for t in terms]
            at, score = nra(lists, len(ids), k, found.floor())
            found.add(score, ids[at], known[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                shard(held, best)
                held, size = [], 0
        if held:
            shard(held, best)
        item = np.repeat(np.array(keys, np.int64), [len(b.score) for b in best])
        if len(item):
            doc, known = np.concatenate([b.doc for b in best]), np.concatenate([b.known for b in best])
            columns = [pa.array(item), pa.array(doc, mask=~known), pa.array(np.concatenate([b.score for b in best]))]
            yield pa.record_batch(columns, names=["item_key", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[tuple[int, str]], k: int) -> DataFrame | None:
    """(item_key, rank, doc_id, score) for a block of item texts; None where nothing can be found."""
    numbers: dict[bytes, int] = {}
    items = [sorted({numbers.setdefault(t, len(numbers)) for t in terms_of(text)}) for _, text in texts]
    held = write_table(postings(docs, numbers), "postings")
    total = held.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    if not total.docs:
        return None
    frequent = np.zeros(len(numbers), np.int64)
    for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequent[row["term"]] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(df) + 1))) for df in frequent], np.int64)
    task = _search([key for key, _ in texts], items, weight, total.docs, total.length, k)
    found = held.mapInArrow(task, "item_key long, doc_id long, score long")
    found = _ranked(found.withColumn("salt", F.spark_partition_id() % SALTS), k, "item_key", "salt")
    return _ranked(found.select("item_key", "doc_id", "score"), k, "item_key").select("item_key", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each row of ``items`` (item_id, text)."""
    texts = items.where("text IS NOT NULL").groupBy("text").agg(F.lit(1).alias("one")).select("text", F.monotonically_increasing_id().alias("item_key"))
    texts = write_table(texts, "item_texts")
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = docs.sparkSession.createDataFrame([], "item_key long, rank int, doc_id long, score long")
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == block).collect()
        ranked = _search_block(docs, [(row.item_key, row.text) for row in mine], k) if mine else None
        found = found if ranked is None else found.union(ranked)
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").join(texts, "text").select("item_id", "item_key")
    return named.join(found, "item_key").select("item_id", "rank", "doc_id", "score")
