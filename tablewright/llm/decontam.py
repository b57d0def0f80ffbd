"""Benchmark leaks found by templates, so that a question with other numbers, names or units is still caught.

A text is read as words. A number becomes ``<number>``, a unit behind a number ``<unit>``, and a capitalised word inside a sentence
``<name>``; all other words are literal and lower-cased. Windows of five template words are hash-joined with those of the benchmark.
An item leaks into a document if one stretch of it, no longer than twice the item, holds at least 0.8 of the item's windows, and if
the slots agree: along one alignment, each value of the item must stand for one value of the document.

Windows with fewer than two literal words say little of a text. They count where they stand in one alignment with a window of more
literal words, and where they are held as they are, with the same values.

Documents emit only windows that the benchmark holds, as long as its windows fit a broadcast of ``BROADCAST_WINDOWS``; beyond that
all windows go through a shuffled join with the same result. The join of very frequent windows is split by adaptive execution.

Items of fewer than five words are one window. Null and empty texts and items have no windows; equal documents are all reported;
documents and items are told apart by id and text, so repeated and null ids of either are no trouble (equal rows of the benchmark are one item);
other columns are not looked at; with an empty table on either side nothing leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import write_table
from .textbytes import lowered, mix, prefix_sums, segment_hash, signed, slices, words

WIDTH = 5
SIMILARITY = 0.8
MIN_LITERAL = 2
BROADCAST_WINDOWS = 1_000_000  # 8 MB of hashes
#: Words that are a unit when they follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "ml l liter liters litre litres gallon gallons cup cups degree degrees c f k percent "
    "dollar dollars euro euros cent cents usd eur gbp w kw v hz khz mhz ghz kb mb gb tb mph kmh "
    "sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre meilen pfund prozent grad "
    "seconde secondes heure heures jour jours semaine semaines mois an ans livre livres tonnes pour degrés "
    "segundo segundos minutos hora horas día días semanas mes meses año años metro metros kilo kilos litro litros grado grados"
).split()
_RICH, _LOW, _SAME = 0, 1, 2  # windows of enough literal words, of fewer, and those again with their values
_NUMBER, _UNIT, _NAME = 1, 2, 3


@lru_cache(1)
def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    first, end, _ = words(data, np.array([0, len(data)]))
    return np.sort(segment_hash(prefix_sums(data), first, end))


def templates(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By word: template hash, slot kind (0: literal), hash of the word as it stands, and row."""
    low = lowered(data)
    digit = (data >= 48) & (data <= 57)
    plain = low.copy()
    inner = np.flatnonzero(digit[:-2] & digit[2:] & ((data[1:-1] == 46) | (data[1:-1] == 44))) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    inner = inner[~np.isin(inner, starts) & ~np.isin(inner + 1, starts)]
    plain[inner] = 48  # the mark inside 3.5 or 1,000 belongs to the number
    first, end, row = words(plain, starts)
    value = segment_hash(prefix_sums(low), first, end)
    if not len(first):
        return value, np.zeros(0, np.uint8), value, row
    digits = np.append(0, np.cumsum(digit))
    kind = np.zeros(len(first), np.uint8)
    number = (digits[end] > digits[first]) & digit[first]
    kind[number] = _NUMBER
    units = _unit_hashes()
    unit = units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value
    after = np.append(False, number[:-1] & (row[1:] == row[:-1]))
    kind[unit & after & ~number] = _UNIT
    upper = data != low
    capital = upper[first] | (upper[np.minimum(first + 1, len(data) - 1)] & (data[first] == 0xC3))
    capitals = np.append(0, np.cumsum(upper))
    single = capitals[end] - capitals[first] == 1
    before, further = data[np.maximum(first - 1, 0)], data[np.maximum(first - 2, 0)]
    inside = (before == 32) & (first - 2 >= starts[row]) & ~np.isin(further, np.frombuffer(b".!?:;|\n \"", np.uint8))
    kind[capital & single & inside & (kind == 0)] = _NAME
    template = np.where(kind == 0, value, mix(kind.astype(np.uint64)))
    return template, kind, value, row


def windows(template: np.ndarray, value: np.ndarray, kind: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of ``width`` words within one text begin, their hashes, and which kind of window each is."""
    n = len(template) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    literal = np.append(0, np.cumsum(kind == 0))
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    low = literal[at + width] - literal[at] < min(width, MIN_LITERAL)

    def hashed(words: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
        total = np.full(len(at), start, np.uint64)
        for j in range(width):
            total = mix(total + words[at + j])
        return total

    kinds = np.concatenate([np.where(low, _LOW, _RICH), np.full(low.sum(), _SAME)]).astype(np.int32)
    return np.append(at, at[low]), np.append(hashed(template, at, width), hashed(value, at[low], width + 1000)), kinds


def _near(at: np.ndarray, row: np.ndarray, anchors: np.ndarray, reach: int) -> np.ndarray:
    """Whether each place has an anchor of its own text within ``reach`` words."""
    if not len(anchors):
        return np.zeros(len(at), bool)
    anchors = np.sort(anchors)
    after = np.searchsorted(anchors, at)
    found = np.zeros(len(at), bool)
    for side in (np.maximum(after - 1, 0), np.minimum(after, len(anchors) - 1)):
        found |= (row[anchors[side]] == row[at]) & (np.abs(anchors[side] - at) <= reach)
    return found


def _slots(kind: np.ndarray, value: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """Of each window, the value hash at slots and 0 at literal words."""
    if not len(at):
        return pa.array([], pa.list_(pa.int64()))
    places = at[:, None] + np.arange(width)
    held = np.where(kind[places] > 0, signed(value[places] | np.uint64(1)), 0)
    offsets = np.arange(0, len(at) * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(held.ravel().astype(np.int64)))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, starts in slices(batch):
            template, kind, value, row = templates(data, starts)
            size = np.bincount(row, minlength=len(starts) - 1)
            begin = np.append(0, np.cumsum(size))
            for width in sorted({min(WIDTH, int(s)) for s in size} - {0}):
                at, key, kinds = windows(template, value, kind, row, width)
                fits = np.minimum(size[row[at]], WIDTH) == width
                at, key, kinds = at[fits], key[fits], kinds[fits]
                own = pa.array(row[at])
                columns = [rows.column("item").take(own), rows.column("item_id").take(own), pa.array(size[row[at]]), pa.array(size[row[at]] - width + 1)]
                columns += [pa.array(at - begin[row[at]]), pa.array(np.full(len(at), width, np.int32)), pa.array(signed(key)), pa.array(kinds), _slots(kind, value, at, width)]
                yield pa.record_batch(columns, names=["item", "item_id", "n_words", "n_windows", "place", "width", "key", "kind", "slots"])


def _document_windows(widths: list[int], held: np.ndarray | None, reach: int):
    """Task function: the windows of documents, only those whose key is in ``held`` (sorted) if given; then those of few literal words
    only within ``reach`` words of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is not None:
            coarse = np.zeros(1 << 20, bool)
            coarse[(held & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for rows, data, starts in slices(batch):
                template, kind, value, row = templates(data, starts)
                begin = np.append(0, np.cumsum(np.bincount(row, minlength=len(starts) - 1)))
                for width in widths:
                    at, key, kinds = windows(template, value, kind, row, width)
                    if held is not None:
                        likely = np.flatnonzero(coarse[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])
                        found = likely[held[np.minimum(np.searchsorted(held, key[likely]), len(held) - 1)] == key[likely]]
                        at, key, kinds = at[found], key[found], kinds[found]
                        useful = (kinds != _LOW) | _near(at, row, at[kinds != _LOW], reach)
                        at, key = at[useful], key[useful]
                    picked = pa.array(row[at])
                    columns = [rows.column("doc_id").take(picked), rows.column("text_key").take(picked), pa.array(at - begin[row[at]]), pa.array(signed(key)), _slots(kind, value, at, width)]
                    yield pa.record_batch(columns, names=["doc_id", "text_key", "spot", "key", "found"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item that leaks into it: doc_id, text_key (xxhash64 of the text), item_id, matched, n_windows,
    containment, consistency; of several stretches the one that holds most."""
    kinds = "item long, item_id long, n_words long, n_windows long, place long, width int, key long, kind int, slots array<long>"
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    named = asked.select(F.xxhash64("text", F.coalesce(F.col("item_id").cast("string"), F.lit("none"))).alias("item"), "item_id", "text")
    items = write_table(named.mapInArrow(_item_windows, kinds), "item_windows")
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    keys = items.select("key").distinct()
    small = keys.count() <= BROADCAST_WINDOWS and items.count() <= BROADCAST_WINDOWS
    held = np.sort(np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)) if small else None
    if held is not None and not len(held):
        widths = []
    reach = items.agg(F.max("n_words")).first()[0] or 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    found = texts.mapInArrow(_document_windows(widths, held, reach), "doc_id long, text_key long, spot long, key long, found array<long>")
    met = found.join(F.broadcast(items) if small else items, "key")

    pair = F.arrays_zip("slots", "found")
    slots = F.transform(F.filter(pair, lambda x: x.slots != 0), lambda x: F.struct(x.slots.alias("item"), x.found.alias("document")))
    item = ["item", "item_id", "n_words", "n_windows"]
    aligned = met.groupBy("doc_id", "text_key", *item, (F.col("spot") - F.col("place")).alias("shift")).agg(
        F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"), F.max(F.col("kind") != _LOW).alias("sure")
    )  # at most an item's windows
    values = F.array_distinct(F.transform("slots", lambda s: s.item))
    steady = F.filter(values, lambda v: F.size(F.filter("slots", lambda s: s.item == v)) == 1)
    # A stretch is a band of shifts as wide as the item; two rows of bands, half a band apart, so that no stretch is cut in both.
    half = F.floor(F.col("shift") * 2 / F.col("n_words"))
    bands = F.explode(F.array(F.floor(half / 2) * 2, F.floor((half + 1) / 2) * 2 - 1))
    stretches = (
        aligned.where("sure")
        .select("doc_id", "text_key", *item, "places", F.size(values).alias("values"), F.size(steady).alias("steady"), bands.alias("band"))
        .groupBy("doc_id", "text_key", *item, "band")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("matched"), F.sum("values").alias("values"), F.sum("steady").alias("steady"))
    )
    judged = stretches.select(
        "doc_id",
        "text_key",
        "item",
        "item_id",
        "matched",
        "n_windows",
        (F.col("matched") / F.col("n_windows")).alias("containment"),
        F.when(F.col("values") == 0, 1.0).otherwise(F.col("steady") / F.col("values")).alias("consistency"),
    ).where((F.col("containment") >= similarity) & (F.col("consistency") >= similarity))
    best = F.max(F.struct("matched", "consistency", "n_windows", "containment")).alias("best")
    best = judged.groupBy("doc_id", "text_key", "item", "item_id").agg(best)
    return best.select("doc_id", "text_key", "item_id", "best.matched", "best.n_windows", "best.containment", "best.consistency")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item leaks into, with all their columns."""
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")).distinct()
    whole = docs.select(F.struct("*").alias("d"))  # so that no column of the documents meets one of the leaks
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("leak_id")) & (F.xxhash64("d.text") == F.col("leak_key"))
    return whole.join(write_table(leaks, "leaks"), same, "left_anti").select("d.*")
