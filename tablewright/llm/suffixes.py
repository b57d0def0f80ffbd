"""Removal of every byte that lies in a string of LENGTH bytes seen earlier, by a distributed merge sort of suffixes.

Sorting all suffixes would move a hundred times the corpus, so only those that can matter are sorted. Each string of LENGTH bytes has
an anchor, its MARK-byte part of least hash; neighbouring strings with one anchor form a span. Equal strings have equal anchors, so:

1. Spans are filed under the hash of their anchor, equal ones of one slice of the corpus once. An anchor that occurs once has no repeated string. Of spans that are equal
   byte for byte (by a second hash) all but the first are repeats as a whole.
2. Where different spans share an anchor, one of each goes on: its suffix from the anchor on is sorted within the task that reads its document,
   front-coded (length shared with the suffix before, then the rest), and sent in runs by anchor.
3. Runs are merged by a loser tree that keeps, for each waiting suffix, how much it shares with the one that beat it, and never compares that
   part again. The shared lengths of neighbours in the merged order, with what stands left of the anchors, say which strings are equal.

Anchors with more than ``CROWD`` different spans are not held together in one task: their strings are exchanged one by one under their own
hashes, which spreads them however many there are.

Order is that of ids (null first), then of text for rows that share an id; such rows count as documents of their own, and an
id may have any number of rows. Null texts are empty; texts shorter than LENGTH are kept whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_table
from .textbytes import mix, prefix_sums, segment_hash, signed, slices

LENGTH = 100
MARK = 24
REACH = LENGTH - MARK + 1  # anchors a string can have
RUN_BYTES = 16 << 20
CROWD = 20_000
_NULL = -(1 << 63)
# A place is one long: row of its id (15 bits), first byte (32), anchor from there (8), length (8); places of an id sort by row and byte.
_ROW, _BYTE, _ANCHOR = 48, 16, 8


def spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first byte in the row, anchor from there, length, anchor hash and content hash of every span."""
    sums = prefix_sums(data)
    grams = len(data) - MARK + 1
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    at = np.arange(grams)
    gram = segment_hash(sums, at, at + MARK)
    # The hash with its place in the low bits: the least of a stretch also says where it is, the first one on ties.
    least, width = (gram & ~np.uint64((1 << 31) - 1)) | at.astype(np.uint64), 1
    while width * 2 <= REACH:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < REACH:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    ends = np.repeat(starts[1:], np.diff(starts))[: len(least)]
    string = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends)
    anchor = (least[string] & np.uint64((1 << 31) - 1)).astype(np.int64)
    new = np.flatnonzero((np.diff(string) != 1) | (np.diff(anchor) != 0)) + 1
    if not len(string):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    first, last = string[np.append(0, new)], string[np.append(new - 1, len(string) - 1)]
    anchor = anchor[np.append(0, new)]
    row = np.searchsorted(starts, first, "right") - 1
    return row, first - starts[row], anchor - first, last + LENGTH - first, gram[anchor], segment_hash(sums, first, last + LENGTH)


def _rows(key: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows to be filed. Of equal spans in one slice only the first goes on; the stretches of bytes that the others cover are known to
    be repeats, and are dealt out by where they stand, so a string that fills a part of the corpus is a few rows of its key."""
    order = np.lexsort((place, doc))
    key, content, doc, place = key[order], content[order], doc[order], place[order]
    again = pd.Series(key ^ mix(content)).duplicated().to_numpy()
    start, end = place[again] >> _BYTE, (place[again] >> _BYTE) + (place[again] & 0xFF)  # with the row of the id on top
    new = np.flatnonzero((np.diff(doc[again]) != 0) | (start[1:] > end[:-1])) + 1
    first, last = np.append(0, new)[: len(start)], np.append(new - 1, len(start) - 1)[: len(start)]
    begin, length = start[first] << _BYTE, end[last] - start[first]
    known = doc[again][first]
    columns = [
        np.concatenate([signed(key[~again]), signed(mix(known.view(np.uint64) ^ begin.view(np.uint64)))]),
        np.concatenate([signed(content[~again]), np.zeros(len(first), np.int64)]),
        np.concatenate([doc[~again], known]),
        np.concatenate([place[~again], begin]),
        np.concatenate([np.zeros((~again).sum(), np.int64), length]),
    ]
    return pa.record_batch([pa.array(c) for c in columns], names=["key", "content", "doc", "place", "stretch"])


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, starts in slices(batch):
            row, byte, anchor, size, key, content = spans(data, starts)
            doc, copy = rows.column("doc").to_numpy()[row], rows.column("copy").to_numpy()[row].astype(np.int64)
            yield _rows(key, content, doc, copy << _ROW | byte << _BYTE | anchor << _ANCHOR | size)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, content, doc, place: repeats as a whole, and the first of each content where contents differ.
    Stretches that are known to be repeats go through."""
    names = ["key", "doc", "place", "repeat", "stretch"]

    def rows(key: np.ndarray, doc: np.ndarray, place: np.ndarray, stretch: np.ndarray | None = None) -> pa.RecordBatch:
        """With stretches: repeats."""
        none = np.zeros(len(key), np.int64)
        columns = [key, doc, place, np.full(len(key), stretch is not None), none if stretch is None else stretch]
        return pa.record_batch([pa.array(c) for c in columns], names=names)

    last = (None, None)  # key and content before this batch
    waiting = None  # the first row of the open key, as long as it has no other content
    for batch in batches:
        stretch = batch.column("stretch").to_numpy()
        key, content, doc, place = (batch.column(i).to_numpy() for i in range(4))
        yield rows(key[stretch > 0], doc[stretch > 0], place[stretch > 0], stretch[stretch > 0])
        key, content, doc, place = (x[stretch == 0] for x in (key, content, doc, place))
        if not len(key):
            continue
        new_key = np.append(key[0] != last[0] if last[0] is not None else True, key[1:] != key[:-1])
        new = new_key | np.append(content[0] != last[1] if last[0] is not None else True, content[1:] != content[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new_key)[first]  # 0: goes on with the key before this batch
        contents = np.bincount(group, minlength=int(new_key.sum()) + 1)
        several = contents > 1
        out = []
        if contents[0]:
            several[0] = True
            if waiting is not None:
                out.append(waiting)
                waiting = None
        chosen = first[several[group]]
        if new_key.any():
            waiting = None
            end = np.flatnonzero(new_key)[-1]
            if contents[-1] == 1:
                waiting = tuple(x[end : end + 1] for x in (key, doc, place))
        out.append((key[chosen], doc[chosen], place[chosen]))
        yield rows(*(np.concatenate(x) for x in zip(*out, strict=True)))
        yield rows(key[~new], doc[~new], place[~new], place[~new] & 0xFF)
        last = key[-1], content[-1]


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """How many first bytes agree, when ``known`` of them are known to."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(run: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, left side, doc, place); each suffix without what it shares with the one before."""
    out, before = [], b""
    for suffix, left, doc, place in run:
        common = shared(before, suffix)
        out.append(struct.pack("<BBBqq", common, len(suffix) - common, len(left), doc, place) + suffix[common:] + left)
        before = suffix
    return b"".join(out)


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    at, suffix, size = 0, b"", struct.calcsize("<BBBqq")
    while at < len(blob):
        common, rest, left, doc, place = struct.unpack_from("<BBBqq", blob, at)
        at += size
        suffix = suffix[:common] + blob[at : at + rest]
        yield common, suffix, blob[at + rest : at + rest + left], doc, place
        at += rest + left


def merge(runs: list[Iterator[tuple[int, bytes, bytes, int, int]]]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """Loser tree over sorted runs; gives each entry with the length it shares with the one before it in the merged order."""
    n = len(runs)
    end = (-1, b"", b"", 0, 0)
    heads = [next(run, end) for run in runs]
    known = [0 if head is not end else -1 for head in heads]  # shared with the entry that last beat it, or that came out last

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; only what is not known to be shared is compared."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        common = shared(heads[a][1], heads[b][1], known[a])
        if heads[b][1][common:] < heads[a][1][common:]:
            a, b = b, a
        known[b] = common
        return a, b

    losers = [0] * n
    winners = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1]
    while known[winner] >= 0:
        yield (known[winner], *heads[winner][1:])
        heads[winner] = head = next(runs[winner], end)
        known[winner] = head[0]
        node = (n + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def resolve(group: list[tuple[int, bytes, bytes, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """For suffixes of one anchor in merged order: (doc, row, from, to) of the bytes in strings seen earlier."""
    seen: dict[tuple[int, bytes], int] = {}
    gone: list[list[int]] = [[] for _ in group]
    order = sorted(range(len(group)), key=lambda i: (group[i][3], group[i][4]))
    # By the bytes of the string that are left of the anchor.
    for reach in range(max(0, LENGTH - max(len(e[1]) for e in group)), max(len(e[2]) for e in group) + 1):
        need, part, parts = LENGTH - reach, 0, []
        for entry in group:
            part += entry[0] < need
            parts.append(part)
        seen.clear()
        for i in order:
            _, suffix, left, _, _ = group[i]
            if reach <= len(left) and need <= len(suffix):
                string = parts[i], left[:reach]
                if string in seen:
                    gone[i].append(reach)
                else:
                    seen[string] = i
    for entry, reaches in zip(group, gone, strict=True):
        if reaches:
            place = entry[4]
            anchor = (place >> _BYTE & 0xFFFFFFFF) + (place >> _ANCHOR & 0xFF)
            cuts = [0, *(k for k in range(1, len(reaches)) if reaches[k] != reaches[k - 1] + 1), len(reaches)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield entry[3], place >> _ROW, anchor - reaches[b - 1], anchor - reaches[a] + LENGTH


def _make_runs(parts: int):
    """Task function: the spans asked for, as front-coded sorted runs of suffixes, one row a run and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, int]] = []

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0], x[1]))
            rows: dict[int, list] = {}
            for part, *entry in held:
                rows.setdefault(part, []).append(entry)
            held.clear()
            return pa.record_batch([pa.array(list(rows), pa.int32()), pa.array([front_code(r) for r in rows.values()], pa.binary())], names=["part", "run"])

        size = 0
        for batch in batches:
            for doc, text, places in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("places").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for place in places:
                    first, anchor = place >> _BYTE & 0xFFFFFFFF, place >> _ANCHOR & 0xFF
                    span = data[first : first + (place & 0xFF)]
                    held.append((zlib.crc32(span[anchor : anchor + MARK]) % parts, span[anchor:], span[:anchor][::-1], doc, place))
                    size += 200
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over runs sorted by part: the repeated bytes that each part's merged order shows."""
    part, runs = None, []

    def found() -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int]] = []
        group: list[tuple[int, bytes, bytes, int, int]] = []
        for entry in merge([decoded(r) for r in runs]):
            if group and entry[0] < MARK:
                rows += resolve(group) if len(group) > 1 else ()
                group = []
            group.append(entry)
        rows += resolve(group) if len(group) > 1 else ()
        return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc", "copy", "start", "end"])

    for batch in batches:
        for this, blob in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), strict=True):
            if this != part and runs:
                yield found()
                runs = []
            part = this
            runs.append(blob)
    if runs:
        yield found()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the spans asked for, under two hashes of its own."""
    for batch in batches:
        for rows, data, starts in slices(batch):
            places = rows.column("places")
            count = np.diff(np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + rows.num_rows + 1])
            flat, row = places.flatten().to_numpy(), np.repeat(np.arange(rows.num_rows), count)
            strings = (flat & 0xFF) - LENGTH + 1
            each = np.repeat(np.arange(len(flat)), strings)
            step = np.arange(len(each)) - np.repeat(np.cumsum(strings) - strings, strings)
            byte = (flat[each] >> _BYTE & 0xFFFFFFFF) + step
            at, sums = starts[row[each]] + byte, prefix_sums(data)
            # Two hashes of the string: of the whole, and of two parts that cover it.
            whole = segment_hash(sums, at, at + LENGTH)
            parts = segment_hash(sums, at, at + LENGTH // 2) + segment_hash(sums, at + LENGTH // 3, at + LENGTH)
            yield _rows(whole, parts, rows.column("doc").to_numpy()[row[each]], flat[each] >> _ROW << _ROW | byte << _BYTE | LENGTH)


def _bits(place: Column, shift: int, bits: int) -> Column:
    return F.shiftright(place, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _whole(judged: DataFrame) -> DataFrame:
    start = _bits(F.col("place"), _BYTE, 32)
    return judged.where("repeat").select("doc", _bits(F.col("place"), _ROW, 15).alias("copy"), start.alias("start"), (start + F.col("stretch")).alias("end"))


_FILED = "key long, content long, doc long, place long, stretch long"
_JUDGED = "key long, doc long, place long, repeat boolean, stretch long"


def _judged(filed: DataFrame) -> DataFrame:
    return filed.repartition("key").sortWithinPartitions("key", "content", "doc", "place").mapInArrow(_judge, _JUDGED)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, copy, text, of): the id and 0; where ids repeat, the number of the row in the order of ids and texts instead. ``of`` is the id."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows.select("doc", F.lit(0).alias("copy"), "text", F.col("doc").alias("of"))
    # Ranges of ids and first letters, so that the rows of one id are sorted by many tasks; the sizes of the ranges are one row a task.
    dealt = rows.repartitionByRange("doc", F.substring("text", 1, 256)).sortWithinPartitions("doc", "text")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = write_table(dealt.select(F.col("doc").alias("of"), "text", F.spark_partition_id().alias("part"), at.alias("at")), "numbered")
    before, total = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):
        before.append((r.part, total))
        total += r["count"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, before long"))
    return placed.join(starts, "part").select((F.col("before") + F.col("at")).alias("doc"), F.lit(0).alias("copy"), "text", "of")


def repeated_bytes(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc, copy, start, end): stretches of bytes in strings of LENGTH bytes that also start earlier; they may overlap."""
    judged = write_table(_judged(rows.mapInArrow(_file, _FILED)), "spans")
    open_ = judged.where("NOT repeat")
    crowds = write_table(open_.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowds")
    some = not crowds.isEmpty()

    def with_texts(places: DataFrame) -> DataFrame:
        listed = places.groupBy("doc", _bits(F.col("place"), _ROW, 15).cast("int").alias("copy")).agg(F.sort_array(F.collect_list("place")).alias("places"))
        return rows.join(listed, ["doc", "copy"]).select("doc", "text", "places")

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    runs = with_texts(open_.join(crowds, "key", "left_anti") if some else open_).mapInArrow(_make_runs(parts), "part int, run binary")
    merged = runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge_runs, "doc long, copy long, start long, end long")
    found = _whole(judged).union(merged)
    if some:
        found = found.union(_whole(_judged(with_texts(open_.join(crowds, "key", "left_semi")).mapInArrow(_strings, _FILED))))
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist(), strict=True):
            data, kept, at, removed, count = text.as_buffer(), hashlib.sha256(), 0, 0, 0
            reach = -1
            for cut in cuts or ():
                start, end = cut["start"], cut["end"]
                if start > reach:
                    kept.update(data[at:start])
                    count += 1
                    removed, reach, at = removed + end - start, end, end
                elif end > reach:
                    removed, reach, at = removed + end - reach, end, end
            kept.update(data[at:])
            out.append((data.size, removed, count, kept.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        yield pa.record_batch([batch.column("doc"), *columns], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay)."""
    rows = numbered(docs)
    found = repeated_bytes(rows.drop("of"), crowd).groupBy("doc", F.col("copy").cast("int").alias("copy"))
    cuts = found.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    joined = rows.join(cuts, ["doc", "copy"], "left").select(F.col("of").alias("doc"), "text", "cuts")
    out = joined.mapInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.nullif("doc", F.lit(_NULL)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
