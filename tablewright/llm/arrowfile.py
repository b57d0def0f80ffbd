"""Token ids as Arrow IPC files of equal-length sequences with masks.

Each file holds a contiguous range of documents, ascending by id: record batches with one fixed-size list of ids and one of mask
bits a sequence, uncompressed, so any sequence is found by arithmetic and read from the mapped file without a copy. Only the last
sequence of a file is padded (mask false). A second small file beside it says where its documents begin.

A task writes under a name of its own and renames when complete, so repeating a lost task gives the same file again.

Null texts are empty (one end id); null ids come first; rows that repeat an id stand next to each other; an empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_path
from .textbytes import slices
from .tokens import encoder

LENGTH = 2048
BATCH_SEQUENCES = 256
FILE_TEXT_BYTES = 64 << 20
MAX_FILES = 10_000  # beyond it files grow, so that the list of files stays small


def _schema(dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Collects ids and writes full record batches; what is held is never more than a batch and a slice of documents."""

    def __init__(self, sink, dtype, length: int):
        self.schema, self.length, self.held, self.size = _schema(dtype, length), length, [], 0
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH_SEQUENCES * self.length:
            ids = np.concatenate(self.held)
            full = len(ids) // (BATCH_SEQUENCES * self.length) * BATCH_SEQUENCES * self.length
            for at in range(0, full, BATCH_SEQUENCES * self.length):
                self._write(ids[at : at + BATCH_SEQUENCES * self.length], BATCH_SEQUENCES * self.length)
            self.held, self.size = [ids[full:]], len(ids) - full

    def _write(self, ids: np.ndarray, real: int) -> None:
        columns = [pa.array(ids), pa.array(np.arange(len(ids)) < real)]
        lists = [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.held)
            self._write(np.append(ids, np.zeros(-len(ids) % self.length, ids.dtype)), len(ids))
        self.writer.close()


class SequenceFile:
    """Random access to a written file; local files are mapped, so a sequence is a view of the file."""

    def __init__(self, path: str):
        self.fs, name = pafs.FileSystem.from_uri(path)
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(name) if local else self.fs.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.reader.get_batch(i // BATCH_SEQUENCES)
        at = i % BATCH_SEQUENCES * self.length
        return batch.column(0).flatten().slice(at, self.length).to_numpy(), batch.column(1).flatten().slice(at, self.length)

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in views that follow each other."""
        span = BATCH_SEQUENCES * self.length
        while count:
            values = self.reader.get_batch(start // span).column(0).flatten()
            take = min(count, span - start % span)
            yield values.slice(start % span, take).to_numpy()
            start, count = start + take, count - take


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class RangeFile:
    """The file of one range of documents and its index, written under temporary names until complete."""

    def __init__(self, folder: str, part: int, enc, end_id: int, length: int):
        self.fs, name = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(name, recursive=True)
        self.part, self.path, self.enc, self.end_id = part, f"{folder}/{part:06d}.arrow", enc, end_id
        self.names = [f"{name}/{part:06d}.arrow", f"{name}/{part:06d}.index"]
        self.tag = uuid.uuid4().hex
        self.sinks = [self.fs.open_output_stream(f"{x}-{self.tag}") for x in self.names]
        self.sequences = SequenceWriter(self.sinks[0], enc.dtype, length)
        self.index = pa.ipc.new_file(self.sinks[1], INDEX)
        self.docs = self.tokens = 0

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        for rows, data, starts in slices(pa.record_batch({"doc_id": doc_ids, "text": texts})):
            ids, counts = self.enc.encode(data, starts)
            self.sequences.add(np.insert(ids, np.cumsum(counts), self.end_id))
            ends = self.tokens + np.cumsum(counts + 1)
            self.index.write_batch(pa.record_batch([rows.column("doc_id"), pa.array(ends - counts - 1), pa.array(counts + 1)], schema=INDEX))
            self.docs, self.tokens = self.docs + len(counts), int(ends[-1])

    def close(self) -> tuple[int, str, int, int]:
        self.sequences.close()
        self.index.close()
        for sink, name in zip(self.sinks, self.names, strict=True):
            sink.close()
            self.fs.move(f"{name}-{self.tag}", name)
        return self.part, self.path, self.docs, self.tokens


def _write_files(folder: str, tokenizer: str, end_id: int, length: int):
    """Task function: sorted rows to one file a range; gives one row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, file, made = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b and (file is None or file.part != parts[a]):
                    if file:
                        made.append(file.close())
                    file = RangeFile(folder, int(parts[a]), encoder(tokenizer), end_id, length)
                for at in range(a, b, 1000):
                    rows = batch.slice(at, min(1000, b - at))
                    texts = [unpack.decompress(x) for x in rows.column("packed").to_pylist()]
                    file.add(rows.column("doc_id"), pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        if file:
            made.append(file.close())
        kinds = {"part": pa.int32(), "path": pa.string(), "docs": pa.int64(), "tokens": pa.int64()}
        yield pa.record_batch([pa.array([row[i] for row in made], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    return run


def _pack(bounds: list[int]):
    """Task function: the range that each document belongs to, and its text compressed for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, edges = zstandard.ZstdCompressor(level=1), np.array(bounds, np.int64)
        for batch in batches:
            for rows, data, starts in slices(batch, limit=16 << 20):
                raw = data.tobytes()
                packed = [pack.compress(raw[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                ids = rows.column("doc_id")
                part = np.searchsorted(edges, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, pa.array(packed, pa.binary())], ["part", "doc_id", "packed"])

    return run


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, folder: str, length: int = LENGTH) -> DataFrame:
    """Write all documents, ascending by id; one row a file: part (ascending), path, docs, tokens."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = slim.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n")).first()
    tasks = 4 * slim.sparkSession.sparkContext.defaultParallelism
    files = max(1, min(MAX_FILES, size.n, max(tasks, int(size.b or 0) // FILE_TEXT_BYTES)))
    shares = [i / files for i in range(1, files)]
    bounds = slim.agg(F.percentile_approx("doc_id", shares, 100 * files)).first()[0] if shares else []
    # Documents are short next to a file, so the ranges are even when the ids are; all rows of an id are in one range.
    dealt = slim.mapInArrow(_pack(sorted(set(bounds or []))), "part int, doc_id long, packed binary").repartition(files, "part")
    ordered = dealt.sortWithinPartitions("part", "doc_id", "packed")
    made = ordered.mapInArrow(_write_files(folder, tokenizer, end_id, length), "part int, path string, docs long, tokens long")
    made.write.mode("overwrite").parquet(f"{folder}/files.parquet")
    return docs.sparkSession.read.parquet(f"{folder}/files.parquet").orderBy("part")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            data = SequenceFile(path)
            fs, name = pafs.FileSystem.from_uri(path.removesuffix(".arrow") + ".index")
            reader = pa.ipc.open_file(fs.open_input_file(name))
            for i in range(reader.num_record_batches):
                docs = reader.get_batch(i)
                crcs = []
                for start, count in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                    crc = 0
                    for ids in data.ids(start, count):
                        crc = zlib.crc32(ids.astype("<u4"), crc)
                    crcs.append(crc)
                starts = pa.array(docs.column("start").to_numpy() + base)
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row a document, from the files: where its ids begin among all ids, how many there are, and their CRC."""
    rows, base = [], 0
    for r in files.orderBy("part").collect():  # MAX_FILES rows at most
        rows.append((r.part, r.path, base))
        base += r.tokens
    listed = spark.createDataFrame(rows, "part int, path string, base long")
    return listed.repartition(max(1, len(rows)), "part").mapInArrow(_read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")


def arrow_uri(path: str) -> str:
    """A path as Spark writes it (``/a``, ``file:/a``, ``s3a://``) as Arrow's file systems name it."""
    if path.startswith("/"):
        return f"file://{path}"
    return path.replace("file:/", "file:///", 1).replace("file://///", "file:///", 1) if path.startswith("file:") else path.replace("s3a://", "s3://", 1)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents below the shared folder and return what the files say of each document."""
    spark = docs.sparkSession
    folder = arrow_uri(new_path(spark, "sequences"))
    return read_documents(spark, write_sequences(docs, tokenizer, end_id, folder))
