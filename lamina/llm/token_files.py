"""Token files: ids at a fixed number of bits, in blocks with an offset table.

A file holds the ids of consecutive documents. Layout, little-endian:

    8 bytes   magic LAMTOK01
    6 x u64   bits an id, documents, ids, ids a block, blocks, first payload byte
    u64 x D   end of each document, in ids from the file's start
    i64 x D   identifier of each document
    u64 x B   first byte of each block, from the first payload byte
    payload   blocks; id k of a block takes bits [k * bits, (k + 1) * bits), lowest bit first

Blocks start on a byte, so any range of ids is read by seeking to its blocks, and NumPy unpacks a block at once.
Rows are range-partitioned by identifier before encoding, rows of one identifier by their texts' hash and a number, so
that no identifier, nor the lack of one, fills a task; every partition writes one file, under a name of its
own that is then moved to the final one, so a task that runs again replaces equal content.

Results for unusual input: null and empty texts have the end id only; null identifiers come first and are marked
by the lowest 64-bit number; repeated rows are written as often as they occur, equal identifiers in the order of
their texts' hash; texts of any length are written whole; an empty table gives no file.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.chunk_encoder import encoder, tokenizer_path
from lamina.llm.common import LOWEST_ID, documents, id_key, scratch_path, small_arrow_batches, written

MAGIC = b"LAMTOK01"
BLOCK_IDS = 8192
#: Text bytes that a file gets on average: at least and at most, and the number of files that an input gets between.
FILE_BYTES = 24 << 20
MOST_FILE_BYTES = 192 << 20
FILES = 10_000
#: Chunks that a worker remembers: fewer than elsewhere, as executors sort whole texts beside it.
MEMO_CHUNKS = 600_000
END_ID = 1


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


#: Widths at which NumPy's own integers have the same layout, without taking bits apart.
_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, bits: int) -> bytes:
    return ids.astype(_WHOLE[bits]).tobytes() if bits in _WHOLE else pack_bits(ids, bits)


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in _WHOLE:
        return np.frombuffer(data, _WHOLE[bits], count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :bits] = spread
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class Writer:
    """Collects documents; packed blocks are kept, ids only until their block is full."""

    def __init__(self, bits: int, block_ids: int = BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        self.doc_ids: list[int] = []
        self.ends: list[int] = []
        self.blocks: list[bytes] = []
        self.rest = np.zeros(0, np.uint32)
        self.count = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.count += len(ids)
        self.ends.append(self.count)
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {ids.max()} does not fit {self.bits} bits")
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // self.block_ids * self.block_ids
        for at in range(0, full, self.block_ids):
            self.blocks.append(pack(self.rest[at : at + self.block_ids], self.bits))
        self.rest = self.rest[full:]

    def save(self, out) -> None:
        blocks = self.blocks + ([pack(self.rest, self.bits)] if len(self.rest) else [])
        offsets = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else []
        first = len(MAGIC) + 48 + 16 * len(self.ends) + 8 * len(blocks)
        out.write(MAGIC)
        out.write(np.array([self.bits, len(self.ends), self.count, self.block_ids, len(blocks), first], "<u8").tobytes())
        out.write(np.array(self.ends, "<u8").tobytes())
        out.write(np.array(self.doc_ids, "<i8").tobytes())
        out.write(np.array(offsets, "<u8").tobytes())
        for block in blocks:
            out.write(block)


class Reader:
    """Random access to a token file; reads the head at once and blocks when asked for."""

    def __init__(self, source):
        self.source = source
        head = source.read(len(MAGIC) + 48)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.bits, n, self.count, self.block_ids, blocks, self.first = (int(x) for x in np.frombuffer(head, "<u8", offset=len(MAGIC)))
        self.ends = np.frombuffer(source.read(8 * n), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(source.read(8 * n), "<i8")
        self.offsets = np.frombuffer(source.read(8 * blocks), "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, from their blocks alone."""
        if start >= end:
            return np.zeros(0, np.uint32)
        low, high = start // self.block_ids, -(-end // self.block_ids)
        self.source.seek(self.first + int(self.offsets[low]))
        stop = int(self.offsets[high]) - int(self.offsets[low]) if high < len(self.offsets) else -1
        data = self.source.read(stop) if stop >= 0 else self.source.read()
        size = -(-self.block_ids * self.bits // 8)
        parts = []
        for block in range(low, high):
            n = min(self.block_ids, self.count - block * self.block_ids)
            at = (block - low) * size
            parts.append(unpack(data[at : at + -(-n * self.bits // 8)], n, self.bits))
        return np.concatenate(parts)[start - low * self.block_ids : end - low * self.block_ids]

    def document(self, n: int) -> np.ndarray:
        return self.ids(int(self.ends[n - 1]) if n else 0, int(self.ends[n]))

    def documents(self, batch_ids: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """Identifier, start and ids of every document, in order, unpacking many documents at a time."""
        n, starts = 0, np.concatenate([[0], self.ends[:-1]])
        while n < len(self.ends):
            to = max(n + 1, int(np.searchsorted(self.ends, starts[n] + batch_ids, "right")))
            part = self.ids(int(starts[n]), int(self.ends[to - 1]))
            for k in range(n, to):
                yield int(self.doc_ids[k]), int(starts[k]), part[starts[k] - starts[n] : self.ends[k] - starts[n]]
            n = to


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encodes and writes `docs` in ascending order of the identifier; returns the files' table:
    `file, path, n_docs, n_ids, n_bytes`."""
    spark = docs.sparkSession
    small_arrow_batches(spark, 4096)
    bits = bits_for(encoder(path, MEMO_CHUNKS).vocabulary)
    rows = docs.select(id_key(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    if files is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-total // min(MOST_FILE_BYTES, max(FILE_BYTES, total // FILES))))
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, writer, number = encoder(path, MEMO_CHUNKS), Writer(bits), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), own.encode_many(batch.column(1)), strict=True):
                writer.add(key, np.concatenate([ids, end]))
        if not writer.ends:
            return
        store, root = _filesystem(folder)
        final, draft = f"{root}/tokens-{number:06d}.bin", f"{root}/.draft-{number:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            writer.save(out)
        store.move(draft, final)
        yield pa.RecordBatch.from_pydict(
            {"file": pa.array([number], pa.int64()), "path": [f"{folder}/tokens-{number:06d}.bin"], "n_docs": pa.array([len(writer.ends)], pa.int64()), "n_ids": pa.array([writer.count], pa.int64()), "n_bytes": pa.array([store.get_file_info(final).size], pa.int64())}
        )

    # Rows of one identifier, as all without any, are told apart by text and number, so a range can end between them.
    told = rows.withColumns({"h": F.xxhash64("text"), "number": F.monotonically_increasing_id()})
    ordered = told.repartitionByRange(files, "key", "h", "number").sortWithinPartitions("key", "h", "number").select("key", "text")
    return written(ordered.mapInArrow(run, "file long, path string, n_docs long, n_ids long, n_bytes long"), "token-files")


def read(files: DataFrame, digest=None) -> DataFrame:
    """`doc_id, start, n_tokens` of every document in the files, where start counts the ids of all documents
    before it, with `ids_crc32` or else, without a digest, `ids`."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = based.select("path", "base").repartition(max(1, files.count()), "path")

    def run(batches: Iterator[pa.RecordBatch], digest) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = _filesystem(path)
                with store.open_input_file(place) as source:
                    found = []
                    for doc_id, start, ids in Reader(source).documents():
                        found.append((None if doc_id == LOWEST_ID else doc_id, base + start, len(ids), digest(ids) if digest else ids.astype(np.int64)))
                        if len(found) == 256:
                            yield _rows(found, digest)
                            found = []
                    if found:
                        yield _rows(found, digest)

    last = "ids_crc32 long" if digest else "ids array<long>"
    return spread.mapInArrow(partial(run, digest=digest), f"doc_id long, start long, n_tokens long, {last}")


def _rows(found: list, digest) -> pa.RecordBatch:
    ids, starts, counts, last = zip(*found, strict=True)
    kind = pa.int64() if digest else pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32" if digest else "ids": pa.array(last, kind)})


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def as_bytes(ids_of: list[tuple[int, np.ndarray]], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A token file in memory, of documents in order."""
    writer, out = Writer(bits, block_ids), io.BytesIO()
    for doc_id, ids in ids_of:
        writer.add(doc_id, ids)
    writer.save(out)
    return out.getvalue()


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(documents(spark, sf_dir), scratch_path(spark, "tokens"), tokenizer_path("word_bpe_49k.json"))
    return read(files, crc32)
