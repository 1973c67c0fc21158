"""Byte-level BPE encoding with offsets, and decoding, over Arrow batches.

Encoding goes through the tokenizers library (`chunk_encoder`). A byte-level token is a string of byte
characters, so its length is its number of bytes: summing these gives each token's bytes in the text, and
counting the bytes that start a character turns them into character offsets. Decoding maps every token back
through the byte table and joins the bytes; a character that tokens split comes out whole, because bytes are
joined before they are read as UTF-8.

Results for unusual input: null and empty texts have no ids and decode to nothing; texts of any length are
encoded whole; repeated rows get equal results; a null identifier stays null; an empty table gives an empty result; other columns are not needed. Ids
outside the vocabulary raise an error when they are decoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.chunk_encoder import ChunkEncoder, byte_characters, encoder, tokenizer_path
from lamina.llm.common import documents, small_arrow_batches


class ByteCodec:
    """Encodes texts and decodes ids with one byte-level vocabulary."""

    def __init__(self, source: ChunkEncoder):
        self.encoder = source
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = source.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.token_bytes[number] = bytes(back[c] for c in token)
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encoder.encode(text)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token, in characters; a token with part of a character has it whole."""
        raw = np.frombuffer(text.encode(), np.uint8)
        end = np.cumsum(self.lengths[ids])
        start = end - self.lengths[ids]
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[start], character[end - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> ByteCodec:
    return ByteCodec(encoder(path))


def rank_file_agrees(json_path: str, rank_path: str) -> bool:
    """Whether a rank file and a tokenizer file hold the same vocabulary."""
    with open(rank_path, "rb") as file:
        ranks = {base64.b64decode(token): int(number) for token, number in map(bytes.split, file)}
    table = codec(json_path).token_bytes
    return len(ranks) == sum(map(bool, table)) and all(table[n] == token for token, n in ranks.items())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """`id, ids array<int>` and, if asked for, `starts` and `ends` in characters, of every row."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = own.encoder.encode_many(batch.column(1))
            out = {"id": batch.column(0), "ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))}
            if offsets:
                both = [own.offsets(t.as_py() or "", i) if len(i) else (i, i) for t, i in zip(batch.column(1), ids, strict=True)]
                for k, name in enumerate(("starts", "ends")):
                    out[name] = pa.array([x[k].astype(np.int32) for x in both], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id long, ids array<int>{extra}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`id, data binary` of rows with `id, ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data = [own.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "data": pa.array(data, pa.binary())})

    return encoded.select("id", "ids").mapInArrow(run, "id long, data binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass and returns digests of the ids and of the decoded bytes, so that
    neither has to leave the worker."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        decimal = [str(n) for n in range(len(own.token_bytes))]
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in own.encoder.encode_many(batch.column(1)):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_bytes})

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rank file and this tokenizer file hold one vocabulary (`rank_file_agrees`, tested).
    return digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
