"""Packing by non-negative least squares over shallow length combinations.

Documents become pieces of at most `capacity` tokens. The histogram of piece lengths has at most `capacity` entries
whatever the input holds, so the driver may have it. All combinations of up to three lengths that fill the window exactly
are enumerated, and repeat counts x >= 0 are sought that minimise |A x - histogram|^2, where a column of A holds how
often a combination uses each length. Coordinate descent along the steepest gain solves this and leaves most
combinations at zero. Counts are rounded and cut to what the histogram has left, the largest first.

A combination with its repeat count then owns a range of the ranks that pieces of one length have, so a piece finds its
sequence and place by a binary search over these ranges and no sequence has to be gathered. Ranks need no sort: a
piece knows how many of its length came before it in its own task, and the counts of tasks are summed beforehand.

What rounding and the histogram's shape leave over is packed greedily in blocks of about BLOCK_PIECES pieces: best fit in
descending order first, then the emptiest sequences are cut to fill the others. What is left of a block, less than a
window, is cut into powers of two, which need no padding. So no sequence is padded.

Results for unusual input: null and empty texts are the end id alone; null identifiers stay null; repeated rows are packed
as often as they occur; texts of any length are cut, never shortened; pieces of equal length are taken in the order of
tasks and rows; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.chunk_encoder import MEMO_CHUNKS, encoder, tokenizer_path
from lamina.llm.common import documents, small_arrow_batches, written
from lamina.llm.packing import best_fit

CAPACITY = 2048
END = 1
BLOCK_PIECES = 4096
#: Descent stops when no single count can lower the squared error by this much, or after so many steps.
LEAST_GAIN, STEPS = 0.25, 50_000
#: Rows of the table of counts by task and length (24 bytes each) up to which it is broadcast; beyond, it is joined by merging.
BROADCAST_ROWS = 200_000
#: Residual sequences are numbered from here on.
RESIDUAL = 1 << 60
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long, number long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", memo_chunks: int = MEMO_CHUNKS) -> DataFrame:
    """PIECE rows of every document, with the end id; `nth` counts the pieces of the same length before it in its task."""
    small_arrow_batches(docs.sparkSession, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, task, number = encoder(path, memo_chunks), np.array([end], np.uint32), TaskContext.get().partitionId(), 0
        wide = "<u2" if own.vocabulary <= 1 << 16 else "<u4"
        before = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lists = own.encode_many(batch.column(1))
            tokens = np.array([len(x) + 1 for x in lists], np.int64)
            ids = np.concatenate([part for x in lists for part in (x, last)] or [last[:0]]).astype("<u4")
            # All pieces but a document's first are full.
            first = (tokens - 1) % capacity + 1
            per = (tokens - first) // capacity + 1
            doc = np.repeat(np.arange(len(tokens)), per)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            length = np.where(k == 0, first[doc], capacity)
            start = np.where(k == 0, 0, first[doc] + (k - 1) * capacity)
            ends = np.cumsum(length)
            view = memoryview(ids).cast("B") if len(ids) else b""
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            # Pieces of one length are counted in the order of rows.
            order = np.argsort(length, kind="stable")
            same, counts = np.unique(length, return_counts=True)
            nth = np.empty_like(length)
            nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(before[same], counts)
            before[same] += counts
            narrow = ids.astype(wide)
            places = (np.concatenate([[0], ends]) * narrow.itemsize).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(places), pa.py_buffer(narrow)])
            numbers = (task << 40) + number + np.arange(len(doc))
            number += len(doc)
            columns = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length, np.array(crcs, np.int64), tokens[doc], np.full(len(doc), task, np.int32), nth, numbers)), binary]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", "number", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, PIECE)


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """All ascending combinations of one to three lengths of `present` that sum to `window`; 0 fills up a row."""
    lengths = np.flatnonzero(present[: window + 1])
    lengths = lengths[lengths > 0]
    out = [np.array([[0, 0, window]])] if present[window] else []
    for a in [0, *lengths[lengths <= window // 3].tolist()]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        c = window - a - b
        held = present[c]
        out.append(np.stack([np.full(int(held.sum()), a), b[held], c[held]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def solved(histogram: np.ndarray, columns: np.ndarray, least_gain: float = LEAST_GAIN, steps: int = STEPS) -> np.ndarray:
    """Counts x >= 0 of the columns with least squared error against the histogram, by coordinate descent: the count
    that gains most goes to its own best value, until none gains `least_gain`."""
    x, error = np.zeros(len(columns)), histogram.astype(float)
    error[0] = 0
    norm = sum(((columns[:, i] == columns[:, j]) & (columns[:, i] > 0)).astype(float) for i in range(3) for j in range(3))
    flat = columns.T.ravel()
    order = np.argsort(flat, kind="stable")
    using, start = np.tile(np.arange(len(columns)), 3)[order], np.searchsorted(flat[order], np.arange(len(histogram) + 1))
    slope = error[columns].sum(1)

    def gains(slope: np.ndarray, norm: np.ndarray, x: np.ndarray) -> np.ndarray:
        change = np.maximum(slope / norm, -x)
        return change * (2 * slope - change * norm)

    gain = gains(slope, norm, x)
    for _ in range(steps if len(columns) else 0):
        best = int(gain.argmax())
        if gain[best] < least_gain:
            break
        change = max(slope[best] / norm[best], -x[best])
        x[best] += change
        for length in filter(None, columns[best].tolist()):
            error[length] -= change
            np.subtract.at(slope, using[start[length] : start[length + 1]], change)
        touched = np.concatenate([using[start[n] : start[n + 1]] for n in columns[best].tolist() if n])
        gain[touched] = gains(slope[touched], norm[touched], x[touched])
    return x


def rounded(histogram: np.ndarray, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole counts that need no more pieces of any length than the histogram has; the largest are served first."""
    left, out = histogram.copy(), np.zeros(len(columns), np.int64)
    for best in np.argsort(-x, kind="stable").tolist():
        count = int(x[best] + 0.5)
        if not count:
            break
        lengths, uses = np.unique(columns[best][columns[best] > 0], return_counts=True)
        out[best] = count = min(count, *(left[lengths] // uses).tolist())
        left[lengths] -= count * uses
    return out


class Plan:
    """Which ranks of a length belong to which slot: arrays sorted by length and first rank."""

    def __init__(self, columns: np.ndarray, counts: np.ndarray):
        rows, used, base = [], {}, 0
        for lengths, count in zip(columns[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
            offset = 0
            for length in filter(None, lengths):
                first = used.get(length, 0)
                rows.append((length, first, first + count, base, offset))
                used[length], offset = first + count, offset + length
            base += count
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        # Ranks are below 2^48, so length and rank make one sorted key.
        self.key = (self.table[:, 0] << 48) + self.table[:, 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank; -1 for those that no combination takes."""
        if not len(self.key):
            return np.full(len(length), -1), np.full(len(length), -1)
        row = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        of, first, last, base, offset = self.table[np.maximum(row, 0)].T
        held = (row >= 0) & (of == length) & (rank < last)
        return np.where(held, base + rank - first, -1), np.where(held, offset, -1)


def filled(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """`piece, begin, length, sequence, offset` of all pieces, without padding: best fit in descending order, then the
    emptiest sequences are cut to fill the others, and the last one is cut into powers of two."""
    grouping, fills = np.full(len(sizes), -1, np.int64), []
    best_fit(sizes, np.argsort(-sizes, kind="stable"), grouping, fills, capacity)
    bins: list[list[list[int]]] = [[] for _ in fills]
    for piece, number in enumerate(grouping.tolist()):
        bins[number].append([piece, 0, int(sizes[piece])])
    order = sorted(range(len(fills)), key=lambda k: (-fills[k], k))
    full, empty = 0, len(order) - 1
    while full < empty:
        into, giver = order[full], bins[order[empty]]
        room = capacity - fills[into]
        while room and giver:
            piece, begin, length = giver[-1]
            taken = min(room, length)
            bins[into].append([piece, begin, taken])
            room, fills[into], fills[order[empty]] = room - taken, fills[into] + taken, fills[order[empty]] - taken
            giver[-1] = [piece, begin + taken, length - taken]
            if taken == length:
                giver.pop()
        full += not room
        empty -= not giver
    out, number = [], 0
    for k in order[: full + 1]:
        # A full sequence is one power of two or is not padded anyway; the last is cut at its powers of two.
        room = fills[k] if fills[k] == capacity else 1 << (fills[k].bit_length() - 1) if fills[k] else 0
        rest, offset, todo = fills[k], 0, bins[k][::-1]
        while todo:
            piece, begin, length = todo.pop()
            taken = min(room - offset, length)
            out.append((piece, begin, taken, number, offset))
            offset, rest = offset + taken, rest - taken
            if taken < length:
                todo.append([piece, begin + taken, length - taken])
            if offset == room:
                number, offset, room = number + 1, 0, 1 << (rest.bit_length() - 1) if rest else 0
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """PLACED rows: every piece of `cut_pieces` (PIECE), or parts of it, with its place in a sequence."""
    rows = written(cut_pieces, "token-pieces")
    by_task = written(rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most a row for each length
        histogram[length] = n
    columns = combinations(histogram > 0, capacity)
    plan = Plan(columns, rounded(histogram, columns, solved(histogram, columns)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ahead = by_task.select("task", "length", before.alias("ahead"))
    ahead = F.broadcast(ahead) if by_task.count() <= BROADCAST_ROWS else ahead.hint("merge")
    ranked = rows.join(ahead, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("ahead"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            placed = batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield placed.filter(pa.array(sequence >= 0))

    facts = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = ranked.select(*facts, "rank").mapInArrow(find, PLACED)

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, _ = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield batch.filter(pa.array(number < 0)).drop_columns(["rank"])

    blocks = max(1, -(-(int(histogram.sum()) - int(whole_count(plan))) // block_pieces))
    kept = ["doc_id", "start", "length", "doc_tokens", "number", "ids"]
    rest = ranked.select(*kept, "rank").mapInArrow(remaining, "doc_id long, start long, length long, doc_tokens long, number long, ids binary")

    def fill(key: tuple, items: pa.Table) -> pa.Table:
        items = items.sort_by("number")
        base = RESIDUAL + (key[0].as_py() << 24)
        lengths, ids = items["length"].to_numpy(), items["ids"].to_pylist()
        doc_id, start, tokens = (items[c].to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        out = []
        for piece, begin, n, number, offset in filled(lengths, capacity):
            wide = len(ids[piece]) // int(lengths[piece])
            part = np.frombuffer(ids[piece], f"<u{wide}")[begin : begin + n].astype("<u4")
            out.append((doc_id[piece], start[piece] + begin, n, zlib.crc32(part.tobytes()), tokens[piece], base + number, offset))
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=[*facts, "sequence_id", "offset"])

    dealt = rest.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks))).repartition(blocks, "block")
    return whole.unionByName(dealt.groupBy("block").applyInArrow(fill, PLACED))


def whole_count(plan: Plan) -> int:
    """Pieces that the plan places."""
    return int((plan.table[:, 2] - plan.table[:, 1]).sum())


def op12_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))
