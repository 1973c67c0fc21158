"""Removal of repeated byte strings by a column-wise Burrows-Wheeler construction over many documents.

Every byte covered by a string of WIDTH bytes that starts anywhere else goes. The strings are found in steps that
keep each task's share bounded:

1. Each window of WIDTH bytes has a minimizer, the smallest hash of its GRAM-byte ranges. Equal windows have equal
   minimizers, so a run of windows with one minimizer (a stretch) can share windows only with stretches of the same
   minimizer. Tasks add up equal stretches before the shuffle; stretches whose minimizer occurs once are dropped.
   Stretches of very frequent minimizers are dealt to tasks by their content too, so no task gets all of them.
2. A minimizer whose stretches are all equal needs no index: its windows repeat if the stretch does.
3. For the others one text of each distinct stretch goes into a collection index. Its columns are SYMBOL bytes
   wide; round by round one symbol of every string, from the right, is inserted, and the Burrows-Wheeler transform
   and the common prefix lengths are updated by one pass over them. Windows are adjacent suffixes with a common
   prefix of WIDTH bytes. A block of whole groups is at most about BLOCK_BYTES, so the files through which the
   passes go are buffers in memory.
4. A group with more than GROUP_STRINGS distinct stretches (the edges of a passage that very many documents share)
   is not put into one block: its windows are counted one by one, by two independent 64-bit hashes.
5. Stretches get back to their documents by a join, and every document's intervals to its text.

Texts are read once: rows get a number, and the stretches of every row are stored with their place, so that sums over
stretches, one text of each and the way back all work on that table. Rows are told apart by their number alone.

Results for unusual input: null and empty texts, and texts shorter than WIDTH, lose nothing; texts of any length are
judged whole; of repeated rows each counts as a document, so all their windows repeat; null identifiers stay null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import documents, small_arrow_batches, written
from lamina.llm.rolling import Ranges, mix

WIDTH = 200
GRAM = 24
#: Bytes of a symbol of the index; WIDTH is a multiple of it.
SYMBOL = 50
BLOCK_BYTES = 1 << 17
GROUP_STRINGS = 2000
#: Windows whose minimizers are computed at once, and stretches that are added up at once.
CHUNK = 1 << 17
COMBINE = 1 << 17
#: Stretches that decide which minimizers are dealt by stretch, and the occurrences there that make one frequent.
SEEN_SITES = 2_000_000
FREQUENT = 200


def _slide(values: np.ndarray, width: int, best: np.ufunc, pad: int) -> np.ndarray:
    """`best` (minimum or maximum) of each `width` consecutive values, by running bests of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, pad, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Of one text: start, number of windows, minimizer, content hash of each stretch, and whether its minimizer
    may occur in it twice (only then can one stretch hold equal windows)."""
    parts = []
    for at in range(0, len(data) - width + 1, CHUNK):
        piece = data[at : at + CHUNK + width - 1]
        ranges = Ranges(piece)
        grams = ranges.every(GRAM)
        reach = width - GRAM + 1
        least = _slide(grams, reach, np.minimum, 2**64 - 1)
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        count = np.diff(np.append(start, len(least)))
        long = -(-count // reach)  # a stretch has `reach` windows at most, so that its text is bounded
        if len(long) and long.max() > 1:
            own = np.repeat(np.arange(len(start)), long)
            turn = np.arange(len(own)) - np.repeat(np.cumsum(long) - long, long)
            left = count[own] - turn * reach
            start, count = start[own] + turn * reach, np.minimum(left, reach)
        end = start + count + width - 1
        key = least[start]
        content = mix(ranges.hash(start, end) + count.astype(np.uint64))
        # A range is a minimizer if it equals the largest minimum of the windows around it.
        around = _slide(np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)]), reach, np.maximum, 0)
        sites = np.flatnonzero(around == grams)
        low, high = np.searchsorted(sites, start), np.searchsorted(sites, end - GRAM, "right")
        seen = np.zeros(len(start), np.int64)
        for step in range(min(8, int((high - low).max(initial=0)))):
            inside = low + step < high
            seen[inside] += grams[sites[low[inside] + step]] == key[inside]
        parts.append((start + at, count, key, content, (seen > 1) | (high - low > 8)))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def repeated_windows(strings: list[bytes], weights: list[int], width: int = WIDTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each string, which of its windows occur twice or more, where a string of weight w counts w times.

    Each string is read in `symbol` phases, so that every window starts a suffix of one of them. Round by round
    one more symbol of every phase is inserted, from the right. `preceding` is the Burrows-Wheeler transform over
    symbols and `common` the common prefix with the suffix before, up to width / symbol."""
    sizes = np.array([len(s) for s in strings], np.int64)
    firsts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(len(strings)), sizes)
    inside = np.arange(len(data)) - firsts[owner]
    begins = inside + symbol <= sizes[owner]  # places where a symbol stands
    names = np.zeros(len(data), np.int64)  # 0: no symbol
    hashes = Ranges(data).every(symbol)
    at = np.flatnonzero(begins)
    names[at] = np.unique(hashes[at], return_inverse=True)[1] + 1
    before = np.zeros(len(data) + symbol, np.int64)  # the symbol that precedes a place in its phase
    before[symbol:] = np.where(begins, names, 0)
    most = width // symbol
    # Empty suffixes: one behind the last symbol of each phase.
    place = (at + symbol)[~np.isin(at + symbol, at, assume_unique=True) | (inside[at] + 2 * symbol > sizes[owner[at]])]
    place = np.sort(place)
    preceding, common = before[place], np.zeros(len(place), np.int8)
    ends, ends_preceding = place, preceding
    rounds = int((sizes.max(initial=0)) // symbol)
    first_of_phase = inside < symbol
    for _ in range(rounds):
        have = np.flatnonzero(preceding)
        order = np.sort((preceding[have].astype(np.uint64) << np.uint64(32)) | have.astype(np.uint64))
        rank = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        letter = order >> np.uint64(32)
        same = letter[1:] == letter[:-1]
        shared = same.astype(np.int8)
        for level in range(1, most):
            cuts = np.cumsum(common < level)
            shared += same & (cuts[rank[1:]] == cuts[rank[:-1]])
        new = place[rank] - symbol
        left = np.where(first_of_phase[new], 0, before[new])
        place = np.concatenate([ends, new])
        preceding = np.concatenate([ends_preceding, left])
        common = np.concatenate([np.zeros(len(ends), np.int8), [0] if len(new) else [], shared]).astype(np.int8)
    group = np.cumsum(common < most)
    real = np.arange(len(place)) >= len(ends)
    place, group = place[real], group[real]
    window = inside[place] + width <= sizes[owner[place]]
    place, group = place[window], group[window]
    total = np.bincount(group, np.array(weights, np.float64)[owner[place]]) if len(group) else np.zeros(0)
    out = np.zeros(len(data), bool)
    out[place] = total[group] > 1.5
    return [out[f : f + n - width + 1] for f, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _raw(text: pa.Scalar) -> bytes:
    return text.as_py() or b""


def _sites(rows: DataFrame) -> DataFrame:
    """`k, c, n, twice, row, start`: all stretches of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, row in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                start, count, k, c, twice = stretches(np.frombuffer(_raw(text), np.uint8))
                if len(k):
                    found.append((k, c, count, twice, np.full(len(k), row, np.int64), start))
            if found:
                k, c, count, twice, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"k": _signed(k), "c": _signed(c), "n": pa.array(count, pa.int32()), "twice": pa.array(twice, pa.bool_()), "row": pa.array(row, pa.int64()), "start": pa.array(start, pa.int32())})

    return rows.select("raw", "row").mapInArrow(run, "k long, c long, n int, twice boolean, row long, start int")


def _counted(sites: DataFrame) -> DataFrame:
    """`k, c, n, seen, twice, row, start`: distinct stretches of parts of the input with their number, added up by
    task, each with one of its places."""

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        k, c, n, twice, row, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, back, seen = np.unique(mix(k.view(np.uint64)) + c.view(np.uint64), return_index=True, return_inverse=True, return_counts=True)
        any_twice = np.bincount(back, twice) > 0
        return pa.RecordBatch.from_pydict({"k": k[first], "c": c[first], "n": n[first], "seen": pa.array(seen, pa.int64()), "twice": any_twice, "row": row[first], "start": start[first]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns))
            held += batch.num_rows
            if held >= COMBINE:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return sites.select("k", "c", "n", "twice", "row", "start").mapInArrow(run, "k long, c long, n int, seen long, twice boolean, row long, start int")


def _frequent(sites: DataFrame) -> DataFrame:
    """`k, hot`: minimizers that occur FREQUENT times or more in about SEEN_SITES stretches. This only decides how rows
    are dealt to tasks, never what is found. There are about SEEN_SITES / FREQUENT of them at most, however large the
    input is."""
    some = sites.sample(False, min(1.0, SEEN_SITES / max(sites.count(), 1)), 1)
    return written(some.groupBy("k").count().where(F.col("count") >= FREQUENT).select("k", F.lit(True).alias("hot")), "frequent")


def _strings(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`k, c, seen, kinds, raw` of the wanted stretches, which have the place `row, start, n` of one text of each."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("k", "c", "seen", "kinds", "start", "n")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            flat, counts = asked.flatten(), asked.value_lengths().to_numpy()
            own = np.repeat(np.arange(len(counts)), counts).tolist()
            texts = [_raw(t) for t in batch.column(0)]
            begin, size = flat.field("start").to_pylist(), flat.field("n").to_pylist()
            raw = [texts[i][a : a + n + WIDTH - 1] for i, a, n in zip(own, begin, size, strict=True)]
            yield pa.RecordBatch.from_pydict({**{c: flat.field(c) for c in ("k", "c", "seen", "kinds")}, "raw": pa.array(raw, pa.binary())})

    return rows.select("row", "raw").join(lists.hint("merge"), "row").select("raw", "wanted").mapInArrow(run, "k long, c long, seen long, kinds long, raw binary")


def _indexed(strings: DataFrame) -> DataFrame:
    """`k, c, mask` of `strings` (k, c, seen, raw), whole groups k at a time; the mask has a bit for each window."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[3] for r in rows], [r[2] for r in rows])
        return pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows], pa.int64()), "c": pa.array([r[1] for r in rows], pa.int64()), "mask": pa.array([np.packbits(m, bitorder="little").tobytes() for m in found], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for k, c, seen, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held >= BLOCK_BYTES and k != last:
                    yield judge(rows)
                    rows, held = [], 0
                rows.append((k, c, seen, raw))
                held += len(raw)
                last = k
        if rows:
            yield judge(rows)

    return strings.repartition("k").sortWithinPartitions("k", "c").select("k", "c", "seen", "raw").mapInArrow(run, "k long, c long, mask binary")


def _one_by_one(strings: DataFrame) -> DataFrame:
    """`k, c, mask` of the strings of very large groups, by counting windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c, seen, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                data = np.frombuffer(raw, np.uint8)
                one, two = Ranges(data).every(WIDTH), Ranges(data[::-1]).every(WIDTH)[::-1]
                n = len(one)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k] * n, pa.int64()), "c": pa.array([c] * n, pa.int64()), "seen": pa.array([seen] * n, pa.int64()), "at": pa.array(range(n), pa.int32()), "w1": _signed(one), "w2": _signed(two)})

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column(2).to_pylist():
                bits = np.zeros(max(at) + 1, bool)
                bits[at] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_pydict({"k": batch.column(0), "c": batch.column(1), "mask": pa.array(out, pa.binary())})

    windows = written(strings.select("k", "c", "seen", "raw").mapInArrow(run, "k long, c long, seen long, at int, w1 long, w2 long"), "windows")
    often = windows.groupBy("w1", "w2").agg(F.sum("seen").alias("times")).where("times > 1").select("w1", "w2")
    marked = windows.join(often.hint("merge"), ["w1", "w2"]).groupBy("k", "c").agg(F.collect_list("at").alias("at"))
    return marked.mapInArrow(masks, "k long, c long, mask binary")


def _covered(size: int, marks: list[dict]) -> np.ndarray:
    """Which bytes lie in repeated windows; marks have start, n and mask (none: all n windows)."""
    change = np.zeros(size + 1, np.int32)
    for m in marks:
        if m["mask"] is None:
            change[m["start"]] += 1
            change[m["start"] + m["n"] - 1 + WIDTH] -= 1
            continue
        bits = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"], bitorder="little") if 8 * len(m["mask"]) >= m["n"] else np.unpackbits(np.frombuffer(m["mask"], np.uint8), bitorder="little")
        at = m["start"] + np.flatnonzero(bits)
        np.add.at(change, at, 1)
        np.add.at(change, at + WIDTH, -1)
    return np.cumsum(change[:-1]) > 0


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, raw, marks` of every row: its bytes and its stretches with repeated windows."""
    small_arrow_batches(docs.sparkSession, 4096, "4m")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    # Numbered rows are stored, so that a number means the same row whenever they are read.
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"), F.monotonically_increasing_id().alias("row")), "texts")
    sites = written(_sites(rows), "sites")
    # One exchange serves the sums over stretches and those over groups: by minimizer, and for frequent ones by
    # content as well, so that a group's stretches are dealt to all tasks.
    dealt = _counted(sites).join(F.broadcast(_frequent(sites)), "k", "left").withColumn("deal", F.when(F.col("hot"), F.col("c")).otherwise(F.lit(0)))
    each = dealt.repartition("k", "deal").groupBy("k", "deal", "c").agg(F.first("n").alias("n"), F.sum("seen").alias("seen"), F.min(F.struct("row", "start")).alias("site"), F.max("twice").alias("twice"), F.first("hot").alias("hot"))
    group = Window.partitionBy("k", "deal")
    each = each.withColumns({"total": F.sum("seen").over(group), "kinds": F.count(F.lit(1)).over(group), "any_twice": F.max("twice").over(group)})
    each = written(each.where("hot OR total > 1 OR any_twice"), "stretches")
    # The sums of frequent groups, a row each.
    whole = each.where("hot").groupBy("k").agg(F.sum("seen").alias("t"), F.count(F.lit(1)).alias("m"), F.max("twice").alias("a"))
    known = each.join(F.broadcast(whole), "k", "left").select("k", "c", "n", "seen", "site.row", "site.start", F.coalesce("t", "total").alias("total"), F.coalesce("m", "kinds").alias("kinds"), F.coalesce("a", "any_twice").alias("any_twice"))
    known = known.where("total > 1 OR any_twice")
    plain = known.where("kinds = 1 AND NOT any_twice").select("k", "c", F.lit(None).cast("binary").alias("mask"))
    mixed = known.where("kinds > 1 OR any_twice")
    strings = written(_strings(rows, mixed), "strings")
    small, large = F.col("kinds") <= GROUP_STRINGS, F.col("kinds") > GROUP_STRINGS
    masks = _indexed(strings.where(small))
    if not strings.where(large).isEmpty():
        masks = masks.unionByName(_one_by_one(strings.where(large)))
    judged = masks.where(F.rlike(F.hex("mask"), F.lit("[1-9A-F]")))
    verdicts = written(plain.unionByName(judged), "verdicts")
    marked = sites.select("k", "c", "n", "row", "start").join(verdicts.hint("merge"), ["k", "c"]).groupBy("row").agg(F.collect_list(F.struct("start", "n", "mask")).alias("marks"))
    return rows.join(marked.hint("merge"), "row", "left").select("id", "raw", "marks")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """`id, n_bytes, n_removed, n_spans` of every row with `kept`, the remaining bytes, or their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, marks in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = _raw(text)
                gone = _covered(len(data), marks or [])
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes() if marks else data
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            last = pa.array(kept, pa.string() if digest else pa.binary())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256" if digest else "kept": last})

    schema = "id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    return find(docs, id_col, text_col).mapInArrow(run, schema)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir), digest=True).withColumnRenamed("id", "doc_id")
