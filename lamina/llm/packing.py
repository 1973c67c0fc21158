"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens; a full piece is a sequence of its own. The others are dealt
into blocks of about BLOCK_PIECES by a hash of their number, so a task never sees more than that. Each block has
ISLANDS populations of groupings. A generation picks whole well-filled bins of one parent and injects them into
another: the bins there that hold an injected piece go, and the pieces which that displaces, with those of the
emptiest bins, are best-fitted in descending order. A round goes on while its best grouping gets better; none is
needed once a block has the least possible number of sequences. After every round the best grouping of an island migrates to
the next island of its block; rounds are separate jobs whose state lies in the shared folder. The best grouping
of a block is used in the end.

Results for unusual input: null and empty texts are a piece of the end id alone; null identifiers stay null;
repeated rows are packed as often as they occur; texts of any length are cut, never shortened; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.chunk_encoder import MEMO_CHUNKS, encoder, tokenizer_path
from lamina.llm.common import documents, small_arrow_batches, written

CAPACITY = 2048
SEPARATOR = 0
BLOCK_PIECES = 16384
ISLANDS = 2
ROUNDS = 3
POPULATION = 6
#: Most generations of a round; it ends before if the least possible number of bins is reached, or if no grouping with
#: fewer bins has come up for PATIENCE generations. An island that ended so goes on only when a better migrant arrives.
GENERATIONS = 200
PATIENCE = 60
#: Bins at least this full may be injected; the share of them that is, and the share of bins that is loosened.
WELL_FILLED = 0.99
INJECTED = (0.02, 0.2)
LOOSENED = (0.01, 0.08)
#: Passes in which displaced pieces change places with smaller ones, and the places looked at for each.
EXCHANGES = 2
TRIES = 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "block long, island int, bins long, squares double, grouping binary, done boolean, migrant boolean"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: all full but the first."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", memo_chunks: int = MEMO_CHUNKS) -> DataFrame:
    """Every document's pieces, with the separator at its end; ids themselves stay in the worker."""
    small_arrow_batches(docs.sparkSession, 4096)  # the more texts, the fewer distinct chunks to look up; 8 MB hold either way

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path, memo_chunks), np.array([separator], np.uint32)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode_many(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                rows += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


class Shelf:
    """Open bins by the room left in them, for best fit: a bit for each room that some bin has."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, number: int, room: int) -> None:
        if room > 0:
            self.by_room[room].append(number)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int]:
        """The bin with the least room that suffices, and its room; -1 if none does."""
        fits = self.mask >> size
        if not fits:
            return -1, self.capacity
        room = size + (fits & -fits).bit_length() - 1
        bins = self.by_room[room]
        number = bins.pop()
        if not bins:
            self.mask ^= 1 << room
        return number, room


def best_fit(sizes: np.ndarray, order: np.ndarray, grouping: np.ndarray, fills: list[int], capacity: int) -> None:
    """Puts the pieces of `order` into the bins of `fills`, or new ones; changes `grouping` and `fills`."""
    shelf = Shelf(capacity)
    for number, fill in enumerate(fills):
        shelf.put(number, capacity - fill)
    for piece, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        number, room = shelf.take(size)
        if number < 0:
            number = len(fills)
            fills.append(0)
        grouping[piece] = number
        fills[number] += size
        shelf.put(number, room - size)


def seeded(sizes: np.ndarray, capacity: int, noise: float, random: np.random.Generator) -> np.ndarray:
    """Best fit in descending order of the sizes, each changed by up to the share `noise`."""
    grouping = np.full(len(sizes), -1, np.int32)
    best_fit(sizes, np.argsort(-sizes * (1 + noise * random.uniform(-1, 1, len(sizes))), kind="stable"), grouping, [], capacity)
    return grouping


def exchange(sizes: np.ndarray, order: np.ndarray, grouping: np.ndarray, fills: list[int], capacity: int) -> np.ndarray:
    """Best fit by exchange: a piece of `order` takes the place of a smaller one where that leaves the least room, at
    most once a bin; changes `grouping` and `fills` and returns the pieces that have no bin then."""
    placed = np.flatnonzero(grouping >= 0)
    reach = sizes[placed] + capacity - np.array(fills, np.int64)[grouping[placed]]  # the largest piece that fits instead
    rank = np.argsort(reach, kind="stable")
    placed, first = placed[rank], np.searchsorted(reach[rank], sizes[order]).tolist()
    bins, held, last = grouping[placed].tolist(), sizes[placed].tolist(), len(placed)
    used = bytearray(len(fills))
    moved, left = [], []
    for n, (size, at) in enumerate(zip(sizes[order].tolist(), first, strict=True)):
        for k in range(at, min(at + TRIES, last)):
            number = bins[k]
            if held[k] < size and not used[number]:
                used[number] = 1
                fills[number] += size - held[k]
                moved.append((n, k, number))
                break
        else:
            left.append(n)
    if not moved:
        return order
    new, old, into = (np.array(x) for x in zip(*moved, strict=True))
    grouping[placed[old]] = -1
    grouping[order[new]] = into
    return np.concatenate([order[left], placed[old]])


def crossed(sizes: np.ndarray, receiver: np.ndarray, donor: np.ndarray, capacity: int, random: np.random.Generator) -> np.ndarray:
    """The receiver with some well-filled bins of the donor."""
    donor_fill = np.bincount(donor, sizes)
    good = np.flatnonzero(donor_fill >= WELL_FILLED * capacity)
    if not len(good):
        good = np.flatnonzero(donor_fill >= np.quantile(donor_fill, 0.75))
    chosen = np.zeros(len(donor_fill), bool)
    chosen[random.choice(good, max(1, int(len(good) * random.uniform(*INJECTED))), replace=False)] = True
    injected = chosen[donor]
    fill = np.bincount(receiver, sizes)
    gone = np.zeros(len(fill), bool)
    gone[receiver[injected]] = True  # they hold duplicates of injected pieces
    # The emptiest bins, and some at random, give their pieces another chance.
    loose = np.argsort(fill * random.uniform(0.9, 1, len(fill)), kind="stable")[: max(1, int(len(fill) * random.uniform(*LOOSENED)))]
    gone[loose] = True
    displaced = gone[receiver] & ~injected
    kept = ~gone[receiver] & ~injected
    # Bins anew: the receiver's that stay, then the injected.
    out = np.full(len(sizes), -1, np.int32)
    stay, given = np.bincount(receiver[kept], minlength=len(fill)) > 0, np.cumsum(chosen)
    out[kept] = (np.cumsum(stay) - 1)[receiver[kept]]
    out[injected] = int(stay.sum()) + given[donor[injected]] - 1
    fills = [*fill[stay].astype(int).tolist(), *donor_fill[chosen].astype(int).tolist()]
    order = np.flatnonzero(displaced)
    for _ in range(EXCHANGES):
        order = exchange(sizes, order[np.argsort(-sizes[order], kind="stable")], out, fills, capacity)
    best_fit(sizes, order[np.argsort(-sizes[order], kind="stable")], out, fills, capacity)
    return out


def fitness(sizes: np.ndarray, grouping: np.ndarray) -> tuple[int, float]:
    """Fewer bins come first, then fuller ones: the negated number of bins and the sum of squared fills."""
    fill = np.bincount(grouping, sizes)
    return -len(fill), float((fill**2).sum())


def evolved(sizes: np.ndarray, population: list[np.ndarray], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS) -> tuple[list[np.ndarray], bool]:
    """The population after some generations, best first, and whether it ended for want of anything better; a
    population that is too small is filled up first, unless its first member is as good as any can be."""
    random = np.random.default_rng(seed)
    fewest = -(-int(sizes.sum()) // capacity)
    while len(population) < POPULATION and not (population and population[0].max(initial=-1) < fewest):
        population.append(seeded(sizes, capacity, 0.0 if not population else 0.02 * len(population), random))
    rated = sorted(((fitness(sizes, g), g) for g in population), key=lambda x: x[0], reverse=True)[:POPULATION]
    idle = 0
    for _ in range(generations):
        if -rated[0][0][0] <= fewest or idle >= PATIENCE:
            break  # no grouping has fewer bins, or none has been found for long
        a, b = random.choice(len(rated), 2, replace=False)
        receiver, donor = rated[min(a, b)][1], rated[max(a, b)][1]
        child = crossed(sizes, receiver, donor, capacity, random)
        rating = fitness(sizes, child)
        idle = 0 if rating[0] > rated[0][0][0] else idle + 1
        if rating not in [r for r, _ in rated]:  # equals would crowd out others
            rated = sorted([*rated, (rating, child)], key=lambda x: x[0], reverse=True)[:POPULATION]
    return [g for _, g in rated], -rated[0][0][0] <= fewest or idle >= PATIENCE


def evolve(sizes: np.ndarray, population: list[np.ndarray], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The groupings of `evolved`."""
    return evolved(sizes, population, seed, capacity, generations)[0]


def _state(block: int, island: int, sizes: np.ndarray, evolved: tuple[list[np.ndarray], bool]) -> pd.DataFrame:
    population, done = evolved
    rated = [fitness(sizes, g) for g in population]
    return pd.DataFrame({"block": block, "island": island, "bins": [-b for b, _ in rated], "squares": [s for _, s in rated], "grouping": [g.astype("<i4").tobytes() for g in population], "done": done, "migrant": False})


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """`cut_pieces` (PIECE) with `sequence_id` and `offset`."""
    columns = list(cut_pieces.columns)
    numbered = written(cut_pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    whole = numbered.where(F.col("length") == capacity).select(*columns, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block_pieces))
    placed = rest.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    deal = min(blocks * islands, 8 * int(cut_pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Dealt by a fixed number of partitions: the rows are few bytes and much work, so they must not be coalesced.
    sized = placed.select("block", "number", "length", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")).repartition(deal, "block", "island")

    def begin(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        sizes = items.sort_values("number")["length"].to_numpy()
        return _state(key[0], key[1], sizes, evolved(sizes, [], hash((key[0], key[1], 0)) % 2**32, capacity))

    def go_on(key: tuple, items: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own, given = state[~state["migrant"]], state[state["migrant"]]
        if own["done"].all() and own["bins"].min() <= given["bins"].min():
            return own
        sizes = items.sort_values("number")["length"].to_numpy()
        population = [np.frombuffer(g, "<i4") for g in state.sort_values(["bins", "squares"], ascending=[True, False])["grouping"]]
        return _state(key[0], key[1], sizes, evolved(sizes, population, hash((key[0], key[1], len(population))) % 2**32, capacity))

    state = written(sized.groupBy("block", "island").applyInPandas(begin, STATE), "islands")
    first = F.max_by(F.struct("bins", "squares", "grouping", "done"), F.struct(-F.col("bins"), F.col("squares"))).alias("first")
    for _ in range(rounds - 1):
        elites = state.groupBy("block", "island").agg(first).select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "first.*", F.lit(True).alias("migrant"))
        both = state.unionByName(elites).repartition(deal, "block", "island")
        state = written(sized.groupBy("block", "island").cogroup(both.groupBy("block", "island")).applyInPandas(go_on, STATE), "islands")

    def finish(key: tuple, items: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("number", ignore_index=True)
        items["bin"] = np.frombuffer(state["grouping"].iloc[0], "<i4")
        items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
        items["sequence_id"] = (int(key[0]) << 24) + items["bin"].astype("int64")
        return items[[*columns, "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    deal = min(blocks, deal)
    chosen = state.groupBy("block").agg(first).select("block", "first.grouping").repartition(deal, "block")
    schema = f"{PIECE}, sequence_id long, offset long"
    packed = placed.select("block", "number", *columns).repartition(deal, "block").groupBy("block").cogroup(chosen.groupBy("block")).applyInPandas(finish, schema)
    return packed.unionByName(whole)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))
