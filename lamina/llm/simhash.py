"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint has 64 bits; bit b is the majority of bit b over the 64-bit hashes of all word shingles. The
embedding maps a fingerprint to the bit counts of its 32 segments of two bits, each written as 0, 1 or 2 ones, so that
the Manhattan distance of two embeddings is the number of bits in which they differ. Changing one bit of a fingerprint
changes one count by one, so this distance never exceeds the Hamming distance, and a pair within MAX_BITS bits lies
within MAX_BITS in the grid of embeddings. Split into two halves, such a pair differs in at most one bit in one of
them; of this half's two quarters one is equal, bit by bit, and the other is within one step of the grid. So each
distinct fingerprint enters, for each quarter, the cell of that quarter's bits and the embedding of its neighbour, and
probes the cells one step up, and an equi-join on cells finds all pairs at one step or none (a step down is the
partner's step up). Inside the join the Manhattan distance of the whole embeddings rules out candidates before the exact
number of differing bits decides. Cells hold distinct fingerprints only, so copies never meet; frequent cells are split
by adaptive execution.

`keep_one` can also link by similarity, as the pipeline's stage does: all pairs of texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more. A radius in bits can't give these, as such pairs differ in up to
a dozen bits and more. In any fixed order of shingles two sets that are so alike share one of their first
n - ceil(0.8 n) + 1, so an equi-join on these prefixes loses no pair. The order counts over all texts, for
one shingle in ELIGIBLE by hash, how many texts have it, and puts the rarest first; shingles of one text alone fill most
prefixes and link nothing. It decides how many candidates there are and nothing else, and as it counts everything, it
serves as well at any size. Every text of a prefix shingle meets the shortest one first. What these pairs connect need not be compared again, so only texts of different components meet
inside a shingle's group, and the parities of their sets, folded to FOLDED longs, rule out most of them within the join.
Longer parities rule out most of the others, and the whole sets decide on what is left.

Components come from min-label propagation with pointer jumping over distinct linked fingerprints; every round is
written to the shared folder.

Results for unusual input: null, empty and blank texts have fingerprint zero and link like others; short texts
are one shingle; repeated rows share a component; null identifiers rank below others and give a null component if
they alone make it up; an empty table gives an empty result; other columns are carried by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import LOWEST_ID, documents, id_key, packed_row, small_arrow_batches, written

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Two-bit segments: the more segments, the fewer unlike pairs share a cell. Bits of a quarter of a fingerprint.
SEGMENT_BITS = 2
QUARTER = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Similarity of whole texts: words of a shingle, and the least Jaccard similarity as a fraction.
SIMILAR_WORDS = 5
SIMILAR = (4, 5)
#: One in so many shingles, by hash, is counted over all texts for the order of prefixes. A prefix has a fifth of a set.
ELIGIBLE = 4
#: Least length of a sketch; texts of more shingles have as many bits as shingles at least, a power of two.
SKETCH_BITS = 1024
#: Further rounds in which the texts of a shingle's group meet some of those that are left, before all that are still apart
#: meet each other; and how many these are at most.
CENTRE_ROUNDS, CENTRES = 1, 16
#: Longs that a sketch is folded to for the join of a shingle's texts.
FOLDED = 8
#: Places of a table, by hash, of the texts whose whole sets are needed: it spares the shuffle of most others.
NEEDED_MARKS = 1 << 22


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The majority bits of the shingles of the whole text."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().translate(_LOWER).split()  # bytes split at exactly the six ASCII gaps
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    k = min(words, len(parts))
    begins, ends = starts[: len(parts) - k + 1].tolist(), (starts + sizes)[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), CHUNK):
        part = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[at : at + CHUNK], ends[at : at + CHUNK], strict=True)), np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begins), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """`row_key, fp` of every row."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"row_key": batch.column(0), "fp": pa.array([fingerprint(t.as_py(), words) for t in batch.column(1)], pa.int64())})

    return docs.select(id_key(id_col).alias("row_key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "row_key long, fp long")


def shingle_set(text: str | None, words: int = SIMILAR_WORDS, wanted: np.ndarray | None = None) -> tuple[int, np.ndarray]:
    """A 64-bit hash of the text's words, and the sorted distinct 64-bit hashes of the shingles of the whole text; none
    of a text that `wanted` has no mark for."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().translate(_LOWER).split()
    joined = b" ".join(parts)
    doc = int.from_bytes(xxh64_intdigest(joined, SEED).to_bytes(8, "little"), "little", signed=True)
    if wanted is not None and not wanted[doc % len(wanted)]:
        return doc, np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    k = min(words, len(parts))
    begins, ends = (starts[: len(parts) - k + 1].tolist(), (starts + sizes)[k - 1 :].tolist()) if k else ([], [])
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)), np.uint64, len(begins))
    return doc, np.unique(hashes)


def _texts(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    small_arrow_batches(docs.sparkSession)
    key = id_key(id_col) if id_col else F.lit(LOWEST_ID)
    return docs.select(key.alias("row_key"), F.col(text_col).cast("string").alias("text"))


def _prefix_size(n: int) -> int:
    """How many of its first shingles a set of `n` needs, so that two similar sets share one of theirs in any fixed order."""
    up, down = SIMILAR
    return n - (up * n + down - 1) // down + 1 if n else 0


def shingled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """`row_key, fp` of every row, and of its text the hash `doc`, the number `n` of five-word shingles, the parities
    `sketch` of their hashes by their last bits, these folded to the longs `f0` and so on, and of eight bytes a hash the
    `counted` shingles, those that ELIGIBLE picks by hash, and the `late` ones that the prefix needs if these are too few."""
    folds = [f"f{k}" for k in range(FOLDED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"fp": [], "doc": [], "n": [], "sketch": [], "counted": [], "late": [], **{f: [] for f in folds}}
            for text in batch.column(1):
                doc, shingles = shingle_set(text.as_py())
                bits = max(SKETCH_BITS, 1 << len(shingles).bit_length())
                odd = np.bincount((shingles % bits).astype(np.int64), minlength=bits) & 1
                sketch = np.packbits(odd.astype(bool))
                folded = np.bitwise_xor.reduce(sketch.view(np.int64).reshape(-1, FOLDED), axis=0)
                own = shingles % ELIGIBLE == 0
                late = shingles[~own][: max(0, _prefix_size(len(shingles)) - int(own.sum()))]
                row = (fingerprint(text.as_py(), words), doc, len(shingles), sketch.tobytes(), shingles[own].tobytes(), late.tobytes(), *folded.tolist())
                for values, value in zip(out.values(), row, strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_pydict({"row_key": batch.column(0), **out}, schema)

    kinds = {"row_key": pa.int64(), "fp": pa.int64(), "doc": pa.int64(), "n": pa.int64(), "sketch": pa.binary(), "counted": pa.binary(), "late": pa.binary(), **{f: pa.int64() for f in folds}}
    schema = pa.schema(list(kinds.items()))
    return _texts(docs, id_col, text_col).mapInArrow(run, "row_key long, fp long, doc long, n long, sketch binary, counted binary, late binary, " + ", ".join(f"{f} long" for f in folds))


def _tokens(rows: DataFrame) -> DataFrame:
    """`token, doc, late` of every shingle that a prefix may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, late in ((1, False), (2, True)):
                tokens = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(column)]
                doc = np.repeat(batch.column(0).to_numpy(), [len(x) for x in tokens])
                yield pa.RecordBatch.from_pydict({"token": np.concatenate([*tokens, np.empty(0, np.int64)]), "doc": doc, "late": np.full(len(doc), late)})

    return rows.select("doc", "counted", "late").mapInArrow(run, "token long, doc long, late boolean")


def _prefixes(rows: DataFrame) -> DataFrame:
    """`token, doc, n` of the shingles of the texts' prefixes that other texts have as well. The order counts, over all
    texts, how many have an eligible shingle: those of one text come first, then the rarer before the more frequent, and
    the shingles that aren't eligible last. Shingles of one text link nothing, so it is enough to know how many they are."""
    tokens = _tokens(rows)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("texts"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("token", "texts")
    met = tokens.hint("merge").join(shared, "token").repartition("doc").dropDuplicates(["doc", "token"])
    up, down = SIMILAR
    size = F.col("n") - F.floor((up * F.col("n") + down - 1) / down) + 1
    about = rows.select("doc", "n", (F.octet_length("counted") / 8).cast("long").alias("eligible"), size.alias("size")).dropDuplicates(["doc"])
    whole = Window.partitionBy("doc")
    ranked = met.join(about.hint("merge"), "doc").withColumns({"held": F.count(F.when(~F.col("late"), 1)).over(whole), "rank": F.row_number().over(whole.orderBy("late", "texts", "token"))})
    left = F.least("size", "eligible") - (F.col("eligible") - F.col("held"))
    return ranked.where(F.col("late") | (F.col("rank") <= left)).select("token", "doc", "n")


def _differing(a: bytes, b: bytes) -> int:
    """Parities that differ; the longer sketch is folded to the length of the other."""
    size = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint64).reshape(-1, size // 8), axis=0) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def _promising(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """`doc_a, doc_b, a, b` of the pairs whose sketches allow similarity: texts that are so alike have at most
    (down - up) / (down + up) of the sum of their shingles on one side only, and each changes one parity."""
    texts = written(rows.select("doc", "fp", "n", "sketch").dropDuplicates(["doc"]), "sketches")
    left, right = texts.toDF("doc_a", "a", "n_a", "sketch_a"), texts.toDF("doc_b", "b", "n_b", "sketch_b")
    up, down = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.array([_differing(x.as_py(), y.as_py()) for x, y in zip(batch.column(6), batch.column(7), strict=True)], np.int64)
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            yield batch.select([0, 1, 2, 3]).filter(pa.array((up + down) * differ <= (down - up) * total))

    both = pairs.join(left.hint("merge"), "doc_a").join(right.hint("merge"), "doc_b").select("doc_a", "doc_b", "a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return written(both.mapInArrow(run, "doc_a long, doc_b long, a long, b long"), "candidates")


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs `doc_a, doc_b, a, b` that are similar by their whole sets."""
    needed = written(pairs.select(F.col("doc_a").alias("doc")).unionByName(pairs.select(F.col("doc_b").alias("doc"))).distinct(), "needed")
    marks = np.zeros(NEEDED_MARKS, bool)
    for r in needed.select(F.pmod("doc", F.lit(NEEDED_MARKS)).cast("int").alias("m")).distinct().toLocalIterator():
        marks[r["m"]] = True
    packed = np.packbits(marks).tobytes()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for batch in batches:
            found = [(d, x.tobytes()) for t in batch.column(1) for d, x in [shingle_set(t.as_py(), wanted=wanted)] if wanted[d % NEEDED_MARKS]]
            yield pa.RecordBatch.from_pydict({"doc": pa.array([d for d, _ in found], pa.int64()), "shingles": pa.array([x for _, x in found], pa.binary())})

    whole = _texts(docs, None, text_col).mapInArrow(sets, "doc long, shingles binary")
    table = written(whole.hint("merge").join(needed, "doc", "left_semi").dropDuplicates(["doc"]), "shingle-sets")
    up, down = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                same.append(down * both >= up * (len(p) + len(q) - both))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(same, pa.bool_()))

    left, right = table.toDF("doc_a", "set_a"), table.toDF("doc_b", "set_b")
    both = pairs.join(left.hint("merge"), "doc_a").join(right.hint("merge"), "doc_b").select("doc_a", "doc_b", "a", "b", "set_a", "set_b")
    return written(both.mapInArrow(run, "doc_a long, doc_b long, a long, b long"), "similar")


def similar_links(rows: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Fingerprints `a, b` of pairs of similar texts of `docs`, of which `rows` is `shingled`: all pairs, without those
    that the pairs with a shared third text already link."""
    placed = written(_prefixes(rows), "prefixes")
    up, down = SIMILAR
    # Every text of a prefix shingle meets the shortest one first; texts that are similar to that one are linked
    # with each other by it, so only the others meet all.
    centres = placed.groupBy("token").agg(F.min(F.struct("n", "doc")).alias("c")).select("token", F.col("c.n").alias("cn"), F.col("c.doc").alias("centre"))
    beside = written(placed.join(centres.hint("merge"), "token").where("doc != centre"), "beside")
    around = beside.where(down * F.col("cn") >= up * F.col("n")).select(F.col("centre").alias("doc_a"), F.col("doc").alias("doc_b")).distinct()
    star = _verified(_promising(around, rows), docs, text_col)
    linked = star.select(F.col("doc_a").alias("centre"), F.col("doc_b").alias("doc"))
    # What the centres connect is known, so from here on only texts of different components have to meet.
    folds = [f"f{k}" for k in range(FOLDED)]
    own = written(rows.select("doc", *folds).dropDuplicates(["doc"]), "folded-sketches")
    rest = written(beside.join(linked.hint("merge"), ["centre", "doc"], "left_anti").select("token", "doc", "n"), "rest")
    others = written(beside.select("token", "doc", "n").join(rest.select("token").distinct().hint("merge"), "token", "left_semi"), "others")
    found = star
    known = components(found.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))).withColumnRenamed("node", "doc")
    about = written(own.join(known.hint("merge"), "doc", "left").withColumn("label", F.coalesce("label", "doc")), "components-so-far")
    for turn in range(CENTRE_ROUNDS + 1):
        one = rest
        if turn < CENTRE_ROUNDS:
            # Any members will do; the hash makes them others in each round.
            hashed = rest.withColumn("h", F.xxhash64(F.lit(turn), "doc"))
            chosen = hashed.groupBy("token", F.pmod("h", F.lit(CENTRES))).agg(F.min(F.struct("h", "doc", "n")).alias("c"))
            one = chosen.select("token", "c.doc", "c.n")
        pairs = _apart(one, others, about, folds)
        more = _verified(_promising(pairs, rows), docs, text_col)
        found = found.unionByName(more)
        if turn < CENTRE_ROUNDS:
            # New pairs join components; only these are connected anew.
            ends = [about.select(F.col("doc").alias(f"doc_{k}"), F.col("label").alias(f"label_{k}")) for k in "ab"]
            joined = more.join(ends[0].hint("merge"), "doc_a").join(ends[1].hint("merge"), "doc_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
            merged = components(joined).toDF("label", "least")
            about = written(about.join(merged, "label", "left").withColumn("label", F.coalesce("least", "label")).drop("least"), "components-so-far")
    return found.where("a != b").select("a", "b")


def _apart(one: DataFrame, other: DataFrame, about: DataFrame, folds: list[str]) -> DataFrame:
    """Pairs `doc_a, doc_b` of two tables of `token, doc, n` that share a token, have different labels by `about` and may
    be similar by their sizes and folded parities."""

    def side(of: DataFrame, mark: str) -> DataFrame:
        full = of.join(about.hint("merge"), "doc")
        return full.select(F.col("token").alias(f"token_{mark}"), *[F.col(c).alias(f"{c}_{mark}") for c in ("doc", "n", "label", *folds)])

    up, down = SIMILAR
    sizes = down * F.least("n_a", "n_b") >= up * F.greatest("n_a", "n_b")
    differ = sum((F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in folds), F.lit(0))
    near = (F.col("label_a") != F.col("label_b")) & sizes & ((up + down) * differ <= (down - up) * (F.col("n_a") + F.col("n_b")))
    met = side(one, "a").hint("merge").join(side(other, "b"), (F.col("token_a") == F.col("token_b")) & near)
    return met.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).distinct()


def _embedded(fp: Column) -> Column:
    """The embedding as 64 bits: a segment's count in its own place, as no, the low or both bits set."""
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    any_, both = fp.bitwiseOR(shifted).bitwiseAND(low), fp.bitwiseAND(shifted).bitwiseAND(low)
    return any_.bitwiseOR(F.shiftleft(both, 1))


def _cells(fp: Column, embedding: Column, quarter: int, up: bool) -> Column:
    """Cells of one quarter as the equal one: its number and bits, and the embedding of the other quarter of its half,
    or that and all embeddings one step up."""
    other = quarter ^ 1
    equal = F.shiftrightunsigned(fp, QUARTER * quarter).bitwiseAND(F.lit(0xFFFF))
    near = F.shiftrightunsigned(embedding, QUARTER * other).bitwiseAND(F.lit(0xFFFF))
    own = (F.lit(quarter).cast("long") * (1 << 32)).bitwiseOR(F.shiftleft(equal, QUARTER)).bitwiseOR(near)
    if not up:
        return F.array(own)
    steps = []
    for at in range(0, QUARTER, SEGMENT_BITS):
        count = F.shiftrightunsigned(near, at).bitwiseAND(F.lit(3))
        steps.append(F.when(count == 0, own + (1 << at)).when(count == 1, own + (2 << at)))
    return F.array_compact(F.array(own, *steps))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Pairs `a, b` of distinct fingerprints that differ in at most `bits` bits (3 at most: one step in one half).
    Each pair appears at least once, in either order."""
    if bits > 3:
        raise ValueError("two halves cover 3 bits at most")
    embedded = distinct.select("fp", _embedded(F.col("fp")).alias("e"))

    def entered(name: str, up: bool) -> DataFrame:
        cells = F.concat(*[_cells(F.col("fp"), F.col("e"), q, up) for q in range(4)])
        return embedded.select(F.col("fp").alias(name), F.explode(cells).alias("cell"))

    base, probe = entered("a", False), entered("b", True)
    a, b = F.col("a"), F.col("b")
    near = (a != b) & (_distance(_embedded(a), _embedded(b)) <= bits) & (_distance(a, b) <= bits)
    return base.hint("merge").join(probe, (base["cell"] == probe["cell"]) & near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """`node, label` with the smallest node that can be reached, of all nodes of `edges` (a, b).

    In each round every node goes to the one among itself and its neighbours that a hash, another in each round, puts first; edges
    are carried over and those within a node go. About half of the nodes are left, and fewer edges, so all rounds together
    cost a few times the first, even on a long path. Then the rounds are followed backwards."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b"), F.col("a")).toDF("node", "other"))
    left = written(both.where("node != other").distinct(), "edges")
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    moves: list[DataFrame] = []
    while not left.isEmpty():

        def place(name: str, turn: int = len(moves)) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), name).alias("h"), F.col(name).alias("to"))

        move = written(left.groupBy("node").agg(F.least(F.min(place("other")), F.first(place("node")))["to"].alias("to")), "moves")
        moves.append(move)
        near = left.join(move, "node").select(F.col("to").alias("node"), "other").distinct()
        far = near.join(move.select(F.col("node").alias("other"), F.col("to").alias("end")), "other")
        left = written(far.select("node", F.col("end").alias("other")).where("node != other").distinct(), "edges")
    if not moves:
        return alone.distinct().select("node", F.col("node").alias("label"))
    roots = moves[-1]
    for move in reversed(moves[:-1]):
        roots = written(move.join(roots.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("to")), "roots")
    label = F.least(F.min("node"), F.first("to"))
    found = roots.join(roots.groupBy("to").agg(label.alias("label")), "to").select("node", "label")
    return found.unionByName(alone.join(found, "node", "left_anti").distinct().select("node", F.col("node").alias("label")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, bits: int = MAX_BITS, similar: bool = False) -> DataFrame:
    """`row_key, fp, component` of every row: the smallest key that links reach. With `similar`, texts that are
    similar by their five-word shingles are linked too."""
    rows = written((shingled if similar else fingerprints)(docs, id_col, text_col, words), "fingerprints")
    groups = written(rows.groupBy("fp").agg(F.min("row_key").alias("first_key")), "distinct-fingerprints")
    pairs = links(groups.select("fp"), bits)
    if similar:
        pairs = pairs.unionByName(similar_links(rows, docs, text_col))
    found = components(written(pairs.distinct(), "links"))
    # A component's label is a fingerprint; the smallest key over its fingerprints replaces it.
    keyed = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_key", F.coalesce("label", "fp").alias("label"))
    smallest = keyed.groupBy("label").agg(F.min("first_key").alias("component"))
    table = written(keyed.join(smallest, "label").select("fp", "component"), "components")
    return rows.join(table.hint("merge"), "fp").select("row_key", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, with the smallest identifier of their component. Rows that repeat that
    identifier stay together, as they can't be told apart by it. `similar` is that of `classes`."""
    stay = classes(docs, id_col, text_col, similar=similar).where("row_key = component").select("row_key").distinct()
    keyed = docs.select(packed_row(docs), id_key(id_col).alias("row_key"))
    return keyed.join(stay.hint("merge"), "row_key", "left_semi").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    def back(key: Column) -> Column:
        return F.when(key != LOWEST_ID, key)

    return classes(documents(spark, sf_dir)).select(
        back(F.col("row_key")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        back(F.col("component")).alias("component_id"),
    )
