import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lamina.llm import nnls_packing as P
from lamina.llm.chunk_encoder import tokenizer_path
from tests.oracle import SF

PATH = tokenizer_path("byte_bpe_50k.json")


def encoded(rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return [(r[0], np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows]


def checked(got, documents, capacity=2048):
    """Every id of every document lies in one piece, places have no gaps; the padding."""
    left = defaultdict(list)
    for r in got:
        left[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    want = defaultdict(list)
    for doc_id, ids in documents:
        want[doc_id, len(ids)].append(ids)
    assert set(left) == set(want)
    for key, texts in want.items():
        # Rows may repeat an identifier: each start is there as often as rows are, and pieces continue each other.
        starts, ends = sorted(a for a, _, _ in left[key]), sorted(a + n for a, n, _ in left[key])
        assert sorted([*starts, *[key[1]] * len(texts)]) == sorted([*ends, *[0] * len(texts)])
        for a, n, crc in left[key]:
            assert n > 0 and crc in {zlib.crc32(ids[a : a + n].tobytes()) for ids in texts}
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert checked(P.op12_nnls_packing(spark, SF).collect(), encoded(rows)) == 0


def test_unusual_rows(spark):
    rows = [(1, None), (2, ""), (None, "no identifier"), (3, "again"), (3, "again"), (4, "x " * 9000), (5, "😀<|endoftext|>"), (6, " \n\x00")]
    rows += [(10 + k, "a" + " a" * (k * 37 % 1500)) for k in range(150)]
    docs = spark.createDataFrame([(*r, "own", 7) for r in rows], "doc_id long, text string, ids string, length int").repartition(3)
    for block_pieces in (4096, 20):
        assert checked(P.pack(P.pieces(docs, PATH), block_pieces=block_pieces).collect(), encoded(rows)) == 0


@pytest.mark.parametrize("length", [1, 700, 1100, 1500, 2047, 2048, 2049])
def test_copies_of_one_length(spark, length):
    """No combination fills a window with one such length, so pieces have to be cut."""
    rows = [(k, "a" + " a" * (length - 2) if length > 1 else "") for k in range(61)]
    got = P.pack(P.pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH)).collect()
    assert checked(got, encoded(rows)) == 0


def test_empty(spark):
    got = P.pack(P.pieces(spark.createDataFrame([], "doc_id long, text string"), PATH))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() == 0


def test_combinations_are_all():
    present = np.array([0, 1, 1, 0, 1, 1, 0, 1, 0, 0, 1, 0, 1], bool)
    want = {tuple(sorted(([0, 0, 0] + list(c))[-3:])) for n in (1, 2, 3) for c in itertools.combinations_with_replacement(np.flatnonzero(present).tolist(), n) if sum(c) == 12}
    assert {tuple(c) for c in P.combinations(present, 12).tolist()} == want


def test_least_squares(spark):
    """At the least error no count can grow with gain, and positive ones have no slope."""
    random = np.random.default_rng(5)
    histogram = random.poisson(30, 33)
    histogram[0] = 0
    columns = P.combinations(histogram > 0, 32)
    x = P.solved(histogram, columns, 1e-9, 200_000)
    a = np.zeros((33, len(columns)))
    for k, lengths in enumerate(columns.tolist()):
        for length in filter(None, lengths):
            a[length, k] += 1
    slope = a.T @ (histogram - a @ x)
    assert x.min() >= 0 and slope.max() < 1e-3 and abs(slope[x > 0]).max() < 1e-3
    counts = P.rounded(histogram, columns, x)
    assert (a @ counts <= histogram).all() and counts.sum() > 0.5 * x.sum()


def test_residual_is_not_padded():
    random = np.random.default_rng(3)
    for n in (1, 2, 50):
        sizes = random.integers(1, 64, n)
        out = P.filled(sizes, 64)
        parts = defaultdict(list)
        for piece, begin, length, _, _ in out:
            parts[piece].append((begin, length))
        for piece, found in parts.items():
            ends = np.cumsum([n for _, n in sorted(found)])
            assert [b for b, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] == sizes[piece]
        fills = defaultdict(int)
        for _, _, length, number, _ in out:
            fills[number] += length
        assert len(parts) == n and all(f & (f - 1) == 0 and f <= 64 for f in fills.values())
