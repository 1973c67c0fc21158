from collections import Counter

import numpy as np
import pytest

from lamina.operators import correlation as C


def frame(spark, masks):
    rows = [(k, int(r), int(c)) for k, m in masks.items() for r, c in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "k int, r long, c long")


def masks():
    rng = np.random.default_rng(2)
    out = {0: rng.random((9, 13)) < 0.4, 1: np.repeat(rng.random((9, 4)) < 0.5, 3, 1), 2: np.ones((9, 12), bool), 3: np.zeros((9, 12), bool)}
    out[0], out[4] = out[0][:, :12], np.zeros((9, 12), bool)
    out[4][4] = True  # one whole row
    return out


def test_counts_are_those_of_pairs(spark):
    got = {(r["k"], r["dr"], r["d"]): r["n"] for r in C.pair_counts(frame(spark, masks()), ["k"], 9, 12, 4).collect()}
    for k, m in masks().items():
        for dr in range(5):
            for d in range(12):
                assert got.get((k, dr, d), 0) == int((m & np.roll(m, (-dr, -d), (0, 1))).sum())


def test_lengths_and_ranges_are_those_of_the_definition(spark):
    groups = spark.createDataFrame([(k,) for k in masks()], "k int")
    got = {r["k"]: r for r in C.two_point(frame(spark, masks()), groups, ["k"], 9, 12).collect()}
    assert set(got) == set(masks())
    for k, m in masks().items():
        f = m.mean()
        if f in (0, 1):
            assert tuple(got[k])[1:] == (0.0, 0.0, 1.0, 0.0)
            continue
        c = np.array([[((m & np.roll(m, (-a, -b), (0, 1))).mean() - f * f) / (f * (1 - f)) for b in range(12)] for a in range(9)])

        def length(line):
            for d, x in enumerate(line):
                if x < 1 / np.e:
                    return d - 1 + (line[d - 1] - 1 / np.e) / (line[d - 1] - x) if line[d - 1] != x else d
            return len(line)

        rings, sums = Counter(), Counter()
        for a in range(-2, 3):
            for b in range(-2, 3):
                rings[int(np.hypot(a, b))] += 1
                sums[int(np.hypot(a, b))] += c[a, b]
        end = next((k for k in sorted(rings) if k <= 2 and round(sums[k] / rings[k], 9) <= 0), 2)
        total = max(sum(s for k, s in sums.items() if k < end), 1)
        assert got[k]["length_h"] == pytest.approx(length(c[0, :6])) and got[k]["length_v"] == pytest.approx(length(c[:4, 0]))
        assert got[k]["integral_range"] == pytest.approx(total) and got[k]["se"] == pytest.approx(np.sqrt(f * (1 - f) * total / m.size))


def test_nothing(spark):
    none = frame(spark, {})
    assert C.two_point(none, none.select("k"), ["k"], 9, 12).count() == 0
