"""Components of links: smallest reachable node, and edges that are carried over instead of joined anew in each round."""

import random

from lamina.llm import simhash as H


def brute(edges):
    label = {n: n for e in edges for n in e}
    while True:
        new = {n: min([label[n], *(label[b if a == n else a] for a, b in edges if n in (a, b))]) for n in label}
        if new == label:
            return label
        label = new


def test_components(spark):
    path = [(k, k + 1) for k in range(200, 260)]
    star = [(500, k) for k in range(501, 560)]
    rng = random.Random(1)
    web = [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    edges = [*path, *star, *web, (7, 7), (-3, 9)]
    got = {r["node"]: r["label"] for r in H.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)
    assert H.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_shrink(spark, monkeypatch):
    """What later rounds read is far less than the first: a group of copies costs its links once."""
    sizes = []
    kept = H.written

    def written(df, name, *args):
        out = kept(df, name, *args)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(H, "written", written)
    edges = [(a, b) for a in range(40) for b in range(a)] + [(k, k + 1) for k in range(100, 160)]
    H.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(sizes) > 1 and sum(sizes[1:]) < sizes[0] / 2
