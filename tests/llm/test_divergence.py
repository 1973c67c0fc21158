import re
from collections import Counter, defaultdict

import pytest

from lamina.llm import divergence
from tests.oracle import same

COLUMNS = "doc_id long, text string, lang string, source string, n long, term string"


def brute(rows, min_documents=10):
    """The contract, term by term."""
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        held[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang in held:
        kept = {t for t, n in held[lang].items() if n >= min_documents}
        groups = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}

        def p(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        q = p({t: sum(g[t] for g in groups.values()) for t in kept})
        shares = {s: p(g) for s, g in groups.items()}
        for s in groups:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(shares[s][t], q[t])) for t in kept if groups[s][t] and shares[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= 10]
    return sorted(out)


def hostile():
    words = ["Apple", "ÄPFEL", "apple", "b", "b1c", "naïve x", "日本", "😀", "z\x00y", "[tie]", "_tie2_"]
    rows = []
    for k in range(240):
        text = " ".join(words[(k * j + j) % len(words)] for j in range(k % 9))
        rows.append((k, text, ["en", "fr", None, "none"][k % 4], ["a", "b", None, "é", "Z"][k % 5], k, "own"))
    rows += [(7, None, "en", "silent", 0, None), (None, "", "mute", "x", 0, None), (8, "once", "mute", "y", 0, None)]
    rows += [(9, "big " * 30_000 + "apple", "en", "a", 0, None)] * 12
    return rows


@pytest.mark.parametrize(("min_documents", "chunk_terms", "cells"), [(10, 4096, 1 << 20), (2, 2, 1 << 20), (3, 4096, 5)])
def test_audit_is_the_contract(spark, min_documents, chunk_terms, cells):
    rows = hostile()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = divergence.audit(docs, min_documents, chunk_terms, cells).collect()
    assert sorted(map(tuple, got)) == brute(rows, min_documents)


def test_empty(spark):
    got = divergence.audit(spark.createDataFrame([], COLUMNS))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


def test_large_numbers():
    import numpy as np

    counts, total = np.array([[0, 1, 3 * 10**12, 10**13]]), np.array([[4 * 10**13 + 7]])
    want = [1 + 10**9 * (c + 2) // (4 * 10**13 + 7 + 2 * 10**9) for c in counts[0].tolist()]
    assert divergence.shares(counts, total, 10**9)[0].tolist() == want


def test_query_matches_sql(spark):
    same(spark, divergence.op11_source_divergence, divergence.OP11_SQL)
