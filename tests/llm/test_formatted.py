"""The columns that the thin queries format, on hostile rows, and queries on an empty table."""

import hashlib
import re

import pytest

from lamina.llm import catalog, simhash
from tests.llm.test_operators import fingerprint

ROWS = [
    (1, "password = 'hunter2xyz' and token: abc"), (2, "AKIA" + "A1" * 9 + " under the MIT license"), (3, None), (None, ""), (4, " \n "),
    (5, "😀 secret=\"abcdef\" 0123456789abcdef0123456789 Apache License, Version 2 cc by nc"), (6, "under the mit license " * 3), (6, "under the mit license " * 3),
    (7, "one two three four five six"), (8, "ONE TWO THREE four five six"), (9, "passwd:x api_key = ABCDEFGH apikey:zzzzzz"), (10, "word " * 3000),
]


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hostile"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ROWS], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{folder}-none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}-none/labels.parquet")
    return folder


def key(r):
    return str(r)


def test_simhash(spark, hostile):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in catalog.queries()["op4_simhash"](spark, hostile).collect()), key=key)
    prints = [(i, fingerprint(t) % 2**64) for i, t in ROWS]
    label = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= simhash.MAX_BITS:
                    label[a] = label[b] = min(label[a], label[b])
    least = {k: min((i for (i, _), x in zip(prints, label, strict=True) if x == k and i is not None), default=None) for k in label}
    null = {k for (i, _), k in zip(prints, label, strict=True) if i is None}  # a null identifier ranks below all others
    assert got == sorted(((i, f"{p:016x}", None if k in null else least[k]) for (i, p), k in zip(prints, label, strict=True)), key=key)


def test_secret_scans(spark, hostile):
    kinds = [
        ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in catalog.queries()["op5_secret_scans"](spark, hostile).collect()), key=key)
    want = []
    for i, text in ROWS:
        found = [(m.start(), k, name, m.end()) for k, (name, pattern, keep) in enumerate(kinds) for m in re.finditer(pattern, text or "") if keep(m)]
        joined = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))
        want.append((i, *[sum(k == n for _, n, *_ in found) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want, key=key)


def test_license_scans(spark, hostile):
    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in catalog.queries()["op10_license_scans"](spark, hostile).collect()), key=key)
    want = []
    for i, text in ROWS:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in phrases for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_table(spark, hostile, name):
    assert catalog.queries()[name](spark, f"{hostile}-none").count() == 0
