import re

"""The pipeline stage by stage against brute force over what the stage before kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from lamina.llm import quality_rules, secret_scans, simhash
from tests.oracle import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_carry_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(7) for c in ("kept", "n_words", "base_spans", "digest", "rule", "fp", "all_spans")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where("kept = 7 AND n_words = 7 AND base_spans = 7 AND digest = 7 AND rule = 7 AND fp = 7").count() == out.count() > 0


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def smallest_of_components(rows):
    """By the stage's rule, pair by pair: linked at 3 bits or a five-word similarity of 0.8, the smallest identifier stays."""
    sets, prints = {}, {}
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        prints[r["doc_id"]] = simhash.fingerprint(r["text"]) % 2**64
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 3)]
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {i for i in label if label[i] == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        if name != "best-fit packing":
            assert docs.columns == COLUMNS
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0")
    clean = {r["doc_id"] for r in labels.collect()}
    measured = quality_rules.measure(spark.read.parquet(f"{SF}/documents.parquet"))
    failed = {r["doc_id"] for r in measured.where(quality_rules.base_failed()).collect()}
    first = {r["doc_id"] for r in kept["quality rules"]}
    assert not first & failed and clean - failed <= first
    texts = {}
    for r in kept["quality rules"]:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        texts[key] = max(texts.get(key, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in kept["exact dedup"]} == set(texts.values())
    stay = {r["doc_id"] for r in kept["simhash near-dedup"]}
    assert stay == smallest_of_components(kept["exact dedup"])
    assert {r["doc_id"] for r in kept["secret scans"]} == stay
    after = secret_scans.scan(spark.createDataFrame(kept["secret scans"], ", ".join(["doc_id long, text string, lang string, source string, n_chars long"])))
    assert after.where(F.size("base_spans") > 0).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in kept["secret scans"] if "[SECRET]" in (r["text"] or ""))
    assert {r["doc_id"] for r in kept["best-fit packing"]} == stay
