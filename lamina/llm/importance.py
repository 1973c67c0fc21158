"""Quality selection by importance resampling over hashed n-gram models.

Tokens are runs of word bytes or of other bytes between white space. Unigrams and bigrams are hashed into BUCKETS
buckets. The target model counts the n-grams of labelled documents of high quality that are not toxic; the raw
model counts those of all documents. A document's log weight is the sum over its n-grams of the log ratio of the
two smoothed models. Gumbel noise, a fixed function of seed and identifier, is added, and the documents with the
k largest sums are kept: a sample without replacement in proportion to the weights. k is the share of high quality
among the labelled documents times the number of documents, unless a share is given.

Target documents are at most TARGET_DOCS, chosen by a hash of the identifier; everything else covers all rows. The
k-th largest sum is found by counting in ever narrower ranges, so no task sorts more than a small part.

Results for unusual input: a text without tokens has weight 0; of rows that tie with the k-th in sum and
identifier all are kept; null identifiers share one noise value; without labels of both kinds every document is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import documents, id_key, small_arrow_batches, written
from lamina.llm.rolling import Ranges, mix

BUCKETS = 1 << 16
TARGET_DOCS = 100_000
SEED = 7
_SPACE, _WORD, _OTHER = 0, 1, 2
_KIND = np.array([_SPACE if b in (32, *range(9, 14)) else _WORD if chr(b).isalnum() and b < 128 or b >= 128 else _OTHER for b in range(256)], np.uint8)
#: Bytes that are hashed at once, but for a token that is longer; cuts lie between tokens.
PIECE = 1 << 20


def _cut(data: np.ndarray, at: int) -> int:
    """The last edge of a token within PIECE bytes from `at` on; if there is none, the first one after that."""
    reach = PIECE
    while at + reach < len(data):
        edges = np.flatnonzero(np.diff(_KIND[data[at : at + reach + 1]]))
        if len(edges):
            return at + 1 + int(edges[-1])
        reach *= 2
    return len(data)


def buckets(text: str | None, size: int = BUCKETS) -> np.ndarray:
    """The buckets of all unigrams and bigrams of the whole text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    parts, at = [], 0
    while at < len(data):
        end = _cut(data, at)
        piece = data[at:end]
        kind = _KIND[piece]
        edges = np.flatnonzero(np.diff(kind)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(piece)]])
        real = kind[starts] != _SPACE
        parts.append(Ranges(piece).hash(starts[real], ends[real]))
        at = end
    if not parts:
        return np.zeros(0, np.int64)
    one = np.concatenate(parts)
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    return (np.concatenate([one, two]) % np.uint64(size)).astype(np.int64)


def _spread(counts: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(counts)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "raw": pa.array(counts[used], pa.int64()), "target": pa.array(target[used], pa.int64())})


def ngram_counts(docs: DataFrame, size: int = BUCKETS) -> DataFrame:
    """`bucket, raw, target` over all rows of `docs` (text, is_target); each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for text, flag in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(buckets(text.as_py(), size), minlength=size)
                counts += own
                if flag:
                    target += own
        yield _spread(counts, target)

    own = docs.select(F.col("text").cast("string"), "is_target").mapInArrow(run, "bucket int, raw long, target long")
    return own.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket, smoothed by one; the buckets are a fixed number."""
    raw, target = np.ones(size), np.ones(size)
    for row in counts.collect():
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighed(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row_key, id, n_ngrams, log_weight` of every row."""
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = [buckets(t.as_py(), len(table)) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_ngrams": pa.array([len(x) for x in found], pa.int64()), "log_weight": pa.array([float(table[x].sum()) for x in found], pa.float64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_ngrams long, log_weight double")
    return rows.withColumn("row_key", id_key("id"))


def gumbel(key: str, seed: int = SEED):
    """Standard Gumbel noise as a function of the key."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def top_k(rows: DataFrame, k: int, bins: int = 1024, rounds: int = 4) -> DataFrame:
    """`rows` (row_key, key) with `kept`: the k largest by key, then by row_key. A few counts narrow the k-th
    down to a range of keys; only that range is sorted."""
    ends = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if k >= ends["n"]:
        return rows.withColumn("kept", F.lit(True))
    lo, hi, need = ends["lo"], math.nextafter(ends["hi"], math.inf), k
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    for _ in range(rounds):
        if not hi - lo > 1e-12 * max(1.0, abs(hi)):
            break
        inside = rows.where((F.col("key") >= lo) & (F.col("key") < hi))
        place = F.least(F.floor((F.col("key") - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("b")).collect()
        for c in counts:  # at most `bins`
            if need <= c["n"]:
                lo, hi, left = c["lo"], math.nextafter(c["hi"], math.inf), c["n"]
                break
            need -= c["n"]
        if left <= 10_000:
            break
    last = rows.where((F.col("key") >= lo) & (F.col("key") < hi)).select("key", "row_key").orderBy(F.desc("key"), F.desc("row_key")).limit(need)
    edge = last.agg(F.min(F.struct("key", "row_key")).alias("e")).first()["e"]
    kept = (F.col("key") > edge["key"]) | ((F.col("key") == edge["key"]) & (F.col("row_key") >= edge["row_key"]))
    return rows.withColumn("kept", kept)


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, target_docs: int = TARGET_DOCS, seed: int = SEED) -> DataFrame:
    """`id, n_ngrams, log_weight, key, kept` of every row of `docs` (doc_id, text)."""
    small_arrow_batches(docs.sparkSession)
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("good"), F.min("quality").alias("quality"))
    totals = judged.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("int")).alias("high")).first()
    if share is None:
        share = totals["high"] / totals["n"] if totals["n"] and 0 < totals["high"] < totals["n"] else 1.0
    chosen = written(judged.where("good = 1").orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(target_docs).select("doc_id", F.lit(True).alias("is_target")), "target-documents")
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left")  # target_docs rows at most
    ratios = log_ratios(ngram_counts(marked.select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))))
    rows = written(weighed(docs, ratios).withColumn("key", F.col("log_weight") + gumbel("row_key", seed)), "weights")
    return top_k(rows, round(share * rows.count())).drop("row_key")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.coalesce(F.try_divide(F.col("log_weight"), F.col("n_ngrams").cast("double")), F.lit(0.0))
    return out.select(F.col("id").alias("doc_id"), "n_ngrams", "log_weight", score.alias("score"), "kept")
