"""Source divergence audit by integer-dictionary encoding.

Texts are read once: a batch's terms become codes of the batch's own dictionary, pairs of document and code are counted,
and what is left, a row for each batch, group and term, is summed by Spark. A language keeps the terms that enough of its
documents have. Its kept terms are sorted and cut into chunks; a chunk's sorted terms are its dictionary, in which
`searchsorted` gives each term its number, so numbers follow the order of the UTF-8 bytes. A bincount over numbers gives
the chunk's dense vector of each source. Shares and their distances are whole numbers; sums over chunks give the
distance of two sources, and as a stable sort of values leaves numbers in order, ties fall to the smaller term.

A chunk has at most CHUNK_TERMS terms, and fewer where a language has so many sources that their vectors would pass CELLS
numbers. No task sees a whole language. Which sources a language has is joined to its chunks, so nothing is broadcast.

Results for unusual input: null and empty texts have no terms, but their group occurs; null languages and sources count as
''; a language without kept terms has value 0 for all pairs and no terms; repeated rows count as often as they occur;
identifiers are not looked at; ties go to the smaller UTF-8 item; texts of any length are read whole; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import ASCII_LOWER, ASCII_UPPER, documents, small_arrow_batches, written

#: Between terms: ASCII characters that are no letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCUMENTS = 10
TOP_TERMS = 10
CHUNK_TERMS = 4096
CELLS = 1 << 20
COUNTS = "lang string, source string, term string, n long, d long"
CHUNKED = "lang string, source string, term string, n long, chunk long"
PARTS = "lang string, source string, part string, item string, value long"


def batch_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> dict[str, pa.Array]:
    """Columns of COUNTS for the documents of a batch: occurrences and documents of each term in each group."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text.cast(pa.string())), GAP)
    coded = lists.flatten().dictionary_encode()
    code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    doc = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    term = code != pc.index(terms, "").as_py()  # parts beside a gap at an end are empty
    width = max(1, len(terms))
    held, times = np.unique(doc[term] * width + code[term], return_counts=True)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy(zero_copy_only=False)
    found, group = np.unique(group, return_inverse=True)
    key, place = np.unique(group[held // width] * width + held % width, return_inverse=True)
    of = found[key // width]
    return {
        "lang": langs.dictionary.take(pa.array(of // max(1, len(sources.dictionary)))),
        "source": sources.dictionary.take(pa.array(of % max(1, len(sources.dictionary)))),
        "term": terms.take(pa.array(key % width)),
        "n": pa.array(np.bincount(place, times, len(key)).astype(np.int64)),
        "d": pa.array(np.bincount(place, minlength=len(key)).astype(np.int64)),
    }


def kept_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """`lang, source, term, n`: occurrences of the terms that at least `min_documents` documents of the language have."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(batch_counts(*batch.columns))

    counted = docs.select("lang", "source", "text").mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    in_lang = F.sum("d").over(Window.partitionBy("lang", "term"))
    return counted.withColumn("documents", in_lang).where(F.col("documents") >= min_documents).select("lang", "source", "term", "n")


def _chunked(kept: DataFrame, chunk_terms: int) -> DataFrame:
    """`kept` with the number of its chunk; terms of one language and chunk are neighbours in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen, last = TaskContext.get().partitionId() << 32, -1, (None, None)
        for batch in batches:
            if not len(batch):
                continue
            lang, term = batch.column(0), batch.column(2)
            new = np.ones(len(batch), bool)
            new[0] = (lang[0].as_py(), term[0].as_py()) != last
            new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            number = seen + np.cumsum(new)
            seen, last = int(number[-1]), (lang[-1].as_py(), term[-1].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + number // chunk_terms)], names=["lang", "source", "term", "n", "chunk"])

    return kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, CHUNKED)


def shares(counts: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)), by long division in three digits of 1000, so that no
    product passes 64 bits."""
    divisor = total + 2 * vocabulary
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, divisor)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(key: tuple, rows: pa.Table) -> pa.Table:
    """What one chunk gives: for each two sources their distance over its terms, for each source its best terms."""
    lang = key[0].as_py()
    marks = rows.filter(pc.is_null(rows["term"])).sort_by("source")
    rows = rows.filter(pc.is_valid(rows["term"]))
    sources = np.array(marks["source"].to_pylist(), object)
    totals, vocabulary = marks["total"].to_numpy()[:, None], marks["vocabulary"][0].as_py()
    coded = rows["term"].combine_chunks().dictionary_encode()
    distinct = np.array(coded.dictionary.to_pylist(), object)
    terms = np.sort(distinct)
    number = np.searchsorted(terms, distinct)[coded.indices.to_numpy()]
    owner = np.searchsorted(sources, np.array(rows["source"].to_pylist(), object))
    counts = np.bincount(owner * len(terms) + number, rows["n"].to_numpy(), len(sources) * len(terms)).astype(np.int64).reshape(len(sources), -1)
    p, q = shares(counts, totals, vocabulary), shares(counts.sum(0), totals.sum(), vocabulary)
    out: list[tuple] = []
    for i, source in enumerate(sources):
        values = distance(p[i], p[i + 1 :]).sum(1)
        out += [(lang, source, "pair", other, v) for other, v in zip(sources[i + 1 :], values.tolist(), strict=True)]
        more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        values = distance(p[i, more], q[more])
        best = np.argsort(-values, kind="stable")[:TOP_TERMS]
        out += [(lang, source, "term", terms[k], v) for k, v in zip(more[best], values[best].tolist(), strict=True)]
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.table([pa.array(x, k) for x, k in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, chunk_terms: int = CHUNK_TERMS, cells: int = CELLS) -> DataFrame:
    """`lang, source, part, item, value, rank` of every group of `docs` (lang, source, text)."""
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = written(kept_counts(plain, min_documents), "kept-counts")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary")), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunked = written(_chunked(kept, max(1, min(chunk_terms, cells // most))), "chunked-counts")
    marks = chunked.select("lang", "chunk").distinct().join(groups, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "chunk", "total", "vocabulary")
    rows = chunked.withColumns({"total": F.lit(None).cast("long"), "vocabulary": F.lit(None).cast("long")}).unionByName(marks)
    parts = written(rows.groupBy("lang", "chunk").applyInArrow(_compared, PARTS), "parts")

    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "value", ways.alias("way")).select("lang", "way.*", "value")
    bare = groups.where("vocabulary = 0").select("lang", "source")  # no chunk tells of these
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    both = pairs.unionByName(none).withColumn("part", F.lit("pair")).unionByName(parts.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS)).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


#: Written from the definition: dense joins of groups with kept terms.
OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
share AS (SELECT lang, source, term, n, (1 + {SCALE}::HUGEINT * (n + 2) // (total + 2 * v))::HUGEINT AS p,
    (1 + {SCALE}::HUGEINT * (lang_n + 2) // (lang_total + 2 * v))::HUGEINT AS q FROM dense),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM share WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
