"""Exact deduplication against a persistent digest index.

The index is a table in the shared folder, bucketed and sorted by digest. New data is reduced to digests, aggregated
map-side and deduplicated by a sort-merge anti-join with the index; digests that the index lacks are appended with a
mark, those that it has are appended as further sightings of a known text, so a text's largest identifier and number
of rows stay right however many batches add to it. Only digests (32 bytes) are shuffled, never texts, and the index
itself is never shuffled: both joins and the sums over sightings work on its buckets.

An index outlives the session: a `DigestIndex` at the same place opens it again. The functions that get none make one
for the call, add their rows in BATCHES batches, and remove it in the end.

Results for unusual input: a null text equals an empty one; rows that repeat their group's largest identifier are all
marked as kept, as the identifier can't tell them apart; a null identifier ranks below all others and can
stay only if its whole group has none; of rows that repeat identifier and text, `drop_duplicates` keeps the one whose
columns have the smallest hash; an empty table gives an empty result; other columns, whatever their names, are
ignored by the index and carried by `drop_duplicates`.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lamina.llm.common import LOWEST_ID, ascii_lower, id_key, packed_row, scratch_path, text_of, written

#: Groups above this share of all rows are joined by broadcast: there are at most HOT_GROUPS of them.
HOT_GROUPS = 1000
#: Batches in which a call without an index of its own adds its rows.
BATCHES = 2
LAYOUT = "digest binary, keep_key long, group_size long, is_new boolean, batch string"


def digest_of(text_col: str = "text"):
    return F.unhex(F.sha2(ascii_lower(text_of(text_col)).cast("binary"), 256))


class DigestIndex:
    """Sightings of every text added so far, in `buckets` sorted buckets: `digest, keep_key, group_size` of each text
    in each batch, `is_new` in the first batch that had it. `path` is its place, of an index that exists or is to be."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        try:
            self.buckets = spark.read.parquet(f"{self.path}/layout").first()["buckets"]
        except AnalysisException:  # no index there
            self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/layout")
        # The catalog gives Spark the buckets; the rows are at `path` and stay when the name goes.
        self.name = f"lamina_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({LAYOUT}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def sightings(self) -> DataFrame:
        return self.spark.table(self.name)

    def table(self) -> DataFrame:
        """`digest, keep_key, group_size` of every text as the first batch that had it left it."""
        return self.sightings().where("is_new").select("digest", "keep_key", "group_size")

    def groups(self) -> DataFrame:
        """`digest, keep_key, group_size` of every text over all batches, without a shuffle."""
        return self.sightings().groupBy("digest").agg(F.max("keep_key").alias("keep_key"), F.sum("group_size").alias("group_size"))

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of `groups` whose digest the index lacks."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def seen(self, groups: DataFrame) -> DataFrame:
        """Rows of `groups` whose digest the index has."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_semi")

    def add(self, digests: DataFrame) -> str:
        """Adds the rows of `digests` (digest, row_key) as one batch, whose name it returns."""
        batch = uuid.uuid4().hex
        groups = digests.groupBy("digest").agg(F.max("row_key").alias("keep_key"), F.count(F.lit(1)).alias("group_size"))
        both = self.unseen(groups).withColumn("is_new", F.lit(True)).unionByName(self.seen(groups).withColumn("is_new", F.lit(False)))
        # Written aside first: an index can't be read and appended to by one job.
        staged = written(both.select("digest", "keep_key", "group_size", "is_new", F.lit(batch).alias("batch")), "batch")
        (
            staged.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .option("compression", "zstd")
            .option("path", f"{self.path}/rows")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )
        return batch

    def close(self) -> None:
        """Takes the name out of the session's catalog; the index stays in its place."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def remove(self) -> None:
        """Takes the index away, name and rows."""
        self.close()
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, row_key, digest` of every row, written once so that texts are hashed once."""
    return written(docs.select(F.col(id_col).alias("id"), id_key(id_col).alias("row_key"), digest_of(text_col).alias("digest")), "digests")


def _add_in_batches(index: DigestIndex, rows: DataFrame, batches: int) -> None:
    """Every row is in exactly one batch, by a hash of its identifier."""
    for k in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("row_key"), F.lit(batches)) == k))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Every row's group: `id, row_key, digest, keep_key, group_size`. With an `index` that earlier calls added to,
    groups are those over all that was added, and the rows become a further batch of it."""
    rows = digests_of(docs, id_col, text_col)
    if index is not None:
        index.add(rows)
        return _joined(rows, index.groups())
    index = DigestIndex(docs.sparkSession)
    _add_in_batches(index, rows, BATCHES)
    out = written(_joined(rows, index.groups()), "annotated")
    index.remove()
    return out


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    # A digest with more than n / HOT_GROUPS of the n rows is one of fewer than HOT_GROUPS, so that many may be
    # broadcast whatever n is; the rest meet in groups of a bounded share.
    floor = max(1000, rows.count() // HOT_GROUPS)
    inside = rows.groupBy("digest").count().where(F.col("count") > floor).select("digest")
    hot = written(inside.limit(HOT_GROUPS), "hot-digests")
    cold = rows.join(F.broadcast(hot), "digest", "left_anti").join(groups.hint("merge"), "digest")
    warm = groups.join(F.broadcast(hot), "digest", "left_semi")
    return cold.unionByName(rows.join(F.broadcast(warm), "digest")).select("id", "row_key", "digest", "keep_key", "group_size")


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType)


def _row_hash(docs: DataFrame) -> Column:
    """Of all columns that Spark can hash, so that the choice among rows does not depend on their order."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if _hashable(f.dataType)])


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose text no row with a larger identifier has. With an `index`, rows whose
    text an earlier batch had go too, and the rows become a further batch of it."""
    rows = digests_of(docs, id_col, text_col)
    if index is None:
        own = DigestIndex(docs.sparkSession)
        _add_in_batches(own, rows, BATCHES)
        kept = written(own.groups().select("digest", "keep_key"), "kept-digests")
        own.remove()
    else:
        batch = index.add(rows)
        kept = index.sightings().where(F.col("is_new") & (F.col("batch") == batch)).select("digest", "keep_key")
    keyed = docs.select(packed_row(docs), digest_of(text_col).alias("digest"), id_key(id_col).alias("keep_key"), _row_hash(docs).alias("order"))
    # Both keys together: the copies of a frequent text spread over all partitions. Rows that repeat identifier
    # and text are the only ones left to choose from, on the partitioning of the join.
    first = Window.partitionBy("digest", "keep_key").orderBy("order")
    found = keyed.join(kept.hint("merge"), ["digest", "keep_key"])
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keep = F.when(F.col("keep_key") != F.lit(LOWEST_ID), F.col("keep_key"))
    return annotate(docs).select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_key") == F.col("keep_key")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
