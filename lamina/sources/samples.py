"""Discovery of samples in a file tree, from Spark's file listing: names are parsed, channels grouped, conflicts
raised, and contents fingerprinted without collecting anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The form of a channel's file name, of a batch folder, and folders whose batch is unknown.
FILE = r"(?i)^(?:batch_([0-9])_)?img_([a-z0-9]+)_(bse|etd|se|inlens)\.tiff?$"
BATCH = r"(?i)batch[\s_-]*([0-9])"
UNKNOWN_FOLDERS = ["test", "batch_unknown", "unknown"]
CHANNELS = ["BSE", "ETD", "Inlens"]


def parse_name(name: Column) -> dict[str, Column]:
    """Prefix batch, sample, channel and whether the secondary-electron channel stands for ETD; null unless the name
    has the form of a channel's file."""
    is_channel = F.rlike(name, F.lit(FILE))
    det = F.lower(F.regexp_extract(name, FILE, 3))
    prefix = F.regexp_extract(name, FILE, 1)
    return {
        "prefix_batch": F.when(is_channel & (prefix != ""), prefix),
        "sample_id": F.when(is_channel, F.concat(F.lit("img_"), F.lower(F.regexp_extract(name, FILE, 2)))),
        "channel": F.when(is_channel, F.when(det == "bse", "BSE").when(det == "inlens", "Inlens").otherwise("ETD")),
        "etd_is_se": F.when(is_channel, det == "se"),
    }


def batch_of(folders: Column) -> Column:
    """The batch of the closest folder that names one, of an array of folders from the root down."""
    named = F.filter(F.transform(folders, lambda f: F.regexp_extract(f, BATCH, 1)), lambda b: b != "")
    return F.coalesce(F.element_at(F.when(F.size(named) > 0, named), -1), F.lit("unknown"))


def parsed(paths: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """`paths` with the parts of the name and `batch`; rows that are no channel files are left out. A name whose prefix
    contradicts its folder raises an error."""
    inner = F.when(F.startswith(F.col(path), F.lit(root)), F.substring(F.col(path), len(root) + 1, 1 << 20)).otherwise(F.col(path)) if root else F.col(path)
    parts = F.split(inner, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    # The root's own name counts as the outermost folder for the batch, but not as a folder of unknown batch.
    named = F.concat(F.array(F.lit(root.rstrip("/").rsplit("/", 1)[-1])), folders)
    out = paths.withColumns(parse_name(F.element_at(parts, -1))).where("sample_id IS NOT NULL")
    hidden = F.exists(folders, lambda f: F.lower(f).isin(UNKNOWN_FOLDERS))
    out = out.withColumn("batch", F.when(hidden, "unknown").otherwise(batch_of(named)))
    clash = F.col("prefix_batch").isNotNull() & (F.col("batch") != "unknown") & (F.col("prefix_batch") != F.col("batch"))
    said = F.concat(F.col(path), F.lit(": the name's batch is "), F.col("prefix_batch"), F.lit(", the folder's is "), F.col("batch"))
    return out.withColumn("batch", F.when(clash, F.raise_error(said)).otherwise(F.col("batch")))


def group(files: DataFrame, path: str = "path") -> DataFrame:
    """A row for each sample with a BSE file: `sample_id, batch, paths` (by channel, the first path in order wins),
    `n_duplicates, complete, etd_is_se, has_prefix`; ordered output is left to the reader."""
    first = Window.partitionBy("sample_id", "channel").orderBy(path)
    ranked = files.withColumn("__n", F.row_number().over(first))
    own = F.when(F.col("__n") == 1, F.struct("channel", F.col(path).alias("path")))
    out = ranked.groupBy("sample_id").agg(
        F.min_by("batch", path).alias("batch"),
        F.map_from_entries(F.collect_list(own)).alias("paths"),
        F.count(F.when(F.col("__n") > 1, 1)).alias("n_duplicates"),
        F.max(F.when(F.col("__n") == 1, F.col("etd_is_se"))).alias("etd_is_se"),
        F.max(F.col("prefix_batch").isNotNull()).alias("has_prefix"),
    )
    return out.where(F.col("paths")["BSE"].isNotNull()).withColumn("complete", F.size("paths") == len(CHANNELS))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of a file tree. Only the listing is used: contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][iI][fF]*").load(folder).select("path", "length")
    root = listing.select(F.regexp_extract(F.min("path"), "^[a-z]+:/*", 0)).first()[0] if not listing.isEmpty() else ""
    base = (root + folder.split(":", 1)[-1].strip("/") + "/") if root else folder
    return group(parsed(listing, "path", base))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """`sample_id, fingerprint`: twelve hexadecimal digits over the contents of a sample's channels in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    own = parsed(files.select("path", F.sha1("content").alias("sha")), "path")
    first = Window.partitionBy("sample_id", "channel").orderBy("path")
    kept = own.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return fingerprint(kept)


def fingerprint(channels: DataFrame) -> DataFrame:
    """`sample_id, fingerprint` of the digests `sample_id, channel, sha`, a row for each channel."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel", "sha"))), lambda x: F.concat_ws(":", x["channel"], x["sha"])), ",")
    return channels.groupBy("sample_id").agg(F.substring(F.sha1(joined), 1, 12).alias("fingerprint"))


def manifest_sizes(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """`title, size_bytes, length, ok` of a manifest (title, size_bytes) against a listing (path, length)."""
    there = listing.select(F.element_at(F.split("path", "/"), -1).alias("title"), "length")
    return manifest.select("title", "size_bytes").join(there, "title", "left").withColumn("ok", F.coalesce(F.col("size_bytes") == F.col("length"), F.lit(False)))
