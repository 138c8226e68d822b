"""The chunk cache: hits, misses, storing, surgical updates.

Validity is decided on narrow rows (path, hash, chunk count); the arrays of chunks travel only for hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import latex as lx

KEY = ["paper_id", "rel_path"]
SCHEMA = "tex string, src_hash string, chunks array<string>"


def file_keys(sources: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """(paper_id, rel_path, src_hash, cache_key, n_chunks) of each source."""
    counts = chunk_rows.groupBy(*KEY).agg(F.count("*").alias("n_chunks"))
    hashes = sources.select(*KEY, lx.content_hash("content").alias("src_hash"), lx.cache_key("rel_path").alias("cache_key"))
    return hashes.join(counts, KEY, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose cached chunks have the same source hash and number."""
    narrow = cache.select(*KEY, "src_hash", F.size("chunks").cast("long").alias("n_chunks"))
    return files.join(narrow.distinct(), [*KEY, "src_hash", "n_chunks"], "left_semi")


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that still have to be translated."""
    narrow = cache.select(*KEY, "src_hash", F.size("chunks").cast("long").alias("n_chunks"))
    return files.join(narrow, [*KEY, "src_hash", "n_chunks"], "left_anti")


def _age(cache: DataFrame) -> list[str]:
    """What orders rows of one file: the later one counts."""
    return [c for c in ("version", "src_hash", "chunks") if c in cache.columns]


def fitting(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached row of each file that has its source hash and number of chunks: one, of several the one of the last version.

    A cache may hold many versions of a file; `version` (or, without it, the chunks themselves) orders rows of one hash.
    """
    rest = [c for c in cache.columns if c not in (*KEY, "src_hash")]
    one = _last(cache, F.struct(*rest)).select(*KEY, "src_hash", "_row.*")
    return one.join(files.select(*KEY, "src_hash", F.col("n_chunks").alias("_n")), [*KEY, "src_hash"]).where(F.size("chunks") == F.col("_n")).select(*cache.columns)


def _last(cache: DataFrame, row: Column) -> DataFrame:
    return cache.groupBy(*KEY, "src_hash").agg(F.max_by(row, F.struct(*_age(cache))).alias("_row"))


def with_cached(file_rows: DataFrame, cache: DataFrame) -> DataFrame:
    """File rows with `cached`: the chunks of the row that `fitting` finds, or null."""
    rows = file_rows.join(_last(cache, F.col("chunks")), [*KEY, "src_hash"], "left")
    return rows.withColumn("cached", F.when(F.size("_row") == F.col("n_chunks"), F.col("_row"))).drop("_row")


def comparable(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached row of each file to compare it with: of those with its number of chunks the one of its hash, else the last."""
    fits = cache.join(files.select(*KEY, F.col("src_hash").alias("_hash"), F.col("n_chunks").alias("_n")), KEY).where(F.size("chunks") == F.col("_n"))
    best = F.struct((F.col("src_hash") == F.col("_hash")).alias("same"), *_age(cache))
    return fits.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in cache.columns if c not in KEY]), best).alias("_row")).select(*KEY, "_row.*").select(*cache.columns)


def cached_chunks(cache: DataFrame) -> DataFrame:
    """One row (…, chunk_idx, translated) per cached chunk."""
    return cache.select(*KEY, F.posexplode("chunks").alias("chunk_idx", "translated"))


def paired(chunk_rows: DataFrame, translations: DataFrame) -> DataFrame:
    """Chunks with their translation by position; a missing one is the original."""
    t = translations.select(*KEY, "chunk_idx", "translated")
    return chunk_rows.join(t, [*KEY, "chunk_idx"], "left").withColumn("final", F.coalesce("translated", "text"))


def to_store(files: DataFrame, translations: DataFrame) -> DataFrame:
    """Cache rows of the files of which no chunk failed."""
    done = translations.groupBy(*KEY).agg(
        F.count_if(F.col("translated").isNull()).alias("n_failed"),
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "translated"))), lambda x: x["translated"]).alias("chunks"),
    )
    return files.join(done.where("n_failed = 0"), KEY).select(*KEY, "cache_key", "src_hash", "chunks")


def rows_to_store(translated: DataFrame) -> DataFrame:
    """`to_store` of file rows with `translated`."""
    done = translated.where((F.size("translated") > 0) & ~F.exists("translated", lambda t: t.isNull()))
    return done.select(*KEY, lx.cache_key("rel_path").alias("cache_key"), "src_hash", F.col("translated").alias("chunks"))


def without(cache: DataFrame, rel_path: str | None = None) -> DataFrame:
    """The cache without one file, or empty."""
    return cache.where(F.col("rel_path") != rel_path) if rel_path is not None else cache.limit(0)


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    return cache.join(new, KEY, "left_anti").unionByName(new)


def read_json(spark: SparkSession, root: str) -> DataFrame:
    """(paper_id, rel_path, cache_key, src_hash, chunks) of the cache files (`….json`, one object each) below the papers' folders in `root`.

    What can't be read has a null path and hash and never hits.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    paper = F.split(lx.below(F.input_file_name(), root), "/")
    return raw.select(F.get(paper, F.lit(0)).alias("paper_id"), F.col("tex").alias("rel_path"), lx.cache_key("tex").alias("cache_key"), "src_hash", "chunks")


def replaced(cache: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The cache with some chunks replaced; a null replacement leaves the old chunk, hashes stay.

    With a column `src_hash`, replacements are of that version of the file only.
    """
    key = [*KEY, "src_hash"] if "src_hash" in new_chunks.columns else KEY
    change = new_chunks.where("translated is not null").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("chunk_idx", "translated"))).alias("_new"))
    chunks = F.transform("chunks", lambda t, i: F.coalesce(F.try_element_at(F.col("_new"), i), t))
    joined = cache.join(change, key, "left")
    return joined.withColumn("chunks", F.when(F.col("_new").isNull(), F.col("chunks")).otherwise(chunks)).select(*cache.columns)


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached files whose chunk count or source hash no longer fits; of several versions the last one is looked at."""
    if "version" in cache.columns:
        cache = cache.groupBy(*KEY).agg(F.max_by(F.struct("src_hash", "chunks"), F.struct(*_age(cache))).alias("_row")).select(*KEY, "_row.*")
    c = cache.select(*KEY, F.col("src_hash").alias("cached_hash"), F.size("chunks").cast("long").alias("n_cached"))
    return files.join(c, KEY).where((F.col("n_chunks") != F.col("n_cached")) | (F.col("src_hash") != F.col("cached_hash"))).select(
        *KEY, "n_chunks", "n_cached", (F.col("src_hash") != F.col("cached_hash")).alias("hash_differs")
    )
