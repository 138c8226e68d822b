"""Whole jobs over corpora of papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.functions import latex as lx
from texloom.operators import audit, cache, merge, repair, segment, tasks, terms, translate
from texloom.plans.held import held, held_by
from texloom.sources import latex as src
from texloom.sources.chunk_store import ChunkStore, exists, joined_by_bucket
from texloom.streaming import progress

KEY = ["paper_id", "rel_path"]


def translate_corpus(
    sources: DataFrame, cached: DataFrame, factory: Callable[[], translate.Translator], *, glossaries: DataFrame | None = None, max_tokens: int = 1024,
    pace: translate.Pace = translate.Pace(calls_per_second=0), with_glossary: bool = True, hold: Callable[[DataFrame, str], DataFrame] = held, buckets: int | None = None,
) -> dict[str, DataFrame]:
    """Segments, cache join, glossary, translation, repair and merge.

    `sources` holds each file once. `cached` may hold many versions of a file; the one of the file's hash and number of chunks is used.
    `glossaries` (paper_id, paper_hash, rank, term, target) is the store of glossaries; those of unchanged papers are used again.
    `hold` fixes what mustn't be computed twice (paid translations). Returns nodes, finished, merged,
    cache and glossary (rows to store), results, stats.

    A file stays one row, with its nodes and chunks in it. Texts and cached chunks are shuffled once, by paper, to meet, and lie in
    as many buckets of papers as the session has shuffle partitions; terms are counted and prompts come to the files there.
    `buckets`: `cached` lies in so many buckets of papers already, as a `ChunkStore` does, and isn't shuffled.
    """
    spark = sources.sparkSession
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cached = cached.repartition(buckets, "paper_id")
    with joined_by_bucket(spark):
        apart = segment.file_rows(sources, max_tokens).repartition(buckets, "paper_id")
        main = src.main_file(sources).select(*KEY, F.lit(True).alias("is_main"))
        files = held_by(cache.with_cached(apart, cached).join(main, KEY, "left"), "files", "paper_id", buckets)
        ready, todo = files.where("cached is not null"), files.where("cached is null").drop("cached")
        prompts, fresh = None, None
        if with_glossary:
            asked, stored, texts = terms.paper_hashes(files), None, segment.chunk_rows(todo)
            if glossaries is not None:
                stored = glossaries.join(asked, ["paper_id", "paper_hash"], "left_semi")
                asked = terms.without_glossary(asked, stored)
                texts = texts.join(asked, "paper_id", "left_semi")
            top = hold(terms.top_terms(texts, "paper_id", ["rel_path", "chunk_idx"]), "terms")
            fresh = hold(translate.build_glossary(top, factory, pace=pace).join(asked, "paper_id"), "glossary")
            every = fresh if stored is None else fresh.unionByName(stored.select(*fresh.columns))
            prompts = terms.glossary_prompts(every)
        asking = todo.withColumn("prompt", F.lit("")) if prompts is None else todo.join(prompts, "paper_id", "left")
        paid = hold(translate.translate_rows(asking, factory, pace=pace), "paid")
    rows = ready.withColumnRenamed("cached", "translated").unionByName(paid)
    whole = merge.merged_rows(rows).select(*KEY, F.when(F.col("is_main"), lx.with_cjk_preamble("merged")).otherwise(F.col("merged")).alias("merged"))
    finished = merge.finished_rows(rows)
    return {
        "nodes": segment.explode_nodes(segment.with_texts(files)), "finished": finished, "merged": whole, "results": segment.chunk_rows(paid, "translated"),
        "stats": merge.segment_stats(finished), "cache": cache.rows_to_store(paid), "glossary": fresh,
    }


def last_versions(sources: DataFrame) -> DataFrame:
    """Each file once: the row of the greatest `version`, where there is such a column, else of the greatest content hash."""
    own = [c for c in sources.columns if c not in KEY]
    order = F.struct(*(["version"] if "version" in own else []), lx.content_hash("content"))
    return sources.groupBy(*KEY).agg(F.max_by(F.struct(*own), order).alias("_row")).select(*KEY, "_row.content")


def resume(sources: DataFrame, store: str, factory: Callable[[], translate.Translator], checkpoint: str, *, compact_every: int = 0, **options):
    """Translate a stream of sources as they come, until it is used up; run it again to go on.

    `store` holds a `ChunkStore`: a batch reads the buckets of its own papers and skips what a version there fits, and writes
    its own version, so a repeated batch overwrites itself. Of several versions of a file in one batch the last counts (see
    `last_versions`). Files of which a chunk failed are open and are tried again with the next batch. With `compact_every`,
    every so many batches only the last version of each file is kept.
    """
    spark, kind = sources.sparkSession, sources.schema["paper_id"].dataType
    chunks = ChunkStore(spark, f"{store}/cache", kind)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        came = held(last_versions(batch), "came")
        before = f"{store}/open/batch={number - 1}"
        left = session.read.schema(came.schema).parquet(before) if number and exists(session, before) else came.limit(0)
        todo = held(came.unionByName(left.join(came, KEY, "left_anti")), "todo")
        with joined_by_bucket(session):
            done = translate_corpus(todo, chunks.read(todo, before=number), factory, **{"buckets": chunks.buckets, **options})
            chunks.put(done["cache"], number)
            done["merged"].write.mode("overwrite").parquet(f"{store}/merged/batch={number}")
            hashed = todo.withColumn("src_hash", lx.content_hash("content"))
            kept = chunks.read(todo, before=number + 1).select(*KEY, "src_hash").distinct()
            hashed.join(kept, [*KEY, "src_hash"], "left_anti").drop("src_hash").write.mode("overwrite").parquet(f"{store}/open/batch={number}")
        if compact_every and number % compact_every == compact_every - 1:
            chunks.compact()

    return progress.run_batches(sources, step, checkpoint)


def chunk_pairs(
    sources: DataFrame, cached: DataFrame, max_tokens: int = 1024, hold: Callable[[DataFrame, str], DataFrame] = held
) -> tuple[DataFrame, DataFrame]:
    """(pairs of chunk and cached chunk where the counts agree, stale files)."""
    chunk_rows = hold(segment.chunks(segment.nodes(sources), max_tokens), "chunks")
    files = cache.file_keys(sources, chunk_rows)
    fit = cache.comparable(files, cached)
    theirs = fit.select(*KEY, "src_hash", F.posexplode("chunks").alias("chunk_idx", "translated"))
    return chunk_rows.join(theirs, [*KEY, "chunk_idx"]), cache.stale(files, cached)


def retranslate(sources: DataFrame, cached: DataFrame, factory: Callable[[], translate.Translator], pace: translate.Pace = translate.Pace(calls_per_second=0)) -> DataFrame:
    """The cache with the chunks replaced that needed translation and got one."""
    pairs, _ = chunk_pairs(sources, cached)
    targets = audit.targets(pairs)
    new = translate.translate(targets, factory, pace=pace)
    return cache.replaced(cached, new.join(targets.select(*KEY, "chunk_idx", "src_hash"), [*KEY, "chunk_idx"]))


def revert_on_errors(node_rows: DataFrame, translated: DataFrame, lines: DataFrame, attempt: int, rel_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged files, reverted nodes) of one repair round."""
    reverted = repair.near_errors(node_rows, lines, repair.radius_of(attempt), rel_path)
    finished = merge.finished_nodes(node_rows, translated, reverted)
    return merge.merged_files(finished), reverted


def repair_rounds(
    node_rows: DataFrame, translated: DataFrame, compile_: Callable[[DataFrame], DataFrame], *, rounds: int = 32, hold: Callable[[DataFrame, str], DataFrame] = held
) -> DataFrame:
    """Merge, let `compile_` make a log table (paper_id, stem, log_text), revert near new error lines, and so on until none is new."""
    lines, merged_rows = None, hold(merge.merged_files(merge.finished_nodes(node_rows, translated)), "merged-0")
    for attempt in range(1, rounds + 1):
        found = hold(repair.error_lines(compile_(merged_rows)), f"lines-{attempt}")
        if (found if lines is None else repair.new_lines(lines, found)).isEmpty():
            break
        lines = hold(found if lines is None else repair.known_lines(lines, found), f"known-{attempt}")
        merged_rows = hold(revert_on_errors(node_rows, translated, lines, attempt)[0], f"merged-{attempt}")
    return merged_rows


def reconcile_tasks(known: DataFrame, external: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Known and external tasks with their artifacts' paths; external ones count as changed."""
    fresh = tasks.unknown(known, external)
    both = known.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)))
    return tasks.reconcile(both, artifacts).withColumn("changed", F.col("changed") | F.col("_new")).drop("_new")


def segment_report(sources: DataFrame, max_tokens: int = 1024, hold: Callable[[DataFrame, str], DataFrame] = held) -> DataFrame:
    """Nodes, translatable nodes and chunks of each file, and how many translatable nodes hold display math."""
    node_rows = hold(segment.nodes(sources), "nodes")
    counts = node_rows.groupBy(*KEY).agg(
        F.count("*").alias("n_nodes"), F.count_if(~F.col("preserve")).alias("n_translatable"),
        F.count_if(~F.col("preserve") & F.col("text").rlike(r"\$\$|\\\[")).alias("n_display_math"),
    )
    n = segment.chunks(node_rows, max_tokens).groupBy(*KEY).agg(F.count("*").alias("n_chunks"))
    return counts.join(n, KEY, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
