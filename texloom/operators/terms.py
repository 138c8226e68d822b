"""Candidate terms of each paper, and the shared glossary built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.functions import latex as lx

# ---- fixed values ----------------------------------------------------------------------------
STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "can", "will", "our", "その", "these", "those",
    "which", "when", "where", "then", "than", "into", "over", "each", "such", "also", "but", "not", "all", "one", "two", "may",
    "use", "used", "using", "based", "via", "per", "its", "their", "they", "them", "have", "has", "been", "more", "most", "some",
    "any", "both", "other", "only", "same", "very", "how", "why", "what", "figure", "table", "section", "equation", "appendix",
    "eq", "fig",
]
STARTERS = [
    "as", "at", "we", "it", "in", "on", "of", "to", "by", "if", "is", "an", "a", "the", "this", "that", "these", "those", "our",
    "their", "its", "when", "where", "while", "for", "with", "from", "and", "or", "but", "each", "all", "both", "such", "using",
    "based", "given", "let", "here", "there", "then", "thus", "however", "moreover", "since", "because", "shown", "show", "note",
    "figure", "table", "section",
]
PHRASE = r"(?U)\b([A-Za-z][A-Za-z0-9\-]*(?:\s+[A-Za-z][A-Za-z0-9\-]*){0,2})\b"
GLOSSARY_HEAD = "\n\n术语表(遇到下列术语时必须使用统一译法,保持全文一致):\n"
# ----------------------------------------------------------------------------------------------
TOP_K, MIN_COUNT = 40, 4


def is_term(phrase: Column) -> Column:
    """One technical word, or two or three words that a stop word neither begins nor ends, one of them capitalised."""
    words = F.split(phrase, r"(?U)\s+")
    first, last, n = F.lower(F.get(words, F.lit(0))), F.lower(F.element_at(words, -1)), F.size(words)
    technical = F.substring(phrase, 2, 1 << 30).rlike("[A-Z]") | phrase.contains("-") | ((F.length(phrase) >= 2) & phrase.rlike("^[A-Z][^a-z]*$"))
    single = technical & ~F.lower(phrase).isin(STOP_WORDS)
    several = ~first.isin(STARTERS + STOP_WORDS) & ~last.isin(STOP_WORDS) & F.exists(words, lambda w: w.rlike("^[A-Z]"))
    return F.when(n == 1, single).otherwise(several)


def term_counts(texts: DataFrame, group: str, order: list[str], text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(group, term, cnt, first_pos): phrases are filtered before they are counted, and counted before the shuffle."""
    phrases = texts.select(group, *order, F.posexplode(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(1))).alias("_k", "term")).where(is_term(F.col("term")))
    return phrases.groupBy(group, "term").agg(F.count("*").alias("cnt"), F.min(F.struct(*order, "_k")).alias("first_pos")).where(F.col("cnt") >= min_count)


def top_terms(texts: DataFrame, group: str, order: list[str], text: str = "text", top_k: int = TOP_K, min_count: int = MIN_COUNT) -> DataFrame:
    """(group, rank, term, cnt): most frequent first, then longest, then first seen."""
    w = Window.partitionBy(group).orderBy(F.desc("cnt"), F.desc(F.length("term")), F.asc("first_pos"))
    ranked = term_counts(texts, group, order, text, min_count).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top_k).select(group, "rank", "term", "cnt")


def parse_glossary(answers: DataFrame, candidates: DataFrame, group: str = "paper_id", answer: str = "answer") -> DataFrame:
    """(group, term, target) from answer lines `term => target` or `term → target`.

    Only candidates count, whatever their case; they keep the spelling of the last candidate. A later line wins.
    """
    lines = answers.select(group, F.posexplode(F.split(answer, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1)).alias("_n", "line"))
    clean = lx.strip(F.regexp_replace(lx.strip("line"), r"^[-•* ]+", ""))
    mark = F.when(clean.contains("=>"), "=>").when(clean.contains("→"), "→")
    at = F.instr(clean, "=>")
    at = F.when(at > 0, at).otherwise(F.instr(clean, "→"))
    pairs = lines.select(
        group, "_n", lx.strip(F.substring(clean, F.lit(1), at - 1)).alias("en"), lx.strip(F.substring(clean, at + F.length(mark), F.length(clean))).alias("target"), mark.alias("m")
    ).where("m is not null and en <> '' and target <> ''")
    spelled = candidates.groupBy(group, F.lower("term").alias("_low")).agg(F.max_by("term", "rank").alias("term"))
    named = pairs.withColumn("_low", F.lower("en")).join(spelled, [group, "_low"])
    return named.groupBy(group, "term").agg(F.max_by("target", "_n").alias("target"))


def glossary_prompts(glossary: DataFrame, group: str = "paper_id") -> DataFrame:
    """(group, prompt): the glossary as a block of text, in order of rank."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "target"))), lambda x: F.concat(F.lit("- "), x["term"], F.lit(" → "), x["target"]))
    return glossary.groupBy(group).agg(F.concat(F.lit(GLOSSARY_HEAD), F.array_join(lines, "\n")).alias("prompt"))


def paper_hashes(sources: DataFrame) -> DataFrame:
    """(paper_id, paper_hash): one hash over all sources of a paper, whatever their order; `src_hash`, where it is there, spares their texts."""
    own = F.col("src_hash") if "src_hash" in sources.columns else lx.content_hash("content")
    files = F.array_sort(F.collect_list(F.concat_ws(":", "rel_path", own)))
    return sources.groupBy("paper_id").agg(F.md5(F.array_join(files, "\n").cast("binary")).alias("paper_hash"))


def without_glossary(hashes: DataFrame, stored: DataFrame) -> DataFrame:
    """Papers whose glossary isn't stored (paper_id, paper_hash, …) or is of other sources; append theirs to the store."""
    return hashes.join(stored, ["paper_id", "paper_hash"], "left_anti")
