"""Derived tables: LaTeX sources, translations, caches, logs and tasks made from the given tables.

Each is a fixed projection, written once as Spark columns here and once as SQL (the `…_SQL`
strings, common table expressions), so that a second engine can rebuild it. Every row of the
given table makes a row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names() -> list:
    """paper_id and rel_path of a document."""
    paper = F.floor(F.col("doc_id") / 4).cast("long").alias("paper_id")
    path = F.when(F.col("doc_id") % 4 == 0, F.lit("main.tex")).otherwise(F.concat(F.lit("sec/s"), (F.col("doc_id") % 4).cast("string"), F.lit(".tex"))).alias("rel_path")
    return [paper, path]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *_names(), "text", "lang", "source")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, rel_path, content, doc_id): part 0 of a paper is a whole document, the others are sections."""
    number = F.col("doc_id").cast("string")
    main = F.concat(
        F.lit("\\documentclass{article}\n\\newcommand{\\hl}[1]{\\textbf{#1}}\n\\title{Study "), number, F.lit(" of "), "lang",
        F.lit("}\n\\begin{document}\n\\maketitle\n\\section{Part "), number, F.lit("}\n"), "text", F.lit(" \\cite{k"), number, F.lit("} and more $x_1$ end\n\\end{document}\n"),
    )
    part = F.concat(F.lit("\\section{Part "), number, F.lit("}\n"), "text", F.lit(" \\hl{note "), "lang", F.lit("} see \\ref{r"), number, F.lit("} again\n"))
    return documents(spark, sf_dir).select("paper_id", "rel_path", F.when(F.col("rel_path") == "main.tex", main).otherwise(part).alias("content"), "doc_id")


DOCS_SQL = """
docs as (
  select doc_id, doc_id // 4 as paper_id, case when doc_id % 4 = 0 then 'main.tex' else 'sec/s' || (doc_id % 4) || '.tex' end as rel_path,
    text, lang, source, chr(10) as nl
  from documents
)"""
SOURCES_SQL = (
    DOCS_SQL
    + r""", sources as (
  select paper_id, rel_path, doc_id, case when doc_id % 4 = 0
    then '\documentclass{article}' || nl || '\newcommand{\hl}[1]{\textbf{#1}}' || nl || '\title{Study ' || doc_id || ' of ' || lang || '}' || nl
      || '\begin{document}' || nl || '\maketitle' || nl || '\section{Part ' || doc_id || '}' || nl || text || ' \cite{k' || doc_id || '} and more $x_1$ end' || nl
      || '\end{document}' || nl
    else '\section{Part ' || doc_id || '}' || nl || text || ' \hl{note ' || lang || '} see \ref{r' || doc_id || '} again' || nl end as content
  from docs
)"""
)


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, rel_path, chunk_idx, original, translated, doc_id): nine variants of whole texts, one for each branch of the checks."""
    around = lambda before, after="": F.concat(F.lit(before), "text", F.lit(after))
    original = F.concat(around("\\item ", " \\textbf{"), "lang", F.lit("}"))
    v = F.col("doc_id") % 9
    translated = (
        F.when(v == 0, around("\\item 这是译文 ", " \\textbf{术语}")).when(v == 1, F.lit(None)).when(v == 2, original).when(v == 3, around("以下是翻译"))
        .when(v == 4, around("\\item 这是译文 ", " \\textbf{术语")).when(v == 5, around("这是译文 ", " \\textbf{术语}"))
        .when(v == 6, around("\\item 这是译文 50% a_b x^2 $y_1$ ", " \\textbf{术语}")).when(v == 7, around("[标题] \\item中 ", " \\textbf {术语} \\sys高效"))
        .otherwise(around("\\item ", " \\textbf{术语\n\n术语}"))
    )
    return documents(spark, sf_dir).select("paper_id", "rel_path", F.lit(0).alias("chunk_idx"), original.alias("original"), translated.alias("translated"), "doc_id")


TRANSLATIONS_SQL = (
    DOCS_SQL
    + r""", translations as (
  select paper_id, rel_path, 0 as chunk_idx, doc_id, '\item ' || text || ' \textbf{' || lang || '}' as original,
    case doc_id % 9 when 0 then '\item 这是译文 ' || text || ' \textbf{术语}' when 1 then null when 2 then '\item ' || text || ' \textbf{' || lang || '}'
      when 3 then '以下是翻译' || text when 4 then '\item 这是译文 ' || text || ' \textbf{术语' when 5 then '这是译文 ' || text || ' \textbf{术语}'
      when 6 then '\item 这是译文 50% a_b x^2 $y_1$ ' || text || ' \textbf{术语}' when 7 then '[标题] \item中 ' || text || ' \textbf {术语} \sys高效'
      else '\item ' || text || ' \textbf{术语' || nl || nl || '术语}' end as translated
  from docs
)"""
)


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document as its chunks: (paper_id, rel_path, chunk_idx, text, src_hash)."""
    lines = documents(spark, sf_dir).select("paper_id", "rel_path", "doc_id", F.md5(F.col("text").cast("binary")).alias("src_hash"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "text"))
    return lines


CHUNKS_SQL = (
    DOCS_SQL
    + """, chunks as (
  select paper_id, rel_path, doc_id, md5(text) as src_hash, k - 1 as chunk_idx, parts[k] as text
  from (select paper_id, rel_path, doc_id, text, string_split(text, nl) as parts, unnest(generate_series(1, len(string_split(text, nl)))) as k from docs)
)"""
)


def chunk_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached lines by doc_id % 5: 0 absent, 1 with another hash, 2 one chunk short, 3 and 4 valid; of them,
    lines of even index are translated."""
    parts = F.split("text", "\n", -1)
    chunks = F.transform(parts, lambda t, i: F.when(i % 2 == 0, F.concat(F.lit("译"), i.cast("string"))).otherwise(t))
    v = F.col("doc_id") % 5
    return documents(spark, sf_dir).where(v != 0).select(
        "paper_id", "rel_path", F.substring(F.md5(F.col("rel_path").cast("binary")), 1, 16).alias("cache_key"),
        F.when(v == 1, F.lit("0" * 32)).otherwise(F.md5(F.col("text").cast("binary"))).alias("src_hash"),
        F.when(v == 2, F.slice(chunks, 1, F.size(chunks) - 1)).otherwise(chunks).alias("chunks"),
    )


CACHE_SQL = (
    CHUNKS_SQL
    + """, cache as (
  select paper_id, rel_path, doc_id, case when doc_id % 5 = 1 then repeat('0', 32) else src_hash end as src_hash, chunk_idx,
    case when chunk_idx % 2 = 0 then '译' || chunk_idx else text end as translated
  from (select *, max(chunk_idx) over (partition by doc_id) as last from chunks) where doc_id % 5 <> 0 and not (doc_id % 5 = 2 and chunk_idx = last)
), cache_files as (
  select paper_id, rel_path, doc_id, min(src_hash) as src_hash, count(*) as n_chunks from cache group by all
  union all
  select paper_id, rel_path, doc_id, md5(text), 0 from docs where doc_id % 5 = 2 and not contains(text, nl)
), files as (
  select paper_id, rel_path, doc_id, src_hash, substring(md5(rel_path), 1, 16) as cache_key, count(*) as n_chunks from chunks group by all
)"""
)


def compile_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, stem, log_text) by paper_id % 3: a log without errors, one mark, a named line and a mark."""
    n = F.col("paper_id") % 20 + 1
    mark = lambda x: F.concat(F.lit("l."), x.cast("string"), F.lit(" \\foo\n"))
    log = F.when(F.col("paper_id") % 3 == 1, F.concat(F.lit("This is XeTeX\n"), mark(n))).otherwise(F.concat(F.lit("main.tex:"), n.cast("string"), F.lit(": error\n"), mark(n + 7)))
    log = F.when(F.col("paper_id") % 3 == 0, F.lit("This is XeTeX\nOutput written on main.pdf\n")).otherwise(log)
    return documents(spark, sf_dir).where("rel_path = 'main.tex'").select("paper_id", F.lit("main").alias("stem"), log.alias("log_text"))


LINES_SQL = """
error_lines as (
  select paper_id, paper_id % 20 + 1 + (case when paper_id % 3 = 2 then 7 else 0 end) as line from (select distinct doc_id // 4 as paper_id from documents where doc_id % 4 = 0) where paper_id % 3 <> 0
  union
  select paper_id, paper_id % 20 + 1 from (select distinct doc_id // 4 as paper_id from documents where doc_id % 4 = 0) where paper_id % 3 = 2
)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["done", "failed", "running", "queued"])), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), k.cast("string")).alias("task_id"), status.alias("status"), status.alias("stage"), F.lit("m").alias("message"),
        (k % 11).cast("int").alias("current"), F.when(k % 13 == 0, 0).otherwise(10).cast("int").alias("total"), F.when(k % 4 == 1, "boom").alias("error"),
        F.when(k % 10 == 0, F.concat(F.lit("/old/"), k.cast("string"), F.lit("_cn.pdf"))).alias("translated_pdf"), F.lit(None).cast("string").alias("bilingual_pdf"),
        F.lit(None).cast("string").alias("original_pdf"), F.concat(F.lit("/w/"), k.cast("string")).alias("workdir"),
        F.when(k % 3 == 0, F.concat(F.lit("Paper: "), k.cast("string"))).when(k % 3 == 1, "").alias("title"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("source"),
        F.when(k % 97 != 0, F.unix_timestamp("o_orderdate").cast("double")).alias("created_at"),
    )


TASKS_SQL = """
tasks as (
  select 't' || o_orderkey as task_id, o_orderkey as k, (['done', 'failed', 'running', 'queued'])[o_orderkey % 4 + 1] as status, 'm' as message,
    o_orderkey % 11 as current, case when o_orderkey % 13 = 0 then 0 else 10 end as total, case when o_orderkey % 4 = 1 then 'boom' end as error,
    case when o_orderkey % 10 = 0 then '/old/' || o_orderkey || '_cn.pdf' end as translated_pdf, '/w/' || o_orderkey as workdir,
    case o_orderkey % 3 when 0 then 'Paper: ' || o_orderkey when 1 then '' end as title, case when o_orderkey % 5 <> 0 then o_orderpriority end as source,
    case when o_orderkey % 97 <> 0 then epoch(o_orderdate)::double end as created_at
  from orders
)"""
_ARTIFACTS = [[], ["_cn"], ["_cn", "_cn_wm"], ["_bilingual", "_cn"], ["_bilingual", "_cn", "_cn_wm", "_orig"], ["_orig"]]


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lists = F.array(*[F.array(*map(F.lit, a)) if a else F.expr("cast(array() as array<string>)") for a in _ARTIFACTS])
    own = table(spark, sf_dir, "orders").select(k, F.explode(F.element_at(lists, (k % 6 + 1).cast("int"))).alias("s"))
    return own.select(F.concat(F.lit("/w/"), k.cast("string")).alias("workdir"), F.concat(F.lit("p"), k.cast("string"), "s", F.lit(".pdf")).alias("file_name"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_of(table(spark, sf_dir, "events"))


def progress_of(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as the progress of one task for each user."""
    e = F.col("event_id")
    stage = F.expr("case event_type when 'signup' then 'queued' when 'view' then 'downloading' when 'click' then 'translating' when 'purchase' then 'done' else 'failed' end")
    return events.select(
        F.col("user_id").cast("string").alias("task_id"), e.alias("seq"), "ts", stage.alias("stage"), F.concat(F.lit("e"), e.cast("string")).alias("message"),
        (e % 11).cast("int").alias("current"), F.when(e % 13 == 0, 0).otherwise(10).cast("int").alias("total"),
    )


def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, url): eight ways of naming a paper, by doc_id % 8."""
    d = F.col("doc_id")
    number = F.concat(F.lit("24"), F.lpad((d % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((d % 100000).cast("string"), 5, "0"))
    forms = [("https://arxiv.org/abs/", ""), ("https://arxiv.org/abs/", "v2"), ("https://arxiv.org/pdf/", ".pdf"), ("arXiv:", ""), ("", ""), ("", "v3"), ("  ", " "), ("/data/paper-", ".zip")]
    url = F.concat(F.lit(forms[-1][0]), d.cast("string"), F.lit(forms[-1][1]))
    for i, (a, b) in enumerate(forms[:-1]):
        url = F.when(d % 8 == i, F.concat(F.lit(a), number, F.lit(b))).otherwise(url)
    return table(spark, sf_dir, "documents").select(d.alias("ref_id"), url.alias("url"))


REFS_SQL = """
refs as (
  select doc_id as ref_id, '24' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '.' || lpad((doc_id % 100000)::varchar, 5, '0') as number from documents
), source_refs as (
  select ref_id, number, case ref_id % 8 when 0 then 'https://arxiv.org/abs/' || number when 1 then 'https://arxiv.org/abs/' || number || 'v2'
    when 2 then 'https://arxiv.org/pdf/' || number || '.pdf' when 3 then 'arXiv:' || number when 4 then number when 5 then number || 'v3'
    when 6 then '  ' || number || ' ' else '/data/paper-' || ref_id || '.zip' end as url
  from refs
)"""
