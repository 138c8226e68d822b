"""All queries over the given tables, with the SQL that a second engine runs for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import latex as lx
from texloom.operators import audit, cache, merge, repair, segment, tasks, terms
from texloom.operators import nodes as node_windows
from texloom.plans import fixtures as fx
from texloom.plans import jobs
from texloom.plans.held import held, shared_dir
from texloom.sources import latex as src
from texloom.sources.chunk_store import ChunkStore, joined_by_bucket
from texloom.streaming import progress, task_feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


# ---------------------------------------------------------------- terms

TERMS_CTE = rf"""
phrases as (
  select source, doc_id, k, ps[k] as term
  from (select source, doc_id, ps, unnest(generate_series(1, len(ps))) as k from (
    select source, doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'),
      '\b([A-Za-z][A-Za-z0-9\-]*(?:\s+[A-Za-z][A-Za-z0-9\-]*){{0,2}})\b', 1) as ps from documents))
), split as (select *, regexp_split_to_array(term, '\s+') as words from phrases
), kept as (
  select * from split where case when len(words) = 1
    then (regexp_matches(substring(term, 2), '[A-Z]') or contains(term, '-') or (length(term) >= 2 and regexp_matches(term, '^[A-Z][^a-z]*$')))
      and lower(term) not in ({_quoted(terms.STOP_WORDS)})
    else lower(words[1]) not in ({_quoted(terms.STARTERS + terms.STOP_WORDS)}) and lower(words[-1]) not in ({_quoted(terms.STOP_WORDS)})
      and len(list_filter(words, lambda w: regexp_matches(w, '^[A-Z]'))) > 0 end
), counted as (
  select source, term, count(*) as cnt, min(doc_id * 10000000 + k) as first_pos from kept group by source, term having count(*) >= 4
), ranked as (
  select source, term, cnt, row_number() over (partition by source order by cnt desc, length(term) desc, first_pos) as rank from counted
)"""


@query(f"with {TERMS_CTE} select source, rank, term, cnt from ranked where rank <= 40")
def term_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_terms(fx.table(spark, sf_dir, "documents"), "source", ["doc_id"])


@query(f"with {TERMS_CTE} select source, term, cnt from counted")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(fx.table(spark, sf_dir, "documents"), "source", ["doc_id"]).select("source", "term", "cnt")


@query(
    f"""with {TERMS_CTE}, lowered as (
  select source, lower(term) as low, arg_max(term, rank) as term, arg_max(rank, rank) as rank from ranked where rank <= 40 group by source, lower(term))
select source, term, '译' || rank as target from lowered where rank % 4 <> 3"""
)
def glossary_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers list every term in one of four forms; those without a target, and unknown terms, don't count."""
    top = term_topk(spark, sf_dir)
    name = F.when(F.col("rank") % 4 == 1, F.upper("term")).otherwise(F.col("term"))
    target = F.concat(F.lit("译"), F.col("rank").cast("string"))
    line = (
        F.when(F.col("rank") % 4 == 0, F.concat(F.lit("- "), name, F.lit(" => "), target)).when(F.col("rank") % 4 == 3, F.concat(name, F.lit(" =>")))
        .otherwise(F.concat(F.lit("• "), name, F.lit(" → "), target))
    )
    answers = top.groupBy("source").agg(F.concat(F.lit("zzz => x\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n")).alias("answer"))
    return terms.parse_glossary(answers, top, "source")


@query(
    f"""with {TERMS_CTE} select source, '{terms.GLOSSARY_HEAD}' || string_agg('- ' || term || ' → ' || '译' || rank, chr(10) order by rank) as prompt
from ranked where rank <= 40 group by source"""
)
def glossary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = term_topk(spark, sf_dir).withColumn("target", F.concat(F.lit("译"), F.col("rank").cast("string")))
    return terms.glossary_prompts(top, "source")


# ---------------------------------------------------------------- identifiers, hashes, sizes


@query(
    f"""with {fx.REFS_SQL} select ref_id, case when ref_id % 8 < 7 then number end as arxiv_id,
  case when ref_id % 8 < 7 then number else 'paper-' || ref_id || '.zip' end as work_key from source_refs"""
)
def arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.source_refs(spark, sf_dir).select("ref_id", lx.arxiv_id("url").alias("arxiv_id"), lx.work_key("url").alias("work_key"))


@query(f"with {fx.SOURCES_SQL} select paper_id, rel_path, md5(content) as src_hash, substring(md5(rel_path), 1, 16) as cache_key from sources")
def content_hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sources(spark, sf_dir).select("paper_id", "rel_path", lx.content_hash("content").alias("src_hash"), lx.cache_key("rel_path").alias("cache_key"))


@query("select source, count(*) as calls, sum(greatest(1, length(text) // 3))::bigint as tokens, max(greatest(1, length(text) // 3)) as longest from documents group by source")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lx.token_estimate("text")
    return fx.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"))


@query(
    rf"""with {fx.TASKS_SQL}, safe as (select task_id, k, trim(left(trim(regexp_replace(regexp_replace(title, '[\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')), 120)) as s from tasks)
select task_id, case when coalesce(s, '') = '' then 'f' || k || '.pdf' else s || case k % 3 when 0 then '_中英对照' when 1 then '_原文' else '_中文' end || '.pdf' end as name from safe"""
)
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.tasks(spark, sf_dir).withColumn("k", F.substring("task_id", 2, 20).cast("long"))
    kind = F.element_at(F.array(F.lit("bilingual"), F.lit("original"), F.lit("translated")), (F.col("k") % 3 + 1).cast("int"))
    return t.select("task_id", lx.download_name("title", kind, F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".pdf"))).alias("name"))


# ---------------------------------------------------------------- checks and repairs of segments

_BALANCE = r"(length(replace(regexp_replace({x}, '(?s)\\.', '', 'g'), '}}', '')) - length(replace(regexp_replace({x}, '(?s)\\.', '', 'g'), '{{', '')))"
_STRUCTURE = r"array_to_string(list_sort(list_filter(list_transform(regexp_extract_all({x}, '\\([a-zA-Z]+)', 1), lambda n: lower(n)), lambda n: n in (" + _quoted(lx.STRUCTURAL) + "))), ',')"
_META = "(trim({x}) = '' or " + " or ".join(f"contains({{x}}, '{m}')" for m in lx.META_MARKS) + ")"
_WORD = r"regexp_matches(regexp_replace({x}, '\\[a-zA-Z]+|[{{}}]', ' ', 'g'), '[A-Za-z]{{2,}}|[一-鿿]')"


def _sql(template: str, x: str) -> str:
    return template.format(x=x)


@query(
    f"""with {fx.TRANSLATIONS_SQL} select doc_id, {_sql(_BALANCE, "text")} as balance, {_sql(_STRUCTURE, "text")} as structure,
  {_sql(_META, "text")} as meta, {_sql(_WORD, "text")} as word from (select doc_id, coalesce(translated, original) as text from translations)"""
)
def segment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brace balance, structural commands, meta talk and words of every translation, or of the original where there is none."""
    t = F.coalesce("translated", "original")
    return fx.translations(spark, sf_dir).select(
        "doc_id", lx.brace_balance(t).alias("balance"), F.array_join(lx.structural_commands(t), ",").alias("structure"), lx.is_meta(t).alias("meta"), lx.has_word(t).alias("word")
    )


def _collapsed(table: str, column: str) -> str:
    """Common table expressions that end in kept (doc_id, collapsed): blank lines go where braces of earlier lines are open."""
    return f"""lines as (
  select doc_id, k, ls[k] as line from (select doc_id, ls, unnest(generate_series(1, len(ls))) as k from (select doc_id, string_split({column}, chr(10)) as ls from {table} where {column} is not null))
), sums as (select *, sum({_sql(_BALANCE, "line")}) over (partition by doc_id order by k) as s from lines
), depths as (select *, s - least(0, min(s) over (partition by doc_id order by k)) as depth from sums
), before as (select *, coalesce(lag(depth) over (partition by doc_id order by k), 0) as d from depths
), kept as (select doc_id, string_agg(line, chr(10) order by k) as collapsed from before where not (trim(line) = '' and d > 0) group by doc_id)"""


@query(f"with {fx.TRANSLATIONS_SQL}, {_collapsed('translations', 'translated')} select t.doc_id, collapsed from translations t left join kept using (doc_id)")
def collapse_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.translations(spark, sf_dir).select("doc_id", lx.drop_blank_in_arguments("translated").alias("collapsed"))


_ESC = "replace(replace(replace(replace(replace(replace({p}, '\\_', chr(1)), '\\^', chr(2)), '_', '\\_'), '^', '\\^'), chr(1), '\\_'), chr(2), '\\^')"
ESCAPED_CTE = (
    fx.TRANSLATIONS_SQL
    + r""", e0 as (select *, regexp_replace(translated, '^(?:\s*\[(?i:"""
    + "|".join(lx.STRAY_TAGS)
    + r""")\]\s*)+', '') as x from translations
), """
    + _collapsed("e0", "x")
    + r""", e1 as (select e0.* replace (collapsed as x) from e0 left join kept using (doc_id)
), e2 as (select * replace (replace(replace(replace(x, '\%', chr(1)), '%', '\%'), chr(1), '\%') as x) from e1
), e3 as (select * replace (array_to_string(list_transform(generate_series(1, len(string_split_regex(x, '(?s)\$.*?\$'))),
    lambda i: """
    + _ESC.format(p=r"(string_split_regex(x, '(?s)\$.*?\$'))[i]")
    + r""" || coalesce((regexp_extract_all(x, '(?s)\$.*?\$'))[i], '')), '') as x) from e2
), e4 as (select * replace (regexp_replace(regexp_replace(x, '\\([a-zA-Z]{2,})[ \t]+\{', '\\\1{', 'g'), '\\[ \t]+([a-zA-Z]{2,})\{', '\\\1{', 'g') as x) from e3
), e5 as (select * replace (regexp_replace(x, '(\\item)([^\s\[])', '\1 \2', 'g') as x) from e4
), escaped as (select * replace (regexp_replace(x, '(\\[a-zA-Z]+)([一-鿿　-〿＀-￯])', '\1{}\2', 'g') as x) from e5
)"""
)


@query(f"with {ESCAPED_CTE} select doc_id, x as fixed from escaped")
def escape_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, blank lines, escapes and spacing repaired, without the fallbacks."""
    t = lx.strip_tags("translated")
    for step in (lx.drop_blank_in_arguments, lx.escape_percent, lx.escape_scripts, lx.join_commands, lx.space_after_item, lx.separate_cjk):
        t = step(t)
    return fx.translations(spark, sf_dir).select("doc_id", t.alias("fixed"))


@query(
    rf"""with {ESCAPED_CTE}, judged as (
  select doc_id, x, original, case when translated is null then 'missing' when {_sql(_META, "translated")} then 'meta'
    when {_sql(_STRUCTURE, "x")} <> {_sql(_STRUCTURE, "original")} then 'structure' when {_sql(_BALANCE, "x")} = {_sql(_BALANCE, "original")} then 'ok' else 'partial' end as outcome
  from escaped)
select doc_id, outcome, case outcome when 'ok' then x when 'partial' then regexp_extract(x, '(?s)^(.*)\{{[^{{}}]*$', 1) || ' ' || original else original end as fixed from judged"""
)
def fix_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.with_repaired(fx.translations(spark, sf_dir), "original", "translated").select("doc_id", "outcome", "fixed")


@query(
    rf"""with {fx.TRANSLATIONS_SQL} select paper_id, count(*) as n_segments, count(*) filter (where translated is null) as n_hard,
  count(*) filter (where translated is null or trim(translated) = '' or (trim(translated) = trim(original)
    and regexp_matches(regexp_replace(original, '\\[a-zA-Z]+|[{{}}]', ' ', 'g'), '[A-Za-z]{{3,}}'))) as n_failed from translations group by paper_id"""
)
def failed_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.translations(spark, sf_dir)
    return t.groupBy("paper_id").agg(F.count("*").alias("n_segments"), F.count_if(F.col("translated").isNull()).alias("n_hard"), F.count_if(lx.is_failed("original", "translated")).alias("n_failed"))


_NEEDS = r"""(length(trim({s})) >= 40 and length(regexp_replace({s}, '[^A-Za-z]', '', 'g')) > 15 and not regexp_matches(coalesce({t}, ''), '[一-鿿]')
  and not (starts_with(trim({s}), '\') and length({s}) - length(replace({s}, '\', '')) > 3 and not regexp_matches(trim({s}), '[.!?]\s')))"""


@query(f"with {fx.TRANSLATIONS_SQL} select doc_id, {_NEEDS.format(s='original', t='translated')} as needs from translations")
def needs_retranslation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.translations(spark, sf_dir).select("doc_id", lx.needs_retranslation("original", "translated").alias("needs"))


# ---------------------------------------------------------------- cache and audit

_FIT = "from files f join cache_files c using (paper_id, rel_path) where f.n_chunks = c.n_chunks"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached, chunk_rows = fx.chunk_cache(spark, sf_dir), fx.chunk_rows(spark, sf_dir)
    counts = chunk_rows.groupBy("paper_id", "rel_path").agg(F.count("*").alias("n"))
    fit = cached.join(counts, ["paper_id", "rel_path"]).where(F.size("chunks") == F.col("n"))
    return chunk_rows.join(cache.cached_chunks(fit), ["paper_id", "rel_path", "chunk_idx"])


@query(
    f"""with {fx.CACHE_SQL}, pairs as (select c.paper_id, c.rel_path, c.text, k.translated from chunks c join cache k using (doc_id, chunk_idx) where doc_id in (select f.doc_id {_FIT}))
select paper_id, rel_path, count(*) filter (where {_NEEDS.format(s="text", t="translated")}) as n_untranslated, count(*) as n_chunks, grouping(paper_id, rel_path) as level
from pairs group by rollup (paper_id, rel_path)"""
)
def retranslation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(_pairs(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.documents(spark, sf_dir).withColumnRenamed("text", "content")
    return cache.file_keys(texts, fx.chunk_rows(spark, sf_dir))


@query(f"with {fx.CACHE_SQL} select paper_id, rel_path, f.src_hash, cache_key, n_chunks from files f semi join cache_files c using (paper_id, rel_path, src_hash, n_chunks)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hits(_files(spark, sf_dir), fx.chunk_cache(spark, sf_dir))


@query(f"with {fx.CACHE_SQL} select paper_id, rel_path, f.src_hash, cache_key, n_chunks from files f anti join cache_files c using (paper_id, rel_path, src_hash, n_chunks)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(_files(spark, sf_dir), fx.chunk_cache(spark, sf_dir))


@query(
    f"""with {fx.CACHE_SQL} select paper_id, rel_path, f.n_chunks, c.n_chunks as n_cached, f.src_hash <> c.src_hash as hash_differs
from files f join cache_files c using (paper_id, rel_path) where f.n_chunks <> c.n_chunks or f.src_hash <> c.src_hash"""
)
def cache_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stale(_files(spark, sf_dir), fx.chunk_cache(spark, sf_dir))


@query(f"with {fx.CACHE_SQL} select c.paper_id, c.rel_path, chunk_idx, coalesce(k.translated, c.text) as final from chunks c left join cache k using (doc_id, chunk_idx)")
def paired_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its cached translation by position, or itself."""
    return cache.paired(fx.chunk_rows(spark, sf_dir), cache.cached_chunks(fx.chunk_cache(spark, sf_dir))).select("paper_id", "rel_path", "chunk_idx", "final")


@query(
    f"""with {fx.CACHE_SQL} select paper_id, rel_path, chunk_idx, case when chunk_idx % 3 = 0 then 'neu' || chunk_idx else translated end as translated from cache"""
)
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third cached chunk is replaced; null replacements change nothing."""
    new = fx.chunk_rows(spark, sf_dir).select(
        "paper_id", "rel_path", "chunk_idx", F.when(F.col("chunk_idx") % 3 == 0, F.concat(F.lit("neu"), F.col("chunk_idx").cast("string"))).alias("translated")
    )
    return cache.cached_chunks(cache.replaced(fx.chunk_cache(spark, sf_dir), new))


@query(
    f"""with {fx.CHUNKS_SQL} select paper_id, rel_path, src_hash, string_agg(text, '|' order by chunk_idx) as joined from chunks
group by paper_id, rel_path, src_hash having count(*) filter (where chunk_idx % 7 = 6) = 0"""
)
def stored_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which no chunk failed (every seventh does), chunks in order."""
    rows = fx.chunk_rows(spark, sf_dir).withColumn("translated", F.when(F.col("chunk_idx") % 7 != 6, F.col("text")))
    return cache.to_store(_files(spark, sf_dir), rows).select("paper_id", "rel_path", "src_hash", F.array_join("chunks", "|").alias("joined"))


# ---------------------------------------------------------------- segmentation and merge


#: Protected stretches of the sources, found by place: what the template puts around a text, and formulas and comments in
#: the whole file, by cutting it at their patterns. The texts hold no backslashes and no braces of their own.
_CUT = """select doc_id, k, {name} as kind, ps[k] as inside, (coalesce(list_sum(list_transform(os[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ps[1:k - 1], lambda x: length(x))), 0))::bigint as a
  from (select doc_id, ps, os, unnest(generate_series(1, len(ps))) as k from (select doc_id, regexp_extract_all(content, '{pattern}') as ps, string_split_regex(content, '{pattern}') as os from files where contains(content, '{mark}')))"""
NODES_CTE = (
    fx.SOURCES_SQL
    + r""", files as (
  select *, length(content) as n, doc_id % 4 = 0 as whole, 'Part ' || doc_id as part, 'Study ' || doc_id || ' of ' || (select lang from docs d where d.doc_id = s.doc_id) as study from sources s
), framed as (
  select *, case when whole then length('\documentclass{article}') + 1 + length('\newcommand{\hl}[1]{\textbf{#1}}') + 1 + length('\title{') end as at_title,
    case when whole then strpos(content, '\section{') + 8 else 9 end as at_part from files
), cuts as (
  """
    + _CUT.format(name="'comment'", pattern=r"%[^\n]*", mark="%")
    + """
  union all """
    + _CUT.format(name="'display'", pattern=r"(?s)\$\$.*?\$\$", mark="$$")
    + """
  union all """
    + _CUT.format(name="'formula'", pattern=r"\$(?:\\.|[^$\\])+\$", mark="$")
    + r"""
), spans as (
  select doc_id, a, a + length(inside) as b from cuts
  union all select doc_id, 0, at_title from framed where whole
  union all select doc_id, at_title + length(study), at_part from framed where whole
  union all select doc_id, 0, at_part from framed where not whole
  union all select doc_id, at_part + length(part), at_part + length(part) + 1 from framed
  union all select doc_id, n - length('\cite{k' || doc_id || '} and more $x_1$ end' || chr(10) || '\end{document}' || chr(10)),
    n - length(' and more $x_1$ end' || chr(10) || '\end{document}' || chr(10)) from framed where whole
  union all select doc_id, n - length('\end{document}' || chr(10)), n from framed where whole
  union all select doc_id, n - length('\ref{r' || doc_id || '} again' || chr(10)), n - length(' again' || chr(10)) from framed where not whole
), joined as (
  select doc_id, min(a) as a, max(b) as b
  from (select *, sum(fresh) over (partition by doc_id order by a, b) as island
        from (select *, case when a > coalesce(max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as fresh from spans where b > a))
  group by doc_id, island
), open as (  -- what lies between protected stretches
  select doc_id, b as a, coalesce(lead(a) over (partition by doc_id order by a), n) as b, n from joined join files using (doc_id)
  qualify b < coalesce(lead(a) over (partition by doc_id order by a), n)
  union all select doc_id, 0, min(a), any_value(n) from joined join files using (doc_id) group by doc_id having min(a) > 0
), words as (
  select doc_id, o.a, o.b, o.n, substring(content, o.a + 1, o.b - o.a) as t from open o join files using (doc_id)
), texts as (  -- those with words and even braces, less the white space that goes to protected neighbours
  select doc_id, a + case when a > 0 then length(t) - length(ltrim(t, ' ' || chr(9) || chr(10))) else 0 end as a,
    b - case when b < n then length(t) - length(rtrim(t, ' ' || chr(9) || chr(10))) else 0 end as b, n
  from words where regexp_matches(regexp_replace(t, '\\[a-zA-Z]+|[{}]', ' ', 'g'), '[A-Za-z]{2,}|[一-鿿]') and length(replace(t, '{', '')) = length(replace(t, '}', ''))
), cut as (
  select doc_id, a, b, false as p from texts
  union all select doc_id, b, coalesce(lead(a) over (partition by doc_id order by a), n), true from texts qualify b < coalesce(lead(a) over (partition by doc_id order by a), n)
  union all select doc_id, 0, coalesce(min(t.a), any_value(f.n)), true from files f left join texts t using (doc_id) group by doc_id having coalesce(min(t.a), any_value(f.n)) > 0
), nodes as (
  select paper_id, rel_path, row_number() over w - 1 as node_idx, t as text, p as preserve, case when not p then count(*) filter (where not p) over w - 1 end as t_idx,
    coalesce(sum(breaks) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as line_start, sum(breaks) over w::bigint as line_end, a::bigint as start
  from (select paper_id, rel_path, a, p, substring(content, a + 1, b - a) as t, length(substring(content, a + 1, b - a)) - length(replace(substring(content, a + 1, b - a), chr(10), '')) as breaks from cut join files using (doc_id))
  window w as (partition by paper_id, rel_path order by a)
)"""
)


@query(f"with {NODES_CTE} select paper_id, rel_path, node_idx, text, preserve, t_idx, line_start, line_end from nodes")
def nodes_from_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.nodes(fx.sources(spark, sf_dir))


@query(f"with {NODES_CTE} select paper_id, rel_path, node_idx, start, length(text) as length, preserve from nodes")
def node_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.span_table(segment.nodes(fx.sources(spark, sf_dir)))


@query(
    f"""with {NODES_CTE} select paper_id, count(*) as total, count(*) filter (where not preserve) as translated, count(*) filter (where preserve) as preserved, 0 as reverted from nodes group by paper_id"""
)
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = segment.nodes(fx.sources(spark, sf_dir)).withColumn("outcome", F.lit("ok"))
    return merge.segment_stats(own)


@query(
    rf"""with {NODES_CTE} select paper_id, rel_path, string_agg(case when preserve then text else '译文' || t_idx end, '' order by node_idx) as merged from nodes group by paper_id, rel_path"""
)
def merged_from_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every translatable node translated by its number, repaired and merged."""
    own = held(segment.nodes(fx.sources(spark, sf_dir)), "nodes")
    done = own.where(~F.col("preserve")).select("paper_id", "rel_path", "t_idx", F.concat(F.lit("译文"), F.col("t_idx").cast("string")).alias("translated"))
    return merge.merged_files(merge.finished_nodes(own, done))


def _stand_in():
    return lambda texts, prompt: ["译" + t for t in texts]


@query(
    rf"""with {NODES_CTE}, merged as (
  select paper_id, rel_path, string_agg(case when preserve then text else '译' || replace(replace(text, '_', '\_'), '^', '\^') end, '' order by node_idx) as m from nodes group by paper_id, rel_path)
select paper_id, rel_path, case when rel_path = 'main.tex' then '\documentclass{{article}}' || chr(10) || chr(10) || '% 中文支持' || chr(10) || '\usepackage[UTF8]{{ctex}}' || chr(10)
  || substring(m, length('\documentclass{{article}}') + 1) else m end as merged from merged"""
)
def translated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with a stand-in translator and an empty cache; nodes are not cut into chunks here."""
    none = fx.chunk_cache(spark, sf_dir).limit(0)
    return jobs.translate_corpus(fx.sources(spark, sf_dir), none, _stand_in, max_tokens=1 << 20)["merged"]


@query(
    rf"""with {NODES_CTE}, {fx.LINES_SQL}, kept as (
  select *, not preserve and rel_path = 'main.tex' and exists (
    select 1 from error_lines e where e.paper_id = n.paper_id and e.line between n.line_start - 10 and n.line_end + 10) as back from nodes n)
select paper_id, rel_path, string_agg(case when preserve or back then text else '译文' || t_idx end, '' order by node_idx) as merged, count(*) filter (where back) as n_reverted
from kept group by paper_id, rel_path"""
)
def repair_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of reverting main files near their error lines, then merging."""
    own = held(segment.nodes(fx.sources(spark, sf_dir)), "nodes")
    done = own.where(~F.col("preserve")).select("paper_id", "rel_path", "t_idx", F.concat(F.lit("译文"), F.col("t_idx").cast("string")).alias("translated"))
    lines = repair.error_lines(fx.compile_logs(spark, sf_dir))
    merged, reverted = jobs.revert_on_errors(own, done, lines, 1, "main.tex")
    counts = reverted.groupBy("paper_id", "rel_path").agg(F.count("*").alias("n_reverted"))
    return merged.join(counts, ["paper_id", "rel_path"], "left").withColumn("n_reverted", F.coalesce("n_reverted", F.lit(0)))


@query(
    f"""with {fx.SOURCES_SQL}, hashes as (
  select paper_id, md5(string_agg(rel_path || ':' || md5(content), chr(10) order by rel_path || ':' || md5(content))) as paper_hash from sources group by paper_id)
select paper_id, paper_hash from hashes where paper_id % 2 = 1"""
)
def glossaries_to_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers without a stored glossary, where every second one has it."""
    hashes = terms.paper_hashes(fx.sources(spark, sf_dir))
    return terms.without_glossary(hashes, hashes.where("paper_id % 2 = 0"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached files in versions: those of `chunk_cache` as version 1, and for every third document the lines as they are, as versions 0
    (of an old hash) and 2 (of the right one)."""
    lines = fx.documents(spark, sf_dir).withColumn("k", F.col("doc_id") % 3)
    key = F.substring(F.md5(F.col("rel_path").cast("binary")), 1, 16).alias("cache_key")
    of = lambda rows, hash_, mark, version: rows.select(
        "paper_id", "rel_path", key, hash_.alias("src_hash"), F.transform(F.split("text", "\n", -1), lambda t: F.concat(F.lit(mark), t)).alias("chunks"), F.lit(version).cast("long").alias("version")
    )
    right = F.md5(F.col("text").cast("binary"))
    every = fx.chunk_cache(spark, sf_dir).withColumn("version", F.lit(1).cast("long"))
    return every.unionByName(of(lines.where("k = 0"), F.lit("f" * 32), "alt", 0)).unionByName(of(lines.where("k = 0"), right, "neu", 2))


_VERSIONS = f"""with {fx.CACHE_SQL}, wanted as (
  select c.paper_id, c.rel_path, c.doc_id, chunk_idx, case when c.doc_id % 3 = 0 then 'neu' || text when c.doc_id % 5 in (3, 4) then k.translated end as translated
  from chunks c left join cache k using (doc_id, chunk_idx))"""


@query(f"{_VERSIONS} select paper_id, rel_path, chunk_idx, translated from wanted where translated is not null")
def cached_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the version that fits each file, of several versions the last, from a store bucketed by paper."""
    rows = held(_versions(spark, sf_dir), "versions")
    store = ChunkStore(spark, f"{shared_dir(spark)}/texloom/store-{uuid.uuid4().hex}", rows.schema["paper_id"].dataType)
    for version in (2, 0, 1):
        store.put(rows.where(F.col("version") == version), version)
    with joined_by_bucket(spark):
        return held(cache.cached_chunks(cache.fitting(_files(spark, sf_dir), store.read())), "fitting")


@query(
    f"""with {fx.CACHE_SQL}, last as (
  select paper_id, rel_path, chunk_idx, 'neu' || text as translated from chunks where doc_id % 3 = 0
  union all select c.paper_id, c.rel_path, c.chunk_idx, k.translated from chunks c join cache k using (doc_id, chunk_idx) where doc_id % 3 <> 0)
select paper_id, rel_path, chunk_idx, translated from last"""
)
def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of every cached file, after the store was compacted to it."""
    rows = held(_versions(spark, sf_dir), "versions")
    store = ChunkStore(spark, f"{shared_dir(spark)}/texloom/store-{uuid.uuid4().hex}", rows.schema["paper_id"].dataType)
    for version in range(3):
        store.put(rows.where(F.col("version") == version), version)
    store.compact()
    return cache.cached_chunks(store.read())


@query(f"with {fx.DOCS_SQL} select paper_id, rel_path, row_number() over (partition by paper_id order by string_split(rel_path, '/')) - 1 as file_no from docs")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each file among those of its paper, in the order of folders."""
    return src.in_path_order(fx.sources(spark, sf_dir)).select("paper_id", "rel_path", "file_no")


@query()
def translated_with_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job with its own chunk size, sources as they are, and a cache of every second file; translations of that cache are marked."""
    sources = fx.sources(spark, sf_dir)
    every = lambda n: F.pmod(F.xxhash64("paper_id", "rel_path"), F.lit(n)) == 0
    marked = lambda mark, chunks: F.transform(chunks, lambda t: F.concat(F.lit(mark), t))
    rows = segment.file_rows(sources.where(every(2) | every(3))).withColumn("translated", marked("旧", segment.chunks_of()))
    version = lambda n, hash_, chunks: F.struct(hash_.alias("src_hash"), chunks.alias("chunks"), F.lit(n).cast("long").alias("version"))
    # every third file also has a later version of other content
    versions = [F.when(every(2), version(1, F.col("src_hash"), F.col("chunks"))), F.when(every(3), version(2, F.lit("f" * 32), marked("falsch", "chunks")))]
    cached = cache.rows_to_store(rows).select("paper_id", "rel_path", "cache_key", F.inline(F.array_compact(F.array(*versions))))
    return jobs.translate_corpus(sources, cached, _stand_in)["merged"]


@query()
def chunks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 100 tokens of every source's nodes."""
    return segment.chunks(segment.nodes(fx.sources(spark, sf_dir)), 100)


@query()
def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.segment_report(fx.sources(spark, sf_dir))


def _line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as nodes, a blank before and a newline after each; every third one is translatable."""
    return fx.chunk_rows(spark, sf_dir).select(
        "paper_id", "rel_path", F.col("chunk_idx").alias("node_idx"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"), (F.col("chunk_idx") % 3 != 1).alias("preserve")
    )


LINE_NODES = (
    fx.CHUNKS_SQL
    + """, line_nodes as (
  select paper_id, rel_path, chunk_idx as node_idx, ' ' || text || chr(10) as text, chunk_idx % 3 <> 1 as preserve, max(chunk_idx) over (partition by doc_id) as last from chunks
)"""
)


@query(
    f"""with {LINE_NODES} select paper_id, rel_path, node_idx, node_idx as line_start, node_idx + 1 as line_end, case when not preserve then (node_idx - 1) // 3 end as t_idx from line_nodes"""
)
def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_windows.with_t_idx(node_windows.with_lines(_line_nodes(spark, sf_dir))).drop("text", "preserve")


@query(
    f"""with {LINE_NODES} select paper_id, rel_path, node_idx, preserve, case when not preserve then substring(text, 2, length(text) - 2 + (node_idx = last)::int)
  when node_idx % 3 = 2 then chr(10) || text when node_idx < last then text || ' ' else text end as text from line_nodes"""
)
def whitespace_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_windows.detach_whitespace(_line_nodes(spark, sf_dir))


@query(
    f"""with {LINE_NODES}, numbered as (select *, case when preserve then (node_idx + 1) // 3 * 2 else (node_idx - 1) // 3 * 2 + 1 end as island from line_nodes)
select paper_id, rel_path, island as node_idx, string_agg(text, '' order by numbered.node_idx) as text, preserve from numbered group by paper_id, rel_path, island, preserve"""
)
def merge_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_windows.merge_neighbours(_line_nodes(spark, sf_dir))


# ---------------------------------------------------------------- error lines


@query(f"with {fx.LINES_SQL} select paper_id, line from error_lines")
def buggy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.error_lines(fx.compile_logs(spark, sf_dir))


@query(f"with {fx.LINES_SQL} select paper_id, line from error_lines where line % 2 = 1")
def new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lines that an earlier round (the even ones) didn't have."""
    found = repair.error_lines(fx.compile_logs(spark, sf_dir))
    return repair.new_lines(found.where("line % 2 = 0"), found)


@query(
    f"""with {fx.CHUNKS_SQL}, {fx.LINES_SQL} select paper_id, rel_path, chunk_idx as node_idx from chunks c
where exists (select 1 from error_lines e where e.paper_id = c.paper_id and e.line between c.chunk_idx - 5 and c.chunk_idx + 5)"""
)
def reverted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, taken as nodes, near the error lines of their paper."""
    own = fx.chunk_rows(spark, sf_dir).select("paper_id", "rel_path", F.col("chunk_idx").alias("node_idx"), F.lit(False).alias("preserve"), F.col("chunk_idx").alias("line_start"), F.col("chunk_idx").alias("line_end"))
    return repair.near_errors(own, repair.error_lines(fx.compile_logs(spark, sf_dir)), 5).select("paper_id", "rel_path", "node_idx")


# ---------------------------------------------------------------- titles, main files, preambles


@query(f"with {fx.SOURCES_SQL} select paper_id, rel_path, 18 as score from sources where doc_id % 4 = 0")
def main_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.main_file(fx.sources(spark, sf_dir))


@query(f"with {fx.DOCS_SQL} select paper_id, rel_path, case when doc_id % 4 = 0 then 'Study ' || doc_id || ' of ' || lang end as title from docs")
def title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sources(spark, sf_dir).select("paper_id", "rel_path", lx.title("content").alias("title"))


@query(
    rf"""with {fx.SOURCES_SQL} select paper_id, rel_path, case when doc_id % 4 = 0 then '\documentclass{{article}}' || chr(10) || chr(10) || '% 中文支持' || chr(10) || '\usepackage[UTF8]{{ctex}}'
  || chr(10) || substring(content, length('\documentclass{{article}}') + 1) else content end as content from sources"""
)
def cjk_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = fx.sources(spark, sf_dir).select("paper_id", "rel_path", lx.with_cjk_preamble("content").alias("content"))
    return once.select("paper_id", "rel_path", lx.with_cjk_preamble("content").alias("content"))  # a second run changes nothing


# ---------------------------------------------------------------- tasks and progress


@query(
    f"""with {fx.TASKS_SQL} select task_id, coalesce(nullif(title, ''), nullif(source, ''), task_id) as label, status, created_at,
  strftime(to_timestamp(created_at) at time zone 'UTC', '%Y-%m-%d %H:%M') as created from tasks"""
)
def task_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.history(fx.tasks(spark, sf_dir))


_ART = """
arts as (
  select k, workdir, case k % 6 when 2 then 'p' || k || '_cn_wm.pdf' when 4 then 'p' || k || '_cn_wm.pdf' when 1 then 'p' || k || '_cn.pdf' when 3 then 'p' || k || '_cn.pdf' end as cn,
    case when k % 6 in (3, 4) then 'p' || k || '_bilingual.pdf' end as bi, case when k % 6 = 4 then 'p' || k || '_orig.pdf' end as orig from tasks
)"""


@query(
    f"""with {fx.TASKS_SQL}, {_ART} select workdir, workdir || '/output/' || cn as translated_pdf, workdir || '/output/' || bi as bilingual_pdf, workdir || '/output/' || orig as original_pdf
from arts where k % 6 between 1 and 4"""
)
def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.artifact_paths(fx.artifacts(spark, sf_dir))


@query(
    f"""with {fx.TASKS_SQL}, {_ART}, joined as (
  select t.*, a.cn, a.bi, a.orig, t.status not in ('running', 'queued') and a.cn is not null as touched from tasks t join arts a using (k)
), new as (
  select task_id, status, error, case when touched then workdir || '/output/' || cn else translated_pdf end as translated_pdf, translated_pdf as old,
    case when touched then workdir || '/output/' || bi end as bilingual_pdf, case when touched then workdir || '/output/' || orig end as original_pdf, touched from joined
)
select task_id, case when touched then 'done' else status end as status, case when touched and status <> 'done' then null else error end as error,
  translated_pdf, bilingual_pdf, original_pdf, touched as changed from new"""
)
def reconcile_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tasks.reconcile(fx.tasks(spark, sf_dir), fx.artifacts(spark, sf_dir))
    return done.select("task_id", "status", "error", "translated_pdf", "bilingual_pdf", "original_pdf", "changed")


@query(f"with {fx.TASKS_SQL}, {_ART} select count(*) filter (where status not in ('running', 'queued') and cn is not null) as changed, count(*) as total from tasks join arts using (k)")
def reload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.reload_counts(tasks.reconcile(fx.tasks(spark, sf_dir), fx.artifacts(spark, sf_dir)))


@query(
    f"""with {fx.TASKS_SQL} select task_id, case when status in ('running', 'queued') then 'failed' else status end as status, case when status in ('running', 'queued') then 'failed' else status end as stage,
  case when status in ('running', 'queued') then '{tasks.INTERRUPTED}' else error end as error from tasks"""
)
def interrupted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.interrupted(fx.tasks(spark, sf_dir)).select("task_id", "status", "stage", "error")


@query(f"with {fx.TASKS_SQL} select task_id, case when k % 3 = 0 then 'done' else status end as status, case when k % 3 = 0 then 'new' else 'm' end as message from tasks")
def upsert_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.tasks(spark, sf_dir)
    new = old.where(F.substring("task_id", 2, 20).cast("long") % 3 == 0).withColumn("status", F.lit("done")).withColumn("message", F.lit("new"))
    return tasks.upsert(old, new).select("task_id", "status", "message")


@query(
    f"""with {fx.TASKS_SQL} select task_id, current as progress_current, total as progress_total, case when total > 0 then floor(current / total * 100 + 0.5) else 0 end::bigint as percent,
  case when translated_pdf is not null then '/api/tasks/' || task_id || '/download/translated' end as translated,
  case when status = 'failed' then 'failed' when status = 'done' then 'done' else 'active' end as first_step from tasks"""
)
def status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tasks.status_view(fx.tasks(spark, sf_dir))
    return v.select(
        "task_id", "progress_current", "progress_total", "percent", F.col("artifacts.translated_pdf").alias("translated"), lx.step_state("status", "stage", 0).alias("first_step")
    )


LATEST_SQL = """with p as (
  select user_id::varchar as task_id, event_id as seq, case event_type when 'signup' then 'queued' when 'view' then 'downloading' when 'click' then 'translating' when 'purchase' then 'done' else 'failed' end as stage,
    event_id % 11 as current, case when event_id % 13 = 0 then 0 else 10 end as total from events
), pick as (select *, row_number() over (partition by task_id order by case when stage in ('done', 'failed') then 0 else 1 end, case when stage in ('done', 'failed') then seq else -seq end) as n from p)
select task_id, seq, stage, current, total, case when total <> 0 then current / total else 0.0 end::double as fraction,
  case when stage in ('done', 'failed') then stage when stage = 'queued' then 'queued' else 'running' end as status from pick where n = 1"""
_PROGRESS = ["task_id", "seq", "stage", "current", "total", "fraction", "status"]


@query(LATEST_SQL)
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest_progress(fx.progress(spark, sf_dir)).select(*_PROGRESS)


@query(LATEST_SQL)
def latest_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the events, run until its input is used up; states are saved batch by batch and read back."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    base = f"{shared_dir(spark)}/texloom/progress-{uuid.uuid4().hex}"
    progress.save_states(fx.progress_of(stream), f"{base}/states", f"{base}/checkpoint")
    return progress.saved_states(spark.read.parquet(f"{base}/states")).select(*_PROGRESS)


@query(
    """select epoch(time_bucket(interval '10 minutes', ts))::bigint as start, case event_type when 'signup' then 'queued' when 'view' then 'downloading' when 'click' then 'translating' when 'purchase' then 'done' else 'failed' end as stage,
  count(*) as events from events group by all"""
)
def stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each stage in windows of ten minutes."""
    return progress.recent_progress(fx.progress(spark, sf_dir)).select(F.unix_timestamp("window.start").alias("start"), "stage", "events")


FEED_SQL = """with p as (
  select user_id::varchar as task_id, event_id as seq, case event_type when 'signup' then 'queued' when 'view' then 'downloading' when 'click' then 'translating' when 'purchase' then 'done' else 'failed' end as stage,
    case event_type when 'signup' then 0 when 'view' then 1 when 'click' then 3 else 99 end as n from events
), seen as (
  select *, coalesce(bool_or(n = 99) over w, false) as ended, coalesce(max(n) over w, 0) as top from p window w as (partition by task_id order by seq rows between unbounded preceding and 1 preceding)
)
select task_id, seq, stage, case when ended then 'after end' when n < top then 'backwards' end as reason from seen"""


@query(FEED_SQL)
def task_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the stream as an update or rejected with a reason, judged by one stateful query."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    base = f"{shared_dir(spark)}/texloom/feed-{uuid.uuid4().hex}"
    task_feed.subscribe(fx.progress_of(stream), f"{base}/out", f"{base}/checkpoint", late="3650 days")
    updates = spark.read.parquet(f"{base}/out/updates").withColumn("reason", F.lit(None).cast("string"))
    return updates.unionByName(spark.read.parquet(f"{base}/out/rejected")).select("task_id", "seq", "stage", "reason")
