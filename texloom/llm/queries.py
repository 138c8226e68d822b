"""Queries over the given tables, one for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.llm import (
    bpe, byte_dedup, decontaminate, lexical_search, line_dedup, near_dedup, pii, quality_crf, quality_rules, substring_dedup, url_filter, warc, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, rule)
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = r"""
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), rules(rule, verdict, rule_host, rule_path) as (
  values ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
    ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), fits as (
  select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule) desc) as k
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f on f.page_id = p.page_id and f.k = 1
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.as_text("base").cast("binary"), 256).alias("base_sha256"),
        pii.as_text("spans").alias("spans"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(hits).drop("text_key")


#: Words of a text as a list, A-Z lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
with items as (select item_id, ws, least(13, len(ws)) as k from (select item_id, {_WORDS} as ws from benchmark) where len(ws) > 0
), windows as (
  select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as seq from (select *, unnest(generate_series(1, len(ws) - k + 1)) as i from items)
), docs as (select doc_id, {_WORDS} as ws from documents
), starts as (
  select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as seq
  from (select doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as i from docs, (select distinct k from windows) where len(ws) >= k)
), hits as (select doc_id, i, s.k, item_id from starts s join windows w on s.k = w.k and s.seq = w.seq
), words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + k - 1)) as j from hits) group by doc_id
), found as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id
)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.ws) as contaminated
from docs d left join words using (doc_id) left join found using (doc_id)
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
with lines as (
  select doc_id, pos - 1 as pos, parts[pos] as line
  from (select doc_id, parts, unnest(generate_series(1, len(parts))) as pos
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
), runs as (
  select doc_id, pos, line,
    lead(line, 1) over w as b, lead(line, 2) over w as c,
    lead(pos, 2) over w as last
  from lines window w as (partition by doc_id order by pos)
), starts as (
  select doc_id, pos, row_number() over (partition by line, b, c order by doc_id, pos) as nth
  from runs where last is not null
), marked as (
  select l.doc_id, l.pos, l.line,
    exists (select 1 from starts s where s.nth > 1 and s.doc_id = l.doc_id and s.pos between l.pos - 2 and l.pos) as gone
  from lines l
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op5_line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op5_line_dedup; shorter runs of `MIN_CHARS` characters or more go too."""
    out = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents"), min_chars=line_dedup.MIN_CHARS, counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_PASSAGES_SQL = r"""
with lines as (
  select doc_id, pos - 1 as pos, parts[pos] as line
  from (select doc_id, parts, unnest(generate_series(1, len(parts))) as pos
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
), runs as (
  select doc_id, pos, line, lead(line, 1) over w as b, lead(line, 2) over w as c
  from lines window w as (partition by doc_id order by pos)
), starts as (
  select doc_id, pos, line,
    length(line) >= 20 and row_number() over (partition by line order by doc_id, pos) > 1 as one,
    b is not null and length(line) + length(b) >= 20 and row_number() over (partition by line, b order by doc_id, pos) > 1 as two,
    c is not null and row_number() over (partition by line, b, c order by doc_id, pos) > 1 as three
  from runs
), marked as (
  select doc_id, pos, line,
    one or two or three or lag(two or three, 1, false) over w or lag(three, 2, false) over w as gone
  from starts window w as (partition by doc_id order by pos)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
  case when strlen(coalesce(html, '')) >= 100 and page_id > min(page_id) over (partition by coalesce(html, ''))
    then 'revisit' else 'response' end as record_type,
  case when strlen(coalesce(html, '')) >= 100 and page_id > min(page_id) over (partition by coalesce(html, ''))
    then min(page_id) over (partition by coalesce(html, '')) end as refers_to
from pages
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(_table(spark, sf_dir, "documents"), threshold=85)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from texloom.llm.store import written

    stats = written(quality_rules.document_stats(_table(spark, sf_dir, "documents")), "op8-stats")
    rules = quality_rules.fit(stats, _table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(stats, rules)
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "rule", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), starts as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as seq from (select doc_id, ws, unnest(generate_series(1, len(ws) - 12)) as i from docs where len(ws) >= 13)
), later as (select doc_id, i from (select *, min(doc_id) over (partition by seq) as low from starts) where low < doc_id
), gone as (select distinct doc_id, unnest(generate_series(i, i + 12)) as i from later
), words as (select doc_id, i, ws[i] as word from (select doc_id, ws, unnest(generate_series(1, len(ws))) as i from docs)
), kept as (
  select w.doc_id, count(g.i) as n_removed, string_agg(case when g.i is null then word end, ' ' order by w.i) as text from words w left join gone g on w.doc_id = g.doc_id and w.i = g.i group by w.doc_id
)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from docs d left join kept k using (doc_id)
"""


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
with docs as (select row_number() over () as d, doc_id, {_WORDS} as ws from documents
), items as (select row_number() over () as q, item_id, {_WORDS} as ws from benchmark
), corpus as (select count(*) as n_docs, sum(len(ws))::bigint as n_terms from docs where len(ws) > 0
), postings as (select d, term, count(*) as tf from (select d, unnest(ws) as term from docs) group by d, term
), asked as (select q, term, count(*) as often from (select q, unnest(ws) as term from items) group by q, term
), weighed as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w
  from (select term, count(*) as df from postings where term in (select term from asked) group by term), corpus
), impacts as (
  select d, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ws) * n_docs) // n_terms))) as impact
  from postings join weighed using (term) join docs using (d), corpus
), scores as (select q, d, sum(often * impact)::bigint as score from asked join impacts using (term) group by q, d
), ranked as (
  select item_id, (row_number() over (partition by q order by score desc, doc_id))::int as rank, doc_id, score
  from scores join items using (q) join docs using (d) where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""


def op12_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = byte_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
with docs as (select row_number() over () as d, doc_id, encode(coalesce(text, '')) as b from documents
), starts as (
  select d, doc_id, i, b[i:i + 49] as string from (select d, doc_id, b, unnest(generate_series(1, octet_length(b) - 49)) as i from docs where octet_length(b) >= 50)
), later as (select d, i from (select d, doc_id, i, min(doc_id) over (partition by string) as low from starts) where low < doc_id
), runs as (
  select d, min(i) as a, max(i) + 50 as z
  from (select d, i, sum(fresh) over (partition by d order by i) as run
        from (select d, i, case when i > lag(i, 1, -50) over (partition by d order by i) + 50 then 1 else 0 end as fresh from later))
  group by d, run
), gaps as (
  select d, lag(z, 1, 1) over w as a, a - 1 as z, z - a as n from runs window w as (partition by d order by a)
  union all select d.d, coalesce(max(z), 1), max(octet_length(b)), 0 from docs d left join runs r on r.d = d.d group by d.d
), pieces as (select g.d, g.a, g.n, hex(b[g.a:g.z]) as piece, g.z >= g.a as held from gaps g join docs using (d)
), kept as (select d, sum(n)::bigint as n_removed, count(*) - 1 as n_spans, coalesce(string_agg(case when held then piece end, '' order by a), '') as rest from pieces group by d)
select doc_id, octet_length(b)::bigint as n_bytes, n_removed, n_spans, sha256(unhex(rest)) as kept_sha256 from docs join kept using (d)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op5_line_dedup_passages": op5_line_dedup_passages,
    "op6_warc": op6_warc,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_crf": op10_quality_crf,
    "op11_lexical_search": op11_lexical_search,
    "op12_byte_dedup": op12_byte_dedup,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op5_line_dedup_passages": OP5_PASSAGES_SQL,
    "op6_warc": OP6_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_byte_dedup": OP12_SQL,
}
