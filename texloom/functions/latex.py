"""Column functions over LaTeX text: repair and checks of translated segments, titles, preambles.

All take and return columns and stay inside the JVM. Patterns avoid engine differences: `.`
never stands for "any character but a newline", and `\\b` is only used next to ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values of the formats -------------------------------------------------------------
#: Commands whose number must not change in a translation.
STRUCTURAL = ["begin", "end", "item", "squishlist", "squishlisttwo", "squishend", "itemize", "enumerate", "description"]
#: Phrases by which a model talks about the task instead of translating.
META_MARKS = [
    "请提供", "需要翻译的", "以下是翻译", "翻译如下", "翻译结果", "的中文翻译", "抱歉", "无法翻译",
    "作为AI", "作为一个AI", "作为一名AI", "作为语言模型", "作为一个语言模型", "[Local Message]", "Traceback", "```",
]
STRAY_TAGS = ["章节标题", "图表标题", "注释", "摘要", "标题", "正文", "段落", "title", "caption", "section"]
CODE_ENVS = ["verbatim", "Verbatim", "lstlisting", "minted", "algorithm", "algorithmic", "algorithm2e"]
STANDARD_CLASSES = ["article", "report", "book", "beamer"]
CTEX_LINES = "% 中文支持\n\\usepackage[UTF8]{ctex}"
ID_PATTERNS = [
    r"arxiv\.org/abs/(\d+\.\d+)", r"arxiv\.org/abs/(\d+)", r"arxiv\.org/pdf/(\d+\.\d+)", r"arxiv\.org/pdf/(\d+)",
    r"arXiv:(\d+\.\d+)", r"arXiv:(\d+)", r"^(\d+\.\d+)(?:v\d+)?$", r"^(\d{4}\.\d{4,5})(?:v\d+)?$",
]
GUARDED_PACKAGES = [
    r"\\RequirePackage\[[^\]]*\]\{inputenc\}", r"\\RequirePackage\[T1\]\{fontenc\}", r"\\RequirePackage\{XCharter\}",
    r"\\RequirePackage\[xcharter[^\]]*\]\{newtxmath\}", r"\\RequirePackage\[scaled=[0-9.]+\]\{zlmtt\}", r"\\RequirePackage\{mathptmx\}",
    r"\\RequirePackage\{times\}", r"\\RequirePackage\{palatino\}", r"\\RequirePackage\{tgtermes\}", r"\\RequirePackage\{newtxtext\}",
    r"\\RequirePackage\{newtxmath\}",
]
PDFTEX_LINES = [r"\\pdfoutput\s*=\s*\d+", r"\\DisableLigatures(?:\[[^\]]*\])?\{[^}]*\}"]
DOWNLOAD_SUFFIX = {"bilingual": "_中英对照", "original": "_原文"}
TRANSLATED_SUFFIX = "_中文"
STAGES = ["downloading", "splitting", "translating", "merging", "compiling", "bilingual", "done"]
CJK = r"[\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
IDEOGRAPH = r"[\x{4E00}-\x{9FFF}]"
TITLE_OPENS = r"(?ms)^[^%\n]*?\\title\s*(?:\[[^\]]*\])?\s*\{"
SIMPLE_MACRO = r"\\newcommand\s*\{?\\([a-zA-Z]+)\}?\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*+)\}"
FORMULA = r"(?s)\$.*?\$"
PLAIN_TEXT_RULES = [
    (r"\\(?:thanks|footnote|label)\{[^}]*\}", ""), (r"\\\\(?:\[[^\]]*\])?", " "), (r"\\[a-zA-Z]+\*?", ""),
    (r"[{}]", ""), (r"\$[^$]*\$", ""), (r"(?U)\s+", " "),
]
NUDGE = "上一轮返回为空或未翻译。请严格按规则把下面这段翻译成{lang},直接输出译文,不要解释:\n\n"
# ----------------------------------------------------------------------------------------------


def c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c(col), r"(?U)^\s+|(?<!\s)\s+$", "")


def any_of(words: list[str]) -> str:
    return "|".join("\\Q" + w + "\\E" for w in words)


def below(path: str | Column, root: str) -> Column:
    """A file's path from the folder `root` on; scheme and host of both don't matter."""
    place = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*"
    top = re.sub(place, "/", root).rstrip("/") + "/"
    return F.substring(F.regexp_replace(c(path), place, "/"), len(top) + 1, 1 << 30)


# ---- identifiers, hashes, sizes ----


def arxiv_id(url: str | Column) -> Column:
    """The paper's number without its version: the first pattern that fits, or null."""
    text = strip(url)
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ID_PATTERNS])


def work_key(source: str | Column) -> Column:
    """arXiv number, else the last part of the path, else `task`."""
    last = F.regexp_extract(F.regexp_replace(c(source), r"/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(arxiv_id(source), F.nullif(F.when(last != ".", last), F.lit("")), F.lit("task"))


def content_hash(content: str | Column) -> Column:
    return F.md5(c(content).cast("binary"))


def cache_key(rel_path: str | Column) -> Column:
    return F.substring(content_hash(rel_path), 1, 16)


def token_estimate(text: str | Column) -> Column:
    """A third of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c(text)) / 3)).cast("long")


# ---- running sums over an array ----


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(values: Column) -> Column:
    """An array cut into about as many blocks as each has elements, so that arrays grown inside one stay short."""

    def cut(v: Column, n: Column) -> Column:
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / n).cast("int")), lambda b: F.slice(v, b * n + 1, n))).otherwise(F.array(v))

    return let(values, lambda v: let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int")), lambda n: cut(v, n)))


def scanned(blocks: Column, zero: Column, total: Callable[[Column], Column], join: Callable[[Column, Column], Column], grown: Callable[[Column, Column], Column]) -> Column:
    """`grown` of each block with the state before it, where `join` takes a state over a block's `total`: a scan in two levels."""

    def offsets(totals: Column) -> Column:
        start = F.struct(zero.alias("now"), F.array_remove(F.array(zero), zero).alias("out"))
        step = lambda a, t: F.struct(join(a["now"], t).alias("now"), F.array_append(a["out"], a["now"]).alias("out"))
        return F.aggregate(totals, start, step, lambda a: a["out"])

    return let(blocks, lambda bs: F.zip_with(bs, offsets(F.transform(bs, total)), grown))


def running_sums(values: Column) -> Column:
    """For each whole number (long) of an array the sum of those before it."""
    zero, none = F.lit(0).cast("long"), F.expr("cast(array() as array<long>)")

    def grown(block: Column, before: Column) -> Column:
        step = lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out"))
        return F.aggregate(block, F.struct(before.alias("sum"), none.alias("out")), step, lambda a: a["out"])

    total = lambda block: F.aggregate(block, zero, lambda a, v: a + v)
    return F.flatten(scanned(in_blocks(values), zero, total, lambda a, t: a + t, grown))


# ---- checks of segments ----


def without_commands(text: str | Column) -> Column:
    return F.regexp_replace(c(text), r"\\[a-zA-Z]+|[{}]", " ")


def has_word(text: str | Column) -> Column:
    """Two Latin letters in a row or an ideograph, outside of commands."""
    return without_commands(text).rlike(r"[A-Za-z]{2,}|" + IDEOGRAPH)


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def brace_balance(text: str | Column) -> Column:
    """Opening less closing braces; a backslash takes the next character with it."""
    t = F.regexp_replace(c(text), r"(?s)\\.", "")
    return count_of(t, "{") - count_of(t, "}")


def structural_commands(text: str | Column) -> Column:
    """Sorted array of the structural commands, lower-cased, with repeats."""
    names = F.transform(F.regexp_extract_all(c(text), F.lit(r"\\([a-zA-Z]+)"), F.lit(1)), F.lower)
    return F.array_sort(F.filter(names, lambda n: n.isin(STRUCTURAL)))


def is_meta(text: str | Column) -> Column:
    """Blank, or talk about the task."""
    return (strip(text) == "") | c(text).rlike(any_of(META_MARKS))


def is_failed(original: str | Column, translated: str | Column) -> Column:
    """Null or blank, or the source given back although it has a word of three letters."""
    same = (strip(translated) == strip(original)) & without_commands(original).rlike("[A-Za-z]{3,}")
    return F.coalesce((strip(translated) == "") | same, F.lit(True))


def needs_retranslation(source: str | Column, translated: str | Column) -> Column:
    """A source of some length in Latin letters whose translation has no ideograph; stacks of commands don't count."""
    s = strip(source)
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    commands_only = s.startswith("\\") & (count_of(s, "\\") > 3) & ~s.rlike(r"[.!?](?U:\s)")
    return (F.length(s) >= 40) & (letters > 15) & ~F.coalesce(c(translated), F.lit("")).rlike(IDEOGRAPH) & ~commands_only


# ---- repair of segments ----


def strip_tags(text: str | Column) -> Column:
    """Without the bracketed labels that models put in front."""
    return F.regexp_replace(c(text), r"(?iU)^(?:\s*\[(?:" + "|".join(STRAY_TAGS) + r")\]\s*)+", "")


def drop_blank_in_arguments(text: str | Column) -> Column:
    """Blank lines go where braces of earlier lines are open (the depth never falls below 0).

    A block of lines takes a depth d to the larger of d + sum and sum - lowest, where `lowest` is the least of its
    running sums; these pairs are composed block by block, then each block drops its own lines.
    """
    lines = F.transform(F.split(c(text), "\n", -1), lambda x: F.struct(x.alias("text"), brace_balance(x).alias("n")))
    pair = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low"))

    def total(block: Column) -> Column:
        return F.aggregate(block, pair, lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.least(a["low"], a["sum"] + x["n"]).alias("low")))

    def kept(block: Column, before: Column) -> Column:
        state = F.struct(before.alias("depth"), F.expr("cast(array() as array<string>)").alias("kept"))

        def step(a: Column, x: Column) -> Column:
            skip = (a["depth"] > 0) & x["text"].rlike(r"^(?U:\s*)$")
            return F.when(skip, a).otherwise(F.struct(F.greatest(F.lit(0), a["depth"] + x["n"]).alias("depth"), F.array_append(a["kept"], x["text"]).alias("kept")))

        return F.aggregate(block, state, step, lambda a: a["kept"])

    after = lambda d, t: F.greatest(d + t["sum"], t["sum"] - t["low"])
    done = F.array_join(F.flatten(scanned(in_blocks(lines), F.lit(0), total, after, kept)), "\n")
    return F.when(c(text).rlike(r"\n(?U:[\s&&[^\n]]*)(?:\n|$)") & c(text).contains("{"), done).otherwise(c(text))


def escape_percent(text: str | Column) -> Column:
    return F.regexp_replace(c(text), r"(?<!\\)%", r"\\%")


def escape_scripts(text: str | Column) -> Column:
    """Bare `_` and `^` get a backslash outside of `$…$`."""
    outside = F.transform(F.split(c(text), FORMULA, -1), lambda x: F.regexp_replace(x, r"(?<!\\)([_^])", r"\\$1"))
    inside = F.regexp_extract_all(c(text), F.lit(FORMULA), F.lit(0))
    return F.array_join(F.zip_with(outside, inside, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def join_commands(text: str | Column) -> Column:
    """Blanks between a command and its brace, or between backslash and command, go."""
    out = F.regexp_replace(c(text), r"\\([a-zA-Z]{2,})[ \t]+\{", r"\\$1{")
    return F.regexp_replace(out, r"\\[ \t]+([a-zA-Z]{2,})\{", r"\\$1{")


def space_after_item(text: str | Column) -> Column:
    return F.regexp_replace(c(text), r"(\\item)(?=(?U:[^\s\[]))", "$1 ")


def separate_cjk(text: str | Column) -> Column:
    """`{}` between a command and an ideograph or wide mark right after it."""
    return F.regexp_replace(c(text), r"(\\[a-zA-Z]+)(?=" + CJK + ")", "$1{}")


def balanced_prefix(text: str | Column) -> Column:
    """The longest prefix with as many opening as closing braces: over the text cut at braces,
    the end of the last piece at which the sum is 0. A backslash takes the next character with it."""
    pieces = F.regexp_extract_all(c(text), F.lit(r"(?s)[^\\{}]++|\\.|\\$|[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("cut"))

    def step(a: Column, p: Column) -> Column:
        depth = a["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        at = a["at"] + F.length(p)
        # an escape counts as passed only together with a plain character or brace after it
        cut = F.when((depth == 0) & ~p.startswith("\\"), at).otherwise(a["cut"])
        return F.struct(depth.alias("depth"), at.alias("at"), cut.alias("cut"))

    return F.aggregate(pieces, start, step, lambda a: F.left(c(text), a["cut"]))


def with_repaired(df: DataFrame, original: str, translated: str, to: str = "fixed", outcome: str = "outcome") -> DataFrame:
    """`df` with the repaired translation and what came of it: ok, missing, meta, structure, partial or original.

    Each step is a column of its own, as a nested expression would be evaluated again for each use.
    """
    out = df.withColumn("_a", drop_blank_in_arguments(strip_tags(translated))).withColumn("_b", escape_percent("_a")).withColumn("_c", escape_scripts("_b"))
    out = out.withColumn("_d", separate_cjk(space_after_item(join_commands("_c"))))
    out = out.withColumn("_same", structural_commands("_d") == structural_commands(original)).withColumn("_even", brace_balance("_d") == brace_balance(original))
    found = F.when(c(translated).isNull(), "missing").when(is_meta(translated), "meta").when(~F.col("_same"), "structure").when(F.col("_even"), "ok")
    out = out.withColumn("_o", found).withColumn("_p", F.when(F.col("_o").isNull(), balanced_prefix("_d")))
    out = out.withColumn("_o", F.coalesce("_o", F.when(F.col("_p") == "", "original").otherwise("partial")))
    text = F.when(F.col("_o") == "ok", F.col("_d")).when(F.col("_o") == "partial", F.concat("_p", F.lit(" "), c(original))).otherwise(c(original))
    return out.withColumn(to, text).withColumn(outcome, F.col("_o")).drop("_a", "_b", "_c", "_d", "_same", "_even", "_o", "_p")


def repaired(original: Column, translated: Column) -> Column:
    """`with_repaired` of values inside an array: (fixed, outcome). Each step is evaluated once."""

    def partial(prefix: Column) -> Column:
        none = prefix == ""
        return F.struct(F.when(none, original).otherwise(F.concat(prefix, F.lit(" "), original)).alias("fixed"), F.when(none, "original").otherwise("partial").alias("outcome"))

    def judged(fixed: Column) -> Column:
        same, even = structural_commands(fixed) == structural_commands(original), brace_balance(fixed) == brace_balance(original)
        found = F.when(translated.isNull(), "missing").when(is_meta(translated), "meta").when(~same, "structure").when(even, "ok")
        whole = lambda o: F.struct(F.when(o == "ok", fixed).otherwise(original).alias("fixed"), o.alias("outcome"))
        return let(found, lambda o: F.when(o.isNotNull(), whole(o)).otherwise(let(balanced_prefix(fixed), partial)))

    steps = [lambda t: drop_blank_in_arguments(strip_tags(t)), escape_percent, escape_scripts, lambda t: separate_cjk(space_after_item(join_commands(t)))]
    return reduce(lambda then, step: lambda t: let(step(t), then), reversed(steps), judged)(translated)


def collapse_document(text: str | Column) -> Column:
    """`drop_blank_in_arguments` outside of code environments, and no blank lines right after `\\begin{…}`."""
    code = r"(?s)\\begin\{(" + "|".join(CODE_ENVS) + r")\}.*?\\end\{\1\}"
    outside = F.transform(F.split(c(text), code, -1), drop_blank_in_arguments)
    inside = F.regexp_extract_all(c(text), F.lit(code), F.lit(0))
    joined = F.array_join(F.zip_with(outside, inside, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.regexp_replace(joined, r"(\\begin\{[^}]+\})\n[ \t]*\n+", "$1\n")


# ---- titles and names ----


def plain_text(text: str | Column) -> Column:
    """Readable text of a LaTeX string."""
    out = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), PLAIN_TEXT_RULES, c(text))
    return strip(F.regexp_replace(strip(out), r"^[:：\-—　 ]+", ""))


def simple_macros(content: str | Column) -> Column:
    """Map of argument-free macros to their plain text of 1 to 40 characters; the last definition counts."""
    names, bodies = (F.regexp_extract_all(c(content), F.lit(SIMPLE_MACRO), F.lit(g)) for g in (1, 2))
    pairs = F.filter(F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("n"), plain_text(b).alias("v"))), lambda p: F.length(p["v"]).between(1, 40))
    none = F.expr("cast(array() as array<struct<n:string,v:string>>)")
    last = F.aggregate(pairs, none, lambda a, p: F.array_append(F.filter(a, lambda q: q["n"] != p["n"]), p))
    return F.map_from_entries(last)


def expand_macros(text: str | Column, macros: str | Column) -> Column:
    """Each `\\name`, with `{}` after it or at a word's end, becomes its text."""

    def step(t: Column, e: Column) -> Column:
        t = F.replace(t, F.concat(F.lit("\\"), e["key"], F.lit("{}")), e["value"])
        t = F.replace(t, F.concat(F.lit("\\"), e["key"], F.lit(" ")), F.concat(e["value"], F.lit(" ")))
        return F.regexp_replace(t, F.concat(F.lit(r"\\"), e["key"], F.lit(r"(?![A-Za-z0-9_])")), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))

    return F.aggregate(F.map_entries(c(macros)), c(text), step)


def rests(text: str | Column, pattern: str) -> Column:
    """What follows each match of a pattern, up to the end of the text."""
    before = F.transform(F.split(c(text), pattern, -1), F.length)
    opens = F.transform(F.regexp_extract_all(c(text), F.lit(pattern), F.lit(0)), F.length)
    ends = F.zip_with(F.slice(before, 1, F.size(opens)), opens, lambda a, b: (a + b).cast("long"))
    return let(c(text), lambda t: F.zip_with(running_sums(ends), ends, lambda a, n: F.substring(t, (a + n + 1).cast("int"), F.length(t))))


def argument(text: str | Column) -> Column:
    """The text up to the brace that closes an argument opened before it, at any depth; null where none does.

    Depth runs over the text cut at braces; a backslash takes the next character with it.
    """
    pieces = F.regexp_extract_all(c(text), F.lit(r"(?s)[^\\{}]++|\\.|\\$|[{}]"), F.lit(0))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("cut"))

    def step(a: Column, p: Column) -> Column:
        depth = a["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        cut = F.when((a["cut"] < 0) & (depth == 0), a["at"]).otherwise(a["cut"])
        return F.struct(depth.alias("depth"), (a["at"] + F.length(p)).alias("at"), cut.alias("cut"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["cut"] >= 0, F.left(c(text), a["cut"])))


def title(content: str | Column) -> Column:
    """Plain text of the first uncommented title that isn't empty, or null; braces may nest to any depth."""

    def first(macros: Column) -> Column:
        found = F.transform(rests(content, TITLE_OPENS), lambda rest: plain_text(expand_macros(argument(rest), macros)))
        return F.get(F.filter(found, lambda t: t != ""), F.lit(0))

    return let(simple_macros(content), first)


# ---- paths ----


def path_parts(path: str | Column) -> Column:
    """The parts of a path, which order files as folders do: `sec/a.tex` before `sec-x/a.tex`."""
    return F.split(c(path), "/", -1)


def download_name(title_: str | Column, kind: str | Column, file_name: str | Column) -> Column:
    """A safe file name from the title, or the file's own name."""
    safe = strip(F.regexp_replace(F.regexp_replace(c(title_), r'[\\/:*?"<>|]', " "), r"(?U)\s+", " "))
    safe = strip(F.substring(safe, 1, 120))
    suffix = reduce(lambda e, kv: F.when(c(kind) == kv[0], kv[1]).otherwise(e), DOWNLOAD_SUFFIX.items(), F.lit(TRANSLATED_SUFFIX))
    return F.when(F.coalesce(safe, F.lit("")) == "", c(file_name)).otherwise(F.concat(safe, suffix, F.lit(".pdf")))


# ---- preambles and class files ----


def has_cjk_package(content: str | Column) -> Column:
    """Whether an uncommented line loads xeCJK or ctex."""
    live = lambda line: F.regexp_replace(line, r"(?<!\\)%[^\n]*$", "")
    return F.exists(F.split(c(content), "\n", -1), lambda line: live(line).rlike(r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\b(?:xeCJK|ctex)\b[^}]*\}"))


def with_cjk_preamble(content: str | Column, xecjk_lines: str = "\\usepackage{xeCJK}") -> Column:
    """CJK support after the first live `\\documentclass` line; unchanged where it is there already."""
    doc_class = strip(F.regexp_extract(c(content), r"\\documentclass[^\n]*?\{([^}]+)\}", 1))
    lines = F.split(c(content), "\n", -1)
    live = lambda line: line.contains("\\documentclass") & ~line.rlike(r"^(?U:\s*)%")
    at = F.coalesce(F.array_position(F.transform(lines, live), True), F.lit(0)).cast("int")
    config = F.when((doc_class == "") | doc_class.isin(STANDARD_CLASSES), F.lit(CTEX_LINES)).otherwise(F.lit(xecjk_lines.strip()))
    n = F.greatest(F.size(lines), F.lit(1))
    new = F.array_join(F.concat(F.slice(lines, 1, at), F.array(F.lit(""), config, F.lit("")), F.slice(lines, at + 1, n)), "\n")
    return F.when(has_cjk_package(content) | (at == 0), c(content)).otherwise(new)


def guarded_class_file(content: str | Column) -> Column:
    """Font packages only outside of XeTeX, pdfTeX-only lines only under pdfTeX."""
    guarded = r"\\ifdefined\\XeTeXversion\\else" + "\n$1\n" + r"\\fi"
    out = reduce(lambda t, p: F.regexp_replace(t, f"({p})", guarded), GUARDED_PACKAGES, c(content))
    return reduce(lambda t, p: F.regexp_replace(t, r"(?m)^([ \t]*)(" + p + r")[ \t]*$", r"$1\\ifdefined\\pdfoutput $2 \\fi"), PDFTEX_LINES, out)


# ---- progress and status ----


def fraction(current: str | Column, total: str | Column) -> Column:
    return F.when(c(total) != 0, c(current) / c(total)).otherwise(F.lit(0.0))


def percent(current: str | Column, total: str | Column) -> Column:
    """Rounded half up; 0 without a positive total."""
    return F.when(c(total) > 0, F.floor(c(current) / c(total) * 100 + 0.5)).otherwise(F.lit(0)).cast("long")


def stage_index(stage: str | Column) -> Column:
    return F.coalesce(*[F.when(c(stage) == s, F.lit(i)) for i, s in enumerate(STAGES)], F.lit(0))


def step_state(status: str | Column, stage: str | Column, step: int) -> Column:
    """done, active, failed or pending: how a step shows for a task."""
    active = F.when(c(status) == "done", len(STAGES) - 1).otherwise(stage_index(stage))
    return (
        F.when((c(status) == "failed") & (active == step), "failed").when((active > step) | (c(status) == "done"), "done").when(active == step, "active").otherwise("pending")
    )


def history_label(title_: str | Column, source: str | Column, task_id: str | Column) -> Column:
    return F.coalesce(F.nullif(c(title_), F.lit("")), F.nullif(c(source), F.lit("")), c(task_id))
