"""Segmentation of LaTeX sources: protected and translatable runs, nodes, chunks.

`runs_of` indexes a document's braces, commands and environments in one pass. An ordered table of
rules (`RULES`) selects stretches from that index; each lays layers, closed or open, on the text, and a sweep
over the layers' ends gives the runs, where the layer laid last shows. What is no text inside an opened stretch is only
looked up where no stretch opened later lies on it, so deep nesting costs no more than its length. Nesting makes it the one
per-document helper. From its runs on, everything is arrays in the document's row: cleaning, merging and
line numbers need no shuffle, and a node table comes from one `posexplode`.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions import latex as lx

# ---- fixed values: names of environments and commands, in the order in which rules apply ----
TRANSPARENT = {
    "center", "centering", "textbf", "textit", "emph", "text", "texttt", "textsc", "textsf", "textrm", "underline",
    "bf", "it", "sc", "sl", "large", "Large", "LARGE", "huge", "Huge", "small", "footnotesize", "normalsize",
    "mbox", "hbox", "textnormal", "mathrm", "texorpdfstring",
}
MATH_ENVS = ["equation", "align", "aligned", "multline", "gather", "eqnarray", "math", "displaymath", "array", "cases", "split", "flalign"]
FLOAT_ENVS = [
    "figure", "table", "wrapfigure", "wraptable", "sidewaystable", "sidewaysfigure", "subfigure", "tabular", "tabularx", "longtable",
]
VERBATIM_ENVS = ["lstlisting", "verbatim", "minted", "Verbatim", "algorithm", "algorithmic"]
AUTHOR_ENVS = ["icmlauthorlist", "authorlist", "authors", "author", "authblk"]
AUTHOR_COMMANDS = [
    "author", "icmlauthor", "icmlcorrespondingauthor", "icmlaffiliation", "icmlsetsymbol", "affiliation", "affil",
    "address", "email", "thanks", "inst", "institute",
]
OPEN_ANYWHERE = ["caption", "subcaption", "title", "abstract", "titlesubtitle"]
OPEN_IN_BODY = [
    "section", "section*", "subsection", "subsection*", "subsubsection", "subsubsection*", "paragraph", "textbf", "textit", "emph", "text",
]
OPEN_ENVS = ["abstract", "quote", "quotation"]
NOT_TEXT_MACROS = {
    "label", "ref", "cite", "url", "href", "input", "include", "includegraphics", "eqref", "autoref", "cref", "footnote",
}
COMMENT = r"(?<!\\)%[^\n]*"
INLINE_MATH = r"(?<!\\)\$(?:\\.|[^$\\])+\$"
#: What lies between two marks, up to the nearest second one.
BLOCK_FENCES = [("\\iffalse", "\\fi"), ("\\makeatletter", "\\makeatother")]
MATH_FENCES = [("$$", "$$"), ("\\[", "\\]")]
BIBLIOGRAPHY = ("\\begin{thebibliography}", "\\end{thebibliography}")
BLOCK_COMMANDS = r"\\(?:begingroup|endgroup|makeatletter|makeatother)"
REFERENCES = [
    r"\\bibliography\{[^}]*\}", r"\\bibliographystyle\{[^}]*\}",
    r"\\cite[a-zA-Z]*\s*(?:\[[^\]]*\])*\{[^}]*\}", r"\\(?:ref|eqref|pageref|autoref|cref|Cref|label|url)\{[^}]*\}", r"\\href\{[^}]*\}\{",
    r"\\includegraphics(?:\[[^\]]*\])?\{[^}]*\}", r"\\input\{[^}]*\}", r"\\include\{[^}]*\}", r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\}",
    r"\\newcommand[^\n]*", r"\\renewcommand[^\n]*", r"\\def[^\n]*",
]
LAYOUT = [
    r"\\vspace\*?\{[^}]*\}", r"\\hspace\*?\{[^}]*\}", r"\\begin\{[^}]*\}", r"\\end\{[^}]*\}", r"\\clearpage", r"\\newpage", r"\\appendix",
    r"\\tableofcontents", r"\\maketitle", r"\\item(?=\s)", r"\\footnote\{",
]
MACRO = r"\\(?:re)?newcommand\s*\{?\\([a-zA-Z]+)\}?\s*\[1\]\s*(?:\[[^\]]*\])?\s*\{([^\n]*)"
# -----------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\\(?:(begin|end)\{([^{}]*)\}|([a-zA-Z]+)(\*?))|\\[^a-zA-Z]|[{}]", re.S)
_MATH_OR_BREAK = (re.compile(INLINE_MATH), re.compile(r"\\\\(?:\[[^\]]*\])?"))


@dataclass(frozen=True)
class Stretch:
    """A piece of a document from `start` to `end`, with the text inside it where it has some."""

    start: int
    end: int
    inside: tuple[int, int] | None = None


class Index:
    """Where a document's braces close, and its commands and environment marks by name."""

    def __init__(self, text: str):
        self.text = text
        self.closing: dict[int, int] = {}
        self.commands: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.marks: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        self.order: list[tuple[int, int, str]] = []  # every command: start, end, name without star
        depth: list[int] = []
        at = 0
        while token := _TOKEN.search(text, at):
            at = token.end()
            mark, env, name, star = token.groups()
            if mark:
                self.marks[mark, env].append(token.span())
                name, star, at = mark, "", token.start() + 1 + len(mark)  # its braces are tokens too
            if name:
                span = (token.start(), at)
                self.commands[name + star].append(span)
                self.order.append((*span, name))
            elif token[0] == "{":
                depth.append(token.start())
            elif token[0] == "}" and depth:
                self.closing[depth.pop()] = token.start()
            elif len(token[0]) == 2 and token[0][1] == "\\":
                # the second backslash of a line break begins a command where letters follow it
                follow = re.compile(r"[a-zA-Z]+\*?").match(text, at)
                at = at - 1 if follow else at
        self.starts = [c[0] for c in self.order]
        self._found: dict[tuple[int, int], list[list[tuple[int, int]]]] = {}

    def blanks(self, at: int) -> int:
        while self.text[at : at + 1] in (" ", "\t"):
            at += 1
        return at

    def braces(self, at: int) -> tuple[int, int] | None:
        """The argument that begins at a position, blanks allowed: its two braces."""
        at = self.blanks(at)
        return (at, self.closing[at]) if at in self.closing else None

    def arguments(self, names: Iterable[str], least: int = 0) -> Iterator[Stretch]:
        """Commands of these names with their argument."""
        for name in names:
            for start, end in self.commands.get(name, ()):
                if start >= least and (pair := self.braces(end)):
                    yield Stretch(start, pair[1] + 1, (pair[0] + 1, pair[1]))

    def environments(self, names: Iterable[str], starred: bool) -> Iterator[Stretch]:
        """Environments from begin to the next end of the same name; they don't overlap."""
        for name in names:
            kinds = [name, name + "*"] if starred else [name]
            free = 0
            for (start, end), kind in sorted((span, k) for k in kinds for span in self.marks.get(("begin", k), ())):
                ends = self.marks.get(("end", kind), ())
                k = bisect_left(ends, (end, 0))
                if start >= free and k < len(ends):
                    yield Stretch(start, ends[k][1], (end, ends[k][0]))
                    free = ends[k][1]

    def matches(self, pattern: str) -> Iterator[Stretch]:
        for m in re.finditer(pattern, self.text):
            yield Stretch(*m.span())

    def fenced(self, marks: tuple[str, str]) -> Iterator[Stretch]:
        """From each first mark to the nearest second one; without a second one there are no more."""
        first, second = marks
        start = self.text.find(first)
        while start >= 0 and (end := self.text.find(second, start + len(first))) >= 0:
            yield Stretch(start, end + len(second))
            start = self.text.find(first, end + len(second))

    def found(self, start: int, end: int) -> list[list[tuple[int, int]]]:
        """Math and line breaks of a piece, as that piece alone reads."""
        if (start, end) not in self._found:
            piece = self.text[start:end]
            self._found[start, end] = [[(start + m.start(), start + m.end()) for m in p.finditer(piece)] for p in _MATH_OR_BREAK]
        return self._found[start, end]

    def code_in(self, start: int, end: int, free: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        """What is no text between two positions: commands with options and arguments, math, line breaks.
        Of commands that only dress up their text, the text is left out.

        Only what meets the `free` intervals counts. `taken` are the others (start, end, how far commands in them reach).
        """
        texts = [(start, end)]
        own = [(a, b) for a, b in free]
        own += [(a, b) for a, b, reach in taken if reach > b]  # commands there go on behind it
        for a, b in sorted(own):
            for first, last, name in self.order[bisect_left(self.starts, a) : bisect_left(self.starts, b)]:
                stop = self.option(last, end)
                pair = self.braces(stop)
                if pair is None or pair[1] >= end:
                    yield first, min(stop, end)
                elif name in TRANSPARENT:
                    yield first, pair[0] + 1
                    yield pair[1], pair[1] + 1
                    texts.append((pair[0] + 1, pair[1]))
                else:
                    yield first, pair[1] + 1
        yield from self._math_in(texts, free)

    def _math_in(self, texts: list[tuple[int, int]], free: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Math and line breaks of nested pieces, where they meet `free`.

        A piece that begins outside of every match of the piece around it reads as that one does, up to its own end; so
        only pieces that begin inside a match are read again. Outermost is the whole document.
        """
        around: list[tuple[int, list[list[tuple[int, int]]]]] = []  # end of each open piece, and what counts there
        whole = self.found(0, len(self.text))
        for a, b in sorted(texts, key=lambda t: (t[0], -t[1])):
            while around and around[-1][0] < b:
                around.pop()
            known = around[-1][1] if around else whole
            new = [self._reread(kind, _around(spans, a), a, b) for kind, spans in enumerate(known)]
            known = [k if n is None else n for n, k in zip(new, known, strict=True)]
            for fresh, spans in zip(new, known, strict=True):
                if fresh is not None or not around:
                    for x, y in _meeting(spans, a, b, free):
                        if y <= b:
                            yield x, y
                        elif self.text.startswith("\\\\", x) and x + 2 <= b:
                            yield x, x + 2  # its option ends behind the piece
            around.append((b, known))

    def _reread(self, kind: int, match: tuple[int, int] | None, start: int, end: int) -> list[tuple[int, int]] | None:
        """Math (0) or line breaks (1) of a piece that begins inside a match; None where it begins outside."""
        if match is None:
            return None
        # all dollars inside a formula are escaped, so a piece that lies in one holds none
        return [] if kind == 0 and end < match[1] else self.found(start, end)[kind]

    def option(self, at: int, end: int) -> int:
        """Behind the blanks and the one option that follow a command."""
        stop = self.blanks(at)
        return self.text.find("]", stop, end) + 1 or stop if self.text[stop : stop + 1] == "[" else stop


def _around(spans: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    """The one of some disjoint spans that holds a position behind its start."""
    k = bisect_left(spans, (at, 0)) - 1
    return spans[k] if k >= 0 and at < spans[k][1] else None


def _meeting(spans: list[tuple[int, int]], start: int, end: int, free: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Of disjoint spans those that begin between `start` and `end` and meet one of the free intervals."""
    last = bisect_left(spans, (end, 0))
    k = bisect_left(spans, (start, 0))
    for a, b in free:
        while k < last and spans[k][1] <= a:
            k = max(k + 1, bisect_left(spans, (a, 0), k) - 1)
        while k < last and spans[k][0] < b:
            yield spans[k]
            k += 1


class Opened:
    """The union of opened stretches, laid from the last one to the first: disjoint, in order, with their commands' reach."""

    def __init__(self, index: Index):
        self.index = index
        self.starts: list[int] = []
        self.parts: list[tuple[int, int, int]] = []  # start, end, how far commands that begin inside reach

    def lay(self, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """The free and the taken parts of a stretch, which is taken from now on."""
        lo = bisect_left(self.starts, start)
        if lo and self.parts[lo - 1][1] > start:
            lo -= 1
        hi = bisect_left(self.starts, end)
        taken = self.parts[lo:hi]
        free, at = [], start
        for a, b, _ in taken:
            if at < a:
                free.append((at, a))
            at = max(at, b)
        if at < end:
            free.append((at, end))
        index = self.index
        reach = max([r for _, _, r in taken], default=0)
        for a, b in free:
            for k in range(bisect_left(index.starts, a), bisect_left(index.starts, b)):
                stop = index.option(index.order[k][1], len(index.text))
                pair = index.braces(stop)
                reach = max(reach, pair[1] + 1 if pair else stop)
        first, last = min([start, *(t[0] for t in taken)]), max([end, *(t[1] for t in taken)])
        self.starts[lo:hi], self.parts[lo:hi] = [first], [(first, last, reach)]
        return free, taken


def text_macros(text: str) -> list[str]:
    """Names of one-argument macros that print their argument as text."""
    swallow = re.compile(r"\\(?:url|verb|lstinline|texttt|path)\b[^\n]*#1")
    bodies = ((m[1], m[2]) for m in re.finditer(MACRO, text))
    return [name for name, body in bodies if "#1" in body and name not in NOT_TEXT_MACROS and not swallow.search(body)]


#: Rules in the order in which they are laid: what they select, and whether its inside is text.
RULES: list[tuple[str, object, bool]] = [
    *[("fence", x, False) for x in BLOCK_FENCES],
    ("pattern", BLOCK_COMMANDS, False),
    ("pattern", COMMENT, False),
    *[("fence", x, False) for x in MATH_FENCES],
    ("pattern", INLINE_MATH, False),
    ("environment", [*MATH_ENVS, *FLOAT_ENVS, *VERBATIM_ENVS, *AUTHOR_ENVS], False),
    ("command", AUTHOR_COMMANDS, False),
    ("fence", BIBLIOGRAPHY, False),
    *[("pattern", x, False) for x in [*REFERENCES, *LAYOUT]],
    ("command", OPEN_ANYWHERE, True),
    ("body command", OPEN_IN_BODY, True),
    ("macro", None, True),
    ("environment", OPEN_ENVS, True),
    ("pattern", COMMENT, False),
]


def layers(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, open) in the order in which they are laid; what no layer covers is open."""
    index = Index(text)
    begins, ends = index.marks.get(("begin", "document")), index.marks.get(("end", "document"))
    body = begins[0][1] if begins else 0
    select = {
        "fence": lambda what, opens: index.fenced(what),
        "pattern": lambda what, opens: index.matches(what),
        "environment": lambda what, opens: index.environments(what, starred=not opens),
        "command": lambda what, opens: index.arguments(what),
        "body command": lambda what, opens: index.arguments(what, body),
        "macro": lambda what, opens: index.arguments(text_macros(text), body),
    }
    laid = [(piece, opens) for kind, what, opens in RULES for piece in select[kind](what, opens)]
    opened, parts = Opened(index), []
    for piece, opens in reversed(laid):
        own = [(piece.start, piece.end, False)]
        if opens:
            free, taken = opened.lay(piece.start, piece.end)
            if free and piece.inside[0] < piece.inside[1]:
                own.append((*piece.inside, True))
                own += [(a, b, False) for a, b in index.code_in(*piece.inside, _within(free, *piece.inside), _within(taken, *piece.inside))]
        parts.append(own)
    out = [(0, body, False)]
    if ends:
        out.append((ends[0][0], len(text), False))
    return out + [layer for own in reversed(parts) for layer in own]


def _within(intervals: list[tuple], start: int, end: int) -> list[tuple]:
    return [(max(a, start), min(b, end), *rest) for a, b, *rest in intervals if a < end and b > start]


def visible(length: int, laid: list[tuple[int, int, bool]]) -> Iterator[tuple[int, int, bool]]:
    """Runs (start, end, open) of what shows of the layers from above: a sweep over their ends."""
    coming = sorted(((a, -n, b, open_) for n, (a, b, open_) in enumerate(laid) if a < b), reverse=True)
    cuts = sorted({0, length, *(x for a, b, _ in laid for x in (a, b))})
    top: list[tuple[int, int, bool]] = []  # the layer laid last comes first
    start, state = 0, None
    for cut in cuts:
        while coming and coming[-1][0] <= cut:
            _, n, end, open_ = coming.pop()
            heapq.heappush(top, (n, end, open_))
        while top and top[0][1] <= cut:
            heapq.heappop(top)
        now = top[0][2] if top else True
        if state is None:
            state = now
        elif now != state or cut == length:
            yield start, cut, state
            start, state = cut, now


def runs_of(text: str) -> list[tuple[str, bool]]:
    """(text, protected) for each run of equal state."""
    return [(text[a:b], not open_) for a, b, open_ in visible(len(text), layers(text))] if text else []


# ---------------------------------------------------------------- DataFrame forms

RUNS = "array<struct<text:string,preserve:boolean>>"


def segment_runs(sources: DataFrame) -> DataFrame:
    """`sources` (paper_id, rel_path, content) with `runs`; null content has none."""
    keep = sources.select("paper_id", "rel_path", "content")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep.schema) + f", runs {RUNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "content"):
                found = [runs_of(x or "") for x in part.column("content").to_pylist()]
                flat = [r for runs in found for r in runs]
                nodes_ = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.string()), pa.array([p for _, p in flat], pa.bool_())], names=["text", "preserve"])
                ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, nodes_)], names=[*part.schema.names, "runs"])

    return keep.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` characters of text, one row at least."""
    start = size = 0
    for i, n in enumerate(map(len, (x.as_py() or "" for x in batch.column(column)))):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def demoted(runs: Column) -> Column:
    """Translatable runs that are unbalanced or hold no word become protected."""
    return F.transform(
        runs, lambda r: F.struct(r["text"].alias("text"), (r["preserve"] | (lx.brace_balance(r["text"]) != 0) | ~lx.has_word(r["text"])).alias("preserve"))
    )


def _lead(text: Column) -> Column:
    return F.regexp_extract(text, r"^(?U:\s*)", 0)


def _tail(text: Column) -> Column:
    return F.when(text.rlike(r"(?U)^\s*$"), "").otherwise(F.regexp_extract(text, r"(?U)(?<!\s)(\s+)$", 1))


def detached(runs: Column) -> Column:
    """White space at the ends of translatable runs goes to the neighbours, where there are any.

    Blank runs are never translatable after `demoted`, and two translatable runs never touch, so
    a hand-over never meets another one.
    """
    n = F.size(runs)

    def one(r: Column, i: Column) -> Column:
        before, after = F.get(runs, i - 1), F.get(runs, i + 1)
        own = F.when(
            r["preserve"],
            F.concat(
                F.when((i > 0) & ~before["preserve"], _tail(before["text"])).otherwise(""),
                r["text"],
                F.when((i < n - 1) & ~after["preserve"], _lead(after["text"])).otherwise(""),
            ),
        ).otherwise(
            F.regexp_replace(
                F.regexp_replace(r["text"], F.when(i > 0, r"^(?U:\s+)").otherwise(r"(?!)"), F.lit("")), F.when(i < n - 1, r"(?U)(?<!\s)\s+$").otherwise(r"(?!)"), F.lit("")
            )
        )
        return F.struct(own.alias("text"), r["preserve"].alias("preserve"))

    return F.transform(runs, one)


def with_merged(df: DataFrame, runs: str = "runs") -> DataFrame:
    """Empty runs go and equal neighbours join. Starts of groups are found first, so each text is joined once;
    the arrays that element functions look into are columns, as an expression would be evaluated for each element."""
    df = df.withColumn("_full", F.filter(runs, lambda r: r["text"] != "")).withColumn("_kinds", F.transform("_full", lambda r: r["preserve"]))
    at = F.sequence(F.lit(0), F.size("_full"))
    starts = F.filter(at, lambda i: (i < F.size("_full")) & ((i == 0) | (F.get("_kinds", i) != F.get("_kinds", i - 1))))
    joined = lambda s, k: F.struct(
        F.array_join(F.transform(F.slice("_full", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_full")) - s), lambda r: r["text"]), "").alias("text"),
        F.get("_kinds", s).alias("preserve"),
    )
    return df.withColumn("_starts", starts).withColumn(runs, F.transform("_starts", joined)).drop("_full", "_kinds", "_starts")


def explode_nodes(df: DataFrame, runs: str = "runs", also: list[str] = []) -> DataFrame:
    """Rows (paper_id, rel_path, node_idx, text, preserve, t_idx, line_start, line_end) of cleaned runs.

    Lines are 0-based; a node's last line is the next one's first. All of it comes from the row's
    own array: running sums over a file's runs, no window. `also` names further fields of the runs.
    """
    # line breaks and translatable runs are summed as one number
    both = F.transform(runs, lambda r: F.shiftleft(lx.count_of(r["text"], "\n").cast("long"), 32) + F.when(r["preserve"], 0).otherwise(1))
    marked = df.withColumn("_n", both).withColumn("_sum", lx.running_sums(F.col("_n")))
    rows = marked.select("paper_id", "rel_path", F.posexplode(F.arrays_zip(F.col(runs).alias("r"), F.col("_n").alias("n"), F.col("_sum").alias("sum"))).alias("node_idx", "x"))
    node, before, lines = F.col("x")["r"], F.col("x")["sum"], F.shiftright(F.col("x")["sum"], 32).cast("int")
    return rows.select(
        "paper_id",
        "rel_path",
        "node_idx",
        node["text"].alias("text"),
        node["preserve"].alias("preserve"),
        F.when(~node["preserve"], before.bitwiseAND(0xFFFFFFFF).cast("int")).alias("t_idx"),
        lines.alias("line_start"),
        (lines + F.shiftright(F.col("x")["n"], 32).cast("int")).alias("line_end"),
        *[node[c].alias(c) for c in also],
    )


def cleaned(sources: DataFrame) -> DataFrame:
    """`sources` (paper_id, rel_path, content) with `runs` as they become nodes."""
    return with_merged(segment_runs(sources).withColumn("runs", demoted(F.col("runs"))).withColumn("runs", detached(F.col("runs"))))


def nodes(sources: DataFrame) -> DataFrame:
    """The node table of a corpus of sources."""
    return explode_nodes(cleaned(sources))


def span_table(node_rows: DataFrame) -> DataFrame:
    """Offset, length and kind of each node: the mask as a table."""
    from pyspark.sql import Window

    w = Window.partitionBy("paper_id", "rel_path").orderBy("node_idx").rowsBetween(Window.unboundedPreceding, -1)
    return node_rows.select(
        "paper_id", "rel_path", "node_idx", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("start"), F.length("text").alias("length"), "preserve"
    )


# ---------------------------------------------------------------- chunks

LEVELS = ["\n\n", "\n", ". ", "。"]


def split_text(text: str, max_tokens: int) -> list[str]:
    """Pieces of at most `max_tokens` (a third of the characters), cut at the coarsest separator present.

    Pieces are packed greedily. A separator between two chunks stays with the left one, so chunks
    concatenate to the text. Sizes add up in characters, so packing is linear.
    """
    room = max_tokens * 3 + 2  # as long as floor(length / 3) stays at the limit
    out: list[str] = []
    todo = [text]
    while todo:
        part = todo.pop()
        if len(part) <= room:
            out.append(part)
            continue
        sep = next((s for s in LEVELS if s in part), None)
        if sep is None:
            out += [part[i : i + 3 * max_tokens] for i in range(0, len(part), 3 * max_tokens)]
            continue
        ends = [m.end() for m in re.finditer(re.escape(sep), part)] + [len(part)]
        cuts, start = [], 0
        while start < len(part):
            # a piece's own separator doesn't count against the room: it is only kept to lose nothing
            k = bisect_left(ends, start + room + len(sep) + 1) - 1
            while k >= 0 and ends[k] > start and ends[k] - (len(sep) if ends[k] < len(part) else 0) - start > room:
                k -= 1
            end = ends[k] if k >= 0 and ends[k] > start else ends[bisect_left(ends, start + 1)]
            cuts.append(part[start:end])
            start = end
        if len(cuts) == 1:  # the separator is only at the end
            body = part[: -len(sep)] if part.endswith(sep) else part
            inner = split_text(body, max_tokens)
            out += [*inner[:-1], inner[-1] + part[len(body) :]]
            continue
        todo += [c for c in reversed(cuts)] if any(len(c) - len(sep) > room for c in cuts) else []
        if not any(len(c) - len(sep) > room for c in cuts):
            out += cuts
    return out


# ---- whole files in a row: nodes as runs, and the chunks of each as its parts ----


def text_of(run: Column) -> Column:
    return F.array_join(run["parts"], "")


def file_rows(sources: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """(paper_id, rel_path, src_hash, n_chunks, runs) of each source, without a shuffle.

    A run is a node: (parts, preserve, at). Its parts are its chunks, or its whole text where it is preserved; `at` chunks
    of the file come before it. Only texts over the limit go through Python.
    """

    @F.pandas_udf("array<array<string>>")
    def pieces(files: pd.Series) -> pd.Series:
        return files.map(lambda texts: None if texts is None else [None if t is None else split_text(t, max_tokens) for t in texts])

    pieces = pieces.asNondeterministic()  # else filters on what comes after it are evaluated before it, with all arrays written out for each element
    long = F.transform("runs", lambda r: F.when(~r["preserve"] & (lx.token_estimate(r["text"]) > max_tokens), r["text"]))
    parts = F.transform("runs", lambda r, i: F.struct(F.coalesce(F.get("_cut", i), F.array(r["text"])).alias("parts"), r["preserve"].alias("preserve")))
    own = F.transform("runs", lambda r: F.when(r["preserve"], 0).otherwise(F.size(r["parts"])).cast("long"))
    rows = cleaned(sources).withColumn("_long", long).withColumn("_cut", pieces(F.when(F.exists("_long", lambda t: t.isNotNull()), F.col("_long"))))
    rows = rows.withColumn("runs", parts).withColumn("_n", own).withColumn("_at", lx.running_sums(F.col("_n")))
    placed = F.zip_with("runs", "_at", lambda r, a: F.struct(r["parts"].alias("parts"), r["preserve"].alias("preserve"), a.cast("int").alias("at")))
    n = F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("paper_id", "rel_path", lx.content_hash("content").alias("src_hash"), n.alias("n_chunks"), placed.alias("runs"))


def chunks_of(runs: str = "runs") -> Column:
    """The chunks of a file row in order."""
    return F.flatten(F.transform(F.filter(runs, lambda r: ~r["preserve"]), lambda r: r["parts"]))


def chunk_rows(rows: DataFrame, *also: str) -> DataFrame:
    """(paper_id, rel_path, chunk_idx, text, …) of file rows; `also` names arrays by chunk."""
    both = F.arrays_zip(chunks_of().alias("text"), *map(F.col, also))
    return rows.select("paper_id", "rel_path", F.posexplode(both).alias("chunk_idx", "x")).select("paper_id", "rel_path", "chunk_idx", "x.text", *[f"x.{a}" for a in also])


def with_texts(rows: DataFrame) -> DataFrame:
    """File rows for `explode_nodes`."""
    return rows.withColumn("runs", F.transform("runs", lambda r: F.struct(text_of(r).alias("text"), r["preserve"].alias("preserve"))))


def chunks(node_rows: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """Rows (paper_id, rel_path, chunk_idx, owner_t_idx, text) of the translatable nodes.

    Only texts over the limit go through Python; the nodes are read once.
    """
    from pyspark.sql import Window

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, max_tokens))

    key = ["paper_id", "rel_path"]
    own = node_rows.where(~F.col("preserve")).select(*key, "t_idx", "text", pieces(F.when(lx.token_estimate("text") > max_tokens, F.col("text"))).alias("long"))
    parts = own.select(*key, "t_idx", F.posexplode(F.coalesce("long", F.array("text"))).alias("k", "text"))
    order = Window.partitionBy(*key).orderBy("t_idx", "k")
    return parts.select(*key, (F.row_number().over(order) - 1).alias("chunk_idx"), F.col("t_idx").alias("owner_t_idx"), "text")
