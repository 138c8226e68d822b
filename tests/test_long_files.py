"""Long and deeply nested files: linear time, and the same results as plain loops."""

import random
import re
import time

from pyspark.sql import functions as F

from texloom.functions import latex as lx
from texloom.operators import segment


def timed(f):
    f()
    start = time.monotonic()
    out = f()
    return out, time.monotonic() - start


def without_blank(text):
    depth, out = 0, []
    for line in text.split("\n"):
        if not line.strip() and depth > 0:
            continue
        bare = re.sub(r"(?s)\\.", "", line)
        depth = max(0, depth + bare.count("{") - bare.count("}"))
        out.append(line)
    return "\n".join(out)


def test_blank_lines_go_as_in_a_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "{", "}", "\n", "\n\n", " \n", "\\{"]) for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["", "\n", "{\n\n\n}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", lx.drop_blank_in_arguments("t").alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [without_blank(t) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(lx.drop_blank_in_arguments("t").alias("x")).first().x is None


def test_running_sums(spark):
    rng = random.Random(2)
    lists = [[rng.randint(-5, 5) for _ in range(n)] for n in [*range(12), 100, 1000]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<long>")
    got = {r.i: r.x for r in df.select("i", lx.running_sums(F.col("v")).alias("x")).collect()}
    assert all(got[i] == [sum(v[:k]) for k in range(len(v))] for i, v in enumerate(lists))


def test_a_hundred_thousand_lines(spark):
    text = "a {\n\nb }\n" * 33_333
    df = spark.createDataFrame([(text,)], "t string")
    got, seconds = timed(lambda: df.select(lx.drop_blank_in_arguments("t").alias("x")).first().x)
    assert got == text.replace("\n\n", "\n") and seconds < 8  # 1.5 s on an idle machine; 240 s before
    _, seconds = timed(lambda: df.select(lx.collapse_document("t").alias("x")).first())
    assert seconds < 8


def test_a_hundred_thousand_nodes(spark):
    df = spark.createDataFrame([("p", "a.tex", "math $x$ words\n" * 50_000)], "paper_id string, rel_path string, content string")
    got, seconds = timed(lambda: segment.nodes(df).agg(F.count("*"), F.max("line_end"), F.max("t_idx")).first())
    assert tuple(got) == (100_001, 50_000, 50_000) and seconds < 15  # 4 s on an idle machine; minutes before


def test_commands_nested_five_thousand_deep():
    deep = {
        "\\begin{document}" + "\\textbf{a " * 5000 + "}" * 5000: 10_001,
        "\\begin{document}" + "\\textbf{a \\emph{b $x$ " * 2500 + "}}" * 2500: 15_001,
        "\\begin{document}$" + "\\textbf{a " * 5000 + "}" * 5000 + "$": 10_001,
        "\\[ a " * 5000: 1,
        "\\iffalse " * 5000: 1,
        "\\begin{thebibliography} " * 5000: 10_000,
        "\\begin{quote} a \\textbf{b} " * 2000 + "\\end{quote}" * 2000: 12_001,
    }
    for text, n in deep.items():
        start = time.monotonic()
        runs = segment.runs_of(text)
        assert len(runs) == n and time.monotonic() - start < 6  # 0.3 s each on an idle machine
        assert "".join(t for t, _ in runs) == text


def naive(text):
    """The layers as the rules say, on an array of characters: every opened stretch looks at everything inside it."""
    index = segment.Index(text)
    state = [True] * len(text)

    def lay(a, b, open_):
        state[a:b] = [open_] * (b - a)

    begins, ends = index.marks.get(("begin", "document")), index.marks.get(("end", "document"))
    body = begins[0][1] if begins else 0
    lay(0, body, False)
    if ends:
        lay(ends[0][0], len(text), False)
    select = {
        "fence": lambda what, opens: [segment.Stretch(*m.span()) for m in re.finditer(f"(?s){re.escape(what[0])}.*?{re.escape(what[1])}", text)],
        "pattern": lambda what, opens: index.matches(what),
        "environment": lambda what, opens: index.environments(what, starred=not opens),
        "command": lambda what, opens: index.arguments(what),
        "body command": lambda what, opens: index.arguments(what, body),
        "macro": lambda what, opens: index.arguments(segment.text_macros(text), body),
    }
    for kind, what, opens in segment.RULES:
        for piece in select[kind](what, opens):
            lay(piece.start, piece.end, False)
            if not opens or piece.inside[0] >= piece.inside[1]:
                continue
            a, b = piece.inside
            lay(a, b, True)
            pieces = [(a, b)]
            for first, last, name in index.order:
                if a <= first < b:
                    stop = index.option(last, b)
                    pair = index.braces(stop)
                    if pair is None or pair[1] >= b:
                        lay(first, min(stop, b), False)
                    elif name in segment.TRANSPARENT:
                        lay(first, pair[0] + 1, False)
                        lay(pair[1], pair[1] + 1, False)
                        pieces.append((pair[0] + 1, pair[1]))
                    else:
                        lay(first, pair[1] + 1, False)
            for x, y in pieces:
                for pattern in segment._MATH_OR_BREAK:
                    for m in pattern.finditer(text[x:y]):
                        lay(x + m.start(), x + m.end(), False)
    runs = []
    for ch, open_ in zip(text, state, strict=True):
        if runs and runs[-1][1] == (not open_):
            runs[-1] = (runs[-1][0] + ch, not open_)
        else:
            runs.append((ch, not open_))
    return runs


def test_runs_are_those_of_the_plain_rules():
    rng = random.Random(11)
    parts = [
        "a", "bc ", "\n", "$", "$", "$$", "%", "\\\\", "\\\\[2pt]", "[", "]", "\\begin{quote}", "\\end{quote}", "\\begin{abstract}", "\\end{abstract}", "\\emph{", "\\textbf{",
        "\\section{", "\\title{", "\\foo{", "\\foo", "\\foo[x]{", "\\texttt{", "}", "}", "}", "{", "\\[", "\\]", "\\iffalse", "\\fi", "\\newcommand{\\hl}[1]{\\textbf{#1}}\n", "\\hl{",
        "\\caption[s]{", "\\begin{document}", "\\end{document}", "\\$", "\\%", "\\begin{figure}", "\\end{figure}", "\\mbox{$", "\\cite{k}",
    ]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert segment.runs_of(text) == naive(text), text


def test_titles_of_any_depth(spark):
    deep = lambda n: "\\title{" + "{a " * n + "}" * n + "}"
    texts = [
        (deep(50), "a " * 49 + "a"), (deep(2000), "a " * 1999 + "a"), ("% \\title{Old}\n\\title[s]{New {one}}", "New one"), ("\\title{open {", None), ("\\title{}\n\\title{Second}", "Second"),
        ("\\newcommand{\\sys}{Orca}\n\\title{\\sys{}: a {\\bf fast} one\\thanks{x}}", "Orca: a fast one"), ("\\title{a \\} b} c}", "a \\ b"), ("no", None), ("", None), (None, None),
        ("x" * 200_000 + "\n\\title{Far}", "Far"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", lx.title("t").alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [w for _, w in texts]
