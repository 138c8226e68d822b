import random
import re

import pytest
from pyspark.sql import functions as F

from texloom.functions import latex as lx


def value(spark, function, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(function(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


CASES = [
    (lx.escape_percent, ["50% a\\%"], "50\\% a\\%"),
    (lx.escape_scripts, ["a_b $x_1$ c^2 \\_"], "a\\_b $x_1$ c\\^2 \\_"),
    (lx.join_commands, ["\\textbf {a} \\ emph{b} \\x\n{c}"], "\\textbf{a} \\emph{b} \\x\n{c}"),
    (lx.space_after_item, ["\\item中 \\item[x] \\item a"], "\\item 中 \\item[x] \\item a"),
    (lx.separate_cjk, ["\\sys高效 \\sys a"], "\\sys{}高效 \\sys a"),
    (lx.strip_tags, [" [标题] [Title] x [y]"], "x [y]"),
    (lx.drop_blank_in_arguments, ["\\textbf{a\n\nb}\n\nc"], "\\textbf{a\nb}\n\nc"),
    (lx.balanced_prefix, ["ab {c} d\\{ {e"], "ab {c} d\\{ "),
    (lx.brace_balance, ["{a\\{{b}"], 1),
    (lx.brace_balance, ["\\{ {x} \\}"], 0),
    (lx.title, ["% \\title{Old}\n\\newcommand{\\sys}{Turbo}\n\\title{\\sys{}: A $x$ {B {C}}\\thanks{Me}\\\\ two}"], "Turbo: A B C two"),
    (lx.title, ["no title"], None),
    (lx.has_cjk_package, ["%\\usepackage{xeCJK}\nx"], False),
    (lx.has_cjk_package, ["\\usepackage{xeCJK}"], True),
    (lx.guarded_class_file, ["\\RequirePackage{times}"], "\\ifdefined\\XeTeXversion\\else\n\\RequirePackage{times}\n\\fi"),
    (lx.guarded_class_file, ["  \\pdfoutput=1 \nx"], "  \\ifdefined\\pdfoutput \\pdfoutput=1 \\fi\nx"),
    (lx.collapse_document, ["\\abstract{甲\n\n乙}"], "\\abstract{甲\n乙}"),
    (lx.collapse_document, ["\\begin{verbatim}{\n\n\\end{verbatim}"], "\\begin{verbatim}{\n\n\\end{verbatim}"),
    (lx.collapse_document, ["\\begin{itemize}\n\n[opts]"], "\\begin{itemize}\n[opts]"),
    (lx.arxiv_id, [" https://arxiv.org/abs/2401.01234v2 "], "2401.01234"),
    (lx.work_key, ["/a/b/c.tar.gz"], "c.tar.gz"),
    (lx.work_key, [""], "task"),
    (lx.is_meta, ["作为一个通用模型"], False),
    (lx.is_meta, ["作为一个AI助手"], True),
    (lx.is_failed, ["The model", "The model"], True),
    (lx.is_failed, ["\\cmd 12", "\\cmd 12"], False),
    (lx.is_failed, ["a", None], True),
    (lx.token_estimate, ["ab"], 1),
]


@pytest.mark.parametrize("case", CASES, ids=[f"{c[0].__name__}-{i}" for i, c in enumerate(CASES)])
def test_cases(spark, case):
    function, args, expected = case
    assert value(spark, function, *args) == expected


def test_fraction_and_percent(spark):
    df = spark.createDataFrame([(5, 10), (5, 0), (1, 8)], "c int, t int")
    rows = df.select(lx.fraction("c", "t").alias("f"), lx.percent("c", "t").alias("p")).collect()
    assert [(r.f, r.p) for r in rows] == [(0.5, 50), (0.0, 0), (0.125, 13)]


def _depth(text):
    return sum({"{": 1, "}": -1}[c] for c in re.findall(r"[{}]", re.sub(r"(?s)\\.", "", text)))


def _collapsed(text):
    out, depth = [], 0
    for line in text.split("\n"):
        if not (line.strip() == "" and depth > 0):
            out.append(line)
            depth = max(0, depth + _depth(line))
    return "\n".join(out)


def _scripts(text):
    parts = re.split(r"(?s)(\$.*?\$)", text)
    return "".join(p if i % 2 else re.sub(r"(?<!\\)([_^])", r"\\\1", p) for i, p in enumerate(parts))


def test_column_forms_equal_loops(spark):
    rng = random.Random(3)
    alphabet = ["a", "{", "}", "\\", "\n", "\n\n", " ", "$", "_", "^", "中"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", lx.brace_balance("t").alias("b"), lx.drop_blank_in_arguments("t").alias("c"), lx.escape_scripts("t").alias("s")).collect()
    for r in rows:
        assert (r.b, r.c, r.s) == (_depth(texts[r.i]), _collapsed(texts[r.i]), _scripts(texts[r.i])), texts[r.i]


def test_outcomes(spark):
    rows = [
        ("\\item a \\textbf{b}", "\\item 中 \\textbf{术}", "ok"), ("\\item a", None, "missing"), ("\\item a", "以下是翻译 x", "meta"),
        ("\\item a", "中", "structure"), ("\\item \\textbf{b}", "\\item 中 \\textbf{术", "partial"), ("{b}", "{中", "original"),
    ]
    df = spark.createDataFrame(rows, "o string, t string, e string")
    for r in lx.with_repaired(df, "o", "t", "x", "got").collect():
        assert r.got == r.e
        if r.got in ("missing", "meta", "structure", "original"):
            assert r.x == r.o
