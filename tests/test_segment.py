import random

from texloom.operators import segment


def open_text(text):
    return [t for t, protected in segment.runs_of(text) if not protected]


def test_rules():
    assert open_text("\\title{\\center{Orca: a system}}") == ["Orca: a system"]
    assert open_text("\\caption[short]{long}") == ["\\caption[short]{long}"]
    assert open_text("% \\title{Old}") == []
    assert open_text("\\begin{figure}x\\caption{Text}y\\end{figure}") == ["Text"]
    assert open_text("\\newcommand{\\hl}[1]{\\textbf{#1}}\n\\begin{document}\\hl{words}\\end{document}z") == ["words"]
    assert open_text("\\newcommand{\\u}[1]{\\url{#1}}\n\\begin{document}\\end{document}") == []
    assert open_text("a $\\$5$ b") == ["a ", " b"]
    assert open_text("\\texorpdfstring{Rich}{Plain}")  # outside of titles it's ordinary text
    assert open_text("\\title{\\texorpdfstring{Rich}{Plain}}") == ["Rich", "{Plain}"]
    assert open_text("\\title{A\\\\[-0.15em]\\titlesubtitle{B}}") == ["A", "B"]


def test_runs_and_pieces_keep_the_text():
    rng = random.Random(1)
    parts = ["a", "bc ", ". ", "\n", "\n\n", "。", "\\title{", "}", "{", "$", "%", "\\\\", "\\begin{quote}", "\\end{quote}", "\\emph{", "\\["]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert "".join(t for t, _ in segment.runs_of(text)) == text
        limit = rng.randint(1, 8)
        pieces = segment.split_text(text, limit)
        assert "".join(pieces) == text
        assert all(len(p) <= 3 * limit + 8 for p in pieces)


def test_levels():
    assert segment.split_text("aaa\n\nbbb", 1) == ["aaa\n\n", "bbb"]
    assert segment.split_text("aaaa. bbbb", 1) == ["aaaa. ", "bbbb"]
    assert segment.split_text("x" * 7, 1) == ["xxx", "xxx", "x"]


def test_nodes(spark):
    text = "\\section{One}\n\\quad Kernel launch  $x$ ok\nend"
    df = spark.createDataFrame([("p", "a.tex", text), ("p", "b.tex", ""), ("q", "c.tex", None)], "paper_id string, rel_path string, content string")
    rows = sorted(segment.nodes(df).collect(), key=lambda r: (r.rel_path, r.node_idx))
    assert "".join(r.text for r in rows) == text
    assert {r.rel_path for r in rows} == {"a.tex"}
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.line_end == b.line_start and a.preserve != b.preserve
    own = [r.text for r in rows if not r.preserve]
    assert own[0] == "One" and own[-1].startswith("ok") and all(t == t.strip() for t in own)
    assert [r.t_idx for r in rows if not r.preserve] == list(range(len(own)))
    spans = sorted(segment.span_table(segment.nodes(df)).collect(), key=lambda r: r.start)
    assert all(a.start + a.length == b.start for a, b in zip(spans, spans[1:], strict=False))


def test_chunks_cover_nodes_in_order(spark):
    long = ". ".join(f"Sentence number {i} of many" for i in range(200))
    df = spark.createDataFrame([("p", "a.tex", f"{long}\n\n$x$ short text")], "paper_id string, rel_path string, content string")
    nodes = segment.nodes(df)
    rows = sorted(segment.chunks(nodes, 50).collect(), key=lambda r: r.chunk_idx)
    by_node = {}
    for r in rows:
        by_node.setdefault(r.owner_t_idx, []).append(r.text)
    for n in nodes.where("not preserve").collect():
        assert "".join(by_node[n.t_idx]) == n.text
    assert len(rows) > 20 and max(len(r.text) for r in rows) <= 50 * 3 + 4
