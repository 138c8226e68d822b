"""Personal data: candidate spans judged by boosted trees, in DataFrame expressions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; matches that fail
their check (parts, Luhn, digits) are dropped. Looser generators propose more spans, which may
overlap: spaced or spelled-out addresses, groups of four digits, digit runs, phone numbers
without a plus, colon-separated addresses. Each candidate has small integer features of its
format and context.

Nobody has labelled personal data here, so a candidate's label is the check that its number or address
carries in itself: Luhn's digit, the parts of an address, a top-level domain of letters, an area code. Features don't
see what the check sees, so trees learn which formats and contexts hold valid data. Loose candidates
that touch a base span of their kind say nothing new and neither train nor count.

Training pre-aggregates all candidates of all documents by their feature cell (at most
`MAX_CELLS` cells by construction), so the driver boosts trees on cell counts, whatever the
size of the corpus. Trees become `CASE WHEN` expressions. For each kind the lowest score at
which held-out candidates besides the base spans reach `PRECISION` is the threshold, and candidates
above it are added to the base spans, which always stay. Kinds without such a threshold, or with
fewer than `MIN_HELD` valid held-out candidates above it, add nothing.

Patterns are anchored at the previous match or the start of a run of their first class and
use possessive repeats: they find the same leftmost matches in linear time and stack.

Defined cases: null and empty texts have no spans; a text of any length is scanned whole;
repeated rows are judged row by row; other columns are ignored, whatever their names. All steps take time in
proportion to the matches of a text (times their logarithm): spans of a kind's base pattern are disjoint and in
order, so overlaps are found by binary search, and equal spans are neighbours once sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.llm.store import written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
MIN_HELD = 10
_LOCAL = "A-Za-z0-9._%+-"
#: generator -> (kind, pattern, characters one of which any match holds)
BASE = {
    "email": ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]"),
    "card": ("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
LOOSE = {
    "spelled": ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++", r"@|\(at\)|\[at\]"),
    "fours": ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])", "[0-9]{4}"),
    "run": ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", "[0-9]{13}"),
    "local": ("phone", r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])", "[0-9]{3}"),
    "colons": ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", ":"),
}
GENERATORS = BASE | LOOSE
KEYWORDS = r"(?i)(mail|contact|phone|tel|call|fax|card|visa|iban|account|addr|\bip\b|host|server)"
#: feature -> number of values; the product bounds the cells that can occur.
FEATURES = {"gen": len(GENERATORS), "digits": 6, "seps": 4, "before": 4, "after": 4, "keyword": 2, "long": 3}
MAX_CELLS = math.prod(FEATURES.values())
BLOCK = 512


def candidate_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and cands: array of (kind, start, end, base, features), for every row of `docs`."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.withColumn("t", F.when(F.col("t").rlike("[0-9@:]|[(\\[]at[)\\]]"), F.col("t")))
    for name, (_, pattern, needs) in GENERATORS.items():
        has = F.col("t").rlike(needs)
        df = df.withColumn(f"g_{name}", F.when(has, F.split("t", pattern, -1))).withColumn(
            f"m_{name}", F.when(has, F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
        )
    df = df.drop("t")
    for name in GENERATORS:
        df = df.withColumn(f"c_{name}", F.expr(_LOCATE.format(g=f"g_{name}", m=f"m_{name}", block=BLOCK))).drop(f"g_{name}", f"m_{name}")
    every = []
    for number, (name, (kind, _, _)) in enumerate(GENERATORS.items()):
        every.append(F.transform(F.coalesce(f"c_{name}", F.expr(_NO_SPANS)), _describer(number, kind, name)))
    df = df.select("doc_id", F.concat(*every).alias("cands"))
    return df.select("doc_id", _with_bases(lambda bases: F.transform("cands", lambda c: c.withField("overlaps", c["base"] | _overlaps_base(bases, c)))).alias("cands"))


def _with_bases(body: Callable[[Column], Column]) -> Column:
    """An expression over the base spans of each kind. They are an element of an array here: as a column they could be
    merged into the element functions that look into them and be found anew for each element."""
    as_span = lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))
    bases = F.array(*[F.transform(F.filter("cands", _base_of(k)), as_span) for k in range(len(KINDS))])
    return F.get(F.transform(F.array(bases), body), F.lit(0))


def _base_of(kind: int):
    return lambda c: c["base"] & (c["kind"] == kind)


def _last_before(spans: Column, at: Column) -> Column:
    """The last of some disjoint, ordered spans that begins before a position, or null, by binary search."""
    halves = F.sequence(F.length(F.bin(F.size(spans))) - 1, F.lit(0), F.lit(-1))

    def further(n: Column, k: Column) -> Column:
        more = n + F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.get(spans, more - 1)["start"] < at, more).otherwise(n)

    return F.get(spans, F.aggregate(halves, F.lit(0), further) - 1)


def _overlaps_base(bases: Column, c: Column) -> Column:
    """Whether a candidate overlaps one of its kind's `bases`."""
    return F.coalesce(_last_before(F.get(bases, c["kind"]), c["end"])["end"] > c["start"], F.lit(False))


def _inside_base(bases: Column, c: Column) -> Column:
    """Whether a candidate lies in one of its kind's `bases`."""
    return F.coalesce(_last_before(F.get(bases, c["kind"]), c["start"] + 1)["end"] >= c["end"], F.lit(False))


#: Gaps and matches to spans: offsets of blocks of matches first, then inside each block.
_NO_SPANS = "cast(array() as array<struct<s:int,e:int,m:string,pre:string,post:string>>)"
_LOCATE = """
if({m} is null or size({m}) = 0, """ + _NO_SPANS + """,
  flatten(transform(
    aggregate(
      transform(sequence(0, (size({m}) - 1) div {block}), b ->
        transform(slice({m}, cast(b * {block} + 1 as int), {block}), (m, i) ->
          named_struct('g', length(get({g}, cast(b * {block} as int) + i)), 'm', m,
            'pre', right(get({g}, cast(b * {block} as int) + i), 24),
            'post', left(get({g}, cast(b * {block} as int) + i + 1), 2)))),
      named_struct('p', 0, 'out', cast(array() as array<struct<p:int,x:array<struct<g:int,m:string,pre:string,post:string>>>>)),
      (a, x) -> named_struct(
        'p', a.p + aggregate(x, 0, (n, y) -> n + y.g + length(y.m)),
        'out', array_append(a.out, named_struct('p', a.p, 'x', x))),
      a -> a.out),
    o -> aggregate(
      o.x,
      named_struct('p', o.p, 'out', """ + _NO_SPANS + """),
      (a, y) -> named_struct(
        'p', a.p + y.g + length(y.m),
        'out', array_append(a.out, named_struct('s', a.p + y.g, 'e', a.p + y.g + length(y.m), 'm', y.m, 'pre', y.pre, 'post', y.post))),
      a -> a.out))))
"""  # fmt: skip


def _luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits passes Luhn's check; false for other lengths."""
    n = F.length(digits)

    def doubled(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), doubled), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _parts_ok(match: Column) -> Column:
    """Whether the four dotted parts are at most 255; leading zeros don't count."""
    short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def _class(c: Column) -> Column:
    """0 none or newline, 1 blank, 2 letter or digit, 3 other."""
    return F.when(c.isNull() | (c == "") | (c == "\n"), 0).when(c == " ", 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def _describer(number: int, kind: str, name: str):
    return lambda c: _described(c, number, kind, name)


#: What loose candidates are checked for; no feature tells it.
CHECKS = {
    "email": r"[A-Za-z].*[A-Za-z]{2,6}$",
    "spelled": r"^[^@(\[]*[A-Za-z].*[.)\]]\x20?[A-Za-z]{2,6}$",
    "local": r"^\(?[2-9][0-9]{1,3}\)?[\x20.-]?[2-9][0-9]{2}[\x20.-][0-9]{3,4}$",
    "colons": r"^(?=.*[A-Fa-f])(?!(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$)",
}


def _described(c: Column, number: int, kind: str, name: str) -> Column:
    digits = F.regexp_replace(c["m"], "[^0-9]", "")
    n = F.length(digits)
    seps = F.length(c["m"]) - F.length(F.regexp_replace(c["m"], r"[\x20().\-]", ""))
    luhn = _luhn(digits)
    valid = {"email": F.lit(True), "ip": _parts_ok(c["m"]), "card": n.between(16, 19) & luhn, "phone": n.between(8, 15)}.get(name, F.lit(False))
    checked = c["m"].rlike(CHECKS[name]) if name in CHECKS else luhn if kind == "card" else valid
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        c["s"].alias("start"),
        c["e"].alias("end"),
        valid.alias("base"),
        F.lit(False).alias("overlaps"),
        checked.alias("label"),
        F.lit(number).alias("gen"),
        F.when(n < 4, 0).when(n < 8, 1).when(n < 12, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5).alias("digits"),
        F.least(seps, F.lit(3)).alias("seps"),
        _class(F.right(c["pre"], F.lit(1))).alias("before"),
        _class(F.left(c["post"], F.lit(1))).alias("after"),
        c["pre"].rlike(KEYWORDS).cast("int").alias("keyword"),
        F.when(F.length(c["m"]) < 12, 0).when(F.length(c["m"]) < 20, 1).otherwise(2).alias("long"),
    )


@dataclass
class Trees:
    """Boosted trees over feature cells: nested (feature, value, yes, no) with numbers as leaves."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)
    #: kind -> precision and recall of what is added, over held-out candidates besides base spans
    quality: dict[int, tuple[float, float]] = field(default_factory=dict)

    def value(self, cell: dict) -> float:
        return self.start + sum(_leaf(t, cell) for t in self.trees)

    def column(self, c: Column) -> Column:
        total = F.lit(self.start)
        for t in self.trees:
            total = total + _tree_column(t, c)
        return total

    def accepts(self, c: Column) -> Column:
        """Whether a candidate's score reaches its kind's threshold."""
        out = F.lit(False)
        score = self.column(c)
        for kind, t in self.thresholds.items():
            out = out | ((c["kind"] == kind) & (score >= t - 1e-9))
        return out


def _leaf(tree, cell: dict) -> float:
    while isinstance(tree, tuple):
        f, v, yes, no = tree
        tree = yes if cell[f] <= v else no
    return tree


def _tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, v, yes, no = tree
    return F.when(c[f] <= v, _tree_column(yes, c)).otherwise(_tree_column(no, c))


def _grow(cells: list[dict], depth: int, ridge: float):
    """A regression tree on gradients g and curvatures h by second-order gain."""
    g, h = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    best = (1e-6, None)
    if depth:
        for f, size in FEATURES.items():
            gl = hl = 0.0
            sums: dict[int, list[float]] = {}
            for c in cells:
                s = sums.setdefault(c[f], [0.0, 0.0])
                s[0] += c["g"]
                s[1] += c["h"]
            for v in range(size - 1):
                s = sums.get(v)
                if s is None:
                    continue
                gl, hl = gl + s[0], hl + s[1]
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                if gain > best[0]:
                    best = (gain, (f, v))
    if best[1] is None:
        return 0.3 * g / (h + ridge)
    f, v = best[1]
    return (f, v, _grow([c for c in cells if c[f] <= v], depth - 1, ridge), _grow([c for c in cells if c[f] > v], depth - 1, ridge))


def boost(cells: list[dict], rounds: int = 25, depth: int = 3, ridge: float = 1.0) -> Trees:
    """Trees from cells with counts n0, n1 (training) and v0, v1 (held out)."""
    model = Trees()
    n1, n = sum(c["n1"] for c in cells), sum(c["n0"] + c["n1"] for c in cells)
    if not n1 or n1 == n:
        return model
    model.start = math.log(n1 / (n - n1))
    score = [model.start] * len(cells)
    for _ in range(rounds):
        for c, s in zip(cells, score, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            c["g"], c["h"] = c["n1"] - (c["n0"] + c["n1"]) * p, (c["n0"] + c["n1"]) * p * (1 - p)
        tree = _grow(cells, depth, ridge)
        model.trees.append(tree)
        score = [s + _leaf(tree, c) for s, c in zip(score, cells, strict=True)]
    for kind in range(len(KINDS)):
        own = sorted(((s, c) for s, c in zip(score, cells, strict=True) if c["kind"] == kind), key=lambda x: -x[0])
        good = bad = 0
        for i, (s, c) in enumerate(own):
            good, bad = good + c["v1"], bad + c["v0"]
            last = i + 1 == len(own) or own[i + 1][0] < s
            if last and good >= MIN_HELD and good / (good + bad) >= PRECISION:
                model.thresholds[kind] = s
                model.quality[kind] = (good / (good + bad), good / sum(c["v1"] for _, c in own))
    return model


def fit(cands: DataFrame) -> Trees:
    """Trees from all candidates, counted by cell; every fourth document only sets thresholds."""
    names = list(FEATURES)
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("held")
    rows = cands.select(held, F.explode("cands").alias("c")).select("held", *[f"c.{f}" for f in ("kind", "base", "overlaps", "label", *names)])
    held_, label, more = F.col("held"), F.col("label"), ~F.col("overlaps")
    trains = ~held_ & (F.col("base") | more)  # held-out ones count only where they'd add something
    cells = rows.groupBy("kind", *names).agg(
        F.count_if(trains & ~label).alias("n0"), F.count_if(trains & label).alias("n1"), F.count_if(held_ & more & ~label).alias("v0"), F.count_if(held_ & more & label).alias("v1")
    )
    return boost([r.asDict() for r in sorted(cells.collect())])  # at most MAX_CELLS rows


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: sorted arrays of (kind, start, end); spans holds base and what the trees
    add, without what lies inside a base span of its kind."""
    cands = written(candidate_rows(docs, doc_id, text), "pii-candidates")
    model = fit(cands)
    as_span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    def chosen(bases: Column) -> Column:
        keep = F.filter("cands", lambda c: c["base"] | (model.accepts(c) & ~_inside_base(bases, c)) if model.thresholds else c["base"])
        every = F.array_sort(F.transform(keep, as_span))
        new = F.get(F.transform(F.array(every), lambda a: F.filter(a, lambda c, i: (i == 0) | (c != F.get(a, i - 1)))), F.lit(0))
        return F.struct(F.flatten(bases).alias("base"), new.alias("spans"))

    return cands.select("doc_id", _with_bases(chosen).alias("s")).select("doc_id", "s.base", "s.spans")


def as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[{}]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the text with every chosen span replaced by its kind; of overlapping spans the first goes, whole."""
    spans = find_spans(docs, doc_id, text).select(F.col("doc_id").alias("_id"), "spans")
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(spans.dropDuplicates(["_id"]), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    labels = F.array(*[F.lit(mark.format(k.upper())) for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("p"), F.lit("").alias("o")),
        lambda a, s: F.when(s["start"] < a["p"], a).otherwise(
            F.struct(s["end"].alias("p"), F.concat(a["o"], F.substr("text", a["p"] + 1, s["start"] - a["p"]), F.get(labels, s["kind"])).alias("o"))
        ),
    )
    return joined.select("doc_id", F.when(F.size("spans") > 0, F.concat(done["o"], F.substr("text", done["p"] + 1, F.length("text")))).otherwise(F.col("text")).alias("text"))
