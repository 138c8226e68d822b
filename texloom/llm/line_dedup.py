"""Line dedup: later copies of maximal repeated runs of lines are deleted. DataFrame functions only.

All documents are sequences of line ids, and their suffixes are ordered by prefix doubling:
suffixes are ranked by their first line, then by pairs of ranks, which orders them by two lines,
by four and so on, until no two suffixes share a rank. Ranks come from a distributed sort of
the distinct pairs. A rank that several suffixes share is an interval of the suffix array; suffixes
whose next line occurs once leave at the first round, so later rounds hold repeated text only.

The intervals of the ranks have a longest common prefix of `lo` lines at least, where `lo` is a power of
two, and fall apart into intervals of `2 * lo` lines. Every suffix is a member of the deepest such interval
that begins with an earlier suffix. There the gap between `lo` and `2 * lo` is halved round by round: members
are split by the rank of what follows after `lo` lines; parts go on above the half, with their own
first suffix, and a part's first suffix goes on below it, under that of the whole interval. Once the gap is one
line, the groups are the intervals of the longest-common-prefix array with their exact length. So every suffix
gets the length of the longest run that it repeats of an earlier one, and as each member is in one group
at any time, the table of members never grows. Runs that the run before reaches as far as are part of it;
what is left are the maximal repeated runs, and their lines go.

Runs of `min_lines` lines count. With `min_chars`, shorter runs whose lines hold that many characters
together count too, so that repeated passages on one or two lines go and short or blank lines stay.

A document whose whole text an earlier one has is one run; its lines are left out before, so groups of copies don't
fill every interval. A very common line is counted before the shuffle; all groups are aggregated, none is collected, and joins
on a group are between a table with one row per group and one that adaptive execution splits.

Defined cases: a null text stays null and counts as one empty line; an empty text is one empty
line; ids may be numbers or strings; rows of equal doc_id and text are one document, those of one doc_id and
other texts are documents in an order by position and a hash of their text; documents with a null doc_id come last
in the order; a text may become empty, but its row stays; other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.llm.store import written

MIN_LINES = 3
MIN_CHARS = 20
HEAVY = 256  # copies of one text in one part of a join
BROADCAST_ROWS = 400_000
_LAST = (1 << 63) - 1
_SUFFIX = ["doc", "row", "pos"]


def _keys(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """doc, in the order of ids with nulls last, and row, which tells the texts of one id apart."""
    kind = docs.schema[doc_id].dataType.simpleString()
    numbers = kind in ("bigint", "int", "smallint", "tinyint")
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)) if numbers else F.coalesce(F.concat(F.lit("0"), F.col(doc_id).cast("string")), F.lit("1"))
    return [doc.alias("doc"), F.xxhash64(F.lit(7), F.coalesce(F.col(text), F.lit(""))).alias("row")]


def _lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row, pos, a 128-bit line id (h1, h2) and the characters (own) of every line."""
    return docs.select(*_keys(docs, doc_id, text), F.posexplode(_lines_of(text)).alias("pos", "line")).select(
        *_SUFFIX, F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), F.length("line").alias("own")
    )


def _at() -> Column:
    """A suffix in the order of documents; `row` tells apart what ids and positions don't."""
    return F.struct("doc", "pos", "row")


def _ranked(suffixes: DataFrame, keys: list[str], label: str, *more: str) -> DataFrame:
    """Suffixes whose key another suffix has too, with the key's rank (in sort order) and the first suffix of the class."""
    classes = suffixes.groupBy(*keys).agg(F.min(_at()).alias("first"), F.max(_at()).alias("last")).where("first < last").drop("last")
    ranks = classes.orderBy(*keys).withColumn("new_rank", F.monotonically_increasing_id())  # keys are distinct, so ranks are the same in a recomputation
    return written(suffixes.join(ranks, keys).select(*_SUFFIX, F.col("new_rank").alias("rank"), "first", *more), label)


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """Level k: doc, row, pos, rank, first of the suffixes that share their first 2**k lines with another; level 0 has `own` too."""
    levels = [_ranked(lines, ["h1", "h2"], "lines-1", "own")]
    while not levels[-1].isEmpty():
        step = 1 << (len(levels) - 1)
        now = levels[-1].select(*_SUFFIX, "rank")
        # equal rows repeat suffixes; one of them is enough as a successor
        ahead = now.select("doc", "row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next")).dropDuplicates(_SUFFIX)
        levels.append(_ranked(now.join(ahead, _SUFFIX), ["rank", "next"], f"lines-{2 * step}"))
    return levels[:-1]


def repeat_lengths(levels: list[DataFrame], least: int) -> DataFrame:
    """doc, row, pos, len: the lines that each suffix shares with an earlier one, the most of all, where they are `least` or more."""
    member = [level.where(_at() > F.col("first")).select(*_SUFFIX, F.struct(F.lit(k).alias("k"), "first").alias("in")) for k, level in enumerate(levels)]
    deepest = reduce(DataFrame.unionByName, member).groupBy(*_SUFFIX).agg(F.max("in").alias("in")).where(F.expr(f"shiftleft(2, in.k) > {least}"))
    left = written(deepest.select(*_SUFFIX, "in.first", F.expr("shiftleft(1, in.k)").alias("lo"), F.expr("shiftleft(1, in.k)").alias("gap")), "lines-members")
    ranks = [level.select(*_SUFFIX, F.lit(1 << k).alias("half"), "rank") for k, level in enumerate(levels[:-1])]
    known = written(reduce(DataFrame.unionByName, ranks).dropDuplicates([*_SUFFIX, "half"]), "lines-known") if ranks else None
    settled = [left.where("gap = 1")]
    for _ in range(len(levels) - 1):
        rank_at = lambda d, r, p, name: known.select(F.col("doc").alias(d), F.col("row").alias(r), F.col("pos").alias(p), "half", F.col("rank").alias(name))
        asked = left.where("gap > 1").withColumn("half", F.expr("gap div 2").cast("int")).withColumn("p", F.col("pos") + F.col("lo"))
        asked = asked.withColumn("fd", F.col("first.doc")).withColumn("fr", F.col("first.row")).withColumn("fp", F.col("first.pos") + F.col("lo"))
        asked = asked.join(rank_at("doc", "row", "p", "next"), ["doc", "row", "p", "half"], "left").join(rank_at("fd", "fr", "fp", "own"), ["fd", "fr", "fp", "half"], "left")
        asked = asked.select(*_SUFFIX, "first", "lo", "half", "next", F.coalesce(F.col("next") == F.col("own"), F.lit(False)).alias("same"))
        parts = asked.where("next is not null and not same").groupBy("lo", "first", "next").agg(F.min(_at()).alias("low"))
        split = asked.join(parts, ["lo", "first", "next"], "left")
        head = F.when(F.col("same"), F.col("first")).when(_at() > F.col("low"), F.col("low"))  # the first of the part, for all others in it
        up = head.isNotNull()
        moved = split.select(*_SUFFIX, F.coalesce(head, "first").alias("first"), F.when(up, F.col("lo") + F.col("half")).otherwise(F.col("lo")).alias("lo"), F.col("half").alias("gap"))
        left = written(moved.where(F.col("lo") + F.col("gap") > least), "lines-members")
        settled.append(left.where("gap = 1"))
    return reduce(DataFrame.unionByName, settled).select(*_SUFFIX, F.col("lo").alias("len"))


def whole_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row, lines, chars of the documents whose whole text an earlier document has."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    own = docs.select(*_keys(docs, doc_id, text), F.xxhash64(F.lit(8), body).alias("row2"), lines.alias("lines"), (F.length(body) - lines + 1).alias("chars"))
    same = ["row", "row2", "lines", "chars"]
    firsts = own.groupBy(*same).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.expr(f"cast(count(*) div {HEAVY} + 1 as int)").alias("fan"))
    firsts = written(firsts.where("first < last").drop("last"), "lines-firsts")
    # a text of very many copies is joined in several parts
    heavy = firsts.where("fan > 1").select(*same, "fan")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy.hint("merge")
    salted = own.join(heavy, same, "left").withColumn("salt", F.expr("if(fan is null, 0, cast(pmod(xxhash64(doc), fan) as int))")).drop("fan")
    parts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    return salted.join(parts, [*same, "salt"]).where("doc > first").select("doc", "row", "lines", "chars").distinct()


def repeated_runs(docs: DataFrame, *, min_lines: int = MIN_LINES, min_chars: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row, runs: for each document that repeats earlier lines, its maximal repeated runs (start, stop) in order."""
    copies = written(whole_copies(docs, doc_id, text), "lines-copies")
    fresh = line_ids(docs, doc_id, text).join(copies.select("doc", "row"), ["doc", "row"], "left_anti")
    levels = suffix_levels(written(fresh, "lines-0"))
    if not levels:
        found = line_ids(docs, doc_id, text).select(*_SUFFIX, F.lit(0).alias("len")).limit(0)
    else:
        found = repeat_lengths(levels, min_lines if min_chars is None else 1)
    if levels and min_chars is not None:
        found = written(found, "lines-lengths")
        short = found.where(F.col("len") < min_lines)
        own = levels[0].select("doc", "row", F.col("pos").alias("at"), "own").dropDuplicates(["doc", "row", "at"])
        spread = short.distinct().withColumn("at", F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1))).join(own, ["doc", "row", "at"])
        long = spread.groupBy(*_SUFFIX, "len").agg(F.sum("own").alias("chars")).where(F.col("chars") >= min_chars).drop("chars")
        found = found.where(F.col("len") >= min_lines).unionByName(long)
    long_copy = F.col("lines") >= min_lines if min_chars is None else (F.col("lines") >= min_lines) | (F.col("chars") >= min_chars)
    found = found.unionByName(copies.where(long_copy).select("doc", "row", F.lit(0).alias("pos"), F.col("lines").alias("len")))
    spans = F.array_sort(F.collect_set(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop"))))
    # a suffix repeats at least what is left of the run before it, so stops never fall; a run that stops where the one before did is part of it
    further = F.filter("spans", lambda s, i: (i == 0) | (F.get("spans", i - 1)["stop"] < s["stop"]))
    return found.groupBy("doc", "row").agg(spans.alias("spans")).select("doc", "row", further.alias("runs"))


def later_copies(docs: DataFrame, *, min_lines: int = MIN_LINES, min_chars: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row, gone: for each document that loses lines, their positions."""
    runs = repeated_runs(docs, min_lines=min_lines, min_chars=min_chars, doc_id=doc_id, text=text)
    fresh = lambda s, i: F.sequence(F.greatest(s["start"], F.coalesce(F.get("runs", i - 1)["stop"], F.lit(0))), s["stop"] - 1)
    return runs.select("doc", "row", F.flatten(F.transform("runs", fresh)).alias("gone"))


def remove_repeated_lines(
    docs: DataFrame, *, min_lines: int = MIN_LINES, min_chars: int | None = None, doc_id: str = "doc_id", text: str = "text", counts: bool = False
) -> DataFrame:
    """`docs` with the later copies deleted from their texts; with `counts`, also n_lines and n_removed."""
    gone = written(later_copies(docs, min_lines=min_lines, min_chars=min_chars, doc_id=doc_id, text=text), "lines-gone")
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that clash with none of ours
    body = own[text]
    # texts move once at every size; a join that broadcasts small lists would only look cheaper on small inputs
    named = docs.toDF(*own.values())
    joined = named.select("*", *_keys(named, own[doc_id], body)).join(gone.hint("merge"), ["doc", "row"], "left")
    # the lines are a column: inside the element function an expression would be split again for each line
    joined = joined.withColumn("parts", _lines_of(body))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    new = F.when(F.col("gone").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n")).otherwise(F.col(body))
    more = [F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    return joined.select(*[new.alias(c) if c == text else F.col(o).alias(c) for c, o in own.items()], *more)
