"""Quality rules: decision lists learned by sequential covering, run as Spark conditions.

One pass over the texts gives every document a row of statistics. A bounded sample of
labelled rows trains an ordered list of rules: each rule is grown as a conjunction of
thresholds by information gain on two thirds of the sample, pruned from its end on the other
third, and kept while its precision there is high; the documents it covers leave the sample
and the next rule is grown. The list becomes one `CASE WHEN` expression over the statistics,
so a verdict names the rule that gave it.

Fixed base rules come first: too few words, or too many words inside repeated 3-word windows.

Defined cases: null texts have no words; rows without label, or with a label other than 0
and 1, do not train; repeated labels of one document train once (the smallest); an empty or
one-sided sample gives an empty list, so only the base rules reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.llm import textvec as tv
from texloom.llm.store import written

#: Bound of the labelled rows that come to the driver for training.
SAMPLE_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_bytes", "n_upper", "n_digits", "n_bars", "n_bangs", "n_stops", "n_same_pairs", "n_distinct")
SYMBOLS = b"[#*$%&|<>]"[1:-1]


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


_SYMBOL, _UPPER, _DIGIT = _flags(SYMBOLS), _flags(bytes(range(65, 91))), _flags(b"0123456789")
_BAR, _BANG, _STOP = _flags(b"|"), _flags(b"!"), _flags(b".?")
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and EXTRA of each text of a column."""
    texts = tv.Texts(column)
    words = tv.Words(texts, tv.SPACE)
    lines = tv.Lines(texts)
    data, at = texts.bytes, texts.offsets
    of = lambda flags: tv.per_row(flags, at)
    has_word = lines.sums(words.inside) > 0
    again = np.zeros(len(lines.h), bool)
    again[has_word] = tv.repeats(lines.row[has_word], lines.h[has_word])[0]
    windows, h = words.windows(3)
    twice = windows[tv.repeats(words.row[windows], h)[1]] if len(windows) else windows
    pairs = np.zeros(len(words.h), bool)
    pairs[1:] = (words.h[1:] == words.h[:-1]) & (words.row[1:] == words.row[:-1])
    seen = tv.repeats(words.row, words.h)[0]
    return {
        "n_words": words.count,
        "word_chars": of(words.inside & ~_CONTINUES[data]),
        "n_symbols": of(_SYMBOL[data]),
        "n_dup_lines": tv.per_row(again, lines.first),
        "n_repeat_words": tv.per_row(tv.covered(len(words.h), twice, 3), words.first),
        "n_lines": tv.per_row(has_word, lines.first),
        "n_bytes": np.diff(at),
        "n_upper": of(_UPPER[data]),
        "n_digits": of(_DIGIT[data]),
        "n_bars": of(_BAR[data]),
        "n_bangs": of(_BANG[data]),
        "n_stops": of(_STOP[data]),
        "n_same_pairs": tv.per_row(pairs, words.first),
        "n_distinct": tv.per_row(~seen, words.first),
    }


def document_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in `keep`, then COUNTS and EXTRA as longs; one row per document, no shuffle."""
    within = text in keep  # then the text travels once
    read = text if within else "_text"
    source = docs.select(*keep, *([] if within else [F.col(text).cast("binary").alias("_text")]))
    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS + EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, read):
                counts = text_counts(part.column(read))
                yield pa.record_batch(
                    [part.column(c) for c in keep] + [pa.array(counts[c], pa.int64()) for c in COUNTS + EXTRA],
                    names=[*keep, *COUNTS, *EXTRA],
                )

    return source.mapInArrow(run, ", ".join(fields))


#: Ratios that rules test: name -> (numerator, denominator).
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_bytes"),
    "digit_share": ("n_digits", "n_bytes"),
    "bars_per_word": ("n_bars", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "words_per_stop": ("n_words", "n_stops"),
    "same_pair_share": ("n_same_pairs", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
}
FEATURES = ("n_words", *RATIOS)


def feature(name: str) -> Column:
    """A feature as a column; a denominator of 0 counts as 1."""
    if name not in RATIOS:
        return F.col(name).cast("double")
    top, bottom = RATIOS[name]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = feature(self.feature)
        return f > self.threshold if self.above else f <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        f = x[:, FEATURES.index(self.feature)]
        return f > self.threshold if self.above else f <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _best_test(x: np.ndarray, bad: np.ndarray, bins: int) -> tuple[float, Test | None]:
    """The threshold with the most information gain for bad rows (gain as in FOIL)."""
    p0, n0 = bad.sum(), (~bad).sum()
    best: tuple[float, Test | None] = (0.0, None)
    for j, name in enumerate(FEATURES):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        where = np.searchsorted(cuts, x[:, j], side="left")  # rows of bins <= i satisfy x <= cuts[i]
        p = np.cumsum(np.bincount(where[bad], minlength=len(cuts) + 1))[:-1]
        n = np.cumsum(np.bincount(where[~bad], minlength=len(cuts) + 1))[:-1]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0)
            if len(gain) and gain.max() > best[0] + 1e-9:
                i = int(gain.argmax())
                low, high = x[x[:, j] <= cuts[i], j], x[x[:, j] > cuts[i], j]
                # any threshold in the gap splits the sample alike; its middle leaves both sides most room
                middle = (low.max() + high.min()) / 2 if len(low) and len(high) else cuts[i]
                best = (float(gain[i]), Test(name, above, float(middle)))
    return best


def learn_rules(
    x: np.ndarray, bad: np.ndarray, *, max_rules: int = 12, max_tests: int = 4, min_precision: float = 0.8, bins: int = 64, min_cover: int = 5
) -> list[Rule]:
    """Ordered rules for bad rows by sequential covering; rows alternate between growing and pruning (2 to 1)."""
    rules: list[Rule] = []
    grow = np.arange(len(x)) % 3 != 2
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and (bad & left & grow).sum() >= min_cover:
        rule: list[Test] = []
        inside = left & grow
        while len(rule) < max_tests and (~bad & inside).any():
            gain, test = _best_test(x[inside], bad[inside], bins)
            if test is None:
                break
            rule.append(test)
            inside &= test.holds(x)
        if not rule:
            break

        def worth(r: list[Test], left=left) -> float:
            hit = _holds(tuple(r), x) & left & ~grow
            p, n = (bad & hit).sum(), (~bad & hit).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = _holds(tuple(rule), x) & left
        both = bad[hit].mean() if hit.any() else 0.0
        check = hit & ~grow
        if hit.sum() < min_cover or both < min_precision or (check.any() and bad[check].mean() < min_precision):
            break
        rules.append(tuple(rule))
        left &= ~hit
    return rules


def training_rows(stats: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, held_out: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and badness of at most `limit` labelled rows, those whose ids hash lowest."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    if held_out is not None:
        marks = marks.where(~held_out)
    order = F.xxhash64("_id")
    chosen = marks.orderBy(order, "_id").limit(limit)
    rows = (
        stats.join(chosen, stats["doc_id"] == chosen["_id"])
        .select("_id", *[feature(f).alias(f) for f in FEATURES], "_quality")
        .dropDuplicates(["_id"])
        .toPandas()
        .sort_values("_id")
    )
    return rows[list(FEATURES)].to_numpy(float), rows["_quality"].to_numpy() == 0


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def first_rule(rules: list[Rule]) -> Column:
    """The text of the first rule that holds, else null: an ordered CASE WHEN."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = out.when(condition, F.lit(" and ".join(map(str, rule))))
    return out


#: Labels of every fourth document (by CRC-32 of its id) are left for tests.
def held_out(name: str = "_id") -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """`stats` with base_failed, rule (the learned rule that rejects, else null) and kept."""
    rule = first_rule(rules)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def fit(stats: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the labels that aren't held out."""
    x, bad = training_rows(stats, labels, limit, held_out())
    return learn_rules(x, bad) if len(x) else []


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents that the base rules or the learned rules reject; columns as they were."""
    stats = written(document_stats(docs), "rules-stats")
    rules = fit(stats, labels)
    own = [f"c{i}" for i in range(len(docs.columns))]  # names that clash with no count
    judged = judge(document_stats(docs.toDF(*own), keep=tuple(own), text=own[docs.columns.index("text")]), rules)
    return judged.where("kept").select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])
