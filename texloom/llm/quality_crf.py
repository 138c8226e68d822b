"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Features describe the line and its neighbours; a transition weight
ties adjacent lines. Forward and backward passes give each line's probability to be good, and
their mean, weighted by the lines' bytes, is the document's raw quality; a logistic
calibration fitted on the same training rows turns it into the score.

Training: at most `SAMPLE_DOCS` labelled documents (those whose ids hash lowest, of at most
`SAMPLE_BYTES` each and `SAMPLE_LINES` lines together) come to the driver as feature matrices; each line carries its document's
label. Scoring: one pass over all whole texts, without a shuffle.

Defined cases: null and empty texts have one empty line and get its score; labels other than
0 and 1 do not train; of repeated labels the smallest counts; without labels of both kinds
every score is 0.5; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.llm import textvec as tv

SAMPLE_DOCS = 4_000
SAMPLE_BYTES = 1 << 20
SAMPLE_LINES = 500_000
THRESHOLD = 0.7
_KINDS = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "symbol": b"#*$%&<>@^~=+\\{}[]_/", "bar": b"|", "bang": b"!", "stop": b".?", "comma": b",;:",
}
_FLAGS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _KINDS.items()}
OWN = ("bytes", "words", *_KINDS, "mean_word", "wide", "same_pairs", "seen_words", "seen_line", "empty", "doc_words", "doc_seen")
NEAR = ("bytes", "upper", "symbol", "bar", "bang", "same_pairs", "seen_words", "seen_line")
N_FEATURES = len(OWN) + 2 * len(NEAR) + 2


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its bytes, and each text's first line index (with the total last)."""
    texts = tv.Texts(column)
    words, lines = tv.Words(texts, tv.SPACE), tv.Lines(texts)
    data, n = texts.bytes, lines.end - lines.start
    line_of = np.searchsorted(lines.start, words.start, side="right") - 1
    count = np.bincount(line_of, minlength=len(n))[: len(n)].astype(float)
    per_word = np.maximum(count, 1)
    share = lambda flags: np.bincount(line_of[flags], minlength=len(n))[: len(n)] / per_word
    pairs = np.zeros(len(words.h), bool)
    pairs[1:] = (words.h[1:] == words.h[:-1]) & (line_of[1:] == line_of[:-1])
    seen = tv.repeats(words.row, words.h)[0]
    own = {
        "bytes": np.log1p(n),
        "words": np.log1p(count),
        **{k: lines.sums(f[data]) / per_word for k, f in _FLAGS.items()},
        "mean_word": lines.sums(words.inside) / per_word,
        "wide": lines.sums(data >= 128) / np.maximum(n, 1),
        "same_pairs": share(pairs),
        "seen_words": share(seen),
        "seen_line": (tv.repeats(lines.row, lines.h)[0] & (n > 0)).astype(float),
        "empty": (count == 0).astype(float),
        "doc_words": np.log1p(words.count)[lines.row],
        "doc_seen": (tv.per_row(seen, words.first) / np.maximum(words.count, 1))[lines.row],
    }
    x = np.zeros((len(n), N_FEATURES), np.float32)
    for j, k in enumerate(OWN):
        x[:, j] = own[k]
    first, last = np.zeros(len(n), bool), np.zeros(len(n), bool)
    first[lines.first[:-1]] = True
    last[lines.first[1:] - 1] = True
    for j, k in enumerate(NEAR):
        x[1:, len(OWN) + j] = own[k][:-1]
        x[:-1, len(OWN) + len(NEAR) + j] = own[k][1:]
    x[first, len(OWN) : len(OWN) + len(NEAR)] = 0
    x[last, len(OWN) + len(NEAR) : -2] = 0
    x[:, -2], x[:, -1] = first, last
    return x, n, lines.first


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray  # log potentials of (state, next state)
    slope: float = 1.0
    shift: float = 0.0

    def potentials(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias

    def line_marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(self.potentials(x), first, self.trans)[0]

    def raw(self, x: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each document's lines."""
        p = self.line_marginals(x, first)
        w = np.maximum(n, 1e-6)
        return np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def score(self, x: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.raw(x, n, first)) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def forward_backward(s: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, expected transition counts, and the log partition function, over
    chains given by their first index. All chains advance together, the longest first in order."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # chains longer than t
    top = np.maximum(s, 0)
    e = np.stack([np.exp(-top), np.exp(s - top)], axis=1)
    m = np.exp(trans - trans.max())
    alpha, norm = np.zeros_like(e), np.ones(len(s))
    for t in range(steps):
        at = start[: active[t]] + t
        a = e[at] * 0.5 if t == 0 else (alpha[at - 1] @ m) * e[at]
        z = a.sum(axis=1)
        alpha[at], norm[at] = a / z[:, None], z
    beta = np.ones_like(e)
    count = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = start[: active[t + 1]] + t
        ahead = e[at + 1] * beta[at + 1] / norm[at + 1][:, None]
        beta[at] = ahead @ m.T
        count += alpha[at].T @ ahead * m
    p = alpha * beta
    p = p[:, 1] / p.sum(axis=1)
    log_z = float(np.log(norm).sum() + top.sum() + (len(s) - len(length)) * trans.max())
    return p, count, log_z


def train(x: np.ndarray, n: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = 120, rate: float = 0.08, ridge: float = 1e-3) -> Crf:
    """Conditional maximum likelihood by Adam over all chains; every line carries its document's label."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - mean) / scale, -6, 6).astype(float)
    length = np.diff(first)
    y = np.repeat(good, length).astype(float)
    same = np.array([((length - 1) * ~good).sum(), ((length - 1) * good).sum()], float)
    total = float(len(y))
    theta = np.zeros(N_FEATURES + 5)  # weights, bias, transitions
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        trans = theta[-4:].reshape(2, 2)
        p, count, _ = forward_backward(z @ theta[:N_FEATURES] + theta[N_FEATURES], first, trans)
        grad = np.concatenate([z.T @ (y - p), [(y - p).sum()], (np.diag(same) - count).ravel()]) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    crf = Crf(mean, scale, theta[:N_FEATURES], float(theta[N_FEATURES]), theta[-4:].reshape(2, 2))
    crf.slope, crf.shift = _calibration(_logit(crf.raw(x, n, first)), good.astype(float))
    return crf


def _calibration(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of y on t with a small ridge, by Newton steps."""
    design, w = np.stack([t, np.ones_like(t)], axis=1), np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(design @ w)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - 1e-2 * (w - [0.5, 0.0]))
        w = w + np.clip(step, -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


def held_out(doc_id: str = "doc_id") -> Column:
    """Labels of these rows never train: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Crf | None:
    """A field trained on at most `limit` labelled documents, or None without labels of both kinds."""
    marks = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q"))
    chosen = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(limit))  # `limit` rows of two numbers
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("_text")).join(chosen, "_id")
    texts = texts.where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= SAMPLE_BYTES)
    lines = F.size(F.split(F.coalesce(F.col("_text").cast("string"), F.lit("")), "\n", -1))
    # a row for each of the chosen documents, in the order in which they were chosen, up to SAMPLE_LINES lines together
    before = F.sum("lines").over(Window.orderBy(F.xxhash64("_id"), "_id"))
    few = texts.select("_id", lines.alias("lines")).groupBy("_id").agg(F.max("lines").alias("lines")).withColumn("before", before).where(F.col("before") <= SAMPLE_LINES)
    rows = texts.join(F.broadcast(few.select("_id")), "_id").select("_id", "_q", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "_text"):
                x, n, first = line_features(part.column("_text"))
                spans = list(zip(first[:-1], first[1:], strict=True))
                yield pa.record_batch(
                    [
                        part.column("_id"),
                        part.column("_q"),
                        pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([n[a:b].astype(np.int64).tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["_id", "_q", "x", "n"],
                )

    kind = lambda c: rows.schema[c].dataType.simpleString()
    got = rows.mapInArrow(run, f"_id {kind('_id')}, _q {kind('_q')}, x binary, n binary").toPandas().drop_duplicates("_id").sort_values("_id")
    good = got["_q"].to_numpy() == 1
    if not len(good) or good.all() or not good.any():
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES)
    n = np.frombuffer(b"".join(got["n"]), np.int64)
    first = np.concatenate([[0], np.cumsum([len(b) // 8 for b in got["n"]])])
    return train(x, n, first, good)


def score(docs: DataFrame, crf: Crf | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, score for every row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                x, n, first = line_features(part.column("text"))
                s = crf.score(x, n, first) if crf else np.full(part.num_rows, 0.5)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(s.astype(float), pa.float64())], names=["doc_id", "n_lines", "score"]
                )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_lines long, score double")


def classify(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines for every document."""
    scored = score(docs, fit(docs, labels, limit))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines")
