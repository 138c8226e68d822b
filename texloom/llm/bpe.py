"""Byte-level BPE over a public vocabulary file: encoding and decoding of whole texts.

A text is cut into words by the vocabulary's pattern; each word is merged by itself. Merging
holds, for one short word, the part boundaries and the rank of every adjacent pair in
contiguous arrays: scan for the smallest rank, delete the boundary between the two parts,
refresh the ranks of the two neighbours, and repeat until no pair has a rank. A bounded
table in each task keeps the tokens of the words it has met. Nothing is shuffled.

Special tokens of the file (`<|endoftext|>`) in a text become their own ids, as the
`tokenizers` library does by default. Ids equal those of that library.

Defined cases: null and empty texts have no tokens; other columns pass through; texts and
ids of any length are handled row by row; a word longer than `LONG_WORD` bytes is merged
with a heap over linked parts, since repeated scans would cost its length squared.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from texloom.llm import textvec as tv

#: Words as the byte-level vocabularies cut them (a fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 200
TABLE_WORDS = 200_000
NONE = 1 << 60
CHUNK = 1 << 19  # bytes of texts whose tokens a task holds at once, or one text


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the file: printable Latin-1 characters
    stand for themselves, the rest are numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_letter = {c: b for b, c in byte_letters().items()}
        as_bytes = lambda s: bytes(of_letter[c] for c in s)
        self.ids = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if all(c in of_letter for c in k)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.size = max(self.bytes_of) + 1
        self.table = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.text_of = [str(i) for i in range(self.size)]
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def _rank(self, parts: list[bytes], i: int) -> int:
        return self.ranks.get((parts[i], parts[i + 1]), NONE)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one word."""
        whole = self.ids.get(word)
        n = len(word)
        if n == 1:
            return (whole,)
        if n > LONG_WORD:
            return self._merge_long(word)
        ranks = self.ranks
        bounds = list(range(n + 1))
        near = [ranks.get((word[i : i + 1], word[i + 1 : i + 2]), NONE) for i in range(n - 1)]
        while near:
            low = min(near)
            if low == NONE:
                break
            i = near.index(low)
            del bounds[i + 1]
            del near[i]
            if i < len(near):
                near[i] = ranks.get((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), NONE)
            if i:
                near[i - 1] = ranks.get((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), NONE)
        ids = self.ids
        return tuple([ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)])

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges in the same order, in n log n steps."""
        n = len(word)
        end, before, live = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
        ranks, queue = self.ranks, []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = ranks.get((word[i:j], word[j : end[j]]), NONE)
                if rank != NONE:
                    queue.append((rank, i, j, end[j])) if not started else heapq.heappush(queue, (rank, i, j, end[j]))

        started = False
        for i in range(n):
            offer(i)
        heapq.heapify(queue)
        started = True
        while queue:
            _, i, j, k = heapq.heappop(queue)
            if not live[i] or not live[j] or end[i] != j or end[j] != k:
                continue
            live[j] = False
            end[i] = k
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ids[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _plain(self, text: str) -> list[int]:
        words = self.words(text)
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > TABLE_WORDS:
            if len(new) > TABLE_WORDS // 2:  # a text of very many words: the table holds them for this text only
                known = {}
            else:
                for late in list(known)[TABLE_WORDS // 2 :]:  # the words met first are the common ones, and stay
                    del known[late]
            new = set(words).difference(known)
        merge = self.merge
        for word in new:
            known[word] = merge(word.encode())
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of token ids; byte sequences that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """`docs` with a column `to`, the token ids of each text (array<int>)."""
    kept = [c for c in docs.columns if c != to]
    schema = StructType([*docs.select(*kept).schema.fields, StructField(to, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in tv.chunks(batch, text, CHUNK):
                ids = pa.array([own.encode(t) for t in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.record_batch([*part.columns, ids], names=[*kept, to])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """`coded` with a column `to`, the text of each row's token ids; null ids give null."""
    kept = [c for c in coded.columns if c != to]
    schema = StructType([*coded.select(*kept).schema.fields, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([None if i is None else own.decode(i) for i in part.column(ids).to_pylist()], pa.string())
                yield pa.record_batch([*part.columns, texts], names=[*kept, to])

    return coded.select(*kept).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded in one pass."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for part in tv.chunks(batch, "text", CHUNK):
                n, coded, decoded = [], [], []
                for t in part.column("text").to_pylist():
                    ids = own.encode(t)
                    n.append(len(ids))
                    coded.append(digest(",".join(map(own.text_of.__getitem__, ids)).encode()))
                    decoded.append(digest(own.decode(ids).encode()))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return source.mapInArrow(run, schema)


def coded_corpus(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """The columns in `keep`, n_tokens, ids and the digest of the text that the ids decode to.

    One pass: two chained ones would hold a second worker with its own tables for each task.
    """
    kept = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    more = [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded_sha256", StringType())]
    schema = StructType([*kept.drop("_text").schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in tv.chunks(batch, "_text", CHUNK):
                ids = [own.encode(t) for t in part.column("_text").to_pylist()]
                digests = [hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids]
                columns = [part.column(c) for c in keep]
                yield pa.record_batch(
                    [*columns, pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(digests, pa.string())],
                    names=[*keep, "n_tokens", "ids", "decoded_sha256"],
                )

    return kept.mapInArrow(run, schema)
