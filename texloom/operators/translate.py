"""Running a translator that the user supplies over chunk rows.

A translator is a callable (texts, prompt) -> list of translations, None where one failed. It
is made once per partition by its factory, retried with growing pauses, and asked once more,
with a nudge, for what came back blank or untranslated. Results carry their key, so nothing
depends on the order of rows; write them before use, so a lost executor costs no paid call twice.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.functions import latex as lx
from texloom.operators import segment, terms

#: Texts of one call at most.
CALL = 10_000

Translator = Callable[[list[str], str], list[str | None]]
_REGISTRY: dict[str, Callable[[], Translator]] = {}


def register(name: str, factory: Callable[[], Translator]) -> None:
    _REGISTRY[name] = factory


def get(name: str) -> Callable[[], Translator]:
    if name not in _REGISTRY:
        raise KeyError(f"no translator {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


@dataclass(frozen=True)
class Pace:
    """Retries of a call and its rate. `calls_per_second` is shared by `tasks` concurrent tasks; 0 is no limit.

    After a failed call the pause is `pause` seconds, twice as long each time, up to `longest_pause`, whatever the rate.
    """

    retries: int = 5
    calls_per_second: float = 5.0
    tasks: int = 8
    longest_pause: float = 30.0
    pause: float = 1.0


def _called(call: Translator, texts: list[str], prompt: str, pace: Pace, last: list[float]) -> list[str | None]:
    gap = pace.tasks / pace.calls_per_second if pace.calls_per_second else 0.0
    for attempt in range(pace.retries):
        wait = last[0] + gap - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        last[0] = time.monotonic()
        try:
            out = call(texts, prompt)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} translations of {len(texts)} texts")
            return out
        except Exception:
            if attempt + 1 < pace.retries:
                time.sleep(min(pace.pause * (2**attempt + random.random()), pace.longest_pause))
    return [None] * len(texts)


def translate(
    chunk_rows: DataFrame, factory: Callable[[], Translator], *, prompt: str = "", prompts: DataFrame | None = None, language: str = "简体中文", pace: Pace = Pace()
) -> DataFrame:
    """(paper_id, rel_path, chunk_idx, text, translated) of every chunk; null where it failed for good.

    `prompts` (paper_id, prompt) adds each paper's glossary to the prompt.
    """
    rows = chunk_rows.select("paper_id", "rel_path", "chunk_idx", "text")
    rows = rows.join(prompts.select("paper_id", F.col("prompt").alias("_p")), "paper_id", "left") if prompts is not None else rows.withColumn("_p", F.lit(""))
    rows = rows.withColumn("_p", F.concat(F.lit(prompt), F.coalesce("_p", F.lit("")))).repartition(pace.tasks, "paper_id", "rel_path", "chunk_idx")

    def attempt(df: DataFrame, text: str) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _t string"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call, last = factory(), [-1e9]
            for frame in frames:
                out: dict = {}
                for p, group in frame.groupby("_p", sort=False):
                    todo = group[group[text].notna() & (group[text].fillna("").str.strip() != "")]
                    out |= dict(zip(todo.index, _called(call, todo[text].tolist(), p, pace, last), strict=True)) if len(todo) else {}
                frame["_t"] = [out.get(i, frame.at[i, text]) for i in frame.index]  # blank texts pass through
                yield frame

        return df.mapInPandas(run, schema)

    first = attempt(rows, "text")
    blank = lx.strip("text") == ""
    failed = ~blank & lx.is_failed("text", "_t")
    again = first.withColumn("_ask", F.when(failed, F.concat(F.lit(lx.NUDGE.format(lang=language)), "text"))).withColumnRenamed("_t", "_first")
    second = attempt(again, "_ask")
    done = F.when(F.col("_ask").isNull(), F.col("_first")).when(~lx.is_failed("text", "_t"), F.col("_t"))
    return second.select("paper_id", "rel_path", "chunk_idx", "text", done.alias("translated"))


def translate_rows(file_rows: DataFrame, factory: Callable[[], Translator], *, prompt: str = "", language: str = "简体中文", pace: Pace = Pace()) -> DataFrame:
    """`translate` of file rows (see `segment.file_rows`), whose texts stay where they are: they get `translated`, an array by chunk.

    `prompt` goes before each row's own, in the column `prompt`. A call has texts of many files and of one prompt. At a
    rate `pace.tasks` tasks share it; without one there are as many tasks as the rows have partitions.
    """
    rows = file_rows.withColumn("_texts", segment.chunks_of()).withColumn("_p", F.concat(F.lit(prompt), F.coalesce("prompt", F.lit("")))).drop("prompt")
    rows = rows.coalesce(pace.tasks) if pace.calls_per_second else rows

    @F.pandas_udf("array<string>")
    def asked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        call, last = factory(), [-1e9]
        for files, prompts in batches:
            out = [None if texts is None else list(texts) for texts in files]  # blank texts pass through
            todo: dict[str, list[tuple[int, int]]] = {}
            for i, (texts, p) in enumerate(zip(out, prompts, strict=True)):
                todo.setdefault(p, []).extend((i, k) for k, t in enumerate(texts or []) if t is not None and t.strip())
            for p, places in todo.items():
                for at in range(0, len(places), CALL):
                    some = places[at : at + CALL]
                    for (i, k), t in zip(some, _called(call, [out[i][k] for i, k in some], p, pace, last), strict=True):
                        out[i][k] = t
            yield pd.Series(out, dtype=object)

    asked = asked.asNondeterministic()  # no plan may pay for a call twice
    nudge = F.lit(lx.NUDGE.format(lang=language))
    failed = lambda t, a: (lx.strip(t) != "") & lx.is_failed(t, a)
    first = rows.withColumn("_first", asked("_texts", "_p"))
    again = first.withColumn("_ask", F.zip_with("_texts", "_first", lambda t, a: F.when(failed(t, a), F.concat(nudge, t))))
    second = again.withColumn("_second", asked(F.when(F.exists("_ask", lambda t: t.isNotNull()), F.col("_ask")), "_p"))
    kept = lambda t, i: F.when(F.get("_ask", i).isNull(), F.get("_first", i)).when(~lx.is_failed(t, F.get("_second", i)), F.get("_second", i))
    return second.withColumn("translated", F.transform("_texts", kept)).drop("_texts", "_p", "_first", "_ask", "_second")


def usage(results: DataFrame) -> DataFrame:
    """Calls and estimated tokens of texts and answers, by paper."""
    tokens = lambda c: F.sum(F.when(F.col(c).isNotNull(), lx.token_estimate(c)))
    return results.groupBy("paper_id").agg(F.count("*").alias("calls"), tokens("text").alias("input_tokens"), F.coalesce(tokens("translated"), F.lit(0)).alias("output_tokens"))


def build_glossary(candidates: DataFrame, factory: Callable[[], Translator], prompt: str = "", pace: Pace = Pace()) -> DataFrame:
    """(paper_id, rank, term, target): one call per paper with its candidate terms, one on a line."""
    ask = candidates.groupBy("paper_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "\n").alias("text")
    )
    asked = ask.select("paper_id", F.lit("").alias("rel_path"), F.lit(0).alias("chunk_idx"), "text")
    answers = translate(asked, factory, prompt=prompt, pace=pace).select("paper_id", F.col("translated").alias("answer")).where("answer is not null")
    found = terms.parse_glossary(answers, candidates)
    return found.join(candidates.select("paper_id", "term", "rank"), ["paper_id", "term"]).select("paper_id", "rank", "term", "target")
