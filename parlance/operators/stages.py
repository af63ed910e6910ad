"""What a call's job does next: its stage, the jobs that follow, classifiers as data, prompts that fit, and an analysis without a model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import answers as A
from parlance.functions.text import fallback_title, flag, tokens
from parlance.operators.conversation import opening, window_numbers
from parlance.operators.plugins import LanguageModel
from parlance.operators.queue import enqueued

#: Transcripts with fewer words aren't shown to a model.
LEAST_WORDS = 4
#: How often a text that doesn't fit may be compressed.
ROUNDS = 3


def _forced(payload: Column) -> Column:
    """Whether a payload asks for a new transcript: JSON's true, not a text that says so."""
    x = F.try_variant_get(A.parsed(payload), "$.force_retranscribe", "variant")
    return F.coalesce(F.when(F.schema_of_variant(x) == "BOOLEAN", x.cast("boolean")), F.lit(False))


def next_stages(jobs: DataFrame, calls: DataFrame, recordings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(id, call_id, stage, error) for each job (id, call_id, kind, payload).

    A job without a call, or whose call or recording isn't there, is ``failed``.
    A transcript that can be read is used again (``analyze``) unless the payload
    forces a new one; a job that only analyses can't. All others ``transcribe``.
    """
    call = F.coalesce("call_id", F.get_json_object("payload", "$.call_id").try_cast("bigint"))
    readable = F.try_variant_get(A.parsed(F.col("transcript_json")), "$.segments", "array<variant>").isNotNull()
    there = transcripts.where(readable).select(F.col("call_id").alias("c_")).distinct().withColumn("readable_", F.lit(True))
    rows = jobs.withColumn("call_id", call).join(calls.select(F.col("id").alias("k_"), F.lit(True).alias("known_")), F.col("call_id") == F.col("k_"), "left")
    rows = rows.join(recordings.select(F.col("call_id").alias("r_")).distinct().withColumn("recorded_", F.lit(True)), F.col("call_id") == F.col("r_"), "left")
    rows = rows.join(there, F.col("call_id") == F.col("c_"), "left")
    error = F.when(F.col("call_id").isNull(), "no call id").when(F.col("known_").isNull(), "call not found").when(F.col("recorded_").isNull(), "no recording")
    again = F.col("readable_").isNotNull() & ((F.col("kind") == "analyze_call") | ~_forced(F.col("payload")))
    return rows.withColumn("error", error).select("id", "call_id", F.when(F.col("error").isNotNull(), "failed").when(again, "analyze").otherwise("transcribe").alias("stage"), "error")


def plugin_jobs(calls: DataFrame, jobs: DataFrame, kinds: list[str], now: str) -> DataFrame:
    """``jobs`` and a job of each kind for each call that has none of that kind, so that a second run adds nothing."""
    wanted = calls.select(F.col("id").alias("call_id"), F.explode(F.array(*[F.lit(k) for k in sorted(set(kinds))])).alias("kind"))
    new = wanted.join(jobs.select("call_id", "kind"), ["call_id", "kind"], "left_anti")
    return enqueued(jobs, new.withColumn("run_after", F.lit(None).cast("timestamp_ntz")), now)


@dataclass(frozen=True)
class Classifier:
    """A question that is asked of every text; those of other types than boolean need a model."""

    name: str
    output: str = "boolean"
    enabled: bool = True


def classified(texts: DataFrame, classifiers: list[Classifier]) -> DataFrame:
    """(call_id, classifier, value) of the boolean classifiers, by words: a family of words is chosen by the classifier's name."""
    text, found = F.col("text"), []
    for c in classifiers:
        if c.enabled and c.output == "boolean":
            family = next((f for f in ("cancellation", "complaint") if f in c.name.lower()), None)
            value = F.coalesce(flag(family, text), F.lit(False)) if family else F.lit(False)
            found.append(F.struct(F.lit(c.name).alias("classifier"), value.alias("value")))
    if not found:
        return texts.select("call_id", F.lit("").alias("classifier"), F.lit(False).alias("value")).where(F.lit(False))
    return texts.select("call_id", F.inline(F.array(*found)))


def analysed(answers: DataFrame, segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """A title and summary for each call that has segments: the model's where they are fit, else label and opening.

    ``answers`` (call_id, answer) are what a model said. Without a JSON object,
    or for a transcript of fewer than LEAST_WORDS words, the call counts as
    resolved and neutral.
    """
    words = segments.groupBy("call_id").agg(F.sum(F.size(tokens(F.col("raw_text")))).alias("n_words"))
    rows = words.join(opening(segments), "call_id", "left").join(transcripts.select("call_id", "primary_language"), "call_id", "left").join(answers, "call_id", "left")
    v = A.parsed(F.col("answer"))
    v = F.when((F.col("n_words") >= LEAST_WORDS) & F.schema_of_variant(v).startswith("OBJECT"), v)
    said = lambda path: A.string(F.try_variant_get(v, path, "variant"))
    first = F.coalesce("opening", F.lit(""))
    return rows.select(
        "call_id", v.isNotNull().alias("from_model"),
        A.accepted_title(said("$.title"), fallback_title(F.coalesce("primary_language", F.lit("")))).alias("title"), A.accepted_summary(said("$.summary"), first).alias("summary"),
        F.coalesce(F.try_variant_get(v, "$.resolved", "boolean"), F.lit(True)).alias("resolved"), F.coalesce(F.try_variant_get(v, "$.sentiment_score", "double"), F.lit(0.0)).alias("sentiment_score"),
    )


def _tokens(text: str) -> int:
    return -(-len(text) // 3)


def fitted(text: str, budget: int, model: LanguageModel) -> str:
    """``text`` within ``budget`` estimated tokens: its windows' compressions take its place, up to ROUNDS times.

    A window whose compression fails stays as it is. Where a round makes nothing
    shorter, or the rounds are used up, the first window is what is left.
    """
    for _ in range(ROUNDS):
        if budget <= 0 or _tokens(text) <= budget:
            return text
        parts = []
        for window in _windows(text, budget):
            try:
                parts.append(model.complete(window).strip())
            except Exception:  # a model may do anything
                parts.append(window.strip())
        shorter = "".join(p + "\n" for p in parts)
        if _tokens(shorter) > budget and len(shorter) >= len(text):
            break
        text = shorter
    return text if _tokens(text) <= budget else _windows(text, budget)[0]


def _windows(text: str, budget: int) -> list[str]:
    """Consecutive lines in windows of ``budget`` tokens; each keeps its lines' ends."""
    lines = text.splitlines(keepends=True)
    out: dict[int, list[str]] = {}
    for line, k in zip(lines, window_numbers([_tokens(x) for x in lines], budget)):
        out.setdefault(k, []).append(line)
    return ["".join(x) for x in out.values()]


def compressed(texts: DataFrame, budget: int, model: LanguageModel) -> DataFrame:
    """(call_id, text) with each text ``fitted`` to a model's window; a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[fitted(t or "", budget, model) for t in pdf.text])

    return texts.select("call_id", "text").mapInPandas(run, "call_id bigint, text string")
