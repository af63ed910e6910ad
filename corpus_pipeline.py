"""From raw documents to piece ids: quality, line dedup, near-dedup, mixing, encoding.

``run(spark, sf_dir)`` applies STAGES to the documents; each stage's result is
written as Parquet in the shared folder and read again by the next.

What all stages share: other columns pass through (the last stage takes doc_id,
lang, source and text), an empty table gives an empty one, and texts of any
length are worked on whole. What they do with nulls, empty texts, ties and
repeated rows is said of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import removed, written
from parlance.llm.linededup import dedup_lines
from parlance.llm.minhash import kept_documents
from parlance.llm.mixing import MIX, Mix, mixed
from parlance.llm.pieces import encoded
from parlance.llm.quality import good_documents

#: The pipeline takes no document twice: up to four fifths of all words, by the query's weights.
PIPELINE_MIX = Mix(share=0.8, max_epochs=1, weights=MIX.weights)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or divergence rules reject go.

    A null or empty text has no words and goes. Null languages share one
    reference. Repeated rows get one verdict, each counting in the reference;
    documents at a limit stay.
    """
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first; n_chars follows the text.

    A null or empty text becomes the empty one. No document goes here, also if
    it loses all its lines. A null id makes no line shared, but loses those that
    others share; rows that repeat an id are one document.
    """
    out = dedup_lines(docs, n_lines="dropped_of", n_dropped="dropped")
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8).

    That with the least id, of its texts that with the least hash. Texts without
    words and rows without an id stay; rows that repeat id and text are one
    document and stay or go together.
    """
    return kept_documents(docs, width=5, threshold=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix's budgets take.

    Null languages and sources are leaves of their own. Texts without words are
    never taken; rows that repeat id, text and leaf are taken together.
    """
    return mixed(docs, PIPELINE_MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's best segmentation and the scores of the four best.

    A null or empty text has no pieces; repeated rows are encoded each; equal
    scores come in the order of their finding.
    """
    return encoded(docs.select("doc_id", "lang", "source", "text"), others=False).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: A reference of divergences, a lattice search: not in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if hasattr(before, "scratch_path"):
            removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
