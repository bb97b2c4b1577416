"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written and read again as the next one's docs.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup
from tarnflow.llm._tables import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined: no letters, or two languages as likely as each other.

    Where no document has a language to learn from, those without letters are all that can be told, and dropped.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Under names of their own, so that a column that is called like one of the prediction's stays as it is.
    own = {c: "text" if c == "text" else f"__{i}" for i, c in enumerate(docs.columns)}
    judged = language_id.predict(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), model)
    return judged.where("lang_pred <> 'und' and not ambiguous").select(*[F.col(n).alias(c) for c, n in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of the least doc_id."""
    return near_dedup.deduplicated(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 200 bytes and more that occur more than once out of the texts; documents stay."""
    cut = suffix_dedup.remove_repeated(docs, carry=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[(columns[c] if c in columns else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, within its error budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packed", packed),
]

#: SQL can't express the first stage, a model's predictions, nor the last, the vocabulary's ids, so it can't express run()'s
#: rows.  Each stage is tested against a brute-force version instead, on what the one before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
