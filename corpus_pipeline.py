"""From raw documents to packed training sequences: each stage is one operator over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.fuzzy_lines import drop_lines, fuzzy_lines
from tidemark.llm.languages import UNKNOWN, identify, learn_languages, learnable
from tidemark.llm.leaks import leaks
from tidemark.llm.near_copies import near_copies
from tidemark.llm.packing import pack
from tidemark.llm.tables import small_enough
from tidemark.sources.scratch import freeze, freeze_alone, spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null and letterless texts.

    The model learns from the labelled rows of ``docs``; a missing label is filled in.
    """
    model = learn_languages(docs.where(learnable(docs)))
    found = identify(spread(docs), model)
    known = found.where(F.col("lang_pred") != UNKNOWN) if model else found
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each line once; documents made of other documents' lines alone go."""
    decisions = freeze_alone(lambda: fuzzy_lines(docs), "line-decisions")
    left = drop_lines(docs, decisions)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""

    def copies() -> DataFrame:
        return near_copies(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()

    return _without(docs, freeze_alone(copies, "near-copies"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""

    def leaked() -> DataFrame:
        found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        return found.select(F.col("doc_id").alias("_gone")).distinct()

    return _without(docs, freeze_alone(leaked, "leaked-documents"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 4096, one row per piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    ids = F.broadcast(gone) if small_enough(gone) else gone
    return docs.join(ids, docs["doc_id"] == ids["_gone"], "left_anti")


def _keyed(docs: DataFrame) -> DataFrame | None:
    """``docs`` with a key for every row as ``doc_id`` and the id itself as ``_own_id``; None if the ids are keys already.

    The first row of each id keeps it as its key.  Rows without an id and further
    rows of an id get keys after all ids (before all, if there is no room).
    """
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if again.isEmpty():
        return None
    numbered = freeze(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    low, high = numbered.agg(F.min("doc_id"), F.max("doc_id")).first()
    if high is None or high < 2**62:
        fresh = F.col("_row") + F.lit(0 if high is None else high + 1)
    elif low > -(2**62):
        fresh = F.lit(low - 1) - F.col("_row")
    else:
        raise ValueError("doc_id leaves no room for the keys of rows with null or repeated ids")
    firsts = numbered.where("doc_id is not null").groupBy("doc_id").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n"))
    firsts = freeze(firsts.where("n > 1").select(F.col("doc_id").alias("_id"), "_first"), "repeated-ids")
    hint = F.broadcast if small_enough(firsts) else (lambda df: df)
    marked = numbered.join(hint(firsts), numbered["doc_id"] == firsts["_id"], "left")
    key = F.when(F.expr("doc_id is null or _row <> _first"), fresh).otherwise(F.col("doc_id"))
    return freeze(marked.withColumns({"_own_id": F.col("doc_id"), "doc_id": key.cast("bigint")}).drop("_row", "_id", "_first"), "keyed-rows")


def by_row(stage: Stage) -> Stage:
    """The stage with every row judged and cut by itself, also where ids are null or repeated."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        keyed = _keyed(docs)
        if keyed is None:
            return stage(spark, docs, sf_dir)
        return stage(spark, keyed, sf_dir).withColumn("doc_id", F.col("_own_id")).select(*docs.columns)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("line_dedup", by_row(drop_repeated_lines)),
    ("near_dedup", by_row(drop_near_copies)),
    ("benchmark_leaks", by_row(drop_leaks)),
    ("packing", pack_sequences),
]

# A trained classifier decides in the first stage; the tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
