"""The corpus pipeline: each stage works on all rows that the one before it kept.

1. language: documents without a letter, and those in which no language holds half, go.
2. near duplicates: the first document of each group stays.
3. benchmark: documents that hold a benchmark item go.
4. mix: documents are repeated or left out so that sources meet their target weights, in
   training order.
5. tokens: the mix is written as packed ids, in the order in which its files hold it; the
   result is read back from the files.

Null texts and texts without a letter go in stage 1. Rows that repeat an id are kept or
dropped together in stages 2 and 3. Rows without an id have no duplicates and are judged by
their texts in stage 3. Further columns are carried along, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadtide.llm import curriculum, decontaminate, language, minhash, token_pack  # noqa: E402
from leadtide.llm.common import row_struct, table  # noqa: E402
from leadtide.llm.queries import END_ID, tokenizer_path  # noqa: E402
from leadtide.workspace import fresh_path, store  # noqa: E402

LEAST_SHARE = 0.5
#: Encoded words and pieces that a worker keeps: it also holds what other stages left.
KEPT = (100_000, 60_000)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language holds at least ``LEAST_SHARE``. Nulls in ``lang`` only
    mean that a row is not learnt from; without any label all documents go."""
    names = docs.columns
    found = language.predict(row_struct(docs, "text"), language.training_rows(docs), keep=["row"])
    clean = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    return found.filter(clean).select("row.*").select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id; all rows of that id stay."""
    gone = store(minhash.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct(), "duplicates")
    return row_struct(docs, "doc_id").join(gone, "doc_id", "left_anti").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; a row for each copy, and none for what is left out."""
    return curriculum.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids in training order, read back: a row for each row of ``docs``. A table that
    was not read from files is packed by id."""
    order = token_pack.stored_order(docs)
    return token_pack.read_documents(spark, token_pack.write(docs, tokenizer_path(), END_ID, order=order, kept=KEPT))


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("benchmark", without_benchmark),
    ("mix", mixed),
    ("tokens", tokens),
]
#: The tokenizer and the language model are not expressible in SQL; tests hold run() to a
#: plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
