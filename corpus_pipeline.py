"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, language_id, packing, toxicity
from tidemark.llm.common import fold, table, written

#: A document nearer than this to no language's profile is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def _set_aside(docs: DataFrame) -> tuple[DataFrame, str, list[Column]]:
    """``docs`` under names that no operator adds, the text's name among them, and the columns under their own names again."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")], [F.col(x).alias(name) for x, name in zip(names, docs.columns, strict=True)]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages that ``docs`` names; the others go."""
    profiles = language_id.learn(docs.where(~F.coalesce(fold("doc_id", 5) == 0, F.lit(False))))
    aside, text, columns = _set_aside(docs)
    found = language_id.identify(aside, profiles, text)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    aside, text, columns = _set_aside(docs)
    labels = table(spark, sf_dir, "labels").where(~F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    return toxicity.score(aside, toxicity.learn(docs, labels), text).where("predicted = 0").select(columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, 0.8 or more in common).

    A document is an id with a text: rows that share an id but not the text are
    documents of their own, as are rows without an id, which come after all ids
    in a group.  Rows with the same id and text are one document.  A row without
    words is nobody's copy and stays.
    """
    identity = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.where(worded).select(identity.alias("_identity"), F.struct("*").alias("_row"))
    found = jaccard_join.jaccard_components(named.select("_identity", "_row.text"), n=5, percent=80, key="_identity")
    first = found.where(F.col("_identity") == F.col("component_id")).select("_identity").distinct()
    return named.join(first, "_identity").dropDuplicates(["_identity"]).select("_row.*").unionByName(docs.where(~worded))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2, 1024)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("best-fit packing", pack_sequences),
]

#: Two stages apply trained models and one a tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
