"""From raw documents to packed sequences: five stages, each over all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, whatever else they are called.  Rows with null
or empty texts, repeated rows and empty tables are fine in every stage; the first
drops texts without a letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.llm.groups import own_columns
from echolake.llm.op1_ngram_jaccard import first_of_components
from echolake.llm.op3_packing import pack, token_pieces, tokenizer_json
from echolake.llm.op5_line_dedup import dedup_lines
from echolake.llm.op7_mixing import mix, word_count
from echolake.llm.op8_language_id import UNKNOWN, predict, train
from echolake.plans.shared import materialize

#: A document whose best language has a lower score than this is rejected.
MIN_SCORE = 0.5
#: Shingle length and similarity (percent) of near duplicates.
SHINGLE, SIMILAR = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised, by a model of the labelled ones."""
    model = train(docs.select("doc_id", "text", "lang"))
    found = predict(docs, model, "__el_pred", "__el_score")
    return found.where((F.col("__el_pred") != UNKNOWN) & (F.col("__el_score") >= MIN_SCORE)).select(*own_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop long lines that many documents hold; every document stays, with what is left of it."""
    kept = dedup_lines(docs, "__el_lines", "__el_dropped")
    return kept.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group of near duplicates."""
    return first_of_components(docs, SHINGLE, SIMILAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the target weights of their sources ask."""
    words = docs.withColumn("__el_words", word_count(F.col("text")))
    mixed = mix(words, "__el_words", "source", "doc_id", out=("__el_whole_source", "__el_goal", "__el_times"))
    return mixed.where("__el_times > 0").withColumn("__el_copy", F.explode(F.sequence(F.lit(1), "__el_times"))).select(*own_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids, with their places."""
    return pack(materialize(token_pieces(docs, tokenizer_json()), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the language model nor the fitted mix; tests hold it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
