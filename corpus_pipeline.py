"""A cleaning pipeline over ``documents``: five stages, each written as Parquet and read as the next one's input.

All stages but the last return the columns of documents, and take these by name, so further columns are left out.
A stage's text changes n_chars with it; texts that a stage does not cut are passed on as they are, null ones as null.
In every stage null and empty texts are neither toxic, nor copies, nor hit, and are kept; rows that are equal fare
equally; rows that share a doc_id but not the text are judged by their own texts, but for near copies, where they are
one document; a null doc_id is no copy of anything; an empty table gives an empty table; texts may be of any length.
See each operator in joinery/llm for its method and further defined results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm import bpe, leaks, nearcopies, substrings, toxicity
from joinery.llm.common import materialise, table
from joinery.llm.queries import _tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_CARRIED = ("lang", "source", "n_chars")


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject; it is trained on labelled documents of ``docs``. Without labels of both classes all stay."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(~F.col("toxic")).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least doc_id, of each group linked by five-word shingles and similarity 0.8."""
    docs = docs.select(*COLUMNS)
    gone = nearcopies.groups(docs, shingle=5).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut, with the white space after them; documents of which no word is left go. Other white space stays."""
    cut = substrings.dedup(docs.select(*COLUMNS), carry=_CARRIED, verbatim=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    kept = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.select("doc_id", "text", "rest.lang", "rest.source", n_chars.alias("n_chars"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents of which more than 0.8 of the words are hit go."""
    cut = leaks.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), carry=_CARRIED)
    n_chars = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; a null text is an empty one."""
    return bpe.digests(docs, _tokenizer())


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmarks),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity model and the tokenizer have no SQL form; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None
