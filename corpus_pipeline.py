"""A training corpus from raw documents: five stages, each written and read by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from pulsetrace.llm import decontaminate, language, packing, pii, simhash
from pulsetrace.llm.common import held_out, new_name, numbered, prepare, table, written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Language models and alignments have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that are ``und``, without a letter, go, whatever the others score."""
    prepare(spark)
    model = language.learn(docs.where(~held_out(3, 1)))
    return language.keep_identified(docs, model)


def _without(docs: DataFrame, drop) -> DataFrame:
    """``docs`` without the rows whose numbers ``drop`` finds; it is given (doc_id, text) with
    those numbers as ids, so repeated and null ids do not hide or remove other rows."""
    prepare(docs.sparkSession)
    number = new_name(docs, "doc")
    rows = numbered(docs, number)
    found = drop(rows.select(F.col(number).alias("doc_id"), "text"))
    gone = written(found.select(F.col("doc_id").alias(number)).distinct(), "dropped")
    return rows.join(gone, number, "left_anti").select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""

    def copies(rows):
        return simhash.near_duplicates(rows, shingle=3, max_bits=3).where("component_id <> doc_id")

    return _without(docs, copies)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, edited ones included."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _without(docs, lambda rows: decontaminate.contaminated(rows, benchmark))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    prepare(spark)
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    prepare(spark)
    return packing.pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("language ID", identified),
    ("SimHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("PII", redacted),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
