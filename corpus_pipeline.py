"""Documents through five stages: toxicity, exact and near de-duplication, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from codestrata.llm.common import checkpoint, documents, remainder
from codestrata.llm.queries import tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model of toxicity does not reject (score under 0.5), each judged by its own text; null ids and repeats
    are kept or go like others, and an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; null and empty texts are one group."""
    return exact_dedup.keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group; rows without words or id stay."""
    return near_dedup.keep_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left, as documents: a row a pass of what the mix takes; rows without words are never taken."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces in sequences; every row gives at least one piece, for null or empty text the end id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]
#: Learned scores, MinHash and pseudorandom draws are beyond SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; every stage's rows are written to the shared checkpoint folder before the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
