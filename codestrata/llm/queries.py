"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import alignment, exact_dedup, fingerprints, language_id, licenses, lm_scoring, mixing, near_dedup, packing, phrases, secrets, sharding, toxicity
from codestrata.llm.common import documents, remainder


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents. Null or wordless texts stand alone; rows that repeat an id are judged each by its text; an empty table gives no rows."""
    return near_dedup.near_groups(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents. Null or empty texts have none; repeated rows are given each; an empty table gives no rows."""
    found = licenses.scan(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_matches")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels of ids whose remainder is not 0. Null text scores as empty text; ties of hashes go by id; repeated rows are given each; empty tables give no rows or, for labels, the score 0."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt where the remainder is not 1. Null or letterless text is `und`; repeated rows are given each; without rows to learn from all is `und`."""
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.filter(remainder("doc_id", 3) != 1))
    return language_id.predict(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents. Null text has size 0; a null source is the last one; equal rows are taken each on its own; an empty table gives no rows."""
    return mixing.mix(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts. Null text is empty; null ids come first; rows of one id go by text; a single row is its own next; an empty table gives no rows."""
    return fingerprints.fingerprint_pairs(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents. Null text has none; repeated rows are given each; an empty table gives no rows."""
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents. Null text counts as empty; a null id loses every tie; repeated rows are given each; an empty table gives no rows."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt where the remainder is not 1. Null text is one end; repeated rows are given each; an empty table gives no rows."""
    docs = documents(spark, sf_dir)
    scored = lm_scoring.score(docs, remainder("doc_id", 5) != 1)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences. Null text is the end id alone; equal rows are packed each; an empty table gives no rows."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over all documents. Null and empty texts, and those that don't come back byte for byte, have zeros; repeated rows count each; an empty table gives no rows."""
    return alignment.align_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language over all documents. Null text is empty, null lang `und`; repeated rows count each; ties go by phrase; an empty table gives no rows."""
    return phrases.phrases(documents(spark, sf_dir))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, and where a 25th would take them. Null text has no bytes; a null id is one key; rows alike get slots each; an empty table gives no rows."""
    return sharding.shard_documents(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_licenses, op3_toxicity, op4_language_id, op5_mixing, op6_fingerprints, op7_secrets, op8_exact_dedup, op9_lm_scoring, op10_packing, op11_alignment, op12_phrases, op13_sharding)}
SQL = {"op8_exact_dedup": exact_dedup.SQL, "op12_phrases": phrases.SQL}
