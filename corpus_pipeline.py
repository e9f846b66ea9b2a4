"""Raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm import decontaminate, language, packing, secrets, simhash
from tidelog.llm.shared import Scratch, free_name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unsure, go."""
    return language.identify(docs, "text", declared="lang", host="source", keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies stays: five-word shingle sets at 0.8 or more."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any test item go."""
    return decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1, keep=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mask; the documents stay."""
    to = free_name(docs, "found_secrets")
    masked = secrets.redact(secrets.find_secrets(docs, to=to), "text", to)
    return masked.withColumn("n_chars", F.when(F.size(to) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]
#: Trigram models, fingerprints, suffix arrays and tokenizers have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
