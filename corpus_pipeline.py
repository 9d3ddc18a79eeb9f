"""The corpus pipeline: five stages from raw documents to token shards.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet
and read again as the next one's ``docs``. All but the last keep the columns of
``documents``; an operator carries columns that it does not read whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import stage
from weftline.llm.decontaminate import uncontaminated
from weftline.llm.mixing import mix
from weftline.llm.ngram_join import one_of_each
from weftline.llm.outliers import passing
from weftline.llm.wavelet import read_documents, write_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by three-word shingles at a similarity of 0.9."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read back from wavelet shards."""
    import public_tokenizers

    return read_documents(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The robust estimates and the token shards are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
