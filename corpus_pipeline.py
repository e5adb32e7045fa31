"""Training text from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm.common import table
from labelkit.llm.decontaminate import drop_leaks
from labelkit.llm.langid import drop_rejected
from labelkit.llm.mixing import mix_sources
from labelkit.llm.overlap import drop_overlapping
from labelkit.llm.secrets import redact_secrets
from labelkit.folders import saved


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return drop_rejected(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 0.8 or more."""
    return drop_overlapping(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark, and their length counted anew."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that sources reach their shares."""
    return mix_sources(docs)


STAGES = [("language ID", identify), ("SimHash near-dedup", deduplicate),
          ("benchmark decontamination", decontaminate), ("secret scans", hide_secrets),
          ("mixing sources", mix)]

#: Language models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
