"""Harmonised corpora at rest: parquet, one folder per corpus and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelkit.functions.arrays import pack_words, unpack_words
from labelkit.functions.tags import decode_labels


def write_corpus(sentences: DataFrame, path: str,
                 by: Sequence[str] = ("corpus", "split")) -> None:
    """Save sentences by corpus and split; rebalancing splits a large part over tasks.

    Arrays of strings are exchanged as texts.
    """
    words = [f.name for f in sentences.schema.fields
             if isinstance(f.dataType, T.ArrayType) and f.dataType.elementType == T.StringType()]
    packed = sentences.withColumns({c: pack_words(F.col(c)) for c in words}).hint("rebalance", *by)
    packed.withColumns({c: unpack_words(F.col(c)) for c in words}).write.partitionBy(*by).parquet(path)


def read_corpus(spark: SparkSession, path: str, splits: Sequence[str] | None = None,
                corpora: Sequence[str] | None = None) -> DataFrame:
    """Saved sentences; folders of other splits and corpora are not opened."""
    sentences = spark.read.parquet(path)
    if splits:
        sentences = sentences.where(F.col("split").isin(*splits))
    if corpora:
        sentences = sentences.where(F.col("corpus").isin(*corpora))
    return sentences


def read_label_encoded(spark: SparkSession, path: str, names: Sequence[str],
                       column: str = "ner_tags") -> DataFrame:
    """A parquet corpus with integer tags as string tags, ids looked up in ``names``."""
    rows = spark.read.parquet(path)
    return rows.withColumn("tags", decode_labels(F.col(column), names)).drop(column)
