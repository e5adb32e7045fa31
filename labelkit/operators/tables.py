"""Filters, orders, unions and reshaping of sentence and token tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.functions.arrays import cut, let, positions_where
from labelkit.functions.tags import encode_labels
from labelkit.functions.text import is_blank, ws_tokens


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def filter_tags(tokens: DataFrame, tags: Iterable[str], tag: str = "tag") -> DataFrame:
    return tokens.where(F.col(tag).isin(*tags))


def filter_min_fields(lines: DataFrame, fewest: int, line: str = "line",
                      sep: str = "\t") -> DataFrame:
    """Lines with at least ``fewest`` fields."""
    return lines.where(F.size(F.split(line, sep)) >= fewest)


def filter_blank(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text has more than blanks."""
    return df.where(~is_blank(F.col(text)))


def filter_confidence(spans: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Spans scored above, not at, ``threshold``."""
    return spans.where(F.col("score") > threshold)


def filter_split(sentences: DataFrame,
                 splits: Sequence[str] = ("test", "validation")) -> DataFrame:
    return sentences.where(F.col("split").isin(*splits))


def explode_tokens(sentences: DataFrame, tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """Sentence rows to token rows ``pos, token, tag``."""
    rest = [c for c in sentences.columns if c not in (tokens, tags)]
    return sentences.select(
        *rest, F.posexplode(F.arrays_zip(F.col(tokens).alias("token"), F.col(tags).alias("tag")))
        .alias("pos", "_t")).select(*rest, "pos", "_t.token", "_t.tag")


def gather_sentences(tokens: DataFrame, keys: Sequence[str], **arrays: str) -> DataFrame:
    """Token rows to sentence rows; ``arrays`` names the array of each column.

    One sentence becomes one row, so the group is as long as the sentence was.
    """
    fields = F.sort_array(F.collect_list(F.struct("pos", *arrays)))
    return (tokens.groupBy(*keys).agg(fields.alias("_t"))
            .select(*keys, *[F.col("_t")[c].alias(name) for c, name in arrays.items()]))


def head_sentences(sentences: DataFrame, n: int,
                   order: Sequence[str] = ("corpus", "split", "sentence_id")) -> DataFrame:
    return sentences.orderBy(*order).limit(n)


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Rows in a random order that is the same in every run and for any number of partitions.

    A digest of keys and seed is each row's place. Its leading 32 bits, cut into equal ranges,
    name the partition, its whole the order inside: no pass over the input samples ranges first. Digests are even,
    so partitions are too, as long as ``keys`` tell rows apart.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    head = F.conv(F.left(place, F.lit(8)), 16, 10).cast("bigint")
    part = F.shiftright(head * F.lit(n).cast("bigint"), 32).cast("int")
    return df.repartitionById(n, part).sortWithinPartitions(place, *keys)


def sequential_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """All rows of all corpora, columns matched by name, repeats kept."""
    return reduce(DataFrame.unionByName, corpora)


def union_eval_splits(*corpora: DataFrame) -> DataFrame:
    """Test and validation sentences of all corpora as one test set."""
    return union_corpora(*[filter_split(c) for c in corpora])


def distinct_labels(sentences: DataFrame, tags: str = "tags") -> DataFrame:
    return sentences.select(F.explode(F.array_distinct(tags)).alias("label")).distinct()


def label_vocabulary(sentences: DataFrame, tags: str = "tags") -> Column:
    """Sorted labels in use as one array value; partial sets are merged, not rows."""
    labels = sentences.select(F.explode(F.array_distinct(tags)).alias("label"))
    return labels.agg(F.sort_array(F.collect_set("label"))).scalar()


def encode_with_vocabulary(sentences: DataFrame, train: DataFrame, tags: str = "tags",
                           name: str = "label_ids") -> DataFrame:
    """Tags to ids learned from ``train``; a tag not seen there is ignored."""
    # a subquery is not allowed inside a lambda, so the vocabulary is a column for a moment
    return (sentences.withColumn("_names", label_vocabulary(train, tags))
            .withColumn(name, encode_labels(F.col(tags), F.col("_names"))).drop("_names"))


def pad_length(df: DataFrame, array: str, batch: Sequence[str], name: str = "width") -> DataFrame:
    """Rows with the size of the longest array of their batch: one long row widens its own
    batch and no other. The widths are one small row per batch."""
    widths = df.groupBy(*batch).agg(F.max(F.size(array)).alias(name))
    return df.join(widths, list(batch))


def conll_to_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two-column text blocks to token rows; the sentence number is 1 plus boundaries so far.

    A boundary is a blank or ``-DOCSTART-`` line, each one counts, so numbers may
    have gaps. Lines are cut into sentences inside the row.
    """
    def boundary(line: Column) -> Column:
        return line.startswith("-DOCSTART-") | is_blank(line)

    rest = [c for c in docs.columns if c != text]
    runs = let(F.split(text, "\n"), lambda v: cut(v, F.concat(
        F.array(F.lit(0)), positions_where(v, lambda x, _: boundary(x)))))
    return (docs.select(*rest, F.posexplode(runs).alias("_run", "_lines"))
            .select(*rest, (F.col("_run") + 1).alias("sentence_id"), F.posexplode(
                F.filter("_lines", lambda x: ~boundary(x))).alias("pos", "_line"))
            .withColumn("_fields", ws_tokens(F.col("_line")))
            .select(*rest, "sentence_id", "pos", F.get("_fields", F.lit(0)).alias("word"),
                    F.get("_fields", F.lit(1)).alias("tag")))
