"""Voting over a span table, for any number of annotators.

``labelkit.functions.spans.vote_spans`` is the same rule inside one row, for
annotators that ran on the same chunk; here spans come as rows of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkit.functions.spans import VOTE_THRESHOLD
from labelkit.functions.text import ws_strip


def collect_votes(spans: DataFrame, keys: Sequence[str] = ("sentence_id",),
                  same: Sequence[str] = ("start", "end", "word")) -> DataFrame:
    """One row per voted-on span: vote and label counts, leading label, first appearance.

    Votes are tallied per label before and after the shuffle, so a span with very
    many votes costs one small row per task. ``first`` packs (model, ord).
    """
    first = F.shiftleft(F.col("model").cast("bigint"), 32) + F.col("ord")
    ballots = (spans.withColumn("word", ws_strip(F.col("word")))
               .groupBy(*keys, *same, "label")
               .agg(F.count("*").alias("n"), F.avg("score").alias("score"),
                    F.min(first).alias("first")))
    standing = F.struct(
        (-F.col("n")).alias("n"), (-F.col("score")).alias("score"),
        F.when(F.col("n") == 1, F.col("first")).alias("tie"), F.col("label").alias("label"))
    groups = ballots.groupBy(*keys, *same).agg(
        F.sum("n").alias("n_votes"), F.count("*").alias("n_labels"),
        F.min("first").alias("first"), F.min(standing).alias("_top"))
    return groups.select(
        *keys, *same, "n_votes", "n_labels", "first", F.col("_top.label").alias("label"),
        (-F.col("_top.n")).alias("n_top"), (-F.col("_top.score")).alias("score"))


def vote_unanimous(groups: DataFrame, threshold: float = VOTE_THRESHOLD) -> DataFrame:
    """One label only: two or more votes, or a lone one above the threshold."""
    return groups.where((F.col("n_labels") == 1)
                        & ((F.col("n_votes") > 1) | (F.col("score") > threshold)))


def vote_majority(groups: DataFrame) -> DataFrame:
    """Several labels, one of them with two or more votes."""
    return groups.where((F.col("n_labels") > 1) & (F.col("n_top") > 1))


def vote_best_score(groups: DataFrame, threshold: float = VOTE_THRESHOLD) -> DataFrame:
    """Several labels with one vote each: the best score, if above the threshold."""
    return groups.where((F.col("n_labels") > 1) & (F.col("n_top") == 1)
                        & (F.col("score") > threshold))


def vote(spans: DataFrame, keys: Sequence[str] = ("sentence_id",),
         same: Sequence[str] = ("start", "end", "word"),
         threshold: float = VOTE_THRESHOLD) -> DataFrame:
    """Spans all annotators settle on, with ``model`` and ``ord`` of their first appearance.

    The three rules together: two votes for the leading label, or a score above the
    threshold.
    """
    groups = collect_votes(spans, keys, same)
    agreed = groups.where((F.col("n_top") > 1) | (F.col("score") > threshold))
    return agreed.select(
        *keys, F.shiftright("first", 32).cast("int").alias("model"),
        F.col("first").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("ord"),
        *same, "label", "score")
