"""The labelling job and its evaluation, composed from the operators.

The unit of work is a chunk of at most ``limit`` characters. Annotators, the vote and
the tagging of words all happen inside a chunk row, so from scan to tagged words
nothing is shuffled and no document, source or sentence is a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.functions.arrays import let
from labelkit.functions.spans import VOTE_THRESHOLD
from labelkit.functions.text import chunk_words, is_blank, join_tokens, split_sentences, ws_tokens
from labelkit.functions.voting import voted_tags

Annotate = Callable[[DataFrame], DataFrame]


def sentence_rows(docs: DataFrame, text: str = "text",
                  split: Callable[[Column], Column] = split_sentences) -> DataFrame:
    """Documents to rows ``sent_no, words``; sentences without a word are dropped."""
    rest = [c for c in docs.columns if c != text]
    # told by the text: a condition on the words would be pushed down and have them found twice
    return (docs.select(*rest, F.posexplode(split(F.col(text))).alias("sent_no", "_sentence"))
            .where(~is_blank(F.col("_sentence")))
            .select(*rest, "sent_no", ws_tokens(F.col("_sentence")).alias("words")))


def chunk_rows(sentences: DataFrame, limit: int = 512) -> DataFrame:
    """Sentences to chunks: ``chunk_no, first_word, offset, words, text, last``."""
    rest = [c for c in sentences.columns if c != "words"]
    chunks = let(chunk_words(F.col("words"), limit), lambda cs: F.transform(
        cs, lambda c: c.withField("last", c["chunk_no"] == F.size(cs) - 1)))
    return (sentences.select(*rest, F.inline(chunks))
            .withColumn("text", join_tokens(F.col("words"))))


def tag_chunks(chunks: DataFrame, threshold: float = VOTE_THRESHOLD) -> DataFrame:
    """Chunks with ``spans`` to chunks with the ``tags`` the annotators agree on."""
    return chunks.withColumn("tags", voted_tags(F.col("words"), F.col("spans"), threshold)).drop("spans")


def label_documents(docs: DataFrame, annotate: Annotate, text: str = "text",
                    limit: int = 512, threshold: float = VOTE_THRESHOLD,
                    split: Callable[[Column], Column] = split_sentences) -> DataFrame:
    """Raw documents to tagged chunks in one pass; ``annotate`` adds ``spans`` to chunks."""
    chunks = chunk_rows(sentence_rows(docs, text, split), limit)
    return tag_chunks(annotate(chunks), threshold)


def labelled_tokens(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tagged chunks to token rows, positions counted through the sentence."""
    pairs = F.arrays_zip(F.col("words").alias("token"), F.col("tags").alias("tag"))
    return (chunks.select(*keys, "sent_no", "first_word", F.posexplode(pairs).alias("_i", "_t"))
            .select(*keys, "sent_no", (F.col("first_word") + F.col("_i")).alias("pos"),
                    F.col("_t.token").alias("token"), F.col("_t.tag").alias("tag")))


def labelled_lines(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tagged chunks to ``value``: a ``token tag`` line per word, a blank line per sentence.

    ``sent_no, chunk_no`` order the rows of a document; each value ends where the
    writer's line end belongs.
    """
    lines = F.zip_with("words", "tags", lambda w, t: F.concat_ws(" ", w, t))
    end = F.when(F.col("last"), "\n").otherwise("")
    return chunks.select(*keys, "sent_no", "chunk_no",
                         F.concat(F.array_join(lines, "\n"), end).alias("value"))


def labelled_documents(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tagged chunks back to one text per document, as it was one before."""
    rows = F.sort_array(F.collect_list(F.struct("sent_no", "chunk_no", "value")))
    return (labelled_lines(chunks, keys).groupBy(*keys).agg(rows.alias("_rows"))
            .select(*keys, F.concat(F.array_join(F.col("_rows.value"), "\n"), F.lit("\n"))
                    .alias("text")))


def label_sentences(sentences: DataFrame, annotate: Annotate, keys: Sequence[str],
                    limit: int = 512, threshold: float = VOTE_THRESHOLD) -> DataFrame:
    """Sentences with ``tokens`` to one predicted tag array each, joined by key.

    Only the chunks of one sentence meet, so a group is as long as its sentence.
    """
    chunks = chunk_rows(sentences.select(*keys, F.col("tokens").alias("words")), limit)
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", "tags")))
    return (tag_chunks(annotate(chunks), threshold).groupBy(*keys)
            .agg(F.flatten(parts["tags"]).alias("tags")))
