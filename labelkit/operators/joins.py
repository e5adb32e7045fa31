"""Joins between tokens, spans, dictionaries and paired files.

Sides that grow with the corpus are not broadcast by hint: adaptive execution does so
where the measured size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.functions.arrays import let
from labelkit.functions.spans import tag_words
from labelkit.functions.text import ws_tokens


def gazetteer_tag(sentences: DataFrame, gazetteer: DataFrame, doc: str = "doc",
                  tokens: str = "tokens", name: str = "types") -> DataFrame:
    """Types of each sentence's tokens in the dictionary of its own document, else ``O``.

    A dictionary becomes one map per document and meets sentence rows; tokens are looked
    up inside the row and never shuffled. Of several types of a surface in a document the
    last by name counts.
    """
    entries = (gazetteer.groupBy(doc, "surface").agg(F.max("type").alias("type"))
               .groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("surface", "type"))).alias("_types")))
    known = F.coalesce("_types", F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")))
    return (sentences.join(entries, doc, "left").withColumn("_types", known)
            .withColumn(name, F.transform(tokens, lambda t: F.coalesce(
                F.try_element_at("_types", t), F.lit("O")))).drop("_types"))


def pair_by_path(docs: DataFrame, annotated: str, raw: str, path: str = "member") -> DataFrame:
    """Annotated ``.out`` members of a folder with the path of their raw ``.txt`` partner."""
    key = F.replace(F.replace(F.col(path), F.lit(annotated), F.lit(raw)),
                    F.lit(".out"), F.lit(".txt"))
    return (docs.where(F.col(path).startswith(annotated) & F.col(path).endswith(".out"))
            .withColumn("raw_path", key))


def pair_documents(annotated: DataFrame, raw: DataFrame, path: str = "member",
                   text: str = "text") -> DataFrame:
    """Annotated documents with the text of their raw partner."""
    partner = raw.select(F.col(path).alias("raw_path"), F.col(text).alias("raw_text"))
    return annotated.join(partner, "raw_path")


def _with_base(files: DataFrame, suffix: str, path: str) -> DataFrame:
    stem = F.left(F.col(path), F.length(path) - len(suffix))
    return files.where(F.col(path).endswith(suffix)).withColumn("base", stem)


def pair_files(files: DataFrame, left: str = ".sentences.txt", right: str = ".ner_tags.txt",
               path: str = "file") -> DataFrame:
    """Sentence files with the tag file of the same base name."""
    tags = _with_base(files, right, path).select("base", F.col(path).alias("tag_file"))
    return _with_base(files, left, path).join(tags, "base")


def unpaired_files(files: DataFrame, left: str = ".sentences.txt",
                   right: str = ".ner_tags.txt", path: str = "file") -> DataFrame:
    """Sentence files without a tag file."""
    return _with_base(files, left, path).join(
        _with_base(files, right, path).select("base"), "base", "left_anti")


def positional_zip(text_lines: DataFrame, tag_lines: DataFrame,
                   keys: Sequence[str] = ("base", "line_no")) -> DataFrame:
    """Line i with line i, then token j with tag j, both cut to the shorter side."""
    pairs = text_lines.select(*keys, ws_tokens(F.col("line")).alias("_w")).join(
        tag_lines.select(*keys, ws_tokens(F.col("line")).alias("_t")), list(keys))
    shorter = F.least(F.size("_w"), F.size("_t"))
    return pairs.select(*keys, F.slice("_w", F.lit(1), shorter).alias("tokens"),
                        F.slice("_t", F.lit(1), shorter).alias("tags"))


def project_spans(words: DataFrame, spans: DataFrame, keys: Sequence[str] = ("sentence_id",),
                  rank: Sequence[str] = ("model", "ord"), piece: int = 512) -> DataFrame:
    """Word rows ``keys, pos, token, start, end`` with the tag of the last span over them.

    Words and spans meet by key and stretch of text: a word stands in the stretch where it
    starts, a span in all from which a word can reach it. A stretch has ``piece`` characters,
    or as many as the longest word, so that one before a span is enough. A sentence of very
    many words is thus dealt to many tasks, each of which holds the words of one stretch;
    both sides are exchanged once and no word is joined back.
    """
    keys = list(keys)
    longest = words.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    width = F.lit(max(piece, longest or 0))

    def place(at: Column) -> Column:
        return F.floor(at / width)

    held = words.groupBy(*keys, place(F.col("start")).alias("_at")).agg(F.sort_array(F.collect_list(
        F.struct("start", "end", "pos", "token"))).alias("_words"))
    last = F.greatest(F.col("start"), F.col("end") - 1)
    heard = (spans.withColumn("_at", F.explode(F.sequence(place(F.col("start")) - 1, place(last))))
             .groupBy(*keys, "_at").agg(F.sort_array(F.collect_list(F.struct(
                 F.struct(*rank).alias("rank"), "start", "end", "label"))).alias("_spans")))
    none = F.array().cast(heard.schema["_spans"].dataType)
    tagged = (held.join(heard, [*keys, "_at"], "left")
              .select(*keys, "_words", tag_words(F.col("_words"), F.coalesce("_spans", none)).alias("_tags"))
              .select(*keys, F.explode(F.arrays_zip("_words", "_tags")).alias("_p")))
    return tagged.select(*keys, "_p._words.pos", "_p._words.token", "_p._words.start",
                         "_p._words.end", F.col("_p._tags").alias("tag"))


def label_lookup(df: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the name of their label id.

    One id, often that of ``O``, may stand in most rows. A label table is sent round where
    the planner sees that it is small; otherwise adaptive execution splits the hot ids.
    """
    return df.join(labels, key)


def match_entities(predicted: DataFrame, gold: DataFrame, keys: Sequence[str],
                   result: str = "matched") -> DataFrame:
    """Entities equal in keys, type and both ends, or those of one side only.

    ``result`` is ``matched``, ``false_positive`` or ``false_negative``.
    """
    on = [*keys, "type", "first", "last"]
    predicted, gold = predicted.select(*on), gold.select(*on)
    if result == "matched":
        return predicted.join(gold, on, "left_semi")
    if result == "false_positive":
        return predicted.join(gold, on, "left_anti")
    if result == "false_negative":
        return gold.join(predicted, on, "left_anti")
    raise ValueError(f"unknown result {result!r}")


def align_predictions(predicted: DataFrame, gold: DataFrame,
                      keys: Sequence[str] = ("sentence_id",)) -> DataFrame:
    """Predicted and gold tags of each gold sentence side by side, joined by key.

    A sentence without a prediction counts as all ``O``, so that its entities are missed
    rather than forgotten. Both sides carry one array per sentence: the shuffle moves
    sentences, not tokens.
    """
    sides = gold.select(*keys, F.col("tags").alias("gold")).join(
        predicted.select(*keys, F.col("tags").alias("pred")), list(keys), "left")
    return align_tagged(sides, keys)


def align_tagged(sentences: DataFrame, keys: Sequence[str], pred: str = "pred",
                 gold: str = "gold") -> DataFrame:
    """Rows ``keys, pred, gold`` as ``align_predictions`` gives them, where both tag arrays
    stand in one row: no join, no shuffle. A null ``pred`` counts as all ``O``."""
    nothing = F.transform(gold, lambda _: F.lit("O"))
    return sentences.select(*keys, F.coalesce(pred, nothing).alias("pred"), F.col(gold).alias("gold"))
