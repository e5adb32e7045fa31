"""Entity spans inside one sentence or chunk: BIO to spans, voting, spans to word tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelkit.functions.arrays import cut, let, positions_where
from labelkit.functions.text import ws_strip

VOTE_THRESHOLD = 0.7


def tag_type(tag: Column) -> Column:
    """Type of a BIO tag; a tag without a prefix is its own type."""
    return F.when(F.substring(tag, 2, 1) == "-", F.substring(tag, F.lit(3), F.length(tag))
                  ).otherwise(tag)


def _opens(tags: Column, tag: Column, i: Column) -> Column:
    before = F.coalesce(F.get(tags, i - 1), F.lit("O"))
    return (tag != "O") & (tag.startswith("B-") | (before == "O")
                           | (tag_type(before) != tag_type(tag)))


def _closes(tags: Column, tag: Column, i: Column) -> Column:
    after = F.coalesce(F.get(tags, i + 1), F.lit("O"))
    return (tag != "O") & (after.startswith("B-") | (after == "O")
                           | (tag_type(after) != tag_type(tag)))


def bio_to_spans(tags: Column) -> Column:
    """Entities of a tag array as ``array<struct<type, first, last>>``.

    An entity opens at ``B-``, after ``O``, or where the type changes.
    """
    return let(tags, lambda t: F.zip_with(
        positions_where(t, lambda x, i: _opens(t, x, i)),
        positions_where(t, lambda x, i: _closes(t, x, i)),
        lambda b, e: F.struct(tag_type(F.get(t, b)).alias("type"), b.alias("first"),
                              e.alias("last"))))


def segment_after(values: Column, ends: "callable") -> Column:
    """Slices of an array, each ending after an element that passes ``ends``."""
    return let(values, lambda v: cut(v, F.filter(
        F.concat(F.array(F.lit(0)), F.transform(
            positions_where(v, lambda x, _: ends(x)), lambda i: i + 1)),
        lambda s: s < F.size(v))))


def shift_spans(spans: Column, offset: Column) -> Column:
    """Spans moved right by ``offset`` characters."""
    return F.transform(spans, lambda s: s.withField("start", s["start"] + offset)
                       .withField("end", s["end"] + offset))


def vote_spans(spans: Column, threshold: float = VOTE_THRESHOLD) -> Column:
    """Spans of all annotators of one chunk to agreed spans, in order of first appearance.

    ``spans`` holds ``struct<model, ord, start, end, word, label, score>``; equal
    (start, end, word) meet, blanks round the word left aside. A label with two or more votes wins with the mean
    score of its votes (tie: higher mean, then label); otherwise the best single
    score wins if it is above ``threshold`` (tie: first annotator). The result holds
    ``struct<rank, start, end, word, label, score>``.
    """

    def tally(votes: Column, label: Column) -> Column:
        return let(F.filter(votes, lambda v: v["label"] == label), lambda mine: F.struct(
            (-F.size(mine)).alias("minus_votes"),
            (-F.aggregate(mine, F.lit(0.0), lambda acc, v: acc + v["score"])
             / F.size(mine)).alias("minus_score"),
            F.when(F.size(mine) == 1, F.get(mine, F.lit(0))["model"]).alias("tie"),
            label.alias("label")))

    def decide(key: Column, votes: Column) -> Column:
        labels = F.array_distinct(votes["label"])
        winner = F.array_min(F.transform(labels, lambda lb: tally(votes, lb)))
        return let(winner, lambda w: F.when(
            (w["minus_votes"] < -1) | (-w["minus_score"] > threshold), F.struct(
                F.array_min(F.transform(votes, lambda v: F.struct(
                    v["model"].alias("model"), v["ord"].alias("ord")))).alias("rank"),
                key["start"].alias("start"), key["end"].alias("end"), key["word"].alias("word"),
                w["label"].alias("label"), (-w["minus_score"]).alias("score"))))

    def same(a: Column, b: Column) -> Column:
        return (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["word"] == b["word"])

    def run(ordered: Column) -> Column:
        # sorted by place, equal spans stand side by side: no search for each of them
        opens = positions_where(ordered, lambda s, i: (i == 0) | ~same(
            s, F.get(ordered, F.greatest(i - 1, F.lit(0)))))
        runs = cut(ordered, opens)
        return F.array_sort(F.array_compact(F.transform(
            runs, lambda votes: decide(F.get(votes, F.lit(0)), votes))))

    # votes of one span stay in the order of annotators and of their spans
    ranked = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), ws_strip(s["word"]).alias("word"),
        s["model"].alias("model"), s["ord"].alias("ord"), s["label"].alias("label"),
        s["score"].alias("score")))
    return let(F.array_sort(ranked), run)


def tag_words(words: Column, spans: Column) -> Column:
    """BIO tag of every word from ranked spans of the same sentence or chunk.

    ``words`` holds ``struct<token, start, end>``, ``spans`` ``struct<rank, start, end,
    label>`` in rank order. The last overlapping span wins; ``B-`` where word
    and span start together, else ``I-``; no overlap is ``O``.
    """

    def tag(all_spans: Column, w: Column) -> Column:
        last = F.try_element_at(F.filter(all_spans, lambda s: (w["end"] > s["start"])
                                         & (w["start"] < s["end"])), F.lit(-1))
        return let(last, lambda s: F.coalesce(F.concat(
            F.when(w["start"] == s["start"], "B-").otherwise("I-"), s["label"]), F.lit("O")))

    return let(spans, lambda s: F.transform(words, lambda w: tag(s, w)))
