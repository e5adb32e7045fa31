"""Vote, tagging of words and merging of pieces over whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelkit.functions.spans import VOTE_THRESHOLD, tag_words, vote_spans
from labelkit.functions.text import BLANKS, joined_positions

_ROWS = 2048  # worked on at once


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranks(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of strings in the order of their bytes, and the different ones."""
    coded = pc.dictionary_encode(strings)
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)] = np.arange(len(place))
    return place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pc.sort_indices(coded.dictionary))


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """True where any of the keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class _Votes:
    """Spans of all annotators in a batch, flat; null ones count as 0 in a row that is ``odd``."""

    def __init__(self, spans: pa.Array) -> None:
        sizes, values = _sizes(spans), spans.flatten()
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        fields = dict(zip([f.name for f in values.type], values.flatten(), strict=True))
        odd = np.zeros(len(values), bool)
        for f in fields.values():
            if f.null_count:
                odd |= f.is_null().to_numpy(zero_copy_only=False)
        self.start, self.end, self.model, self.ord = (
            pc.fill_null(fields[n], 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "end", "model", "ord"))
        self.score = pc.fill_null(fields["score"], 0).to_numpy(zero_copy_only=False).astype(np.float64)
        odd |= np.isnan(self.score)
        self.odd = np.bincount(self.row[odd], minlength=len(sizes)) > 0
        self.label, self.labels = _ranks(pc.fill_null(fields["label"], ""))
        words = pc.dictionary_encode(pc.fill_null(fields["word"], ""))
        trimmed, _ = _ranks(pc.utf8_trim(words.dictionary, characters=BLANKS))
        self.word = trimmed[words.indices.to_numpy(zero_copy_only=False)]

    def agreed(self) -> tuple[np.ndarray, ...]:
        """``row, start, end, label, votes, score`` of voted-on spans in order of first appearance."""
        order = np.lexsort((self.score, self.label, self.ord, self.model, self.word, self.end, self.start, self.row))
        row, start, end, word, model, number, label, score = (
            x[order] for x in (self.row, self.start, self.end, self.word, self.model, self.ord, self.label, self.score))
        new = _fresh(row, start, end, word) if len(row) else np.zeros(0, bool)
        run, first = np.cumsum(new) - 1, np.nonzero(new)[0]
        # per span and label; scores are added up in the order of annotators
        ballots, one, of = np.unique(run * max(1, len(self.labels)) + label, return_index=True, return_inverse=True)
        n = np.bincount(of, minlength=len(ballots))
        mean = np.bincount(of, score, minlength=len(ballots)) / n
        best = np.lexsort((label[one], np.where(n == 1, model[one], 0), -mean, -n, run[one]))
        best = best[_fresh(run[one][best])] if len(best) else best
        rank = np.lexsort((word[first], end[first], start[first], number[first], model[first], row[first]))
        first, best = first[rank], best[rank]
        return row[first], start[first], end[first], label[one][best], n[best], mean[best]


def _voted_tags(words: pa.Array, spans: pa.Array, threshold: float) -> pa.Array:
    """Tags of a batch of word arrays; null where a word or a span has a null, or a score is none."""
    sizes, tokens = _sizes(words), words.flatten()
    w_row = np.repeat(np.arange(len(sizes)), sizes)
    votes = _Votes(spans)
    odd = votes.odd | words.is_null().to_numpy(zero_copy_only=False) | spans.is_null().to_numpy(zero_copy_only=False)
    if tokens.null_count:
        odd |= np.bincount(w_row[tokens.is_null().to_numpy(zero_copy_only=False)], minlength=len(sizes)) > 0
    lengths = pc.fill_null(pc.utf8_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    heads = np.cumsum(sizes) - sizes
    begin -= begin[heads[w_row]]
    row, start, end, label, n, mean = votes.agreed()
    kept = (n > 1) | (mean > threshold)
    row, start, end, label = (x[kept] for x in (row, start, end, label))
    # words that a span lies over stand together; all rows on one line
    width = int((begin + lengths).max(initial=0)) + 4
    low = np.searchsorted(w_row * width + begin + lengths + 1, row * width + np.clip(start, -1, width - 3) + 1, "right")
    high = np.searchsorted(w_row * width + begin + 1, row * width + np.clip(end, 0, width - 3) + 1, "left")
    over = np.maximum(high - low, 0)
    at = np.repeat(low - np.cumsum(over) + over, over) + np.arange(over.sum())
    last = np.full(len(tokens), -1)
    last[at] = np.repeat(np.arange(len(row)), over)  # of several spans the last one stays
    tag = np.zeros(len(tokens), np.int64)
    hit = last >= 0
    tag[hit] = 1 + 2 * label[last[hit]] + (begin[hit] != start[last[hit]])
    names = pa.array(["O", *(f"{place}-{name}" for name in votes.labels.to_pylist() for place in "BI")], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), names.take(pa.array(tag)), mask=pa.array(odd))


def voted_tags(words: Column, spans: Column, threshold: float = VOTE_THRESHOLD) -> Column:
    """BIO tag of every word by the spans that the annotators of its sentence or chunk agree on.

    The same as ``tag_words`` over ``joined_positions`` and ``vote_spans``, found batch by batch; rows
    with a null inside, or a score that is no number, go through these.
    """

    def of(words: pa.Array, spans: pa.Array) -> pa.Array:
        parts = [_voted_tags(words.slice(i, _ROWS), spans.slice(i, _ROWS), threshold) for i in range(0, len(words), _ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return F.coalesce(F.arrow_udf(of, "array<string>")(words, spans),
                      tag_words(joined_positions(words), vote_spans(spans, threshold)))


def _merged(pieces: pa.Array) -> pa.Array:
    """Entities of a batch of piece arrays; a null label counts as ``O``, a null array gives null."""
    sizes, values = _sizes(pieces), pieces.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    fields = dict(zip([f.name for f in values.type], values.flatten(), strict=True))
    coded = pc.dictionary_encode(pc.fill_null(fields["label"], "O"))
    labels, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    types: dict[str, int] = {}
    kind = np.array([-1 if t == "O" else types.setdefault(t[2:] if t[1:2] == "-" else t, len(types)) for t in labels], np.int64)[code]
    begins = np.array([t.startswith("B-") for t in labels], bool)[code]
    cut = np.ones(len(kind) + 1, bool)  # between a piece and the one before it
    cut[1:-1] = (row[1:] != row[:-1]) | begins[1:] | (kind[1:] != kind[:-1])
    first, last = (np.nonzero(c & (kind >= 0))[0] for c in (cut[:-1], cut[1:]))
    run = (np.cumsum(cut[:-1]) - 1)[first]
    scores = pc.fill_null(fields["score"], 0).to_numpy(zero_copy_only=False).astype(np.float64)
    of = np.cumsum(cut[:-1]) - 1
    # added up from the left, one by one
    score = np.bincount(of, scores, minlength=1)[run] / (last - first + 1)
    unknown = np.bincount(of[fields["score"].is_null().to_numpy(zero_copy_only=False)], minlength=of.max(initial=0) + 1)[run] > 0
    named = (kind >= 0) & ~fields["piece"].is_null().to_numpy(zero_copy_only=False)
    held = np.append(0, np.cumsum(named))
    inside = fields["piece"].filter(pa.array(named))
    offsets = np.append(held[first], held[last[-1] + 1] if len(last) else 0)
    word = pc.replace_substring(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inside), " "), " ##", "")
    found = pa.StructArray.from_arrays(
        [fields["start"].take(pa.array(first)).cast(pa.int32()), fields["end"].take(pa.array(last)).cast(pa.int32()),
         pa.array(list(types), pa.string()).take(pa.array(kind[first])), pa.array(score, pa.float64(), mask=unknown), word],
        ["start", "end", "label", "score", "word"])
    ends = np.append(0, np.cumsum(np.bincount(row[first], minlength=len(sizes))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=pieces.is_null())


def group_subword_entities(pieces: Column) -> Column:
    """Runs of one entity merged: ``array<struct<start, end, label, score, word>>``.

    ``pieces`` holds ``struct<label, score, start, end, piece>``, places being ints. A group opens at
    ``B-`` or where the type changes; ``O`` is dropped; the score is the mean;
    pieces are joined by blanks, ``##`` rests without one. Found batch by batch.
    """

    def of(pieces: pa.Array) -> pa.Array:
        return _merged(pieces)

    return F.arrow_udf(of, "array<struct<start: int, end: int, label: string, score: double, word: string>>")(pieces)
