"""Tag functions: parsing, mapping between tagsets, ids and subword alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelkit.functions.arrays import let, running_sum
from labelkit.schemas import IGNORED, LETTER_TO_NAME


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def parse_tag(tag: Column) -> Column:
    """``X-Y`` as ``struct<prefix, type>``; null where a tag has not exactly two parts."""
    parts = F.split(tag, "-")
    return F.when(F.size(parts) == 2, F.struct(
        F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("type")))


def map_types(tag: Column, names: Mapping[str, str] = LETTER_TO_NAME,
              other: str = "MISC") -> Column:
    """Type of a tag renamed; unknown types and malformed tags become ``other``, ``O`` stays."""
    parts = F.split(tag, "-")
    name = F.coalesce(literal_map(names)[F.get(parts, F.lit(1))], F.lit(other))
    return (F.when(F.size(parts) == 2, F.concat(F.get(parts, F.lit(0)), F.lit("-"), name))
            .when(tag == "O", "O").otherwise(other))


def remap_tags(tags: Column, mapping: Mapping[str, str], default: str = "O") -> Column:
    """Every tag looked up in ``mapping``; ``default`` where it is missing."""
    return F.transform(tags, lambda t: F.coalesce(literal_map(mapping)[t], F.lit(default)))


def relabel_positional(tags: Column, old: Sequence[str], new: Sequence[str],
                       default: str = "O") -> Column:
    """The i-th name of ``old`` becomes the i-th of ``new``; names beyond it ``default``."""
    return remap_tags(tags, dict(zip(old, new)), default)


def decode_labels(ids: Column, names: Sequence[str]) -> Column:
    """Label ids to names."""
    vocabulary = F.array(*[F.lit(n) for n in names])
    return F.transform(ids, lambda i: F.get(vocabulary, i))


def encode_labels(tags: Column, names: Sequence[str] | Column, unseen: int = IGNORED) -> Column:
    """Label names to their 0-based position in ``names``; ``unseen`` where missing."""
    vocabulary = names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names])
    return let(vocabulary, lambda v: F.transform(tags, lambda t: F.when(
        F.array_contains(v, t), (F.array_position(v, t) - 1).cast("int")).otherwise(unseen)))


def clamp_labels(ids: Column, highest: int = 10) -> Column:
    """Ids above ``highest`` become 0."""
    return F.transform(ids, lambda i: F.when(i > highest, 0).otherwise(i))


def begin_to_inside(label: Column) -> Column:
    """Odd ids open an entity; the next even id continues it."""
    return label + F.pmod(label, F.lit(2))


def rename_label(label: Column) -> Column:
    """``LABEL_0`` to ``O`` and ``LABEL_k`` to ``B-k``."""
    return F.when(label == "LABEL_0", "O").otherwise(F.replace(label, F.lit("LABEL_"), F.lit("B-")))


def bio_from_types(types: Column) -> Column:
    """Plain types of one sentence to BIO tags; a run of one type is one entity."""
    return let(types, lambda ts: F.transform(ts, lambda t, i: (
        F.when(t == "O", "O")
        .when(F.get(ts, i - 1).eqNullSafe(t), F.concat(F.lit("I-"), t))
        .otherwise(F.concat(F.lit("B-"), t)))))


def align_labels(labels: Column, word_ids: Column, mode: str = "first") -> Column:
    """Word label ids spread over subwords; a null word id marks a special piece.

    ``first``: the first piece of a word has its label, further pieces the
    continuing one. ``copy``: every piece has the label of its word.
    """

    def piece(e: Column, w: Column, i: Column) -> Column:
        label = F.get(e["labels"], w)
        if mode == "copy":
            return F.coalesce(label, F.lit(IGNORED))
        again = F.get(e["ids"], i - 1).eqNullSafe(w)
        return (F.when(w.isNull(), IGNORED)
                .when(again, begin_to_inside(label)).otherwise(label))

    if mode not in ("first", "copy"):
        raise ValueError(f"unknown mode {mode!r}")
    return let(F.struct(labels.alias("labels"), word_ids.alias("ids")),
               lambda e: F.transform(e["ids"], lambda w, i: piece(e, w, i)))


def consume_labels(labels: Column, pieces: Column, special: Sequence[str]) -> Column:
    """The i-th piece that is neither special nor a ``##`` rest takes the i-th label.

    Rests, special pieces and pieces beyond the last label are ignored.
    """

    def kept(p: Column) -> Column:
        return ~(p.isin(*special) | p.startswith("##"))

    def spread(e: Column) -> Column:
        taken = running_sum(F.transform(e["pieces"], lambda p: kept(p).cast("int")))
        return F.zip_with(e["pieces"], taken, lambda p, k: F.when(
            kept(p), F.coalesce(F.get(e["labels"], k), F.lit(IGNORED))).otherwise(IGNORED))

    return let(F.struct(labels.alias("labels"), pieces.alias("pieces")), spread)


def mask_ignored(predictions: Column, labels: Column) -> Column:
    """``array<struct<pred, gold>>`` of the positions whose label is not ignored."""
    both = F.zip_with(predictions, labels,
                      lambda p, g: F.struct(p.alias("pred"), g.alias("gold")))
    return F.filter(both, lambda x: x["gold"] != IGNORED)
