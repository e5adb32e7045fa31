"""Tagsets, file layouts and table schemas shared by every module."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The label sets, in the id order each corpus declares.
CANON = ["O", "B-p", "I-p", "B-i", "I-i", "B-g", "I-g", "B-t", "I-t", "B-o", "I-o"]
CNEC = ["O", "B-P", "I-P", "B-I", "I-I", "B-G", "I-G", "B-T", "I-T", "B-O", "I-O",
        "B-M", "I-M", "B-A", "I-A"]
MEDIEVAL = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]
MEDIEVAL_CANON = ["O", "B-p", "I-p", "B-g", "I-g"]
BSNLP = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC",
         "B-PRO", "I-PRO", "B-EVT", "I-EVT"]
COUNTED = CANON + ["B-m", "I-m", "B-a", "I-a"]

# Letter types to named types, and named types to canonical tags.
LETTER_TO_NAME = {"P": "PER", "G": "LOC", "I": "ORG"}
BSNLP_TO_CANON = {"B-PER": "B-p", "I-PER": "I-p", "B-ORG": "B-i", "I-ORG": "I-i",
                  "B-LOC": "B-g", "I-LOC": "I-g"}

# Fixed value: marks a position that carries no label.
IGNORED = -100


@dataclass(frozen=True)
class Layout:
    """One text layout: a token per line, fields at fixed places."""

    name: str
    sep: str
    token: int
    tag: int
    width: int
    extras: dict[str, int] = field(default_factory=dict)
    number: int | None = None
    number_base: int = 0
    number_blanks: bool = False
    header: str | None = None
    quoted: bool = False
    blank_is_boundary: bool = False


LAYOUTS = {
    layout.name: layout
    for layout in [
        Layout("cnec4", "\t", 0, 3, 4, {"lemmas": 1, "morph_tags": 2}),
        Layout("cnec5", "\t", 1, 4, 5, {"lemmas": 2, "morph_tags": 3},
               number=0, number_base=1, number_blanks=True),
        Layout("chnec4", " ", 0, 3, 4, {"lemmas": 1, "language": 2}),
        Layout("med10", "\t", 1, 9, 10, number=0),
        Layout("bsnlp3", "\t", 1, 2, 3, number=0),
        Layout("wiki3", "\t", 1, 2, 3, number=0),
        Layout("poner_csv", ",", 1, 4, 5, {"lemmas": 2}, number=0, number_base=1,
               header='"ID","Word","Lemma","Morphology","Annotation"', quoted=True),
        Layout("infer2", " ", 0, 1, 2, blank_is_boundary=True),
        Layout("legacy4", "\t", 0, 3, 4),
    ]
}

SPAN = T.StructType([
    T.StructField("model", T.IntegerType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("word", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

DOCS = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("well_formed", T.BooleanType()),
])
