"""Text functions: Unicode blanks, sentences, words with offsets, chunks, page XML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelkit.functions.arrays import cut, let, running_sum

# The characters Unicode counts as blank, plus the four information separators.
BLANKS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Shortened Czech words whose period does not end a sentence.
ABBREVIATIONS = ["apod", "atd", "č", "čp", "dr", "Dr", "hod", "Ing", "kap", "Mgr", "mj",
                 "např", "nar", "p", "pí", "př", "prof", "Prof", "r", "resp", "roč", "s", "sl",
                 "srov", "st", "str", "sv", "Sv", "tj", "tzn", "tzv", "ul", "viz", "zvl"]


def plain_blanks(text: Column) -> Column:
    """Every Unicode blank as one U+0020; lengths and offsets stay the same."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def ws_tokens(text: Column) -> Column:
    """Words of a text, split on runs of Unicode blanks."""
    return F.array_remove(F.split(plain_blanks(text), " "), "")


def ws_strip(text: Column) -> Column:
    """Text without Unicode blanks at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True where a text has no character but Unicode blanks."""
    return F.coalesce(ws_strip(text) == "", F.lit(True))


def split_literal(text: Column) -> Column:
    """Pieces between period-space pairs; a trailing empty piece is kept."""
    return F.split(text, "[.] ")


def split_sentences(text: Column, abbreviations: Iterable[str] = ABBREVIATIONS) -> Column:
    """Sentences: a cut at blanks after ``. ! ? …`` and before a capital letter.

    A period after a known short form or a single capital letter does not end
    a sentence. Pieces are stripped, blank ones dropped: a cut takes all blanks
    with it, so only those at the ends of the text are left to strip.
    """
    known = "|".join(sorted(abbreviations, key=lambda a: (-len(a), a)))
    shortened = rf"(?<!(?:^|[^\p{{L}}\p{{N}}])(?:\p{{Lu}}|{known})\.)"
    return F.array_remove(F.split(ws_strip(text), rf"(?<=[.!?…]){shortened}[{BLANKS}]+(?=\p{{Lu}})"), "")


def strip_final_period(token: Column) -> Column:
    """Token without one final period."""
    return F.regexp_replace(token, r"[.]\z", "")


def join_tokens(tokens: Column) -> Column:
    """Tokens joined by single spaces."""
    return F.array_join(tokens, " ")


def word_positions(text: Column) -> Column:
    """Words of a text as ``array<struct<token, start, end>>`` in code points, end exclusive."""

    def place(e: Column) -> Column:
        lead = F.length(F.get(e["gaps"], F.lit(0)))
        steps = F.transform(
            e["words"], lambda w, i: F.length(w) + F.length(F.get(e["gaps"], i + 1)))
        return F.zip_with(e["words"], running_sum(steps), lambda w, s: F.struct(
            w.alias("token"), (s + lead).alias("start"), (s + lead + F.length(w)).alias("end")))

    return let(plain_blanks(text), lambda t: let(F.struct(
        F.array_remove(F.split(t, " +"), "").alias("words"),
        F.split(t, "[^ ]+").alias("gaps")), place))


def joined_positions(words: Column) -> Column:
    """Words with (start, end) as they stand when joined by single spaces."""
    return let(words, lambda ws: F.zip_with(
        ws, running_sum(F.transform(ws, lambda w: F.length(w) + 1)), lambda w, s: F.struct(
            w.alias("token"), s.alias("start"), (s + F.length(w)).alias("end"))))


def chunk_starts(words: Column, limit: int = 512) -> Column:
    """Word positions at which the greedy packing opens another chunk.

    A word joins the open chunk while chunk length + word + 1 stays within
    ``limit``; the words of the first chunk each count one joining blank, the first
    word of a later chunk counts none. Position 0 appears when the very first
    word is over the limit by itself.
    """

    def step(acc: Column, n: Column) -> Column:
        full = acc["used"] + n + 1 > limit
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, n).otherwise(acc["used"] + n + 1).alias("used"),
            F.when(full, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"])
            .alias("cuts"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"),
                     F.array().cast("array<int>").alias("cuts"))
    return F.aggregate(F.transform(words, F.length), start, step, lambda acc: acc["cuts"])


def chunk_words(words: Column, limit: int = 512, compat: bool = False) -> Column:
    """Chunks of a word array as ``array<struct<chunk_no, first_word, offset, words>>``.

    ``offset`` is where the chunk begins in the words joined by single spaces.
    ``compat=True`` keeps the empty chunk before an over-long first word, with
    the one character it adds to every later offset.
    """

    def build(e: Column) -> Column:
        cuts = e["cuts"]
        over_first = F.get(cuts, F.lit(0)).eqNullSafe(F.lit(0))
        keep_empty = over_first if compat else F.lit(False)
        starts = F.when(over_first & ~keep_empty, cuts).otherwise(
            F.concat(F.array(F.lit(0)), cuts))
        return let(starts, lambda s: let(cut(e["w"], s), lambda pieces: F.zip_with(
            F.zip_with(s, pieces, lambda a, p: F.struct(a.alias("a"), p.alias("p"))),
            running_sum(F.transform(pieces, lambda p: F.length(join_tokens(p)) + 1)),
            lambda x, off: F.struct(x["a"].alias("first_word"), off.alias("offset"),
                                    x["p"].alias("words")))))

    def number(chunks: Column) -> Column:
        return F.transform(chunks, lambda c, i: F.struct(
            i.alias("chunk_no"), c["first_word"].alias("first_word"),
            c["offset"].alias("offset"), c["words"].alias("words")))

    def one(w: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("chunk_no"), F.lit(0).alias("first_word"),
                                F.lit(0).alias("offset"), w.alias("words")))

    # most sentences are within the limit as a whole and need no packing
    chunks = let(words, lambda w: F.when(F.size(w) > 0, F.when(
        F.length(join_tokens(w)) < limit, one(w)).otherwise(number(let(
            F.struct(w.alias("w"), chunk_starts(w, limit).alias("cuts")), build)))))
    return F.when(words.isNotNull(), F.coalesce(chunks, F.array()))


def tags_from_lines(block: Column) -> Column:
    """Second field of every non-blank line of a text block, else ``O``."""
    lines = F.filter(F.split(block, "\n"), lambda x: ~is_blank(x))
    return F.transform(lines, lambda x: F.coalesce(F.get(ws_tokens(x), F.lit(1)), F.lit("O")))


def output_name(path: Column) -> Column:
    """``a/b.xml`` to ``a/b.conll``: the last four characters are replaced."""
    return F.concat(F.left(path, F.greatest(F.length(path) - 4, F.lit(0))), F.lit(".conll"))


def flat_output_name(path: Column) -> Column:
    """``x/a.b.zip`` to ``x_ab.conll``: last four characters, slashes and periods go."""
    stem = F.left(path, F.greatest(F.length(path) - 4, F.lit(0)))
    return F.concat(F.translate(stem, "/.", "_"), F.lit(".conll"))


def parse_page(xml: str) -> ElementTree.Element | None:
    """Root of a page, or none for a malformed one."""
    try:
        return ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        return None


def _unicode_texts(xml: str | None, in_lines: bool) -> list[str] | None:
    """Text of the ``Unicode`` elements of a page, up to their first child element each.

    Comments and processing instructions do not end a text. Names count without their
    namespace. ``in_lines``: only elements inside a ``TextLine``.
    """
    root = None if xml is None else parse_page(xml)
    if root is None:
        return None
    found, stack = [], [(root, not in_lines)]
    while stack:  # children in reverse, so that elements come in document order
        element, inside = stack.pop()
        name = element.tag.rsplit("}", 1)[-1]
        if inside and name == "Unicode" and element.text:
            found.append(element.text)
        inside = inside or name == "TextLine"
        stack += [(child, inside) for child in reversed(element)]
    return found


_PAGES = 64  # held as Python objects at once


def _of_pages(xml: Column, work: Callable[[str | None], object], kind: pa.DataType, spark_kind: T.DataType | str) -> Column:
    """``work`` of every page, few pages at a time: the rest of a batch stays in Arrow."""

    def few(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), _PAGES):
                yield pa.array([work(x) for x in batch.slice(start, _PAGES).to_pylist()], kind)

    return F.arrow_udf(few, spark_kind)(xml)


def _units(xml: Column, in_lines: bool) -> Column:
    return _of_pages(xml, lambda x: _unicode_texts(x, in_lines), pa.list_(pa.string()), T.ArrayType(T.StringType()))


def page_xml_text(xml: Column) -> Column:
    """Text of all non-empty ``Unicode`` elements in document order, joined by spaces.

    Null for a malformed page, which so is told from an empty one and ends no job.
    """
    return F.array_join(_units(xml, False), " ")


def page_xml_lines(xml: Column) -> Column:
    """Text lines of a page: the ``Unicode`` elements inside ``TextLine``; null if malformed."""
    return _units(xml, True)


HYPHENS = ("-", "\u00ac", "\u00ad")  # at the end of a line: its last word goes on in the next


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _reading_order(root: ElementTree.Element) -> dict[str, int]:
    """Places of regions: ordered groups by index, unordered ones as they stand, nested ones
    where their group stands."""
    places: dict[str, int] = {}

    def index(element: ElementTree.Element) -> int:
        value = element.get("index", "")
        return int(value) if value.isdecimal() else 1 << 30

    left = [e for e in root.iter() if _name(e) == "ReadingOrder"][:1]
    while left:
        element = left.pop()
        if (ref := element.get("regionRef")) is not None:
            places.setdefault(ref, len(places))
        children = list(element)
        if _name(element).startswith("OrderedGroup"):
            children.sort(key=index)
        left += reversed(children)
    return places


def _line_text(line: ElementTree.Element) -> str:
    """Text of a line itself, or else that of its words."""
    def text(element: ElementTree.Element) -> str | None:
        return next((u.text for equiv in element if _name(equiv) == "TextEquiv" for u in equiv
                     if _name(u) == "Unicode" and u.text), None)

    own = text(line)
    return own if own is not None else " ".join(filter(None, (text(w) for w in line if _name(w) == "Word")))


def merge_lines(lines: list[str]) -> str:
    """Lines as running text; a word cut by a hyphen at a line's end is put together."""
    out = ""
    for line in lines:
        if out.endswith(HYPHENS):
            out = out[:-1] + line
        else:
            out += (" " if out else "") + line
    return out


def _regions(xml: str | None) -> list[dict] | None:
    root = None if xml is None else parse_page(xml)
    if root is None:
        return None
    order, found, left = _reading_order(root), [], [(root, None)]
    while left:  # in document order; a line belongs to the innermost region round it
        element, region = left.pop()
        if _name(element) == "TextRegion":
            region = {"region": element.get("id"), "lines": []}
            found.append(region)
        elif _name(element) == "TextLine" and region is not None:
            if line := _line_text(element):
                region["lines"].append(line)
            continue
        left += [(child, region) for child in reversed(element)]
    found = [f for f in found if f["lines"]]
    found.sort(key=lambda f: order.get(f["region"], len(order)))
    return [f | {"text": merge_lines(f["lines"])} for f in found]


def page_xml_regions(xml: Column) -> Column:
    """Text regions of a page in reading order: ``array<struct<region, lines, text>>``.

    Regions that the reading order does not name follow in document order, those without text
    are left out. Null for a malformed page, empty for one without regions.
    """
    kind = pa.list_(pa.struct([("region", pa.string()), ("lines", pa.list_(pa.string())), ("text", pa.string())]))
    return _of_pages(xml, _regions, kind, "array<struct<region: string, lines: array<string>, text: string>>")


def first_region_text(xml: Column) -> Column:
    """Text of the region that is read first; null where there is none."""
    return F.get(page_xml_regions(xml), F.lit(0))["text"]
