"""Array building blocks: binding, prefix sums, runs and slices.

Everything here is a Column of built-in functions and works within one row,
so no operator built on it needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes.

    The optimizer may paste a projected column into a lambda and so evaluate it
    per element; a lambda variable is never pasted.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def positions_where(values: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Ascending 0-based positions whose (element, position) passes ``test``."""
    return F.array_compact(F.transform(values, lambda x, i: F.when(test(x, i), i)))


def _fold_sums(block: Column) -> Column:
    return F.aggregate(block, F.array(F.lit(0)),
                       lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def running_sum(values: Column, widths: tuple[int, ...] = (16, 64)) -> Column:
    """Exclusive prefix sums of an int array.

    Sums run inside blocks of ``widths[0]``, block totals in the same way with the
    next width, and are added afterwards: appending to one ever longer array
    would copy it once per element. A short array is one block.
    """

    def single(v: Column) -> Column:
        return F.slice(_fold_sums(v), F.lit(1), F.size(v))

    if not widths:
        return let(values, single)
    width, wider = widths[0], widths[1:]

    def in_blocks(v: Column) -> Column:
        count = F.floor(F.size(v) / F.lit(width)).cast("int")
        partial = F.transform(F.sequence(F.lit(0), count),
                              lambda b: _fold_sums(F.slice(v, b * width + 1, F.lit(width))))
        return let(partial, lambda p: F.flatten(F.zip_with(
            p, running_sum(F.transform(p, lambda x: F.element_at(x, -1)), wider),
            lambda x, base: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + base))))

    return let(values, lambda v: F.when(F.size(v) <= 3 * width, single(v)).otherwise(
        in_blocks(v)))


def cut(values: Column, starts: Column) -> Column:
    """Slices of ``values`` that begin at each of the ascending ``starts``."""
    return let(F.struct(values.alias("v"), starts.alias("s")), lambda e: F.transform(
        e["s"], lambda b, k: F.slice(
            e["v"], b + 1, F.coalesce(F.get(e["s"], k + 1), F.size(e["v"])) - b)))


_JOINT = "\x1f"  # a character that words hardly have


def pack_words(words: Column) -> Column:
    """An array of strings as ``struct<text, words>``: one text where that can be undone, else the array.

    In a shuffle a word of a text takes its own bytes and one more, one of an array 16 bytes at least.
    """
    text = F.array_join(words, _JOINT)
    undone = F.coalesce(F.split(text, _JOINT) == words, F.lit(False))
    return F.struct(F.when(undone, text).alias("text"), F.when(~undone, words).alias("words"))


def unpack_words(packed: Column) -> Column:
    """The array that ``pack_words`` was given."""
    return F.coalesce(F.split(packed["text"], _JOINT), packed["words"])


def pad_truncate(values: Column, length: int | Column, pad: Column) -> Column:
    """Exactly ``length`` elements: cut on the right or filled with ``pad``."""
    size = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(values, F.array_repeat(pad, size)), F.lit(1), size)


def attention_mask(values: Column, length: int | Column) -> Column:
    """1 for a real position, 0 for padding, ``length`` long."""
    return pad_truncate(F.transform(values, lambda _: F.lit(1)), length, F.lit(0))


def argmax_label(scores: Column) -> Column:
    """0-based position of the highest score; the first one on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
