"""Running numbers over ordered rows, without one task per file, split or corpus.

A scope such as the train split may hold most rows. Totals are therefore taken in
blocks of the ordering index, block totals in larger blocks, and only the few
top-level totals of a scope meet in one window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from labelkit.folders import saved


def running_offset(df: DataFrame, scope: Sequence[str], index: str, value: Column,
                   name: str = "offset", shifts: Sequence[int] = (12, 24)) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same scope.

    ``index`` is a bigint, unique within a scope; scope columns are not null. Rows
    whose index agrees above the lowest ``shifts[0]`` bits share a block, blocks that
    agree above ``shifts[1]`` bits a larger block. The input is read twice: for the totals
    of its blocks, which are saved and from which all larger blocks are added up, and for
    the rows, which are shuffled once.
    """
    scope = list(scope)
    block, base = "_block", "_base"
    keyed = df.withColumn(block, F.shiftright(F.col(index).cast("bigint"), shifts[0]))
    totals = saved(keyed.groupBy(*scope, block).agg(F.sum(value).alias("_total")), "totals")
    bases = _block_bases(totals, scope, block, base, [s - shifts[0] for s in shifts[1:]])
    window = Window.partitionBy(*scope, block).orderBy(index).rowsBetween(*_BEFORE)
    return (keyed.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))
            .join(bases, [*scope, block], "left")
            .withColumn(name, F.col(name) + F.col(base)).drop(block, base))


_BEFORE = (Window.unboundedPreceding, -1)


def offset_in_ranges(df: DataFrame, order: Sequence[str], scope: Sequence[str], index: str, value: Column,
                     name: str = "offset", shifts: Sequence[int] = (12, 24)) -> DataFrame:
    """As ``running_offset``, with whole blocks dealt to partitions that follow one another by ``order, index``.

    ``scope`` has the columns of ``order`` and maybe more, so that one exchange serves the sums and
    the order. Sums of earlier blocks are joined before it: those that are 0 are left out and the
    others saved, so that the planner knows how few they are. Rows of a partition are not sorted.
    """
    order, scope = list(order), list(scope)
    if not set(order) <= set(scope):
        raise ValueError("scope must have the columns of order")
    block, base = "_block", "_base"
    keyed = df.withColumn(block, F.shiftright(F.col(index).cast("bigint"), shifts[0])).withColumn("_value", value)
    totals = saved(keyed.groupBy(*scope, block).agg(F.sum("_value").alias("_total")), "totals")
    bases = saved(_block_bases(totals, scope, block, base, [s - shifts[0] for s in shifts[1:]]).where(F.col(base) != 0), "bases")
    known = F.lit(True)
    for c in (*scope, block):
        known = known & F.col(c).isNotNull()
    window = Window.partitionBy(*scope, block).orderBy(index).rowsBetween(*_BEFORE)
    return (keyed.join(bases, [*scope, block], "left")
            .withColumn(base, F.when(known, F.coalesce(base, F.lit(0))))
            .repartitionByRange(*order, block)
            .withColumn(name, F.coalesce(F.sum("_value").over(window), F.lit(0)) + F.col(base))
            .drop(block, base, "_value"))


def _block_bases(totals: DataFrame, scope: list[str], block: str, name: str,
                 shifts: Sequence[int]) -> DataFrame:
    """Sums of ``_total`` over the earlier blocks of a scope: ``scope, block, name``."""
    if not shifts:
        window = Window.partitionBy(*scope).orderBy(block).rowsBetween(*_BEFORE)
        return totals.select(*scope, block, F.coalesce(F.sum("_total").over(window), F.lit(0)).alias(name))
    wide, base = f"_wide{len(shifts)}", f"_base{len(shifts)}"
    keyed = totals.withColumn(wide, F.shiftright(block, shifts[0]))
    larger = keyed.groupBy(*scope, wide).agg(F.sum("_total").alias("_total"))
    bases = _block_bases(larger, scope, wide, base, [s - shifts[0] for s in shifts[1:]])
    window = Window.partitionBy(*scope, wide).orderBy(block).rowsBetween(*_BEFORE)
    return (keyed.withColumn(name, F.coalesce(F.sum("_total").over(window), F.lit(0)))
            .join(bases, [*scope, wide], "left")
            .select(*scope, block, (F.col(name) + F.col(base)).alias(name)))


def number_lines(sentences: DataFrame, scope: Sequence[str], index: str,
                 count_blanks: bool = False, base: int = 0, tokens: str = "tokens",
                 name: str = "first_no", shifts: Sequence[int] = (12, 24)) -> DataFrame:
    """Add the number of each sentence's first token line within ``scope``.

    ``count_blanks`` lets the blank line after a sentence take a number too.
    """
    lines = F.size(tokens) + F.lit(1 if count_blanks else 0)
    return (running_offset(sentences, scope, index, lines, name, shifts)
            .withColumn(name, F.col(name) + base))


def sentence_ids(sentences: DataFrame, scope: Sequence[str], index: str,
                 name: str = "sentence_id", shifts: Sequence[int] = (12, 24)) -> DataFrame:
    """Dense 0-based sentence numbers within ``scope``, in ``index`` order."""
    return running_offset(sentences, scope, index, F.lit(1), name, shifts)


def batch_rows(df: DataFrame, size: int, scope: Sequence[str], index: str,
               name: str = "batch", shifts: Sequence[int] = (12, 24), dense: bool = False) -> DataFrame:
    """Number batches of ``size`` consecutive rows within ``scope``.

    ``dense``: the index already counts the rows of its scope from 0, as ``sentence_ids`` does.
    """
    numbered = (df.withColumn(name, F.col(index)) if dense
                else running_offset(df, scope, index, F.lit(1), name, shifts))
    return numbered.withColumn(name, F.floor(F.col(name) / size))


# A block is one split of one part of a file, told by this compact key. Names are kept
# out of the lines: ``files`` holds ``part_key, part, file`` and what else a file has.
_BLOCK = ["part_key", "start"]
_EARLIER = (Window.unboundedPreceding, -1)


class _Order:
    """Sees that the lines of a block come together and in order, as a scan gives them."""

    def __init__(self) -> None:
        self.block: tuple | None = None
        self.line = -1

    def check(self, part: np.ndarray, start: np.ndarray, line: np.ndarray) -> np.ndarray:
        """True where a line opens a block; lines that were dealt out anew are an error."""
        opens = np.ones(len(part), dtype=bool)
        opens[1:] = (part[1:] != part[:-1]) | (start[1:] != start[:-1])
        opens[0] = (part[0], start[0]) != self.block
        before = np.concatenate([[self.line], line[:-1]])
        if (line <= before).any():
            raise ValueError("lines were reordered after reading: number them as they are read")
        self.block, self.line = (part[-1], start[-1]), line[-1]
        return opens


def _numpy(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _count_in_blocks(lines: DataFrame, name: str) -> DataFrame:
    """Add the 1-based number of each line within its block.

    A scan task reads the lines of a block in order and together, so a pass over its
    batches counts them where they are: a window would shuffle and sort every line.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, total = _Order(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = order.check(*_numpy(batch, *_BLOCK, "line_id"))
            places = np.arange(1, batch.num_rows + 1)
            base = np.maximum.accumulate(np.where(opens, places - 1, -1))
            numbers = np.where(base >= 0, places - base, places + total)
            total = numbers[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, name])

    schema = T.StructType([*lines.schema.fields, T.StructField(name, T.LongType())])
    return lines.mapInArrow(count, schema)


def _in_file_order(blocks: DataFrame, files: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """Block rows with a number for their file, and the order of a file's blocks."""
    by_file = Window.partitionBy("file")
    named = blocks.join(_told_apart(files).select("part_key", "part", "file"), "part_key")
    return (named.withColumn("file_key", F.min("part_key").over(by_file)),
            by_file.orderBy("part", "start"))


def _told_apart(files: DataFrame) -> DataFrame:
    """Files as they are; two parts with one key would be taken for one and are an error."""
    parts = files.groupBy("part_key").agg(F.count_distinct("part").alias("_parts"))
    clash = F.when(F.col("_parts") > 1, F.raise_error(F.lit("two file names share a key")))
    return files.join(parts, "part_key").where(clash.isNull()).drop("_parts")


def file_names(files: DataFrame) -> DataFrame:
    """``file_key`` with the name and folders of each file."""
    rest = [c for c in files.columns if c not in ("part_key", "part")]
    return files.groupBy("file").agg(F.min("part_key").alias("file_key"), *[
        F.first(c).alias(c) for c in rest if c != "file"]).select("file_key", *rest)


def number_file_lines(lines: DataFrame, files: DataFrame, name: str = "line_no") -> DataFrame:
    """Lines of ``read_lines`` with ``file_key`` and a dense 0-based number per file.

    A long file is numbered by as many tasks as it has blocks. Block totals are saved
    first, so that the planner knows their size and sends them round while they are
    small. ``lines`` must come straight from reading.
    """
    blocks, order = _in_file_order(
        lines.groupBy(*_BLOCK).agg(F.count("*").alias("_lines")), files)
    before = F.sum("_lines").over(order.rowsBetween(*_EARLIER))
    bases = saved(blocks.select(*_BLOCK, "file_key", F.coalesce(before, F.lit(0)).alias("_base")),
                  "blocks")
    return (_count_in_blocks(lines, name).join(bases, _BLOCK)
            .withColumn(name, F.col(name) + F.col("_base") - 1).drop("_base"))


_PIECE = ("part_key bigint, start bigint, ordinal bigint, opens boolean, closes boolean, "
          "lines array<string>")


class _Runs:
    """Cuts batches of lines into runs without a boundary; no line is looked at singly."""

    def __init__(self, edges: bool) -> None:
        self.edges, self.order = edges, _Order()
        self.held: list[tuple[pa.RecordBatch, np.ndarray]] = []  # lines of a run that may go on
        self.block: np.ndarray | None = None  # the block at hand
        self.ended = 0  # and the number of its runs that have ended

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part, start, line_id, word = _numpy(batch, *_BLOCK, "line_id", "_word")
        fresh = self.order.check(part, start, line_id)
        if fresh[0] and not self.held:
            yield from self._totals()
            self.ended = 0
        goes_on = bool(self.held) and word.all() and not fresh.any()
        self.held.append((batch.select([*_BLOCK, "line", "_word"]), fresh))
        if not goes_on:
            yield from self._cut(ended=not word[-1])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self._cut(ended=True)
        yield from self._totals()

    def _totals(self) -> Iterator[pa.RecordBatch]:
        """The row of the block at hand."""
        if self.edges and self.block is not None:
            yield _totals_batch(self.block[None], np.array([self.ended]))

    def _cut(self, ended: bool) -> Iterator[pa.RecordBatch]:
        """The runs of the lines held; one that may go on is held further."""
        batches = pa.Table.from_batches([b for b, _ in self.held]).combine_chunks().to_batches()
        if len(batches) > 1:
            raise ValueError("a run of lines is too large for one row")
        rows, fresh = batches[0], np.concatenate([f for _, f in self.held])
        part, start, word = _numpy(rows, *_BLOCK, "_word")
        keys = np.stack([part, start], 1)
        after = np.append(fresh[1:], True)
        first = np.nonzero(word & (fresh | ~np.append(False, word[:-1])))[0]
        end = np.nonzero(word & (after | ~np.append(word[1:], False)))[0] + 1
        of = np.cumsum(fresh) - fresh[0]
        heads = np.append(0, np.nonzero(fresh[1:])[0] + 1)
        runs = np.bincount(of[first], minlength=len(heads))
        number = np.arange(len(first)) - (np.cumsum(runs) - runs)[of[first]]
        number[of[first] == 0] += self.ended
        runs[0] += self.ended
        if self.edges and len(heads) > 1:
            yield _totals_batch(keys[heads[:-1]], runs[:-1])
        self.block, self.ended, self.held = keys[-1], int(runs[-1]), []
        opens, closes = fresh[first], after[end - 1]
        if not ended:
            self.ended -= 1
            self.held = [(rows.slice(first[-1]), fresh[first[-1]:])]
            first, end, number, opens, closes = (
                x[:-1] for x in (first, end, number, opens, closes))
        own = (opens | closes) == self.edges
        if own.any():
            first, end = first[own], end[own]
            yield _pieces_batch(keys[first], number[own], opens[own], closes[own],
                                _run_lists(rows.column("line"), first, end))


def _run_lists(lines: pa.Array, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lines of some runs as one list per run."""
    steps = np.zeros(len(lines) + 1, np.int8)
    steps[first] += 1
    steps[end] -= 1
    offsets = pa.array(np.append(0, np.cumsum(end - first)), pa.int32())
    return pa.ListArray.from_arrays(offsets, lines.filter(pa.array(np.cumsum(steps[:-1]) > 0)))


def _pieces_batch(keys: np.ndarray, ordinals: np.ndarray, opens: np.ndarray,
                  closes: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
    numbers = [pa.array(x, pa.int64()) for x in (keys[:, 0], keys[:, 1], ordinals)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array(opens), pa.array(closes), lists],
                                      [c.split()[0] for c in _PIECE.split(", ")])


def _totals_batch(keys: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    no = np.zeros(len(runs), bool)
    return _pieces_batch(keys, runs, no, no, pa.nulls(len(runs), pa.list_(pa.string())))


def _pieces(lines: DataFrame, boundary: Column, edges: bool) -> DataFrame:
    """Runs of lines without a boundary, per block: those inside it, or those at its edges.

    ``opens``: the run begins with the block's first line and may go on from the block
    before; ``closes``: it ends with the last. ``edges`` gives the runs that do either and, for
    every block, a row without lines whose ordinal is the number of runs.
    """
    marked = lines.select(*_BLOCK, "line_id", "line", (~boundary).alias("_word"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(edges)
        for batch in batches:
            if batch.num_rows:
                yield from runs.add(batch)
        yield from runs.close()

    return marked.mapInArrow(gather, _PIECE)


def sentence_lines(lines: DataFrame, files: DataFrame, boundary: Column,
                   name: str = "sentence_id") -> DataFrame:
    """Rows ``file_key, sentence_id, lines``: runs of lines without a boundary, numbered densely per file.

    The task that reads a block puts its sentences together. Only the runs at the edges
    of blocks, at most two per block, are saved, exchanged and joined to one another; how
    many runs the blocks before hold is sent round. A file without boundaries is one
    row. ``lines`` must come straight from reading.
    """
    edges = saved(_pieces(lines, boundary, True), "edges")
    blocks, order = _in_file_order(edges.groupBy(*_BLOCK).agg(
        F.max(F.when(F.col("lines").isNull(), F.col("ordinal"))).alias("_runs"),
        F.max("opens").alias("_first"), F.max("closes").alias("_last")), files)
    goes_on = F.col("_first") & F.coalesce(F.lag("_last").over(order), F.lit(False))
    before = F.sum(F.col("_runs") - F.col("_goes_on")).over(order.rowsBetween(*_EARLIER))
    bases = saved(blocks.withColumn("_goes_on", goes_on.cast("int"))
                  .withColumn("_base", F.coalesce(before, F.lit(0)) - F.col("_goes_on"))
                  .select(*_BLOCK, "file_key", "_base", F.row_number().over(order).alias("_no")),
                  "blocks")

    def numbered(pieces: DataFrame) -> DataFrame:
        return pieces.join(bases, _BLOCK).withColumn(name, F.col("ordinal") + F.col("_base"))

    inside = numbered(_pieces(lines, boundary, False)).select("file_key", name, "lines")
    cut = numbered(edges.where(F.col("lines").isNotNull())).groupBy("file_key", name).agg(
        F.sort_array(F.collect_list(F.struct("_no", "ordinal", "lines"))).alias("_parts"))
    return inside.unionByName(cut.select("file_key", name, F.flatten("_parts.lines").alias("lines")))


def sentence_boundaries(lines: DataFrame, files: DataFrame, boundary: Column,
                        name: str = "sentence_id") -> DataFrame:
    """Token lines ``file_key, sentence_id, pos, line`` with a dense sentence number per file."""
    return sentence_lines(lines, files, boundary, name).select(
        "file_key", name, F.posexplode("lines").alias("pos", "line"))
