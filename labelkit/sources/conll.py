"""CoNLL-style text files: reading into sentence rows, writing from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions.arrays import let, pack_words, unpack_words
from labelkit.functions.spans import segment_after
from labelkit.functions.tags import map_types, rename_label
from labelkit.functions.text import BLANKS, is_blank
from labelkit.operators.joins import positional_zip
from labelkit.operators.numbering import (file_names, number_file_lines, number_lines,
                                          offset_in_ranges, sentence_lines)
from labelkit.schemas import LAYOUTS, Layout

_CSV_SCHEMA = "f0 string, f1 string, f2 string, f3 string, f4 string"


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = False
               ) -> DataFrame:
    """Rows ``part_key, start, line_id, line``.

    ``part_key`` tells the file, ``start`` where the split of it begins that the line
    was read from, ``line_id`` rises within the split.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("part_key"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def list_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Rows ``part_key, part, file`` and folder columns such as ``split``; no file is opened.

    A file has one part, itself; a caller that takes several as one renames ``file``.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
             .load(path))
    folders = [c for c in files.columns if c not in (
        "path", "modificationTime", "length", "content")]
    name = F.col("_metadata.file_path")
    return files.select(F.xxhash64(name).alias("part_key"), name.alias("part"),
                        name.alias("file"), *folders)


def assign_split(path: Column) -> Column:
    """Split a file belongs to, told by its name; ``dev`` is the validation split."""
    name = F.element_at(F.split(path, "/"), -1)
    return (F.when(name.rlike(r"^train\.|training"), "train")
            .when(name.rlike(r"^test\.|test"), "test")
            .when(name.rlike(r"^(dev|validation)\.|validation"), "validation"))


def is_boundary(line: Column, layout: Layout) -> Column:
    """Lines between sentences: ``-DOCSTART-`` and empty ones, in some layouts blank ones."""
    empty = is_blank(line) if layout.blank_is_boundary else line == ""
    return line.startswith("-DOCSTART-") | empty


def _fields(line: Column, layout: Layout) -> Column:
    if layout.quoted:
        row = F.from_csv(line, F.lit(_CSV_SCHEMA), {"sep": layout.sep, "escape": '"'})
        return let(row, lambda r: F.array(*[r[f"f{i}"] for i in range(layout.width)]))
    return F.split(line, layout.sep)


def _body(lines: DataFrame, layout: Layout) -> DataFrame:
    """Lines without the header, wherever a part repeats it."""
    return lines.where(F.col("line") != layout.header) if layout.header else lines


def _parsed(lines: DataFrame, layout: Layout) -> DataFrame:
    return lines.withColumn("_f", _fields(F.col("line"), layout))


def _complete(fields: Column, layout: Layout) -> Column:
    """True where a line has the fields its layout needs."""
    needed = [layout.token, layout.tag, *layout.extras.values()]
    return F.get(fields, F.lit(max(needed))).isNotNull()


def read_conll(spark: SparkSession, path: str | list[str], layout: str,
               recursive: bool = False) -> DataFrame:
    """Sentence rows ``file, split, sentence_id, tokens, tags`` and the layout's other arrays.

    ``sentence_id`` is dense per file. Files may be split anywhere; the task that reads
    a split puts its sentences together, and only those cut by a split are exchanged.
    A file without blank lines is one sentence and so one row. Lines with too few
    fields are left to ``conll_rejects``; a sentence of such lines alone has no row.
    Folder columns such as ``split=train`` are kept.
    """
    spec = LAYOUTS[layout]
    files = list_files(spark, path, recursive)
    rows = sentence_lines(_body(read_lines(spark, path, recursive), spec), files,
                          is_boundary(F.col("line"), spec))
    columns = ["tokens", "tags", *spec.extras, *(() if spec.number is None else ("numbers",))]
    # as rows of a generator: a condition on the parsed lines would be pushed down and have them parsed a second time
    if spec.quoted:
        filled = F.filter(F.array(_parsed_rows(F.col("lines"), spec)), lambda s: F.size(s["tokens"]) > 0)
    else:
        rows = rows.withColumn("_s", _parsed_batches(F.col("lines"), spec))
        filled = F.when(F.size("_s.tokens") > 0, F.array("_s"))
    sentences = (rows.select("file_key", "sentence_id", F.explode(filled).alias("_s"))
                 .join(file_names(files), "file_key"))
    folders = files.columns[3:]
    split = [] if "split" in folders else [assign_split(F.col("file")).alias("split")]
    return sentences.select("file", *folders, *split, "sentence_id",
                            *[(F.col("_s")[name].cast("array<bigint>") if name == "numbers" else F.col("_s")[name]).alias(name)
                              for name in columns])


def _parsed_rows(lines: Column, spec: Layout) -> Column:
    """Arrays of the layout's fields from the lines of one sentence, row by row."""
    parsed = F.filter(F.transform(lines, lambda x: _fields(x, spec)), lambda f: _complete(f, spec))
    columns = {"tokens": lambda f: F.get(f, F.lit(spec.token)),
               "tags": lambda f: F.rtrim(F.get(f, F.lit(spec.tag)), F.lit(BLANKS))}
    for name, at in spec.extras.items():
        columns[name] = lambda f, at=at: F.get(f, F.lit(at))
    if spec.number is not None:
        columns["numbers"] = lambda f: F.get(f, F.lit(spec.number)).cast("bigint")
    return let(parsed, lambda fields: F.struct(*[F.transform(fields, _one(c)).alias(name) for name, c in columns.items()]))


def _parsed_batches(lines: Column, spec: Layout) -> Column:
    """The same over whole Arrow batches, for layouts whose fields hold no separator."""
    places = {"tokens": spec.token, "tags": spec.tag, **spec.extras, **({} if spec.number is None else {"numbers": spec.number})}
    last, sep = max(spec.token, spec.tag, *spec.extras.values()), spec.sep

    def of(lines: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(lines.flatten(), sep)
        full = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False) > last
        first = parts.offsets.to_numpy(zero_copy_only=False)[:-1][full]
        kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        ends = pa.array(np.append(0, np.cumsum(kept)), pa.int32())

        def field(name: str, at: int) -> pa.Array:
            values = parts.values.take(pa.array(first + at))
            return pa.ListArray.from_arrays(ends, pc.utf8_rtrim(values, characters=BLANKS) if name == "tags" else values)

        return pa.StructArray.from_arrays([field(name, at) for name, at in places.items()], list(places))

    return F.arrow_udf(of, f"struct<{', '.join(f'{name}: array<string>' for name in places)}>")(lines)


def _one(field: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda f: field(f)


def conll_rejects(spark: SparkSession, path: str | list[str], layout: str) -> DataFrame:
    """Token lines with too few fields: ``file, line_no, line``."""
    spec = LAYOUTS[layout]
    files = list_files(spark, path)
    numbered = number_file_lines(read_lines(spark, path), files)
    short = ~is_boundary(F.col("line"), spec) & ~_complete(F.col("_f"), spec)
    return (_parsed(_body(numbered, spec), spec).where(short)
            .join(file_names(files), "file_key").select("file", "line_no", "line"))


def conll_block(layout: Layout, first_no: Column | None = None) -> Column:
    """Text of one sentence, a line per token and a line end after the last one.

    Uses the columns ``tokens`` and ``tags`` and, where the layout has them, arrays
    named like its other fields; a field without a column is ``_``.
    """

    def quote(value: Column) -> Column:
        if not layout.quoted:
            return value
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    def line(row: Column, i: Column) -> Column:
        cells = [F.lit("_")] * layout.width
        cells[layout.token], cells[layout.tag] = row["tokens"], row["tags"]
        for name, at in layout.extras.items():
            cells[at] = row["tokens"] if layout.quoted else F.coalesce(row[name], F.lit("_"))
        if layout.number is not None:
            cells[layout.number] = (first_no + i).cast("string")
        return F.concat_ws(layout.sep, *[quote(c) for c in cells])

    arrays = ["tokens", "tags"] + ([] if layout.quoted else list(layout.extras))
    lines = F.transform(F.arrays_zip(*arrays), line)
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def _with_fields(sentences: DataFrame, spec: Layout, scope: Sequence[str], index: str,
                 number_scope: Sequence[str] | None) -> DataFrame:
    """Sentences with every array the layout writes, and the first token's number."""
    if spec.number is None:
        return _with_arrays(sentences, spec, [*scope, index])
    return number_lines(_with_arrays(sentences, spec, sentences.columns), number_scope or scope, index, spec.number_blanks,
                        spec.number_base).select(*scope, index, *_arrays(spec), "first_no")


def _arrays(spec: Layout) -> list[str]:
    return ["tokens", "tags", *(() if spec.quoted else spec.extras)]


def _with_arrays(sentences: DataFrame, spec: Layout, columns: Iterable[str]) -> DataFrame:
    """``columns`` and every array the layout writes."""
    for name in _arrays(spec):
        if name not in sentences.columns:
            sentences = sentences.withColumn(name, F.transform("tokens", lambda _: F.lit("_")))
    return sentences.select(*[c for c in columns if c not in _arrays(spec)], *_arrays(spec))


def _value(spec: Layout) -> Column:
    return conll_block(spec, F.col("first_no") if spec.number is not None else None)


def to_conll(sentences: DataFrame, layout: str, scope: Sequence[str] = ("corpus", "split"),
             index: str = "sentence_id", number_scope: Sequence[str] | None = None) -> DataFrame:
    """Rows ``scope, index, value`` with the text of each sentence in a layout.

    Tokens are numbered where the layout says so, within ``number_scope``; ``index``
    orders the sentences of a scope.
    """
    spec = LAYOUTS[layout]
    return _with_fields(sentences, spec, scope, index, number_scope).select(
        *scope, index, _value(spec).alias("value"))


def write_conll(sentences: DataFrame, path: str, layout: str,
                scope: Sequence[str] = ("corpus", "split"), index: str = "sentence_id",
                number_scope: Sequence[str] | None = None, compression: str = "none") -> None:
    """Write sentence rows as text files under one folder per scope, in index order.

    A sentence is one output row, so no task gathers a whole file; parts of a
    large scope are written by many tasks and follow one another in name order.
    Range partitioning samples its input and numbering adds it up first: pass a saved
    table where the sentences are costly to make. Sentences are exchanged once, their arrays as texts; only
    numbers within scopes that are not parts of ``scope`` take a second exchange. Files with a
    ``compression``, such as ``gzip``, are some times smaller, and each is read by one task.
    """
    spec = LAYOUTS[layout]
    sentences = sentences.where(F.size("tokens") > 0)
    inside = spec.number is not None and set(scope) <= set(number_scope or scope)
    number = F.size("tokens") + F.lit(1 if spec.number_blanks else 0)
    rows = (_with_arrays(sentences, spec, dict.fromkeys([*scope, *(number_scope or scope), index])) if inside
            else _with_fields(sentences, spec, scope, index, number_scope))
    arrays = _arrays(spec)
    rows = rows.withColumn("_n", number).withColumns({c: pack_words(F.col(c)) for c in arrays})
    if spec.header:
        heads = sentences.select(*scope).distinct().withColumn(index, F.lit(-1).cast("bigint"))
        rows = rows.unionByName(heads, allowMissingColumns=True)
    if inside:
        rows = offset_in_ranges(rows, scope, number_scope or scope, index, F.col("_n"), "first_no").withColumn(
            "first_no", F.col("first_no") + spec.number_base)
    else:
        rows = rows.repartitionByRange(*scope, index)
    # lines are made after the exchange, so that sampling does not make them as well
    rows = rows.sortWithinPartitions(*scope, index).withColumns({c: unpack_words(F.col(c)) for c in arrays})
    value = _value(spec)
    if spec.header:
        value = F.when(F.col(index) == -1, F.lit(spec.header)).otherwise(value)
    rows.select(*scope, value.alias("value")).write.partitionBy(*scope).text(path, compression=compression)


def group_sentences(rows: DataFrame, groups: str = "groups") -> DataFrame:
    """Labelled words of unsegmented predictions as sentence rows.

    ``groups`` holds ``struct<word, label>`` in text order, labels ``LABEL_k``. A sentence ends
    after a word that ends in a period. Adds ``sentence_id, tokens, tags`` to the other columns; a
    row without words has no sentence.
    """
    rest = [c for c in rows.columns if c != groups]
    cut = segment_after(F.col(groups), lambda g: g["word"].endswith("."))
    return (rows.select(*rest, F.posexplode(cut).alias("sentence_id", "_g"))
            .select(*rest, F.col("sentence_id").cast("bigint").alias("sentence_id"), F.col("_g.word").alias("tokens"),
                    F.transform("_g.label", rename_label).alias("tags")))


def groups_to_conll(rows: DataFrame, by: Sequence[str], groups: str = "groups") -> DataFrame:
    """Rows ``by, sentence_id, value``: unsegmented predictions as four-column text."""
    return to_conll(group_sentences(rows.select(*by, groups), groups), "legacy4", by)


def write_token_csv(sentences: DataFrame, path: str, scope: Sequence[str] = ("split",),
                    index: str = "sentence_id") -> None:
    """Quoted ``ID, Word, Lemma, Morphology, Annotation`` rows with header, numbered from 1."""
    write_conll(sentences, path, "poner_csv", scope, index)


def convert_cnec_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Four-column lines to numbered lines with named types; ``file, line_no, line``.

    Every line takes a number, blank lines stay as they are; a line with fewer than
    four fields only gets its number in front.
    """
    parts = F.split("line", "\t")
    number = (F.col("line_no") + 1).cast("string")
    full = F.concat_ws("\t", number, F.slice(parts, 1, 3),
                       map_types(F.get(parts, F.lit(3))))
    short = F.concat_ws("\t", number, parts)
    line = (F.when(is_blank(F.col("line")), "")
            .when(F.size(parts) >= 4, full).otherwise(short))
    return (number_file_lines(lines, files).join(file_names(files), "file_key")
            .select("file", "line_no", line.alias("line")))


def write_cnec_lines(lines: DataFrame, files: DataFrame, path: str) -> None:
    """Write the converted lines as text, a folder ``file_name=...`` per file, in line order."""
    converted = convert_cnec_lines(lines, files)
    (converted.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
     .select(F.col("file").alias("file_name"), F.col("line").alias("value"))
     .write.partitionBy("file_name").text(path))


def read_annotations(docs: DataFrame, doc: str = "member", text: str = "text") -> DataFrame:
    """Dictionary entries ``doc, surface, type`` of annotation files given as text.

    Lines have four fields at least, surface first and type third; of a repeated
    surface the last line counts.
    """
    lines = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n"))
                        .alias("line_no", "_line"))
    fields = lines.withColumn("_f", F.split(F.btrim("_line", F.lit(" \t\r\n")), "\t"))
    return (fields.where(F.size("_f") >= 4)
            .groupBy("doc", F.get("_f", F.lit(0)).alias("surface"))
            .agg(F.max_by(F.get("_f", F.lit(2)), "line_no").alias("type")))


def file_base(suffix: str) -> Column:
    """Name of a ``file`` without its suffix; null for other files."""
    return F.when(F.col("file").endswith(suffix),
                  F.left("file", F.length("file") - len(suffix)))


def read_parallel_text(spark: SparkSession, sentences: str, tags: str,
                       sentence_base: Column | None = None,
                       tag_base: Column | None = None) -> DataFrame:
    """Sentence and tag files of one base, paired line by line and token by token.

    The parts of a base, if it has several, follow one another in name order.
    """

    def side(path: str, base: Column) -> DataFrame:
        files = list_files(spark, path).withColumn("file", base).where(F.col("file").isNotNull())
        names = file_names(files).select("file_key", F.col("file").alias("base"))
        return number_file_lines(read_lines(spark, path), files).join(names, "file_key")

    left = file_base(".sentences.txt") if sentence_base is None else sentence_base
    right = file_base(".ner_tags.txt") if tag_base is None else tag_base
    return positional_zip(side(sentences, left), side(tags, right))
