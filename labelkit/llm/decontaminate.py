"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question asked again with other
values keeps its template. Windows of the template are hashed and joined with those of the
benchmark; along each alignment of a document with an item the values in the slots must
map one to one, or windows with slots do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.llm.common import let
from labelkit.folders import saved

UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "l", "ml", "s", "ms", "h", "min", "hours?", "minutes?", "seconds?",
         "days?", "weeks?", "months?", "years?", "miles?", "feet", "foot", "inch(?:es)?", "pounds?", "ounces?",
         "liters?", "litres?", "meters?", "metres?", "grams?", "kilograms?", "kilometers?", "kilometres?",
         "dollars?", "euros?", "cents?", "percent", "degrees?", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb",
         "w", "kw", "kwh", "v", "mph", "kmh")

# marks that the regular expressions below put round slots; no text holds them afterwards
_NAME, _NAME_END, _UNIT = "\x02", "\x03", "\x04"
# capitalised words inside a sentence, as one name
NAME_RUN = r"([\p{Ll}\p{Nd},;)] )(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"
UNIT_AFTER = rf"([0-9]) ?((?i:{'|'.join(UNITS)}))([^\p{{L}}]|$)"
TOKEN = r"\x02[^\x03]*\x03|\x04?[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[%€$£]"
# Java matches a repeated group by recursion, a possessive one in a loop; nothing follows these groups, so both match alike
_NAME_RUN, _TOKEN = NAME_RUN.replace(")*", ")*+"), TOKEN.replace(")*", ")*+")


def template_tokens(text: Column) -> Column:
    """Tokens of a text, slots still with their values: lower case, but for the case marks of
    names ``\\x02...\\x03``; units begin with ``\\x04``, numbers with a digit."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x02\x03\x04]", " ")
    marked = F.regexp_replace(F.regexp_replace(clean, _NAME_RUN, f"$1{_NAME}$2{_NAME_END}"),
                              UNIT_AFTER, f"$1 {_UNIT}$2$3")
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))


def _is_slot(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    return (first <= _UNIT) | first.between("0", "9") | first.isin("%", "€", "$", "£")


def _placeholder(token: Column, names: bool) -> Column:
    first = F.substring(token, 1, 1)
    name = F.lit(_NAME) if names else F.regexp_replace(token, f"[{_NAME}{_NAME_END}]", "")
    return (F.when(first.between("a", "z"), token).when(first.between("0", "9"), "0").when(first == _NAME, name)
            .when(first == _UNIT, _UNIT).when(first.isin("%", "$", "€", "£"), _UNIT).otherwise(token))


def template_windows(text: Column, width: int = 5, count_words: bool = False) -> Column:
    """Array of ``place, hash, slots`` for each window of ``width`` tokens; ``slots`` joins
    the window's slot values, and with ``count_words`` there are ``words``, the number of others,
    and ``at``, the places of the slots.

    A text with names gives windows with names as slots and, besides, as words: a copy in
    lower case then still shares the latter.
    """

    fields = "place:int,hash:bigint,slots:string" + (",words:int,at:array<int>" if count_words else "")

    def windows(tokens: Column, names: bool) -> Column:
        kinds = F.transform(tokens, lambda t: _placeholder(t, names))
        values = F.transform(tokens, lambda t: F.when(
            _is_slot(t) if names else _is_slot(t) & (F.substring(t, 1, 1) != _NAME), t))
        return let(F.struct(kinds.alias("k"), values.alias("v")), lambda a: F.transform(
            F.sequence(F.lit(0), F.size(a["k"]) - width), lambda i: F.struct(
                i.alias("place"), F.xxhash64(*[a["k"][i + j] for j in range(width)]).alias("hash"),
                F.concat_ws("\n", *[a["v"][i + j] for j in range(width)]).alias("slots"),
                *([F.size(F.filter(F.slice(tokens, i + 1, width), lambda t: ~_is_slot(t))).alias("words"),
                   F.filter(F.sequence(i, i + width - 1), lambda j: a["v"][j].isNotNull()).alias("at")]
                  if count_words else []))))

    def both(tokens: Column) -> Column:
        named = F.exists(tokens, lambda t: F.substring(t, 1, 1) == _NAME)
        return F.when(F.size(tokens) < width, F.array().cast(
            f"array<struct<{fields}>>")).when(
            named, F.concat(windows(tokens, True), windows(tokens, False))).otherwise(windows(tokens, True))

    return let(template_tokens(text), both)


def benchmark_windows(benchmark: DataFrame, width: int = 5, least_literal: int = 3,
                      item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, n_windows, hash, item_place, item_slots, item_at``: windows of all items with at least
    ``least_literal`` words outside slots, saved, so that the planner knows their size. Items
    of fewer than ``width`` tokens have none."""
    literal = F.filter(template_windows(F.col(text), width, True), lambda w: w["words"] >= least_literal)
    rows = benchmark.select(F.col(item_id).alias("item_id"), literal.alias("w"))
    rows = rows.withColumn("n_windows", F.size(F.array_distinct(F.transform("w", lambda x: x["place"]))))
    return saved(rows.select("item_id", "n_windows", F.inline("w")).select(
        "item_id", "n_windows", "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), F.col("at").alias("item_at")),
        "benchmark")


def _usual(slots: Column) -> Column:
    """Of slots ``at, i, d``: the pairs ``i, d`` that no other value ``d`` of the same ``i`` outnumbers."""

    def often(pairs: Column) -> Column:
        return F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"), F.size(
            F.filter(slots, lambda s: (s["i"] == p["i"]) & (s["d"] == p["d"]))).alias("n")))

    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(s["i"].alias("i"), s["d"].alias("d"))))
    return let(often(pairs), lambda all_: F.transform(
        F.filter(all_, lambda p: ~F.exists(all_, lambda q: (q["i"] == p["i"]) & (q["n"] > p["n"]))),
        lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, width: int = 5,
               one_to_one: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows, matched, share, rewritten``: documents that hold an item.

    A pair is listed if ``least_share`` of the item's template windows stand within some stretch
    of the document that is twice as long as the item, along alignments whose slot values
    map one to one; ``matched`` counts the best stretch. Without ``one_to_one`` an alignment
    loses only windows with a slot whose value most slots of the same item value outvote, and
    several item values may have one value in the document. ``rewritten``: some slot in it has
    another value than the item's.

    Null and short texts hold nothing; items with equal windows are all listed; rows that
    share an id (null ids too) are judged together; other columns are ignored; an
    empty table on either side gives no rows. Documents are read whole. Their windows stay
    in the scanning task while the benchmark is small enough to be sent round, which the
    planner sees from the saved table; beyond that both sides are joined by hash.
    """
    items = benchmark_windows(benchmark, width)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.inline(template_windows(F.col(text), width)))
    hits = rows.join(items, "hash")
    # per alignment: windows without slots, windows with slots, and the pairs of values
    zipped = [F.split("item_slots", "\n").alias("i"), F.split("slots", "\n").alias("d")]
    pairs = F.filter(F.arrays_zip(*([] if one_to_one else [F.col("item_at").alias("at")]), *zipped),
                     lambda p: p["i"] != "")
    # stretches of twice the item's length, one at every length of it
    length = F.col("n_windows") + width - 1
    stretch = F.floor(F.col("place") / length)
    aligned = hits.select("doc_id", "item_id", "n_windows", "item_place", (F.col("place") - F.col("item_place")).alias("shift"),
                          pairs.alias("pairs"), F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    placed = (aligned.groupBy("doc_id", "item_id", "stretch", "shift").agg(
        F.max("n_windows").alias("n_windows"),
        F.collect_set(F.when(F.size("pairs") == 0, F.col("item_place"))).alias("plain"),
        F.collect_set(F.when(F.size("pairs") > 0, F.col("item_place"))).alias("slotted"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")))
    fits = ((F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs"))
            & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["d"]))) == F.size("pairs")))
    counted = (placed.withColumn("places", F.when(fits, F.array_union("plain", "slotted")).otherwise(F.col("plain")))
               .withColumn("changed", fits & F.exists("pairs", lambda p: p["i"] != p["d"])))
    if not one_to_one:
        counted = _by_slot(aligned)
    found = (counted
             .select("doc_id", "item_id", "stretch", "n_windows", "changed", F.explode("places").alias("place"))
             .groupBy("doc_id", "item_id", "stretch").agg(F.max("n_windows").cast("bigint").alias("n_windows"),
                                                          F.count_distinct("place").alias("matched"),
                                                          F.max("changed").alias("changed"))
             .groupBy("doc_id", "item_id", "n_windows").agg(F.max(F.struct("matched", "changed")).alias("best"))
             .select("doc_id", "item_id", "n_windows", "best.matched", F.col("best.changed").alias("rewritten")))
    return (found.withColumn("share", F.col("matched") / F.col("n_windows")).where(F.col("share") >= least_share)
            .select("doc_id", "item_id", "n_windows", "matched", "share", "rewritten"))


def _by_slot(aligned: DataFrame) -> DataFrame:
    """Per alignment the places of windows whose slots are all usual there; ``changed``: one has another value."""
    placed = (aligned.groupBy("doc_id", "item_id", "stretch", "shift").agg(
        F.max("n_windows").alias("n_windows"),
        F.collect_set(F.struct(F.col("item_place").alias("place"), "pairs")).alias("windows"))
        .withColumn("usual", _usual(F.array_distinct(F.flatten(F.col("windows.pairs")))))
        .withColumn("windows", F.filter("windows", lambda w: F.forall(w["pairs"], lambda p: F.array_contains(
            F.col("usual"), F.struct(p["i"].alias("i"), p["d"].alias("d")))))))
    return placed.withColumns({"places": F.array_distinct(F.col("windows.place")), "changed": F.exists(
        F.flatten(F.col("windows.pairs")), lambda p: p["i"] != p["d"])})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Documents that hold no item of the benchmark; slots are judged one by one."""
    leaks = saved(find_leaks(docs, benchmark, doc_id=doc_id, **{"one_to_one": False, **options}).select(
        F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, docs[doc_id].eqNullSafe(leaks["_leak"]), "left_anti")
