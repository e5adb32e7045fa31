"""Mixing sources to target weights.

Tokens are counted per source, each source gets a target, and a document is emitted
floor(rate) times plus once more where a draw hashed from its id falls below the rate's
fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkit.llm.common import WORD, fresh
from labelkit.folders import saved


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cycled_weights(sources: DataFrame, weights: Sequence[float], source: str = "source") -> DataFrame:
    """Add ``weight``: the weights in turn over the sources by code point, null last."""
    order = Window.orderBy(F.col(source).asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    return sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))


def water_fill(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """Add ``target`` to rows ``size, weight``: shares of the sum of all sizes by weight.

    No target exceeds ``cap`` times its size; what is cut off goes to the others by
    weight. Sorted by size per weight, the sources that reach their cap come first, so
    one running sum finds the level at which all shares add up. One row per source, in
    one task: the table is as long as the list of weights a user sets up.
    """
    ratio = F.col("size") * cap / F.col("weight")
    by_ratio = Window.orderBy("_ratio", "_tie")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sources.withColumn("_ratio", ratio)
            .withColumn("_tie", F.xxhash64(*[c for c in sources.columns]))
            .withColumn("_place", F.row_number().over(by_ratio))
            .withColumn("_capped", F.coalesce(F.sum(F.col("size") * cap).over(before), F.lit(0.0)))
            .withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("_level", (F.sum("size").over(everything) - F.col("_capped"))
                        / (F.sum("weight").over(everything) - F.col("_used")))
            # the first source that its level leaves below the cap
            .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(
                F.col("_place"), F.col("_level").alias("level")))).over(everything)["level"])
            .withColumn("target", F.least(F.col("weight") * F.coalesce(F.col("_level"), F.lit(0.0)),
                                          F.col("size") * cap))
            .drop("_ratio", "_tie", "_place", "_capped", "_used", "_level"))


def seeded_uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone (52 bits of an md5)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def draw_limits(bins: DataFrame, targets: DataFrame, cap: float, steps: int) -> DataFrame:
    """Per source ``rate`` and ``below``: draws under ``below`` (of ``steps``) give the extra copy.

    Draws are even, so the limit lies near ``steps`` times the rate's fraction; it is set where
    the words of the documents under it come nearest to that fraction of the source's
    words. One window row per source and step.
    """
    rate = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("size"), F.lit(cap))).otherwise(0.0)
    rated = targets.withColumn("rate", rate)
    held = bins.select(F.col("source").alias("of"), "bin", "words")
    so_far = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    met = held.withColumn("so_far", F.sum("words").over(so_far)).join(
        rated, F.col("of").eqNullSafe(rated["source"]))
    wanted = (F.col("rate") - F.floor("rate")) * F.col("size")
    best = F.min(F.struct(F.abs(F.col("so_far") - wanted).alias("off"), (F.col("bin") + 1).alias("below")))
    nothing = F.struct(F.max(F.abs(wanted)).alias("off"), F.lit(0).cast("bigint").alias("below"))
    return (met.groupBy("source").agg(best.alias("best"), nothing.alias("nothing"), *[
        F.max(c).alias(c) for c in ("size", "target", "rate")])
        .withColumn("below", F.least("best", "nothing")["below"]).drop("best", "nothing"))


def mixing_copies(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), cap: float = 3.0,
                  seed: str = "mix", steps: int = 4096, doc_id: str = "doc_id", text: str = "text",
                  source: str = "source", prefix: str = "") -> DataFrame:
    """Every document with ``size, source_size, target, copies`` (names after ``prefix``).

    ``copies`` is 0 to ``cap``: the whole part of the source's rate, and one more where the
    document's draw, a hash of seed and id, falls below the rate's fraction. Sizes are
    uneven, and plain draws would leave a source of some hundred documents a tenth off its target;
    so the limit is moved, within one of ``steps`` steps, to where the drawn words add up.

    Rows that share an id share the draw; null ids are one id; a null source is a source of
    its own; null and empty texts have size 0. An empty table gives an empty table.
    Columns of these names are replaced.

    Sizes are added up where they are read, so a source that holds most rows sends a number
    per task and step. The limits are saved, and the planner, which then knows their true
    size, sends them round or splits a hot source in the join.
    """
    size, source_size, target, copies = (
        prefix + n for n in ("size", "source_size", "target", "copies"))
    _src, _size, _sum, _target, _rate, _below, _bin = fresh(
        docs, "src", "n", "sum", "target", "rate", "below", "bin")
    draw = F.floor(seeded_uniform(F.col(doc_id), seed) * steps)
    bins = saved(docs.select(F.col(source).alias("source"), draw.alias("bin"), text_size(F.col(text)).alias("words"))
                 .groupBy("source", "bin").agg(F.sum("words").alias("words")), "mix-draws")
    sources = bins.groupBy("source").agg(F.sum("words").alias("size"))
    targets = saved(water_fill(cycled_weights(sources, weights), cap), "mix-targets")
    limits = saved(draw_limits(bins, targets, cap, steps), "mix-limits").select(
        F.col("source").alias(_src), F.col("size").alias(_sum), F.col("target").alias(_target),
        F.col("rate").alias(_rate), F.col("below").alias(_below))
    sized = docs.withColumns({_size: text_size(F.col(text)), _bin: draw})
    joined = sized.join(limits, sized[source].eqNullSafe(limits[_src]), "left")
    extra = (F.col(_bin) < F.col(_below)).cast("bigint")
    return (joined.withColumns({size: F.col(_size), source_size: F.col(_sum), target: F.col(_target),
                                copies: F.floor(_rate) + extra})
            .drop(_src, _size, _sum, _target, _rate, _below, _bin))


def mix_sources(docs: DataFrame, copy: str = "copy", **options) -> DataFrame:
    """The mix itself: each document once per copy, ``copy`` counting from 1."""
    marked = mixing_copies(docs, prefix="_mix_", **options)
    return (marked.where("_mix_copies > 0")
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
            .drop("_mix_size", "_mix_source_size", "_mix_target", "_mix_copies"))
