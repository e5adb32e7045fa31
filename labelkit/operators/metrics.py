"""Entity-level precision, recall and F1, and token accuracy.

Predicted and gold tags of a sentence stand in one row, so entities are found and
matched where they are, in whole Arrow batches, and only per-type counts are shuffled. Counts of separate
runs can be added up before they are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ["tp", "n_pred", "n_gold", "n_correct", "n_tokens"]


class _Tags:
    """The tag arrays of a batch, flat; ``types`` and ``names`` are numbered alike for all sides."""

    def __init__(self, tags: pa.Array, types: dict[str, int], names: dict[str | None, int]) -> None:
        self.sizes = pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        coded = pc.dictionary_encode(tags.flatten(), null_encoding="encode")
        known, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        self.name = np.array([names.setdefault(t, len(names)) for t in known], np.int64)[codes]
        kinds = [-1 if t is None or t == "O" else types.setdefault(t[2:] if t[1:2] == "-" else t, len(types)) for t in known]
        kind = np.array(kinds, np.int64)[codes]
        begins = np.array([t is not None and t.startswith("B-") for t in known], bool)[codes]
        cut = np.ones(len(kind) + 1, bool)  # between a tag and the one before it
        cut[1:-1] = (self.row[1:] != self.row[:-1]) | begins[1:] | (kind[1:] != kind[:-1])
        first, last = (np.nonzero(c & (kind >= 0))[0] for c in (cut[:-1], cut[1:]))
        self.of, self.kind = self.row[first], kind[first]
        self.first, self.last = first - self.starts[self.of], last - self.starts[self.of]

    def found_in(self, other: _Tags) -> np.ndarray:
        """True for entities that the other side has too."""
        width = max(self.sizes.max(initial=0), other.sizes.max(initial=0)) + 1
        mine, theirs = (t.of * width + t.first for t in (self, other))
        if not len(theirs):
            return np.zeros(len(mine), bool)
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        return (theirs[at] == mine) & (other.last[at] == self.last) & (other.kind[at] == self.kind)


def _lists(counts: np.ndarray, missing: pa.Array | None, **columns: pa.Array) -> pa.Array:
    values = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values, mask=missing)


def _matches(result: str) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Entities of one side that the other has, or has not, row by row of a batch."""

    def work(pred: pa.Array, gold: pa.Array) -> pa.Array:
        types, names = {}, {}
        p, g = _Tags(pred, types, names), _Tags(gold, types, names)
        side, other = (g, p) if result == "false_negative" else (p, g)
        kept = side.found_in(other) == (result == "matched")
        return _lists(np.bincount(side.of[kept], minlength=len(side.sizes)), None,
                      type=pa.array(list(types), pa.string()).take(pa.array(side.kind[kept])),
                      first=pa.array(side.first[kept], pa.int32()), last=pa.array(side.last[kept], pa.int32()))

    return work


def _counted(pred: pa.Array, gold: pa.Array) -> pa.Array:
    """Counts of each row of a batch, one for each of its types and one of its tokens."""
    types, names = {}, {}
    p, g = _Tags(pred, types, names), _Tags(gold, types, names)
    rows, kinds = len(p.sizes), len(types) + 1  # the last is that of tokens
    places = [t.of * kinds + t.kind for t in (p, p, g)]
    places[0] = places[0][p.found_in(g)]
    tokens = np.arange(rows) * kinds + kinds - 1
    used, at = np.unique(np.concatenate([*places, tokens]), return_inverse=True)
    sums = [np.bincount(x, minlength=len(used)) for x in np.split(at, np.cumsum([len(x) for x in places]))[:3]]
    both = np.minimum(p.sizes, g.sizes)
    row = np.repeat(np.arange(rows), both)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    correct = np.bincount(row[p.name[p.starts[row] + pos] == g.name[g.starts[row] + pos]], minlength=rows)
    for t in (p, g):  # beyond the shorter side, no tag equals a null one
        beyond = np.arange(len(t.row)) - t.starts[t.row] >= both[t.row]
        correct += np.bincount(t.row[beyond & (t.name == names.get(None, -1))], minlength=rows)
    is_tokens = used % kinds == kinds - 1
    of_row = [np.where(is_tokens, x[used // kinds], 0) for x in (correct, g.sizes)]
    return _lists(np.bincount(used // kinds, minlength=rows), pc.or_(pred.is_null(), gold.is_null()),
                  type=pa.array([*types, None], pa.string()).take(pa.array(used % kinds)),
                  **{name: pa.array(x, pa.int32()) for name, x in zip(COUNTS, [*sums, *of_row], strict=True)})


def match_tagged(sentences: DataFrame, keys: Sequence[str], result: str = "matched",
                 pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Rows ``keys, type, first, last`` as ``match_entities`` gives them, where both tag arrays
    stand in one row: no join, no shuffle. A null array has no entities.

    ``result`` is ``matched``, ``false_positive`` or ``false_negative``.
    """
    if result not in ("matched", "false_positive", "false_negative"):
        raise ValueError(f"unknown result {result!r}")
    found = F.arrow_udf(_matches(result), "array<struct<type: string, first: int, last: int>>")
    return sentences.select(*keys, F.inline(found(F.col(pred), F.col(gold))))


def metric_counts(sentences: DataFrame, by: Sequence[str], pred: str = "pred",
                  gold: str = "gold") -> DataFrame:
    """Counts per ``by`` and entity type; the row without a type counts tokens."""
    counted = F.arrow_udf(_counted, f"array<struct<type: string, {', '.join(f'{c}: int' for c in COUNTS)}>>")
    return (sentences.select(*by, F.inline(counted(F.col(pred), F.col(gold))))
            .groupBy(*by, "type").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def accumulate_metric(*counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of several batches or runs added up."""
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    return total.groupBy(*by, "type").agg(*[F.sum(c).alias(c) for c in COUNTS])


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """Counts of all runs written so far; none before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def add_to_ledger(counts: DataFrame, path: str, keys: Sequence[str] = ("run", "model", "dataset")) -> DataFrame:
    """Append the counts of runs that the ledger has not got; the whole ledger.

    A run is known by ``keys``, null being a value like others. Adding one again changes nothing,
    so a job that was ended between two additions is simply run anew; an append that
    fails leaves no rows. Runs are added one writer at a time.
    """
    spark, keys = counts.sparkSession, list(keys)
    known = read_ledger(spark, path)
    new = counts.select(*keys, "type", *COUNTS)
    if known is not None:
        seen = known.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        new = new.join(seen, same, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _rates(df: DataFrame) -> DataFrame:
    def share(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, 0.0).otherwise(F.try_divide(part, whole))

    return (df.withColumn("precision", share(F.col("tp"), F.col("n_pred")))
            .withColumn("recall", share(F.col("tp"), F.col("n_gold")))
            .withColumn("f1", share(2 * F.col("tp"), F.col("n_pred") + F.col("n_gold"))))


def entity_prf_by_type(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each entity type."""
    return _rates(counts.where(F.col("type").isNotNull())
                  .select(*by, "type", "tp", "n_pred", "n_gold"))


def entity_prf_overall(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same over all types together, with token accuracy."""
    totals = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    accuracy = F.when(F.col("n_tokens") == 0, 0.0).otherwise(
        F.try_divide("n_correct", "n_tokens"))
    return _rates(totals).withColumn("accuracy", accuracy)


def evaluate_models(sentences: DataFrame, by: Sequence[str] = ("model", "dataset"),
                    pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Every model on every dataset in one job: rows per type, and ``overall`` ones."""
    counts = metric_counts(sentences, by, pred, gold)
    # every small count row goes to its own type and to the overall row
    kinds = F.explode(F.array_compact(F.array("type", F.lit("overall"))))
    totals = (counts.select(*by, kinds.alias("type"), *COUNTS)
              .groupBy(*by, "type").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    accuracy = F.when(F.col("type") == "overall", F.when(F.col("n_tokens") == 0, 0.0).otherwise(
        F.try_divide("n_correct", "n_tokens")))
    return _rates(totals).withColumn("accuracy", accuracy).select(
        *by, "type", "tp", "n_pred", "n_gold", "precision", "recall", "f1", "accuracy")
