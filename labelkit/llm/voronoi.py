"""Exact top-k search by inner product: a kNN join over Voronoi cells.

Queries and data are grouped by pivots. A summary of each cell (its radius and the few
members next to its pivot) gives every query a score that its k-th best row reaches at
least; from it follows, for each group of queries and each cell, how far from the pivot
a row must lie to matter. Only such rows are sent to a group, in slices, so that a task
holds one bounded group of queries and one bounded slice of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkit.folders import saved

_EXACT = float(1 << 52)  # sums of integers below this are exact in doubles
_LONG = (1 << 63) - 1
_TILE = 256  # queries scored at once


def whole_parts(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component, as doubles that hold integers."""
    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _prepared(rows: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), whole_parts(F.col(vector), scale).alias("v")).where(
        v.isNotNull() & ~odd)


def _padded(rows: DataFrame, dim: int) -> DataFrame:
    """Vectors of one length, and a hash of them."""
    full = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
    return rows.select("id", full.alias("v")).withColumn("h", F.xxhash64("v"))


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors with their ``most`` smallest ids; a vector of very many rows is cut
    down in every task before it is sent."""
    order = Window.partitionBy("h", "v").orderBy(F.asc_nulls_last("id"))
    held = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return held.groupBy("h", "v").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("ids"))


def _dealt(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, scale: float) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot and the distance to it, in units of ``scale``."""
    squares = (pivots ** 2).sum(1)
    for batch in batches:
        x = _matrix(batch.column("v")) / scale
        cell, far = np.empty(len(x), np.int32), np.empty(len(x))
        for a in range(0, len(x), 1024):
            part = x[a:a + 1024]
            cell[a:a + 1024] = (squares - 2 * part @ pivots.T).argmin(1)
            far[a:a + 1024] = np.linalg.norm(part - pivots[cell[a:a + 1024]], axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)],
                                         [*batch.schema.names, "cell", "far"])


def _query_groups(counts: dict[int, int], pivots: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """``cell, first group, number of groups`` for the cells that hold queries: neighbouring
    cells share a group of about ``size`` queries, a larger cell is split."""
    left, chain = sorted(counts), []
    at = left[0] if left else None
    while left:
        left.remove(at)
        chain.append(at)
        if left:
            at = left[int(((pivots[left] - pivots[at]) ** 2).sum(1).argmin())]
    out, group, held = [], 0, 0
    for cell in chain:
        n = counts[cell]
        if held and held + n > size:
            group, held = group + 1, 0
        split = -(-n // size)
        out.append((cell, group, split))
        held += n
        if split > 1:
            group, held = group + split, 0
    return out


def _reaches(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: np.ndarray, members: np.ndarray,
             scale: float, most: int) -> Iterator[pa.RecordBatch]:
    """``grp, cell, reach``: rows of a cell nearer to its pivot than ``reach`` can't be among
    the best ``most`` of any query of the group."""
    longest = np.sqrt((pivots ** 2).sum(1).max()) + radius.max()
    for batch in batches:
        groups = batch.column("grp").to_numpy(zero_copy_only=False)
        x = _matrix(batch.column("v")) / scale
        for g in np.unique(groups):
            best = np.full(len(pivots), np.inf)
            mine = x[groups == g]
            for a in range(0, len(mine), _TILE):
                q = mine[a:a + _TILE]
                norm = np.linalg.norm(q, axis=1)[:, None]
                if len(members) >= most:
                    floor = np.partition(q @ members.T, -most, axis=1)[:, [-most]] - 1e-9 * norm * longest
                else:
                    floor = np.full((len(q), 1), -np.inf)
                gap = floor - q @ pivots.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(norm > 0, gap / norm, -np.inf)
                best = np.minimum(best, reach.min(0))
            cells = np.nonzero(best <= radius)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), g, np.int32)), pa.array(cells.astype(np.int32)), pa.array(best[cells])],
                ["grp", "cell", "reach"])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the range of a long, its ends."""
    bound = np.linalg.norm(q, axis=1).max() * np.linalg.norm(x, axis=1).max()
    if bound < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q).dot(whole(x).T), -_LONG - 1, _LONG).astype(np.int64)


def _solve(queries: pa.Table, data: pa.Table, most: int) -> pa.Table:
    """The ``most`` best rows of one slice for each query of one group."""
    out: tuple[list, ...] = ([], [], [], [])
    if queries.num_rows and data.num_rows:
        ids = data.column("ids").to_pylist()
        first = np.array([i[0] is None for i in ids]), np.array([i[0] or 0 for i in ids], np.int64)
        order = np.lexsort(first[::-1])  # by smallest id, null last
        x, hashes = _matrix(data.column("v"))[order], data.column("h").to_numpy()[order]
        q, qids, qh = _matrix(queries.column("v")), queries.column("qid").to_numpy(), queries.column("h").to_numpy()
        for a in range(0, len(q), _TILE):
            for k, row in enumerate(_scores(q[a:a + _TILE], x), a):
                if len(row) > most:
                    limit = np.partition(row, -most)[-most]
                    above = np.nonzero(row > limit)[0]
                    found = np.concatenate([above, np.nonzero(row == limit)[0][:most - len(above)]])
                else:
                    found = np.arange(len(row))
                for j in found:
                    same = bool(hashes[j] == qh[k] and (x[j] == q[k]).all())
                    for i in ids[order[j]]:
                        for column, value in zip(out, (qids[k], row[j], i, same), strict=True):
                            column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)],
                    ["qid", "score", "id", "same"])


def top_inner_products(queries: DataFrame, data: DataFrame, k: int = 5, id_col: str = "vec_id",
                       vector: str = "embedding", scale: float = 256.0, most_pivots: int = 4096,
                       pivot_budget: int = 4_000_000, group_size: int = 4096, least_groups: int = 8,
                       slice_rows: int = 16_384) -> DataFrame:
    """``query_id, rank, id, score``: for every row of ``queries`` its ``k`` best rows of ``data``
    by the inner product of the components' ``floor(scale * x)``, ties to the smaller id.

    A query's own row, the one of the same id and vector, is no candidate; ``data`` holding it
    several times has the repeats as candidates. Repeated queries are answered each. Vectors
    that are null, or hold a component that is null or not finite (before or after scaling),
    take no part; shorter vectors count as filled up with zeros. Null ids are kept and come
    last among ties. Scores beyond the range of a long are reported as its ends and tie
    there. Columns other than the two named are ignored. Empty tables give no rows; less
    than ``k`` candidates give fewer rows.

    The result does not depend on the parameters from ``most_pivots`` on. Pivots are the
    distinct vectors of smallest hash, the root of their number up to ``most_pivots`` and to
    ``pivot_budget`` components, summaries included: all that the driver and every task hold.
    """
    spark, most = data.sparkSession, k + 1
    rows, asked = (_prepared(d, id_col, vector, scale) for d in (data, queries))
    out = "query_id bigint, rank int, id bigint, score bigint"
    sizes = [r.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
             for r in (rows, asked)]
    if any(s.dim is None for s in sizes):
        return spark.createDataFrame([], out)
    dim, unit = max(1, *(s.dim for s in sizes)), max(s.top or 0.0 for s in sizes) or 1.0
    vectors = saved(_distinct(_padded(rows, dim), most), "vectors")
    asked = saved(_padded(asked, dim), "queries")
    n = vectors.count()
    sought = saved(asked.select("h", "v").distinct().withColumn("qid", F.monotonically_increasing_id()), "sought")

    m = max(1, min(most_pivots, int(n ** 0.5), pivot_budget // (dim * (most + 1))))
    pivots = np.array([r.v for r in vectors.orderBy("h", "v").limit(m).select("v").collect()]).reshape(-1, dim) / unit
    shared = spark.sparkContext.broadcast(pivots)

    def dealt(df: DataFrame, schema: str) -> DataFrame:
        return df.mapInArrow(lambda b: _dealt(b, shared.value, unit), f"{schema}, cell int, far double")

    cells = saved(dealt(vectors.select("h", "v", "ids"), "h bigint, v array<double>, ids array<bigint>"), "cells")
    near = Window.partitionBy("cell").orderBy("far", "h")
    inner = np.array([r.v for r in cells.withColumn("place", F.row_number().over(near)).where(F.col("place") <= most)
                      .select("v").toLocalIterator()]).reshape(-1, dim) / unit
    radius = np.full(len(pivots), -np.inf)
    for r in cells.groupBy("cell").agg(F.max("far").alias("far")).collect():
        radius[r.cell] = r.far
    placed = saved(dealt(sought, "h bigint, v array<double>, qid bigint"), "placed")
    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    size = max(1, min(group_size, -(-sum(counts.values()) // least_groups)))
    groups = spark.createDataFrame(_query_groups(counts, pivots, size), "cell int, first int, parts int")
    grouped = saved(placed.join(F.broadcast(groups), "cell").select(  # at most most_pivots rows
        "qid", "h", "v", (F.col("first") + F.pmod("h", "parts")).cast("int").alias("grp")), "grouped")

    summary = spark.sparkContext.broadcast((radius, inner))
    needs = saved(grouped.select("grp", "v").mapInArrow(
        lambda b: _reaches(b, shared.value, *summary.value, unit, most), "grp int, cell int, reach double")
        .groupBy("grp", "cell").agg(F.min("reach").alias("reach")), "needs")
    slices = max(1, -(-n // slice_rows))
    sent = (cells.join(needs, "cell").where("far >= reach - 1e-9")
            .select("grp", F.pmod("h", F.lit(slices)).cast("int").alias("slice"), "h", "v", "ids"))
    to = grouped.select("grp", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "qid", "h", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        return _solve(left, right, most)

    found = to.groupBy("grp", "slice").cogroup(sent.groupBy("grp", "slice")).applyInArrow(
        solve, "qid bigint, score bigint, id bigint, same boolean")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = (found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "same"))).alias("best")))
    answers = saved(best.join(sought, "qid").select("h", "v", "best"), "answers")
    own = F.array_position(F.transform("best", lambda e: e["id"].eqNullSafe(F.col("own")) & e["same"]), True)
    return (asked.withColumnRenamed("id", "own").join(answers, ["h", "v"])
            .withColumn("at", own)
            .select("own", F.posexplode(F.slice(F.filter("best", lambda e, i: i + 1 != F.col("at")), 1, k)))
            .select(F.col("own").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("id"),
                    F.col("col.score").alias("score")))
