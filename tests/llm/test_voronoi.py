"""Exact top-k search against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from labelkit.llm.voronoi import _reaches, top_inner_products

SCHEMA = "vec_id bigint, embedding array<float>, id string, h int, rank int"


def brute(queries, data, k=5):
    """Per query row: the best rows of ``data`` but one that is the query itself."""
    def whole(v):
        if v is None or any(x is None or not math.isfinite(float(np.float32(x))) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    rows = [(i, w) for i, v, *_ in data if (w := whole(v)) is not None]
    out = []
    for i, v, *_ in queries:
        if (q := whole(v)) is None:
            continue
        left = list(rows)
        if (i, q) in left:
            left.remove((i, q))
        scored = sorted((-max(-2 ** 63, min(sum(a * b for a, b in zip(q, w, strict=False)), 2 ** 63 - 1)), j is None, j or 0)
                        for j, w in left)
        out += [(i, r, None if no else j, -s) for r, (s, no, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def ours(spark, queries, data, **options):
    found = top_inner_products(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(data, SCHEMA), **options)
    return sorted([tuple(r) for r in found.select("query_id", "rank", "id", "score").collect()], key=repr)


def row(i, v):
    return (i, v, "x", 7, 9)  # columns whose names the operator uses itself


@pytest.mark.parametrize("options", [{}, {"slice_rows": 7, "group_size": 2, "most_pivots": 4}, {"pivot_budget": 1}])
def test_against_brute_force(spark, options):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    data = [row(i, [c + rng.gauss(0, 0.05) for c in centres[i % 5]]) for i in range(200)]
    data += [row(300 + i, data[3][1]) for i in range(40)]  # one vector very often
    data += [row(500 + i, [float(i % 3), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(12)]  # ties
    queries = data[::10] + [row(3, data[3][1]), row(900, [0.0] * 6)]
    assert ours(spark, queries, data, **options) == brute(queries, data)


def test_odd_rows(spark):
    data = [row(1, [0.5, 0.5]), row(1, [0.5, 0.5]), row(2, None), row(3, [1.0, None]), row(4, [float("nan"), 1.0]),
            row(5, [float("inf"), 1.0]), row(None, [0.5, 0.5]), row(6, [0.5]), row(7, []), row(8, [3e38, 3e38]),
            row(9, [-3e38, 1.0]), row(10, [0.5, 0.5])]
    assert ours(spark, data, data) == brute(data, data)


def test_few_or_none(spark):
    one = [row(1, [1.0, 2.0])]
    assert ours(spark, one, one) == [] == ours(spark, one, []) == ours(spark, [], one)
    assert ours(spark, one, [*one, row(2, [0.0, 1.0])]) == [(1, 1, 2, 2 * 256 * 256)]


def test_far_cells_are_not_sent():
    """Of tight clusters only those that can hold a best row are asked for."""
    pivots = np.eye(8) * 1.0
    members = np.repeat(pivots, 6, axis=0)
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([pivots[2].tolist()])], ["grp", "v"])
    found = pa.Table.from_batches(list(_reaches([batch], pivots, np.full(8, 0.1), members, 1.0, 6)))
    assert found.column("cell").to_pylist() == [2]
