"""Rewritten questions whose values coincide or repeat, in the pipeline's stage."""

from pyspark.sql import functions as F
from test_llm_edges import DOCS, prose

from labelkit.llm.decontaminate import drop_leaks, find_leaks, template_tokens

ITEM = "A shop packs {} boxes and sends {} crates with {} bags on {} carts to {} towns for {} buyers"
VALUES = {  # the item's, the document's
    1: ((3, 5, 6, 7, 8, 9), (4, 4, 6, 7, 8, 9)),  # coinciding in the document
    2: ((2, 2, 6, 7, 8, 9), (3, 5, 6, 7, 8, 9)),  # one item value in independent roles
}


def test_stage_finds_coinciding_and_repeated_values(spark):
    docs = spark.createDataFrame([(k, "so. " + ITEM.format(*d) + ". end", "en", "s", 0) for k, (_, d) in VALUES.items()]
                                 + [(9, prose(1, 50), "en", "s", 0)], DOCS)
    for k, (i, _) in VALUES.items():
        bench = spark.createDataFrame([(1, ITEM.format(*i))], "item_id bigint, text string")
        found = find_leaks(docs.where(f"doc_id = {k}"), bench, one_to_one=False).collect()
        assert [(r["share"], r["rewritten"]) for r in found] == [(1.0, True)]
        assert find_leaks(docs.where(f"doc_id = {k}"), bench).count() == 0
        assert {r["doc_id"] for r in drop_leaks(docs.where(f"doc_id in ({k}, 9)"), bench).collect()} == {9}


def test_an_outvoted_value_costs_its_own_windows(spark):
    item = "Mary buys 3 red apples and sells 3 green apples then eats 3 ripe plums and gives away 3 sweet pears today"
    text = "Mary buys 4 red apples and sells 4 green apples then eats 4 ripe plums and gives away 5 sweet pears today"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got, = find_leaks(docs, bench, one_to_one=False).collect()
    assert got["matched"] == got["n_windows"] - 4 and got["rewritten"]


def test_long_runs_of_names_and_of_groups_of_digits_are_one_token(spark):
    names, digits = " ".join(["Ab"] * 200_000), ",".join(["1"] * 200_000)
    rows = spark.createDataFrame([(f"so {names} {digits} end",)], "text string").select(template_tokens(F.col("text")).alias("t"))
    assert rows.collect()[0]["t"] == ["so", f"\x02{names.lower()}\x03", digits, "end"]
