"""Short forms learned from planted ones, sentences cut by them, and rows in a seeded order."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from labelkit.operators import (sentences_by_forms, short_forms, shuffle_rows, split_by_learned_forms,
                                word_period_counts)

PLANTED = {"de": ["usw", "bzw", "nr", "z.b"], "en": ["dr", "e.g", "approx", "vol"]}
DOCS = "doc_id long, lang string, text string"


@pytest.fixture(scope="module")
def planted(spark):
    """Sentences of 300 made-up words a language; any ends a sentence, short forms stand inside."""
    rng, rows = random.Random(5), []
    for lang, forms in PLANTED.items():
        words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(5, 9))) for _ in range(300)]
        for i in range(150):
            sentences = []
            for _ in range(12):
                s = rng.choices(words, k=rng.randint(5, 12))
                if rng.random() < 0.4:
                    form = rng.choice(forms)
                    after = s[2].title() if form in ("dr", "nr") else s[2]
                    s[1:3] = [f"{form.title() if form == 'dr' else form}.", after]
                sentences.append(" ".join([s[0].title(), *s[1:]]) + ".")
            rows.append((len(rows), lang, " ".join(sentences)))
    return spark.createDataFrame(rows, DOCS)


def test_planted_forms_are_found_alone(planted):
    found = short_forms(planted).where("is_short").collect()
    assert {lang: sorted(r["word"] for r in found if r["lang"] == lang) for lang in PLANTED} == {
        lang: sorted(forms) for lang, forms in PLANTED.items()}


def test_sentences_are_whole(planted):
    rows = split_by_learned_forms(planted, short_forms(planted)).collect()
    assert len(rows) == 300 and {len(r["sentences"]) for r in rows} == {12}
    assert all(" ".join(r["sentences"]) == r["text"] for r in rows)


def test_a_language_has_its_own_forms(spark, planted):
    docs = spark.createDataFrame([(1, "en", "See Vol. Three. Yes."), (2, "de", "See Vol. Three. Yes."), (3, "xx", "See Vol. Three. Yes."),
                                  (4, None, "A. Smith. Yes! No"), (5, "en", None), (6, "en", "")], DOCS)
    docs = docs.withColumn("word", F.lit(1)).withColumn("is_short", F.lit("kept"))
    rows = {r["doc_id"]: r for r in split_by_learned_forms(docs, short_forms(planted)).collect()}
    assert rows[1]["sentences"] == ["See Vol. Three.", "Yes."]
    assert rows[2]["sentences"] == rows[3]["sentences"] == ["See Vol.", "Three.", "Yes."]
    assert rows[4]["sentences"] == ["A. Smith.", "Yes!", "No"]
    assert rows[5]["sentences"] is None and rows[6]["sentences"] == []
    assert {r["is_short"] for r in rows.values()} == {"kept"}


def test_counts_of_words_and_periods(spark):
    docs = spark.createDataFrame([(1, "en", "(Dr. no, dr. Yes) DR dr, 3kg. end."), (2, None, " "), (3, "en", None)], DOCS)
    rows = {r["word"]: tuple(r)[2:] for r in word_period_counts(docs).collect()}
    assert rows["dr"] == (2, 2, 1) and rows["end"] == (1, 0, 0) and rows["no"] == (0, 1, 0)
    assert short_forms(docs.limit(0)).collect() == []


def test_long_text_and_control_characters(spark):
    text = "One two. Three\u0001 four. " * 20_000
    row = spark.createDataFrame([(text,)], "text string").select(
        sentences_by_forms(F.col("text"), F.array(F.lit("four"))).alias("s")).first()
    assert len(row["s"]) == 20_001 and row["s"][1] == "Three\u0001 four. One two." and row["s"][-1] == "Three\u0001 four."


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_seeded_order_at_any_number_of_partitions(spark, partitions):
    rows = spark.range(3000).withColumn("name", F.concat(F.lit("n"), F.col("id") % 7))
    want = sorted(range(3000), key=lambda i: hashlib.md5(f"n{i % 7}|{i}|42".encode()).hexdigest())
    shuffled = shuffle_rows(rows, ["name", "id"], partitions=partitions)
    assert [r["id"] for r in shuffled.collect()] == want
    sizes = shuffled.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes <= 3 * 3000 / partitions
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_order_of_empty_and_repeated_rows(spark):
    assert shuffle_rows(spark.range(0), ["id"]).collect() == []
    twice = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert sorted(str(r["id"]) for r in shuffle_rows(twice, ["id"]).collect()) == ["1", "1", "None"]
