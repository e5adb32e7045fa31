"""Voting, projection and metrics against plain restatements of their rules."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from labelkit import functions as L
from labelkit.operators import (add_to_ledger, accumulate_metric, align_predictions, entity_prf_by_type,
                                entity_prf_overall, match_entities, match_tagged, metric_counts,
                                project_spans, vote)

SPANS = ("sentence_id bigint, model int, ord int, start int, end int, word string, "
         "label string, score double")

CASES = [
    ([(0, "g", .6), (1, "g", .5), (2, "p", .99)], ("g", .55)),
    ([(0, "p", .65)], None),
    ([(0, "i", .71)], ("i", .71)),
    ([(0, "p", .8), (1, "i", .8), (2, "g", .75)], ("p", .8)),
    ([(0, "p", .7), (1, "i", .7)], None),
    ([(0, "g", .6), (1, "g", .5)], ("g", .55))]


def in_rows(spark, spans):
    """Both forms of the vote over the same span rows."""
    df = spark.createDataFrame(spans, SPANS)
    table = vote(df).select("sentence_id", "model", "ord", "start", "end", "word", "label", "score")
    packed = df.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct(
        *[c for c in df.columns if c != "sentence_id"]))).alias("s"))
    arrays = packed.select("sentence_id", F.inline(L.vote_spans(F.col("s")))).select(
        "sentence_id", "rank.model", "rank.ord", "start", "end", "word", "label", "score")
    rounded = [sorted(tuple(r[:-1]) + (round(r[-1], 6),) for r in x.collect())
               for x in (table, arrays)]
    assert rounded[0] == rounded[1]
    return rounded[0]


def test_vote_cases(spark):
    spans = [(i, m, 0, 0, 3, "w", lb, s) for i, (votes, _) in enumerate(CASES)
             for m, lb, s in votes]
    won = {r[0]: (r[6], r[7]) for r in in_rows(spark, spans)}
    assert [won.get(i) for i in range(len(CASES))] == [result for _, result in CASES]


def test_padded_words_meet_in_both_forms(spark):
    spans = [(1, 0, 0, 0, 3, "Jan", "p", .5), (1, 1, 0, 0, 3, " Jan\u00a0", "p", .5),
             (1, 2, 0, 0, 3, "Hus", "p", .6)]
    assert in_rows(spark, spans) == [(1, 0, 0, 0, 3, "Jan", "p", .5)]


def test_sentences_without_prediction_count_as_o(spark):
    gold = spark.createDataFrame([(1, ["B-p", "O"]), (2, ["B-g"])], "sentence_id bigint, tags array<string>")
    pairs = align_predictions(gold.where("sentence_id = 1"), gold)
    assert {r["sentence_id"]: list(r["pred"]) for r in pairs.collect()} == {1: ["B-p", "O"], 2: ["O"]}
    overall = entity_prf_overall(metric_counts(pairs, [])).first()
    assert (overall["n_gold"], overall["recall"], overall["n_tokens"]) == (2, 0.5, 3)


@pytest.mark.parametrize("models", [3, 5])
def test_vote_random(spark, models):
    rng = random.Random(models)
    spans, groups = [], defaultdict(list)
    for sentence in range(60):
        for model in range(models):
            places = rng.sample(range(6), rng.randint(0, 4))
            for order, at in enumerate(sorted(places)):
                label, score = rng.choice("pgi"), rng.randint(40, 100) / 100
                spans.append((sentence, model, order, at, at + 2, "w", label, score))
                groups[sentence, at].append((model, order, label, score))
    expected = []
    for (sentence, at), votes in groups.items():
        by_label = defaultdict(list)
        for _, _, label, score in votes:
            by_label[label].append(score)
        most = max(map(len, by_label.values()))
        if most > 1:
            mean, label = min((-sum(s) / len(s), lb) for lb, s in by_label.items()
                              if len(s) == most)
            mean = -mean
        else:
            _, _, label, mean = max(votes, key=lambda v: (v[3], -v[0]))
            if mean <= 0.7:
                continue
        expected.append((sentence, *min(votes)[:2], at, at + 2, "w", label, round(mean, 6)))
    assert in_rows(spark, spans) == sorted(expected)


def test_lone_confident_model_is_kept(spark):
    spans = [(s, 0, i, i * 4, i * 4 + 3, "w", "p", 0.9) for s in range(3) for i in range(5)]
    assert [r[:7] for r in in_rows(spark, spans)] == [r[:7] for r in spans]


def test_project_spans_long_words_and_overlaps(spark):
    rng = random.Random(7)
    words, at = [], 0
    for pos in range(400):
        size = 1500 if pos == 50 else rng.randint(1, 9)
        words.append((1, pos, "w", at, at + size))
        at += size + rng.randint(1, 3)
    spans = []
    for order in range(150):
        start = rng.randint(0, at)
        spans.append((1, order % 3, order, start, start + rng.choice([0, 3, 40, 2500]), "w",
                      rng.choice("pgi"), 0.9))
    expected = []
    for _, pos, _, b, e in words:
        tag = "O"
        for s in sorted(spans, key=lambda s: s[1:3]):
            if e > s[3] and b < s[4]:
                tag = ("B-" if b == s[3] else "I-") + s[6]
        expected.append(tag)
    got = project_spans(
        spark.createDataFrame(words, "sentence_id bigint, pos int, token string, start int, end int"),
        spark.createDataFrame(spans, SPANS), piece=3).orderBy("pos").collect()
    assert [r["tag"] for r in got] == expected


def entities(tags):
    found, open_at = set(), None
    for i, tag in enumerate([*tags, "O"]):
        before = tags[i - 1] if i else "O"
        if open_at is not None and (tag == "O" or tag[0] == "B" or tag[2:] != before[2:]):
            found.add((before[2:], open_at, i - 1))
            open_at = None
        if tag != "O" and open_at is None:
            open_at = i
    return found


def test_metrics_random(spark):
    rng = random.Random(3)
    choices = ["O", "O", "B-p", "I-p", "B-g", "I-g"]
    rows = []
    for i in range(80):
        gold = [rng.choice(choices) for _ in range(rng.randint(1, 20))]
        pred = [t if rng.random() < .8 else rng.choice(choices) for t in gold]
        rows.append((i, pred, gold))
    df = spark.createDataFrame(rows, "id int, pred array<string>, gold array<string>")
    tp = sum(len(entities(p) & entities(g)) for _, p, g in rows)
    n_pred, n_gold = (sum(len(entities(r[k])) for r in rows) for k in (1, 2))
    counts = metric_counts(df, [])
    overall = entity_prf_overall(counts).first()
    assert (overall["tp"], overall["n_pred"], overall["n_gold"]) == (tp, n_pred, n_gold)
    assert overall["f1"] == pytest.approx(2 * tp / (n_pred + n_gold))
    assert overall["accuracy"] == pytest.approx(
        sum(a == b for _, p, g in rows for a, b in zip(p, g)) / sum(len(g) for _, _, g in rows))
    halves = [metric_counts(df.where(F.col("id") % 2 == k), []) for k in (0, 1)]
    merged = {r["type"]: tuple(r) for r in accumulate_metric(*halves, by=[]).collect()}
    assert merged == {r["type"]: tuple(r) for r in counts.collect()}


def test_gold_against_itself_and_no_entities(spark):
    df = spark.createDataFrame([(["B-p", "O"], ["B-p", "O"])], "pred array<string>, gold array<string>")
    row = entity_prf_by_type(metric_counts(df, [])).first()
    assert (row["precision"], row["recall"], row["f1"]) == (1, 1, 1)
    empty = spark.createDataFrame([(["O"], ["O"])], "pred array<string>, gold array<string>")
    row = entity_prf_overall(metric_counts(empty, [])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0, 0, 1)


def test_one_long_sentence_is_dealt_to_many_tasks(spark):
    """Words and spans of one key are exchanged by stretch; no task gets them all."""
    n = 20_000
    words = spark.range(n).select(F.lit(1).cast("bigint").alias("sentence_id"), F.col("id").cast("int").alias("pos"), F.lit("w").alias("token"),
                                  (F.col("id") * 6).cast("int").alias("start"), (F.col("id") * 6 + 5).cast("int").alias("end"))
    spans = words.where("pos % 3 = 0").select("sentence_id", F.lit(0).alias("model"), F.col("pos").alias("ord"), "start", "end",
                                              F.lit("p").alias("label"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tagged = project_spans(words, spans)
        sizes = [r["count"] for r in tagged.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < n / 3
        assert tagged.where((F.col("tag") == "B-p") != (F.col("pos") % 3 == 0)).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ledger_takes_a_run_once(spark, tmp_path):
    df = spark.createDataFrame([("a", ["B-p", "O"], ["B-p", "O"]), (None, ["O"], ["B-g"])],
                               "model string, pred array<string>, gold array<string>")
    counts = metric_counts(df, ["model"]).withColumn("run", F.lit(1)).withColumn("dataset", F.lit("d"))
    path = str(tmp_path / "ledger")
    rows = [sorted(map(str, add_to_ledger(c, path).collect()))
            for c in (counts.where("model = 'a'"), counts, counts, counts.withColumn("run", F.lit(2)))]
    assert len(rows[0]) == 2 and len(rows[1]) == 4 and rows[1] == rows[2] and len(rows[3]) == 8


def test_matching_in_the_row_equals_the_join(spark):
    rng = random.Random(11)
    tags = ["O", "B-p", "I-p", "B-g", "I-g"]
    rows = [(i, *[[rng.choice(tags) for _ in range(n)] for _ in range(2)]) for i, n in
            ((i, rng.randint(0, 8)) for i in range(80))]
    rows += [(80, None, ["B-p"]), (81, ["B-p", "O"], None), (82, ["O", "B-a|b"], ["O", "B-a|b"])]
    both = spark.createDataFrame(rows, "s int, pred array<string>, gold array<string>")
    sides = [both.select("s", F.inline(L.bio_to_spans(F.col(c)))) for c in ("pred", "gold")]
    for result in ("matched", "false_positive", "false_negative"):
        one = match_tagged(both, ["s"], result)
        other = match_entities(*sides, ["s"], result)
        assert one.schema.simpleString() == other.schema.simpleString()
        assert sorted(one.collect()) == sorted(other.collect()) and one.count()
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="unknown result"):
        match_tagged(both, ["s"], "all")
