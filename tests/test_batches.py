"""Functions that work on Arrow batches: annotators' spans and page XML."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from labelkit.functions import bio_to_spans, group_subword_entities, joined_positions, tag_words, text, vote_spans
from labelkit.functions.voting import voted_tags
from labelkit.operators import match_tagged, metric_counts
from labelkit.plans import bridge
from labelkit.plans.labelling import label_documents, labelled_tokens
from labelkit.plans.queries import QUERIES
from labelkit.plans.span_queries import _predicted


def test_spans_of_batches_are_those_of_each_row(spark):
    words = [["a", "##b", "žluť", "a"], [], None, ["𝒳y"] * 9, [f"w{k}" for k in range(400)], ["##x", "##x", "##x"]]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id int, words array<string>")
    plan = rows.select(bridge.model_spans(F.col("words")).alias("s"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for m in bridge.MODELS:
        plain = F.transform(group_subword_entities(bridge.model_pieces(F.col("words"), m)), lambda s, i: F.struct(
            i.alias("ord"), s["start"], s["end"], s["word"], s["label"], F.round(s["score"], 6)))
        for r in rows.select(bridge.model_spans(F.col("words")).alias("s"), plain.alias("p")).collect():
            assert (r["s"] is None) == (r["p"] is None)
            assert [tuple(s)[1:] for s in r["s"] or [] if s["model"] == m] == [tuple(p) for p in r["p"] or []]


def test_tags_of_batches_are_those_of_each_row(spark):
    words = [["a", "##b", "žluť", "a"], [], None, ["𝒳y"] * 9, [f"w{k}" for k in range(400)], ["##x", "##x", "##x"]]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id int, words array<string>")
    plain = F.struct(bridge.gold_tags(F.col("words")), *[bridge.model_tags(F.col("words"), m) for m in bridge.MODELS])
    for r in rows.select(bridge.rule_tags(F.col("words")).alias("t"), plain.alias("p")).collect():
        assert tuple(r["t"]) == tuple(r["p"])


def test_voted_tags_of_batches_are_those_of_each_row(spark):
    rng, rows = random.Random(7), []
    for k in range(300):
        words = [rng.choice(["a", "žluť", "𝒳y", "", "w" * 9]) for _ in range(rng.randrange(12))]
        spans = [(m, i, rng.randrange(-1, 30), rng.randrange(32), rng.choice(["a", " a\u00a0", "b", "Ž"]), rng.choice("pgi"),
                  rng.choice([.2, .7, .71, .9])) for m in range(3) for i in range(rng.randrange(9))]
        rows.append((k, words, rng.sample(spans, len(spans))))
    rows += [(300, None, []), (301, ["a"], None), (302, ["a", None], [(0, 0, 0, 1, "a", "p", .9)]), (303, [], []),
             *((304 + i, ["a", "b"], [(0, 0, 0, 1, "a", "p", .9), (1, 0, 2, 3, "b", *odd)])
               for i, odd in enumerate([("g", None), ("g", float("nan"))]))]
    df = spark.createDataFrame(rows, "id int, words array<string>, spans array<struct<model: int, ord: int, start: int, end: int, "
                               "word: string, label: string, score: double>>").repartition(3)
    plain = tag_words(joined_positions(F.col("words")), vote_spans(F.col("spans")))
    got = df.select("id", voted_tags(F.col("words"), F.col("spans")).alias("t"), plain.alias("p")).collect()
    assert len(got) == len(rows) and all(r["t"] == r["p"] for r in got)
    assert {t for r in got for t in r["t"] or []} >= {"O", "B-p", "I-g"}


def test_labelling_votes_in_batches(spark):
    docs = spark.createDataFrame([(1, "Jan Hus. " * 9), (2, None), (3, " \u00a0"), (4, "x" * 600 + " y")], "doc_id int, text string")
    tokens = labelled_tokens(label_documents(docs, bridge.rule_annotators), ["doc_id"])
    assert tokens._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    assert sorted(tokens.groupBy("doc_id").count().collect()) == [(1, 18), (4, 2)]


def merged(pieces):
    """Entities of one array of pieces, restated in plain Python."""
    found, before = [], "O"
    for label, score, start, end, piece in pieces:
        label = label or "O"
        kind = label[2:] if label[1:2] == "-" else label
        if label != "O":
            if label.startswith("B-") or before == "O" or kind != (before[2:] if before[1:2] == "-" else before):
                found.append([start, end, kind, [], []])
            found[-1][1] = end
            found[-1][3].append(score)
            found[-1][4].append(piece)
        before = label
    return [(a, e, k, None if None in sc else round(sum(sc) / len(sc), 9), " ".join(p for p in ps if p is not None).replace(" ##", ""))
            for a, e, k, sc, ps in found]


def test_pieces_of_batches_are_merged_as_in_each_row(spark, sf):
    rng = random.Random(3)
    rows = [(k, [(rng.choice(["O", "B-p", "I-p", "g", "I-O", None]), rng.choice([.1, .7, None]), i, i + 1,
                  rng.choice(["a", "##b", "ž", None])) for i in range(rng.randrange(9))]) for k in range(200)] + [(200, None), (201, [])]
    df = spark.createDataFrame(rows, "id int, p array<struct<label: string, score: double, start: int, end: int, piece: string>>").repartition(3)
    got = {r["id"]: r["g"] for r in df.select("id", group_subword_entities(F.col("p")).alias("g")).collect()}
    assert got.pop(200) is None
    for k, g in got.items():
        assert [(*s[:3], s[3] and round(s[3], 9), s[4]) for s in g] == merged(rows[k][1])
    plan = QUERIES["group_subword_entities"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan


def test_spans_are_projected_in_their_row_unless_an_id_is_shared(spark, tmp_path):
    text = "Jan Hus a b c d e f. Praha g h i j k. " * 4
    def of(name, rows):
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr(
            "*", "'s' AS source").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        df = QUERIES["project_spans"](spark, f"{tmp_path}/{name}")
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan, {k: sorted(map(str, g)) for k, g in _by_first(df.collect()).items()}

    plan, alone = of("own", [(1, text, "cs"), (2, text + "x y", "cs"), (None, text, "cs"), (3, None, "cs"), (4, "", None)])
    assert set(alone) == {1, 2, None} and plan.count("BroadcastHashJoin") >= 1
    assert any("-p" in t or "-g" in t or "-i" in t for t in alone[1]) and not any("-" in t for t in alone[None])
    rows = QUERIES["project_spans_in_rows"](spark, f"{tmp_path}/own").where("doc_id IS NOT NULL").collect()
    assert {k: sorted(map(str, g)) for k, g in _by_first(rows).items()} == {k: alone[k] for k in (1, 2)}
    _, twice = of("twice", [(1, text, "cs"), (1, "Brno l m n o p q", "cs"), (2, text + "x y", "cs")])
    assert len(twice[1]) > len(alone[1]) and twice[2] == alone[2]


def _by_first(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(tuple(r[1:]))
    return found


def test_ledger_runs_find_tags_in_batches(spark, sf):
    plan = _predicted(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5(" not in plan


def aligned(rows):
    """Counts over document rows, each with each that shares its id."""
    tags, found = {}, []
    kinds = dict(zip(bridge._DIGITS, bridge._TYPES, strict=True))
    for row, (_, text, _) in enumerate(rows):
        for no, sentence in enumerate(text.split(". ") if text else []):
            digits = [hashlib.md5(w.encode()).hexdigest() for w in sentence.split()]
            for m in ("gold", *bridge.MODELS):
                types = [kinds[d[0] if m == "gold" or d[1 + 3 * m] >= "4" else d[2 + 3 * m]] for d in digits]
                tags[row, no, m] = [t if t == "O" else f"{'I' if i and types[i - 1] == t else 'B'}-{t}" for i, t in enumerate(types)]
    for (row, no, m), gold in tags.items():
        key = rows[row][0]
        for model in bridge.MODELS if m == "gold" and gold else ():
            said = [tags[r, no, model] for r, (other, _, lang) in enumerate(rows)
                    if other == key is not None and (model != 1 or lang not in ("de", None))
                    and tags.get((r, no, model))]
            for pred in said or [["O"] * len(gold)]:
                found.append((key, no, model, sum(p == g for p, g in zip(pred, gold)), len(gold)))
    return sorted(found, key=str)


def test_predictions_are_aligned_in_their_row_unless_an_id_is_shared(spark, tmp_path):
    def of(name, rows):
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr(
            "*", "'s' AS source").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        df = QUERIES["align_predictions"](spark, f"{tmp_path}/{name}")
        return sorted(map(tuple, df.collect()), key=str), df._jdf.queryExecution().executedPlan().toString()

    own = [(k, ". ".join(" ".join(f"w{k * j + i}" for i in range(k + j)) for j in range(4)), lang)
           for k, lang in enumerate(["de", "en", "cs", None, "de", "en"])]
    odd = [(7, None, "en"), (8, "", "en"), (9, "a b. . \t. c", "de"), (None, "a b. c d e f g", "en"), (None, "d", "de")]
    shared = [(k, f"{text}. tail {k}", lang) for (k, text, _), lang in zip(own, ["en", "en", "de", "de", "de", None])]
    found, plan = of("own", own + odd)
    assert found == aligned(own + odd) and "LeftOuter" not in plan.split("Initial Plan")[0]
    found, plan = of("shared", own + odd + shared + own[:2])
    assert found == aligned(own + odd + shared + own[:2]) and "LeftOuter" in plan


def test_few_pages_are_held(monkeypatch):
    held = []
    monkeypatch.setattr(text.F, "arrow_udf", lambda of, kind: lambda xml: of)
    few = text._of_pages("xml", lambda x: x, pa.string(), "string")
    for part in few(iter([pa.array([str(k) for k in range(150)]), pa.array([None], pa.string())])):
        held.append(len(part))
    assert held == [64, 64, 22, 1]


def test_entities_of_batches_are_those_of_each_row(spark):
    tags = [["B-p", "I-p", "O", "B-a|b"], ["I-p", "B-p", "p", "I-i"], ["O", None, "X-O", ""], [], None, ["B-p", None], ["B-p", "I-p", "O"]]
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(tags) for j, b in enumerate(tags)],
                                 "i int, j int, pred array<string>, gold array<string>")
    sides = rows.select("i", "j", bio_to_spans(F.col("pred")).alias("p"), bio_to_spans(F.col("gold")).alias("g")).collect()
    found = {(r["i"], r["j"]): [{tuple(e) for e in r[c] or []} for c in "pg"] for r in sides}
    matched = match_tagged(rows, ["i", "j"])
    assert "ArrowEvalPython" in matched._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, matched.collect())) == sorted((*k, *e) for k, (p, g) in found.items() for e in p & g)
    missed = match_tagged(rows, ["i", "j"], "false_negative").collect()
    assert sorted(map(tuple, missed)) == sorted((*k, *e) for k, (p, g) in found.items() for e in g - p)
    counts = {(r["i"], r["j"], r["type"]): tuple(r)[3:] for r in metric_counts(rows, ["i", "j"]).collect()}
    assert counts[0, 6, "p"] == (1, 1, 1, 0, 0) and counts[0, 6, "a|b"] == (0, 1, 0, 0, 0)
    assert counts[0, 6, None] == (0, 0, 0, 3, 3) and counts[5, 2, None] == (0, 0, 0, 1, 4)
    assert not any(4 in k[:2] for k in counts)
