"""Readers, writers and numbering on small files cut at every place."""

import itertools
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelkit import functions as L
from labelkit.functions.arrays import pack_words, unpack_words
from labelkit.operators import (number_file_lines, number_lines, running_offset, sentence_ids,
                                sentence_lines)
from labelkit.operators.numbering import offset_in_ranges
from labelkit.operators.numbering import _Runs
from labelkit.plans.bridge import corpus_sentences, rule_annotators
from labelkit.plans.labelling import label_documents, labelled_documents
from labelkit.sources import archives, conll, corpus

EDGES = ("-DOCSTART-\t_\t_\tO\n\nJana\tjana\tNNFS1\tB-P\nNováková\tn\tNNFS1\tI-P\n\n\n\n"
         "\U0001F600\t_\t_\tO\nkrátká\tx\n \ndál\td\tX\tB-G \n\nkonec\tk\tX\tO")


@pytest.fixture
def splits(spark):
    """Sets the largest file split for one test."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda size: (spark.conf.set(key, str(size)),
                        spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [7, 16, 33, 1 << 20])
def test_conll_edges_at_any_split(spark, tmp_path, splits, size):
    (tmp_path / "train.conll").write_text(EDGES, encoding="utf-8")
    (tmp_path / "dev.conll").write_text("a\tb\tc\tO\n", encoding="utf-8")
    splits(size)
    rows = conll.read_conll(spark, str(tmp_path), "cnec4").orderBy("split", "sentence_id")
    got = [(r["split"], r["sentence_id"], list(r["tokens"]), list(r["tags"]))
           for r in rows.toPandas().to_dict("records")]
    assert got == [
        ("train", 0, ["Jana", "Nováková"], ["B-P", "I-P"]),
        ("train", 1, ["\U0001F600", "dál"], ["O", "B-G"]),
        ("train", 2, ["konec"], ["O"]),
        ("validation", 0, ["a"], ["O"])]
    rejects = conll.conll_rejects(spark, str(tmp_path), "cnec4").orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rejects] == [(8, "krátká\tx"), (9, " ")]


def test_many_sentences_at_many_splits(spark, tmp_path, splits):
    rng = random.Random(1)
    expected, text = [], ""
    for i in range(400):
        words = [f"w{i}x{j}" for j in range(rng.randint(1, 7))]
        expected.append(words)
        text += "".join(f"{w} O\n" for w in words) + "\n" * rng.randint(1, 4)
    (tmp_path / "train.conll").write_text(text)
    splits(97)
    rows = conll.read_conll(spark, str(tmp_path), "infer2").orderBy("sentence_id").toPandas()
    assert [list(t) for t in rows["tokens"]] == expected
    assert list(rows["sentence_id"]) == list(range(400))


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_running_offset_in_small_blocks(spark, partitions):
    rng = random.Random(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = [(scope, i, rng.randint(0, 5)) for scope in "ab"
            for i in rng.sample(range(3000), 500 if scope == "a" else 9)]
    df = spark.createDataFrame(rows, "scope string, i bigint, n int")
    got = running_offset(df, ["scope"], "i", F.col("n"), shifts=(2, 5, 9)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["offset"] == sum(n for s, i, n in rows if s == r["scope"] and i < r["i"])
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_and_ids(spark):
    df = spark.createDataFrame([("f", 0, ["a", "b"]), ("f", 5, ["c"]), ("f", 9, ["d"])],
                               "file string, i bigint, tokens array<string>")
    numbered = number_lines(df, ["file"], "i", count_blanks=True, base=1, shifts=(1, 2))
    assert [r["first_no"] for r in numbered.orderBy("i").collect()] == [1, 4, 6]
    ids = sentence_ids(df, ["file"], "i")
    assert [r["sentence_id"] for r in ids.orderBy("i").collect()] == [0, 1, 2]


def test_csv_quotes_survive(spark, tmp_path):
    df = spark.createDataFrame([("train", 0, ['"a', 'b"c"', "d,e"], ["O", "B-g", "O"]),
                                ("train", 1, ["f"], ["O"])],
                               "split string, sentence_id bigint, tokens array<string>, "
                               "tags array<string>")
    path = str(tmp_path / "csv")
    conll.write_token_csv(df, path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv/split=train").glob("part-*")))
    assert text.startswith('"ID","Word","Lemma","Morphology","Annotation"\n"1","""a","""a","_","O"\n')
    back = conll.read_conll(spark, path, "poner_csv").orderBy("sentence_id").toPandas()
    assert [list(t) for t in back["tokens"]] == [['"a', 'b"c"', "d,e"], ["f"]]
    assert [list(n) for n in back["numbers"]] == [[1, 2, 3], [4]]


def test_written_order_and_numbers(spark, tmp_path, sf):
    path = tmp_path / "out"
    conll.write_conll(corpus_sentences(spark, sf), str(path), "wiki3")
    for folder in path.glob("corpus=*/split=*"):
        text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
        numbers = [int(line.split("\t")[0]) for line in text.split("\n") if line]
        assert numbers == list(range(len(numbers)))


def test_words_are_packed_and_unpacked(spark):
    rows = [(0, ["a", "b c"]), (1, []), (2, None), (3, [""]), (4, ["a\x1fb"]), (5, [None, "a\x1fb"]), (6, ["a", None]), (7, ["\x1f"]),
            (8, ["", ""]), (9, ["ž\n", "\t"])]
    df = spark.createDataFrame(rows, "id int, w array<string>").repartition(3)
    packed = df.select("id", pack_words(F.col("w")).alias("p"))
    assert {r["id"] for r in packed.where("p.text IS NOT NULL").collect()} == {0, 3, 8, 9}
    assert dict(packed.select("id", unpack_words(F.col("p"))).collect()) == dict(rows)


def test_offsets_in_ranges_take_one_exchange(spark):
    rng = random.Random(5)
    rows = [(scope, i, i // 40, rng.randint(0, 5)) for scope in "ab" for i in rng.sample(range(3000), 700)]
    df = spark.createDataFrame(rows, "scope string, i bigint, doc bigint, n int").repartition(4)
    for scope in (["scope"], ["scope", "doc"]):
        got = offset_in_ranges(df, ["scope"], scope, "i", F.col("n"), shifts=(4, 8))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0
        placed = got.withColumn("at", F.spark_partition_id()).collect()
        assert len(placed) == len(rows)
        for r in placed:
            assert r["offset"] == sum(n for s, i, d, n in rows if s == r["scope"] and i < r["i"] and (len(scope) == 1 or d == r["doc"]))
        order = [(r["scope"], r["i"] >> 4) for r in sorted(placed, key=lambda r: (r["at"], r["scope"], r["i"]))]
        assert order == sorted(order)
    with pytest.raises(ValueError):
        offset_in_ranges(df, ["scope", "doc"], ["scope"], "i", F.col("n"))


@pytest.mark.parametrize("layout", ["wiki3", "bsnlp3", "poner_csv"])
def test_sentences_are_written_in_order_and_numbered_across_blocks(spark, tmp_path, layout):
    df = spark.range(9000).select(F.lit("c").alias("corpus"), F.lit("train").alias("split"), F.col("id").alias("sentence_id"),
                                  (F.col("id") / 5000).cast("bigint").alias("doc_id"), F.array(
        F.concat(F.lit("w"), "id"), F.lit("a\x1fb")).alias("tokens"), F.array(F.lit("O"), F.lit("B-p")).alias("tags")).repartition(5)
    path = str(tmp_path / layout)
    conll.write_conll(df, path, layout, number_scope=["corpus", "split", "doc_id"] if layout == "bsnlp3" else None)
    back = conll.read_conll(spark, path, layout).orderBy("sentence_id").collect()
    base = 1 if layout == "poner_csv" else 0
    assert [list(r["tokens"]) for r in back] == [[f"w{k}", "a\x1fb"] for k in range(9000)]
    assert [r["numbers"][0] - base for r in back] == [2 * (k % 5000 if layout == "bsnlp3" else k) for k in range(9000)]


def test_lines_are_parsed_in_batches(spark, tmp_path):
    (tmp_path / "train.conll").write_text("1\ta\tB-p\u00a0\textra\n2\tshort\n 3\t\t\n\nonly\n\n4\tž\tO\n")
    back = conll.read_conll(spark, str(tmp_path), "wiki3")
    assert "ArrowEvalPython" in back._jdf.queryExecution().executedPlan().toString()
    rows = [(r["sentence_id"], r["tokens"], r["tags"], r["numbers"]) for r in back.orderBy("sentence_id").collect()]
    assert rows == [(0, ["a", ""], ["B-p", ""], [1, 3]), (2, ["ž"], ["O"], [4])]


def test_compressed_files_are_read_back(spark, tmp_path):
    df = spark.range(50).select(F.lit("train").alias("split"), F.col("id").alias("sentence_id"), F.array(F.lit("a"), F.lit("b")).alias("tokens"),
                                F.array(F.lit("O"), F.lit("B-p")).alias("tags"))
    conll.write_conll(df, str(tmp_path / "gz"), "med10", ["split"], compression="gzip")
    assert list((tmp_path / "gz/split=train").glob("part-*.txt.gz"))
    back = conll.read_conll(spark, str(tmp_path / "gz"), "med10").orderBy("sentence_id").collect()
    assert [(r["tokens"], r["tags"], r["numbers"]) for r in back] == [(["a", "b"], ["O", "B-p"], [2 * k, 2 * k + 1]) for k in range(50)]


def test_cnec_lines(spark, tmp_path):
    (tmp_path / "train.conll").write_text("a\tl\tm\tB-P\nb\tx\n\nc\tl\tm\tB-a-b\textra\n")
    lines = conll.convert_cnec_lines(conll.read_lines(spark, str(tmp_path)),
                                     conll.list_files(spark, str(tmp_path)))
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == [
        "1\ta\tl\tm\tB-PER", "2\tb\tx", "", "4\tc\tl\tm\tMISC"]


def test_parallel_text(spark, tmp_path):
    (tmp_path / "x.sentences.txt").write_text("Jan je zde\n\nkonec tady\nnavíc\n")
    (tmp_path / "x.ner_tags.txt").write_text("B-PER O O\n\nO\n")
    (tmp_path / "y.sentences.txt").write_text("sama\n")
    rows = conll.read_parallel_text(spark, str(tmp_path), str(tmp_path)).orderBy("line_no")
    assert [(list(r["tokens"]), list(r["tags"])) for r in rows.toPandas().to_dict("records")] == [
        (["Jan", "je", "zde"], ["B-PER", "O", "O"]), ([], []), (["konec"], ["O"])]


def test_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    good = '<P xmlns="u"><Unicode>a</Unicode><Unicode>b</Unicode></P>'
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("1.xml", good)
        z.writestr("bad.xml", "<P>")
        z.writestr("notes.txt", "x")
    with zipfile.ZipFile(tmp_path / "deep/two.zip", "w") as z:
        z.writestr("2.xml", good)
    flat = archives.read_archives(spark, str(tmp_path))
    assert sorted(r["member"] for r in flat.collect()) == ["1.xml", "bad.xml", "notes.txt"]
    deep = archives.read_archives(spark, str(tmp_path), recursive=True, member_glob="*.xml",
                                  check_xml=True, stretch=1)
    assert {r["member"]: r["well_formed"] for r in deep.collect()} == {
        "1.xml": True, "bad.xml": False, "2.xml": True}
    texts = deep.where("well_formed").select(L.page_xml_text(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in texts] == ["a b", "a b"]
    chosen = archives.read_archives(spark, str(tmp_path), members=["notes.txt"]).collect()
    assert [r["text"] for r in chosen] == ["x"]


def test_written_archives_are_cut_and_whole(spark, tmp_path):
    docs = [("big.zip", f"{i}.xml", "x" * 50) for i in range(40)] + [("small.zip", "a.xml", "y")]
    df = spark.createDataFrame(docs, "archive string, member string, text string")
    files = archives.write_archives(df, str(tmp_path), part_chars=500).collect()
    assert len([f for f in files if f["archive"] == "big.zip"]) > 1
    assert [f["file"] for f in files if f["archive"] == "small.zip"] == ["small-00000.zip"]
    back = archives.read_archives(spark, str(tmp_path)).select("member", "text").collect()
    assert sorted(map(tuple, back)) == sorted((m, t) for _, m, t in docs)


def test_archives_of_one_name_keep_their_folders(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.zip", "1.xml", "one"), ("b/x.zip", "1.xml", "two")],
                                 "archive string, member string, text string")
    files = archives.write_archives(docs, str(tmp_path)).collect()
    assert sorted(f["file"] for f in files) == ["a/x-00000.zip", "b/x-00000.zip"]
    back = archives.read_archives(spark, str(tmp_path), recursive=True).collect()
    assert sorted(r["text"] for r in back) == ["one", "two"]


def test_one_archive_is_unpacked_by_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for i in range(64):
            z.writestr(f"{i}.xml", f"<P>{i}</P>" * 2000)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    docs = archives.read_archives(spark, str(tmp_path), stretch=64 << 10)
    tasks = docs.select(F.spark_partition_id().alias("task"), "member").collect()
    assert len({r["member"] for r in tasks}) == 64 and len({r["task"] for r in tasks}) > 4


def test_reordered_lines_are_an_error(spark, tmp_path):
    (tmp_path / "train.conll").write_text("a O\n\nb O\n\nc O\n")
    lines, files = conll.read_lines(spark, str(tmp_path)), conll.list_files(spark, str(tmp_path))
    backwards = lines.orderBy(F.desc("line_id"))
    with pytest.raises(Exception, match="reordered"):
        number_file_lines(backwards, files).collect()
    with pytest.raises(Exception, match="reordered"):
        sentence_lines(backwards, files, F.col("line") == "").collect()


def test_reading_exchanges_edges_only(spark, tmp_path):
    (tmp_path / "train.conll").write_text("a O\n\nb O\n\nc O\n\n" * 50)
    rows = conll.read_conll(spark, str(tmp_path), "infer2")
    assert rows.count() == 150
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    inside, cut = plan.split("Union", 1)[1].split("Aggregate", 1)
    # lines inside blocks meet block totals of a known size and are not grouped
    assert "MapInArrow" in inside and "MapInArrow" not in cut


def test_corpus_prunes_partitions_and_columns(spark, tmp_path, sf):
    path = str(tmp_path / "corpus")
    corpus.write_corpus(corpus_sentences(spark, sf), path)
    one = corpus.read_corpus(spark, path, splits=["test"]).select("sentence_id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "ReadSchema: struct<sentence_id:bigint>" in plan


def test_labelling_job_does_not_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labelled = label_documents(docs, rule_annotators)
    assert "Exchange" not in labelled._jdf.queryExecution().executedPlan().toString()
    texts = labelled_documents(labelled, ["doc_id"])
    words = texts.select(F.expr("size(filter(split(text, '\n'), x -> x <> ''))").alias("n"))
    expected = docs.select(F.size(L.ws_tokens(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0]
    assert words.agg(F.sum("n")).first()[0] == expected


def _runs_one_by_one(rows):
    """Runs and their number per block, line by line: rows ``block, line, is_word``."""
    blocks, runs, totals = {}, [], []
    for block, line, word in rows:
        blocks.setdefault(block, []).append(line if word else None)
    for block, lines in blocks.items():
        found, at = [], 0
        for word, group in itertools.groupby(lines, key=lambda x: x is not None):
            group = list(group)
            if word:
                found.append((at == 0, at + len(group) == len(lines), group))
            at += len(group)
        runs += [(block, n, *run) for n, run in enumerate(found)]
        totals.append((block, len(found)))
    return runs, totals


def test_runs_in_batches_of_any_size():
    rng = random.Random(5)
    for _ in range(1000):
        block, share, rows = 0, rng.choice([0, 0.2, 0.5, 0.8, 1]), []
        for i in range(rng.randint(0, 14)):
            block += rng.random() < 0.2
            rows.append((block, f"l{i}", rng.random() < share))
        runs, totals = [], []
        for edges in (False, True):
            cutter, batches, at = _Runs(edges), [], 0
            while at < len(rows):
                part = rows[at:at + rng.randint(1, 5)]
                batches += cutter.add(pa.RecordBatch.from_pydict({
                    "part_key": [b for b, _, _ in part], "start": [b * 7 for b, _, _ in part],
                    "line_id": list(range(at, at + len(part))), "line": [t for _, t, _ in part],
                    "_word": [w for _, _, w in part]}))
                at += len(part)
            for r in [r for b in [*batches, *cutter.close()] for r in b.to_pylist()]:
                assert r["start"] == r["part_key"] * 7
                if r["lines"] is None:
                    totals.append((r["part_key"], r["ordinal"]))
                else:
                    assert edges == (r["opens"] or r["closes"])
                    runs.append((r["part_key"], r["ordinal"], r["opens"], r["closes"], r["lines"]))
        assert (sorted(runs), sorted(totals)) == _runs_one_by_one(rows)


def test_lines_are_parsed_once(spark, tmp_path):
    """No condition on parsed lines is pushed below, where they would be parsed again."""
    (tmp_path / "a.csv").write_text('"ID","Word","Lemma","Morphology","Annotation"\n"1","a","a","_","O"\n\n"short"\n\n"2","b","b","_","B-p"\n')
    back = conll.read_conll(spark, str(tmp_path), "poner_csv")
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    # inside one sentence and across edges: two branches of the plan
    assert plan.lower().count("csvtostructs") + plan.count("from_csv") == 1, plan
    assert sorted((r["sentence_id"], r["tokens"], r["tags"]) for r in back.collect()) == [(0, ["a"], ["O"]), (2, ["b"], ["B-p"])]
