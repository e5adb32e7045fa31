"""The pipeline's stages, each against plain Python on the rows it was given."""

import re

import pandas as pd
import pytest
from test_llm_queries import KINDS
from test_overlap import survivors

import corpus_pipeline
from labelkit.folders import saved


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf), "stage")
        tables.append(docs.toPandas())
    return tables


def test_columns(stages):
    assert all(list(t.columns) == list(stages[0].columns) for t in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    assert set(stages[1].doc_id) == set(stages[0].doc_id)


def test_one_document_of_each_group(stages):
    """By brute-force Jaccard of five-word shingles; the rule of bits is op9's."""
    assert sorted(stages[2].doc_id) == survivors({r.doc_id: r.text for r in stages[1].itertuples()})


def test_leaks_go(stages, sf):
    def words(t):
        return " ".join(re.findall(r"[^\W\d_]+", t.lower()))

    items = [words(t) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    whole = {r.doc_id for r in stages[2].itertuples() if any(i in words(r.text) for i in items)}
    gone = set(stages[2].doc_id) - set(stages[3].doc_id)
    assert whole and whole <= gone and len(gone) <= len(whole) + 2


def test_secrets_are_hidden(stages):
    assert list(sorted(stages[4].doc_id)) == list(sorted(stages[3].doc_id))
    before = stages[3].set_index("doc_id").text
    for r in stages[4].itertuples():
        for kind, pattern in KINDS.items():
            least = {"assign": 6, "access": 20, "hex": 24}[kind]
            found = [m for m in re.finditer(pattern, before[r.doc_id])
                     if len(m[2] if kind == "assign" else m[0]) >= least]
            assert not any(m[0] in r.text for m in found)
        assert r.n_chars == len(r.text) and ("[secret]" in r.text) == (before[r.doc_id] != r.text)


def test_a_secret_is_hidden_and_counted(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, 'a token = "' + "ab12" * 6 + '" b', "en", "s", 9), (2, "clean", "en", "s", 5)], schema)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.hide_secrets(spark, docs, sf).collect()}
    assert got == {1: ('a [secret]" b', 13), 2: ("clean", 5)}


def test_mix(stages):
    sizes = stages[4].assign(size=[len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in stages[4].text])
    copies = stages[5].groupby("doc_id").size()
    assert copies.max() <= 3 and set(copies.index) <= set(sizes.doc_id)
    taken = (sizes.set_index("doc_id")["size"] * copies.reindex(sizes.doc_id, fill_value=0)).sum()
    assert taken == pytest.approx(sizes["size"].sum(), rel=0.2)


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).toPandas()
    order = ["doc_id", "copy"]
    assert got.sort_values(order).text.tolist() == stages[5].sort_values(order).text.tolist()
