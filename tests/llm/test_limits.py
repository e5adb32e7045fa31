"""Limits of languages with few labelled texts, and with odd texts among them."""

import random

import numpy as np
import pytest
from test_llm_edges import DOCS, prose

from labelkit.llm import langid

OTHER = "jedna dva tři čtyři pět šest sedm osm devět deset jedenáct dvanáct".split()
LATIN = "quick brown foxes jumped swiftly over lazy dogs while wizards vex judges by night".split()


def shuffled(words, seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("n", [100, 12, 2, 1])
def test_few_texts_have_a_limit(spark, n):
    docs = [(k, prose(k, 60), "xx", "s", 0) for k in range(n)]
    models = langid.fit(spark.createDataFrame(docs, DOCS))
    assert models.langs == ["xx"] and np.isfinite(models.limit).all()


def test_unlearned_latin_language_is_rejected(spark):
    docs = [(k, prose(k, 60), "xx", "s", 0) for k in range(100)]
    docs += [(200, shuffled(LATIN, 1), None, "s", 0), (201, shuffled(OTHER, 1), None, "s", 0)]
    got = langid.identify_languages(spark.createDataFrame(docs, DOCS)).where("rejected").collect()
    assert sorted(r["doc_id"] for r in got) == [200, 201]


def test_odd_calibration_texts_do_not_open_the_limit(spark):
    def junk(seed):
        rng = random.Random(seed)
        return "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(300))

    docs = [(k, junk(k) if k % 50 == 0 else prose(k, 60), "xx", "s", 0) for k in range(1000)] + [(5000, junk(5000), None, "s", 0)]
    got = langid.identify_languages(spark.createDataFrame(docs, DOCS)).where("rejected").collect()
    assert 5000 in {r["doc_id"] for r in got} and all(r["doc_id"] % 50 == 0 for r in got)
