"""The pipeline's near-duplicates against brute-force Jaccard of five-word shingles."""

import random

import corpus_pipeline
from test_llm_edges import DOCS, ROWS, prose

from labelkit.llm import overlap


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def survivors(texts):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return sorted(set(root.values()))


def test_stage_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = random.Random(3)
    for k in range(150):  # short near copies, and copies of copies
        ws = (texts[1000 + rng.randrange(k)] if k % 3 else prose(k, 40 + k)).split()
        at = rng.randrange(len(ws))
        texts[1000 + k] = " ".join(ws[:at] + ["other"] * rng.choice([0, 1, 2]) + ws[at + rng.choice([0, 1]):])
    given = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts.items()], docs.schema)
    got = sorted(r["doc_id"] for r in corpus_pipeline.deduplicate(spark, given, sf).select("doc_id").collect())
    assert got == survivors(texts) and len(got) < len(texts) - 50


def test_members_that_miss_their_leader_meet():
    base = [f"w{k}" for k in range(200)]
    texts = [base[:100], base[15:115], base[17:117], base[5:105]]
    links = list(overlap._spanning([overlap.shingle_set(" ".join(t)) for t in texts], overlap.np.array([0, 1, 2, 0]), 0.8))
    assert links == [(1, 2), (1, 3)]


def test_fingerprints_alone_find_near_copies(spark, sf, monkeypatch):
    texts = [prose(k, 400).split() for k in range(6)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(10 + k, " ".join(t[:-1])) for k, t in enumerate(texts)]
    no_band = overlap.np.zeros(1, overlap.np.int64)  # of one row each: no block has two members
    monkeypatch.setattr(overlap, "_bands", lambda shingles: no_band + len(shingles) * 1000 + int(shingles[0] % 997))
    given = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.deduplicate(spark, given, sf).collect()) == survivors(dict(rows))


def test_odd_rows(spark, sf):
    got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(ROWS, DOCS), sf).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 2), (False, 4), (False, 6), (True, 0)]
    assert corpus_pipeline.deduplicate(spark, spark.createDataFrame([], DOCS), sf).count() == 0
