"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; properties."""

import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from labelkit.llm import langid, pitman_yor, simhash
from labelkit.llm.chat import ChatTemplate, format_turns, parse_formatted, read_back
from labelkit.llm.decontaminate import drop_leaks, find_leaks
from labelkit.llm.licenses import scan_licenses
from labelkit.llm.mixing import mix_sources, mixing_copies
from labelkit.llm.quality import clean_lines
from labelkit.llm.secrets import RULES, SecretRule, may_match, redact_secrets, scan_secrets
from labelkit.llm.simhash import drop_near_duplicates, near_duplicates
from labelkit.llm.warc import assemble, parse_records, read_warc, write_warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)) + "."


LONG = prose(1, 60_000)
ROWS = [(1, prose(2, 80), "en", "a", 5), (1, prose(2, 80), "en", "a", 5), (2, None, None, None, None),
        (3, "", "en", "a", 0), (None, prose(3, 70), "de", "b", 1), (None, None, None, "b", None),
        (4, LONG, "de", "b", len(LONG)), (5, " \n\t ", "en", "a", 4), (6, "12 %% 99", None, "a", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(2, 80)), (2, None), (3, ""), (4, "too short")], "item_id bigint, text string")


OPERATORS = {
    "licenses": lambda d, i: scan_licenses(d), "copies": lambda d, i: mixing_copies(d), "secrets": lambda d, i: scan_secrets(d)[0],
    "redacted": lambda d, i: redact_secrets(d), "quality": lambda d, i: clean_lines(d),
    "language": lambda d, i: langid.identify_languages(d), "groups": lambda d, i: near_duplicates(d),
    "scores": lambda d, i: pitman_yor.score_texts(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(odd, empty, items, name):
    run = OPERATORS[name]
    assert run(odd, items).count() == len(ROWS)
    assert run(empty, items).count() == 0


CLASHES = ["_facts", "_lines", "_src", "_fp", "_found", "_blob", "spans", "size", "score", "copy", "labels", "kept",
           "rejected", "fingerprint", "word", "rate"]


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(odd, items, name):
    wide = odd.withColumns({c: F.lit("mine") for c in CLASHES})
    got = OPERATORS[name](wide, items)
    assert got.count() == len(ROWS)
    for c in ("_facts", "_lines", "_src", "_fp", "_found", "_blob"):
        if c in got.columns:
            assert got.where(F.col(c) == "mine").count() == len(ROWS)


def test_quality_of_odd_rows(odd):
    rows = clean_lines(odd).orderBy("doc_id").collect()
    assert [r["n_words"] for r in rows if r["text"] is None] == [0, 0]
    assert all(r["base_failed"] and not r["kept"] for r in rows if not (r["text"] or "").strip())
    assert [r["n_words"] for r in rows if r["doc_id"] == 4] == [60_000]


def test_quality_lines(spark):
    good = "\n".join(prose(i, 9) for i in range(12))
    text = f"Home | News | About | Contact\n{good}\nCopyright © all rights reserved\nBUY NOW!! CHEAP!!\n### ***"
    row = clean_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["clean_text"] == good and row["lines_lost"] == 4 and row["kept"]


def test_licenses_across_lines_and_gaps(spark):
    spread = prose(5, 90) + "\nPermission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated documentation files. " + prose(6, 90)
    rows = [(1, spread), (2, "under the MIT-license, under the mit license"), (3, "cc by nc cc by nc"), (4, "under mit the license"), (5, None)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert list(got[1]["labels"]) == ["mit"] and got[1]["n_base"] == 0 and got[1]["score"] >= 0.9
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 4)
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 0, 3)
    assert not list(got[4]["labels"]) and got[5]["score"] == 0


def test_mix_targets(spark):
    rows = [(i, "w " * n, s, None) for s, n, k in (("a", 10, 5), ("b", 10, 200), (None, 10, 20)) for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")
    got = mixing_copies(docs).select("source", "source_size", "target").distinct().collect()
    targets = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert targets["a"] == (50, 150.0)  # five eighths, but three times its size at most
    total = sum(t for _, t in targets.values())
    assert total == pytest.approx(2250) and all(t <= 3 * n for n, t in targets.values())
    assert mix_sources(docs).groupBy("doc_id", "source").count().agg(F.max("count")).first()[0] <= 3


def test_rewritten_question_is_found(spark):
    item = "A train leaves Prague at 7 and travels 120 km to Brno at a speed of 60 km per hour with 7 coaches"
    same = "yes. A train leaves Vienna at 9 and travels 340 km to Linz at a speed of 85 km per hour with 9 coaches. done"
    other = "yes. A train leaves Vienna at 9 and travels 340 km to Linz at a speed of 85 km per hour with 4 coaches. done"
    docs = spark.createDataFrame([(1, same), (2, item.lower()), (3, prose(1, 40)), (4, other)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in find_leaks(docs, bench).collect()}
    assert got[1]["share"] == 1.0 and got[1]["rewritten"]
    assert not got[2]["rewritten"] and 3 not in got
    # one item value, 7, has two values there: windows with slots do not count
    assert 4 not in got


def test_leaks_of_odd_rows(odd, empty, items):
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(odd, items).collect()} == {(1, 1)}
    assert find_leaks(empty, items).count() == 0 and find_leaks(odd, items.limit(0)).count() == 0
    assert drop_leaks(odd, items).count() == len(ROWS) - 2


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (3, "nothing")], "doc_id bigint, text string")
    rule = SecretRule("assign", 1, r"token = ([a-z]+)", 1, 6)
    found, ledger = scan_secrets(docs, rules=[rule])
    assert ledger.count() == 2  # two blobs, one rule
    assert sorted(r["doc_id"] for r in found.where(F.size("spans") > 0).collect()) == [1, 2]
    more = docs.unionByName(spark.createDataFrame([(4, "token = zzzzzzz")], docs.schema))
    newer = SecretRule("other", 2, "nothing")
    found, added = scan_secrets(more, ledger, [rule, newer])
    assert sorted((r["rule"], len(r["spans"])) for r in added.collect()) == [
        ("assign@1", 1), ("other@2", 0), ("other@2", 0), ("other@2", 1)]
    assert sorted((r["doc_id"], len(r["spans"])) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_redacted_spans_overlap(spark):
    docs = spark.createDataFrame([(1, "x token=" + "ab12" * 8 + " y"), (2, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in redact_secrets(docs).collect()} == {1: "x [secret] y", 2: None}


def test_warc_of_odd_pages(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz"
    rows = [(1, "http://a/\r\nx", tricky), (2, "http://b", tricky), (2, "http://b", tricky), (3, None, None), (None, "http://c", "né"), (4, "u", "né")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    write_warc(pages, str(tmp_path / "w"))
    got = assemble(read_warc(spark, str(tmp_path / "w"))).collect()
    assert sum(r["copies"] for r in got) == len(rows)
    mains = {(r["main"]["type"], r["main"]["payload_bytes"]) for r in got}
    assert mains == {("response", len(tricky)), ("revisit", len(tricky)), ("response", 0), ("response", 3), ("revisit", 3)}
    assert all(r["request"] and r["metadata"] for r in got)
    assert {bytes(r["main"]["payload"]).decode() for r in got if r["main"]["type"] == "response"} == {tricky, "", "né"}
    write_warc(pages.limit(0), str(tmp_path / "e"))
    assert assemble(read_warc(spark, str(tmp_path / "e"))).count() == 0


def test_broken_archive():
    whole = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    kinds = [r[1] for r in parse_records(io.BytesIO(whole + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut"))]
    assert kinds == ["metadata", "broken"]


def test_assembly_finds_every_direction(spark):
    schema = "record_id string, type string, concurrent_to array<string>"
    rows = [("m1", "response", []), ("q1", "request", ["m1"]), ("x1", "metadata", ["q1"]),
            ("m2", "response", ["q2", "x2"]), ("q2", "request", []), ("x2", "metadata", []), ("q3", "request", ["gone"])]
    got = {r["capture_id"]: r for r in assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"m1", "m2", "gone"} and got["gone"]["main"] is None
    for m, q, x in (("m1", "q1", "x1"), ("m2", "q2", "x2")):
        assert (got[m]["main"]["record_id"], got[m]["request"]["record_id"], got[m]["metadata"]["record_id"]) == (m, q, x)


def test_probabilities_add_up():
    """Over all words of the training text and one unknown word, in every context."""
    rng = np.random.default_rng(3)
    words, ctx = rng.integers(1, 400, 20_000).astype(np.uint64), rng.integers(0, 5, 20_000).astype(np.uint8)
    bucket = pitman_yor._Bucket()
    grid = np.array([(w, c) for w in [*range(1, 400), 9999] for c in range(5)])
    bucket.add("s", words, ctx, np.ones(len(words)), False)
    bucket.add("s", grid[:, 0].astype(np.uint64), grid[:, 1].astype(np.uint8), np.zeros(len(grid)), False)
    bucket.close()
    chain = pitman_yor._Chain(bucket, bucket.totals(), 1)
    for _ in range(3):
        chain.sweep()
    p = chain.probability(chain.sample())
    assert np.bincount(bucket.ctx, p)[:5] == pytest.approx(1)


def test_seats():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 5, 1000, 100_000])
    tables = np.mean([pitman_yor.seat(customers, np.full(5, 10.0), np.full(5, 0.5), rng) for _ in range(200)], axis=0)
    exact = []
    for c in customers:  # expectation of the same process, customer by customer
        t = float(c > 0)
        for i in range(1, c):
            t += 10 / (10 + i - 0.5 * t)
        exact.append(t)
    assert tables == pytest.approx(exact, rel=0.05)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\tÉA\x0bž　", max_size=60))
def test_hashed_words_split_like_bytes(text):
    raw = text.encode()
    starts, hashes, _ = pitman_yor.hashed_words(raw)
    expected = raw.lower().split()
    assert len(starts) == len(expected)
    assert len(set(hashes.tolist())) == len(set(expected))


def test_long_text_in_pieces(monkeypatch, spark):
    docs = spark.createDataFrame([(1, prose(7, 3000)), (2, prose(8, 50))], "doc_id bigint, text string")
    whole = {r["doc_id"]: r for r in pitman_yor.score_texts(docs).collect()}
    stretch = pitman_yor._Stretch("a")
    stretch.add(1, True, prose(7, 3000).encode())
    stretch.hash_waiting()
    monkeypatch.setattr(pitman_yor, "_PIECE", 500)
    pieces = pitman_yor._Stretch("a")
    pieces.add(1, True, prose(7, 3000).encode())
    pieces.hash_waiting()
    for k in range(3):
        assert np.array_equal(np.concatenate([p[k] for p in stretch.parts]), np.concatenate([p[k] for p in pieces.parts]))
    assert stretch.endings == pieces.endings and whole[1]["n_tokens"] == 3001


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="user:\\#/\n", max_size=6), st.text(alphabet="a\\#/<>turn \n:", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    t = ChatTemplate()
    formatted = "".join(t.opened(r) + t.escaped(x) + t.closing for r, x in turns)
    assert parse_formatted(formatted) == turns
    assert all("</turn>" not in t.escaped(x) and "###" not in t.escaped(x) for _, x in turns)


def test_chat_states(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (2, 0, "assistant", "c", "x"), (3, 0, "user", None, "x"),
            (3, 1, "assistant", "d", "x"), (3, 2, "user", "e", "x"), (4, 0, None, "f", "x"), (None, 0, "user", "g", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq string")
    got = {r["conv"]: r for r in read_back(format_turns(df)).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False}
    assert got[3]["n_turns"] == 3 and got[3]["loss_chars"] == 1
    segments = [r for r in format_turns(df).orderBy("seq", "segment").collect() if r["conv"] == 1]
    assert parse_formatted("".join(r["value"] for r in segments)) == [("user", "a"), ("assistant", "b")]
    assert [r["value"] for r in segments if r["loss"]] == ["b"]
    assert read_back(format_turns(df.limit(0))).count() == 0


def test_language_of_odd_texts(odd):
    rows = langid.identify_languages(odd, calibration=0).collect()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in rows if not any(c.isalpha() for c in r["text"] or ""))


def test_rejection(spark):
    docs = [(k, prose(k, 60), "xx", "s", 0) for k in range(60)] + [(100, "Съешь ещё этих мягких французских булок", None, "s", 0)]
    got = langid.identify_languages(spark.createDataFrame(docs, DOCS), per_language=30, calibration=10).where("rejected").collect()
    assert [r["doc_id"] for r in got] == [100]


def test_texts_in_pieces_score_alike():
    texts = [prose(k, 40) for k in range(5)]
    codes, who, _ = langid.letter_codes(texts)
    key, n = np.unique(langid.grams(codes, langid.ORDER)[who >= 0], return_counts=True)
    models = langid.LanguageModels(["xx"], *langid._kneser_ney(["xx"], key, n[:, None].astype(float)), np.array([np.inf]))
    whole, _ = models.cross_entropy(texts)
    cut, _ = models.cross_entropy(texts, most_codes=64)
    alone = np.vstack([models.cross_entropy([t])[0] for t in texts])
    assert whole == pytest.approx(cut, rel=1e-5) and whole == pytest.approx(alone, rel=1e-5)
    # after any context the letters' probabilities add up to less than 1, and nearly to it
    letters = np.unique(codes[who >= 0])
    tail = np.concatenate([np.concatenate([codes[40:43], [c]]) for c in letters]).astype(np.uint64)
    p = np.exp(models.score(tail)[3::4, 0]).sum()
    assert 0.98 < p <= 1.0001


def test_links_of_crowded_blocks():
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = np.array(sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for _ in range(300)}), "<u8")
    links = list(simhash._spanning(prints, 3))
    assert len(links) <= len(prints) - 1

    def parts(pairs):
        root = list(range(len(prints)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        return len(set(root))

    close = [(i, j) for i in range(len(prints)) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3]
    assert parts(links) == parts(close)


def test_groups_of_odd_rows(spark, odd):
    got = near_duplicates(odd).collect()
    zero = {r["component_id"] for r in got if r["fingerprint"] == 0}
    assert zero == {2}  # null, empty and blank texts are one group
    kept = drop_near_duplicates(odd).collect()
    assert sorted((r["doc_id"] for r in kept), key=lambda x: -1 if x is None else x) == [None, 1, 2, 4, 6]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200)], "a bigint, b bigint")
    got = dict(map(tuple, simhash.components(links).collect()))
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100}


def test_stages_take_odd_rows(spark, sf, odd, empty):
    for rows in (odd, empty):
        docs = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf)
            assert docs.columns[:5] == odd.columns
            docs.count()


def test_every_word_before_is_a_context_of_its_own(spark):
    """Words that share their last letters are told apart, in the probability of what follows them."""
    rows = [(k, f"{a}ing {b} " * 30) for k in range(40) for a, b in (("s", "left"), ("r", "right"))]
    docs = spark.createDataFrame([(1000 + k, t) for k, (_, t) in enumerate(rows)] + [(1, "sing left"), (2, "sing right")],
                                 "doc_id bigint, text string")
    for buckets in (1, 8):
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs, buckets=buckets).where("doc_id < 3").collect()}
        assert got[1] > got[2] + 1.5


def test_texts_without_hints_are_not_exchanged(spark):
    """The ledger and the findings are whole, but only texts that may hold a secret are sent."""
    texts = ["plain words " * 50, "PassWord = abcdefgh", "0123456789abcdef01234567", None, "plain words " * 50, "secret"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = docs.select("doc_id", may_match(F.col("text")).alias("may")).collect()
    assert [r["may"] for r in sorted(rows)] == [False, True, True, False, False, True]
    found, ledger = scan_secrets(docs)
    assert ledger.count() == 5 * len(RULES) and found.count() == 6
    assert {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in found.collect() if r["spans"]} == {1: ["assign"], 2: ["hex"]}
    free = (*RULES, SecretRule("any", 1, "plain"))
    assert {r["doc_id"] for r in scan_secrets(docs, rules=free)[0].where("size(spans) > 0").collect()} == {0, 1, 2, 4}
