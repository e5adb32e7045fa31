"""Registered queries of the training-text operators: against SQL, or against plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
import xxhash
from compare import connect, difference

from labelkit.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def texts(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, sf, db, name):
    assert difference(QUERIES[name](spark, sf).toPandas(), db.execute(ORACLES[name]).df()) is None


def test_leaks(spark, sf, texts):
    """A document leaks an item if half of its five-word windows stand in it, one after another."""
    def windows(t):
        w = re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*|[%€$£]", t.lower())
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    items = {r.item_id: windows(r.text) for r in pd.read_parquet(f"{sf}/benchmark.parquet").itertuples()}
    where = defaultdict(list)
    for item, ws in items.items():
        for k, w in enumerate(ws):
            where[w].append((item, k))
    want = set()
    for doc, text in texts.text.items():
        found = defaultdict(set)
        for w in windows(text):
            for item, k in where.get(w, ()):
                found[item].add(k)
        want |= {(doc, item) for item, ks in found.items() if len(ks) >= len(items[item]) / 2}
    got = QUERIES["op1_template_leaks"](spark, sf).toPandas()
    assert set(zip(got.doc_id, got.item_id, strict=True)) == want and len(want) >= 3


KINDS = {"assign": r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def test_secrets(spark, sf, texts):
    got = QUERIES["op4_secret_ledger"](spark, sf).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(texts.index)
    least = {"assign": 6, "access": 20, "hex": 24}
    for doc, text in texts.text.items():
        spans = []
        for order, (kind, pattern) in enumerate(KINDS.items()):
            for m in re.finditer(pattern, text):
                if len(m[2] if kind == "assign" else m[0]) >= least[kind]:
                    spans.append((m.start(), order, kind, m.end()))
        written = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        row = got.loc[doc]
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), doc
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[2] == k for s in spans) for k in KINDS]
        assert set(filter(None, written.split(","))) <= set(row.spans.split(","))


def test_warc(spark, sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    got = QUERIES["op6_warc_captures"](spark, sf).toPandas().set_index("page_id")
    largest = pages.groupby("html").page_id.max()
    assert len(got) == len(pages)
    for page in pages.itertuples():
        row, payload, first = got.loc[page.page_id], page.html.encode(), largest[page.html]
        assert row.payload_bytes == len(payload)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert row.record_type == ("response" if first == page.page_id else "revisit")
        assert pd.isna(row.refers_to) if first == page.page_id else row.refers_to == first


def test_language_model(spark, sf, texts):
    got = QUERIES["op7_pitman_yor"](spark, sf).toPandas().set_index("doc_id")
    tokens = {d: t.encode().lower().split() + [None] for d, t in texts.text.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in tokens.items():
        row = got.loc[d]
        assert row.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (
            len(ws), sum(count[w] > 0 for w in ws), n, held[d])
    unseen = got[got.held_out]
    assert unseen.score.sum() > unseen.base_score.sum()
    assert got[~got.held_out].score.sum() > got[~got.held_out].base_score.sum()


def test_language_id(spark, sf, texts):
    got = QUERIES["op8_language_id"](spark, sf).toPandas().set_index("doc_id")
    assert all(got.held_out[d] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got.index)
    unseen = got[got.held_out].join(texts.lang)
    assert (unseen.lang_pred == unseen.lang).mean() >= 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def brute_fingerprint(text):
    ws = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(prints)
    for k, a in enumerate(docs):
        for b in docs[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


def test_simhash(spark, sf, texts):
    got = QUERIES["op9_simhash_groups"](spark, sf).toPandas().set_index("doc_id")
    prints = {d: brute_fingerprint(t) for d, t in texts.text.items()}
    assert dict(got.fingerprint) == {d: f"{p:016x}" for d, p in prints.items()}
    assert dict(got.component_id) == brute_components(prints)


def test_every_sql_runs_alone():
    assert not [n for n in ORACLES if n not in QUERIES] and duckdb
