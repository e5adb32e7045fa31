"""Phrase mining against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from labelkit.llm import phrases
from labelkit.llm.phrases import Trie, mine_phrases, walk

SCHEMA = "doc_id bigint, text string, lang string, word int, phrase string, n int"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            totals[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    key = lang, tuple(ws[i:i + k])
                    counts[key] = counts.get(key, 0) + 1
    often = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, ws), f in often.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                if 100 * f >= 80 * often[lang, ws[i:i + k]]:
                    gone.add((lang, ws[i:i + k]))
    out = []
    for lang in totals:
        mine = []
        for (of, ws), a in often.items():
            if of == lang and (of, ws) not in gone:
                cuts = [(2_000_000 * a // (counts[of, ws[:k]] + counts[of, ws[k:]]), k) for k in range(1, len(ws))]
                score, k = min(cuts)
                mine.append((-score, -a, " ".join(ws).encode(), counts[of, ws[:k]], counts[of, ws[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def ours(spark, rows, **options):
    df = spark.createDataFrame([(1, text, lang, 5, "p", 6) for lang, text in rows], SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in mine_phrases(df, **options).collect())


def sample(n):
    rng = random.Random(4)
    names = ["a", "b", "c", "dd", "É", "x|y", "the", "Of"]
    texts = ["".join(rng.choice(names) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 40)))
             for _ in range(n)]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), t) for t in texts]
    return [*rows, rows[0], rows[0], ("en", None), ("en", ""), ("fr", "one two"), ("de", "q w e r t " * 3000)]


@pytest.mark.parametrize("options", [{}, {"most_words": 5, "most_phrases": 40}])
def test_against_brute_force(spark, monkeypatch, options):
    """Also with text, words and phrases in many parts: nothing depends on their sizes."""
    rows = sample(150)
    if options:
        monkeypatch.setattr(phrases, "_BLOCK", 200)
        monkeypatch.setattr(phrases, "_ROW", 50)
    assert ours(spark, rows, least=3, top=40, **options) == brute(rows, 3, 40)


def test_nothing_frequent(spark):
    assert ours(spark, [("en", "one two three")]) == [] == ours(spark, [])
    assert ours(spark, [("en", "one. two. one. two.")], least=2) == []


def test_trie():
    """States of all positions, moved at once, stand where the phrases do."""
    rng = np.random.default_rng(1)
    codes = rng.integers(-1, 40, 20_000)
    want = {}
    level = {(w,): w for w in range(40)}
    trie, states = Trie(40), {(w,): w + 1 for w in range(40)}
    for depth in (2, 3):
        grams = {tuple(codes[i:i + depth].tolist()) for i in range(len(codes) - depth + 1)}
        grams = sorted(g for g in grams if min(g) >= 0 and g[:-1] in level and (depth == 2 or sum(g) % 3))
        ids = np.arange(len(grams)) + 1000 * depth
        trie.add_level(np.array([states[g[:-1]] for g in grams]), np.array([g[-1] for g in grams]), ids)
        level = dict(zip(grams, ids.tolist(), strict=True))
        closed = trie.closed()
        at, state = walk(codes, closed)
        want = {i: level[g] for i in range(len(codes) - depth + 1) if (g := tuple(codes[i:i + depth].tolist())) in level}
        assert dict(zip(at.tolist(), closed[2][state].tolist(), strict=True)) == want
        name = {n: s for s, n in enumerate(closed[2].tolist()) if n >= 0 and s > 40}
        states = {g: name[n] for g, n in level.items()}
