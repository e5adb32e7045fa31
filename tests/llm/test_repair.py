"""Conversation repair against a plain dynamic program over single rows."""

import hashlib
import random
import zlib

import pandas as pd
import pytest

from labelkit.llm import repair
from labelkit.llm.repair import audit_conversations, base_matrices, repair_conversations, rule_matrices, sequence_matrix
from labelkit.llm.searches import QUERIES

WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows):
    """Facts of one conversation's rows, and the cheapest edits by trying them from the right."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    kinds, seen = [], set()
    for _, _, role, text in rows:
        end = text.rstrip(WS)[-1:]
        kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    best = {q: (0, "") if q in (0, 3) else None for q in range(4)}

    def with_inserts(table):
        for _ in range(3):
            for q in range(4):
                to = 3 if q == 2 else 2
                if table[to] is not None:
                    new = (table[to][0] + 3, "I" + table[to][1])
                    table[q] = min(filter(None, (table[q], new)))
        return table

    best = with_inserts(best)
    for k in range(len(rows) - 1, -1, -1):
        new = {}
        for q in range(4):
            ways = [(best[q][0] + 4, "D" + best[q][1])] if best[q] else []
            more = 3 if kinds[k] == "truncated" else 0
            if kinds[k] not in ("blank", "duplicate"):
                if (to := step.get((initials[k], q))) is not None and best[to]:
                    ways.append((best[to][0] + more, "K" + best[to][1]))
                to = 3 if q == 2 else 2
                if best[to]:
                    ways.append((best[to][0] + more + 3, "R" + best[to][1]))
            new[q] = min(ways) if ways else None
        best = with_inserts(new)
    cost, audit = best[0]
    made, state, k = [], 0, 0
    for edit in audit:
        if edit in "IR":
            role, text = ("assistant" if state == 2 else "user"), "" if edit == "I" else rows[k][3]
        elif edit == "K":
            role, text = rows[k][2:]
        if edit != "D":
            made.append((role, text))
            state = 1 if role[0] == "s" else 2 if role[0] == "u" else 3
        k += edit != "I"
    return ((max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()), made


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, piece int"


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(" " if x is None and k > 1 else x for k, x in enumerate(r[:4])))
    return out


def sample(rng, n):
    texts = ["Yes.", "No", "  ", "", "Why?", "So!\n", None, "x" * 20_000 + ".", "é ü"]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 3, None]), role,
                         rng.choice(texts) if rng.random() < 0.5 else f"text {turn}.", "c", 1))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_query(spark, sf):
    rows = [tuple(r) for r in pd.read_parquet(f"{sf}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    after = by_conversation(damaged(rows))
    want = {c: brute(after.get(c, []))[0] for c in {r[0] for r in rows}}
    got = QUERIES["op13_conversation_repair"](spark, sf).toPandas()
    assert {r.conv_id: tuple(getattr(r, f) for f in FACTS) for r in got.itertuples()} == want


@pytest.mark.parametrize("segment", [2, 4096])
def test_odd_rows(spark, monkeypatch, segment):
    """Null ids, turns, roles and texts, ties, repeats, long texts, unknown roles, clashing names."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = sample(random.Random(3), 60)
    want = {c: brute(r) for c, r in by_conversation(rows).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r[f] for f in FACTS) for r in audit_conversations(df).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    made = {}
    for r in repair_conversations(df).orderBy("place").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    assert made == {c: w[1] for c, w in want.items() if w[1]}


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """It is cut into segments, dealt to several tasks, and its copies are counted, not listed."""
    monkeypatch.setattr(repair, "SEGMENT", 50)
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!", f"{t}?"]), "", 0) for t in range(600)]
    rows += [(7, 100, "user", "again.", "", 0)] * 300
    got = audit_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r[f] for f in FACTS) for r in got] == [brute(by_conversation(rows)[7])[0]]


def test_grammar_changes_nothing():
    """Products over rules equal products over single symbols."""
    rng, rules = random.Random(2), ["ua", "xx", "\ue000\ue000", "Au", "\ue001x"]
    with_rules, without = rule_matrices(rules), base_matrices()
    for _ in range(60):
        s = "".join(rng.choice("suaoSUAOxua") for _ in range(rng.randint(1, 30)))
        a, b = sequence_matrix(s, rules, with_rules), sequence_matrix(s, [], without)
        assert {k: (c, repair.flat(r)) for k, (c, r) in a.items()} == {k: (c, repair.flat(r)) for k, (c, r) in b.items()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit_conversations(empty).count() == 0 == repair_conversations(empty).count()
