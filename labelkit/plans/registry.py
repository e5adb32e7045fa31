"""Registered queries and the SQL that states the same result over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_HEX = "'0123456789abcdef','ppgiOOOOOOOOOOOO'"

# One annotator's type and score of a token, from the digits of ``h = md5(token)``.
MODEL_TYPE = f"""translate(CASE WHEN substr(h, 2 + 3 * model, 1) < '4'
    THEN substr(h, 3 + 3 * model, 1) ELSE substr(h, 1, 1) END, {_HEX})"""
MODEL_SCORE = "(instr('0123456789abcdef', substr(h, 4 + 3 * model, 1)) - 1) / 15.0"

# Shared parts of the SQL side; each may use those above it.
PARTS = {
    "docs": """SELECT doc_id, lang AS corpus, source AS archive, text,
        CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation'
             ELSE 'train' END AS split FROM documents""",
    "sents": """SELECT * EXCLUDE (text), unnest(string_split(text, '. ')) AS sent,
        generate_subscripts(string_split(text, '. '), 1) - 1 AS sent_no FROM docs""",
    "wds": r"""SELECT *, list_filter(regexp_split_to_array(sent, '\s+'), lambda x: x <> '') AS w
        FROM sents""",
    "tok": """SELECT * EXCLUDE (sent, w), unnest(w) AS token,
        generate_subscripts(w, 1) - 1 AS pos FROM wds""",
    "placed": """SELECT *, s AS "start", s + length(token) AS "end" FROM (
        SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, sent_no ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM tok)""",
    "typed": f"""SELECT *, md5(token) AS h, translate(substr(md5(token), 1, 1), {_HEX}) AS type
        FROM placed""",
    "gold": """SELECT *, CASE WHEN type = 'O' THEN 'O'
        WHEN lag(type) OVER (PARTITION BY doc_id, sent_no ORDER BY pos) = type
        THEN 'I-' || type ELSE 'B-' || type END AS tag FROM typed""",
    "voices": f"""SELECT * EXCLUDE (type), model, {MODEL_TYPE} AS type, {MODEL_SCORE} AS score
        FROM typed, (VALUES (0), (1), (2)) v(model)""",
    "said": """SELECT *, CASE WHEN type = 'O' THEN 'O'
        WHEN lag(type) OVER (PARTITION BY doc_id, sent_no, model ORDER BY pos) = type
        THEN 'I-' || type ELSE 'B-' || type END AS tag FROM voices""",
    "spans": """SELECT doc_id, sent_no, model, row_number() OVER (
            PARTITION BY doc_id, sent_no, model ORDER BY min(pos)) - 1 AS ord,
        min("start") AS "start", max("end") AS "end", string_agg(token, ' ' ORDER BY pos) AS word,
        any_value(type) AS label, round(avg(score), 6) AS score, min(pos) AS first,
        max(pos) AS last
        FROM (SELECT *, sum((tag LIKE 'B-%')::INT) OVER (
                PARTITION BY doc_id, sent_no, model ORDER BY pos) AS island
              FROM said WHERE true)
        WHERE type <> 'O' GROUP BY doc_id, sent_no, model, island""",
    "goldspans": """SELECT doc_id, sent_no, corpus, any_value(type) AS type, min(pos) AS first,
        max(pos) AS last
        FROM (SELECT *, sum((tag LIKE 'B-%')::INT) OVER (
                PARTITION BY doc_id, sent_no ORDER BY pos) AS island FROM gold)
        WHERE type <> 'O' GROUP BY doc_id, sent_no, corpus, island""",
    "ballots": """SELECT doc_id, sent_no, "start", "end", word, label, count(*) AS n,
        avg(score) AS score, min(model * 1000000 + ord) AS first FROM spans
        GROUP BY doc_id, sent_no, "start", "end", word, label""",
    "groups": """SELECT doc_id, sent_no, "start", "end", word, sum(n)::BIGINT AS n_votes,
        count(*) AS n_labels, min(first) AS first,
        (array_agg(label ORDER BY n DESC, score DESC,
            CASE WHEN n = 1 THEN first ELSE 0 END, label))[1] AS label,
        (array_agg(score ORDER BY n DESC, score DESC,
            CASE WHEN n = 1 THEN first ELSE 0 END, label))[1] AS score,
        max(n) AS n_top FROM ballots GROUP BY doc_id, sent_no, "start", "end", word""",
    "corp": """SELECT corpus, split, doc_id, sent_no, w, row_number() OVER (
        PARTITION BY corpus, split ORDER BY doc_id, sent_no) - 1 AS sentence_id
        FROM wds WHERE len(w) > 0""",
    "ctok": """SELECT g.*, c.sentence_id FROM gold g JOIN corp c USING (doc_id, sent_no)""",
    "ctags": """SELECT corpus, split, sentence_id, any_value(doc_id) AS doc_id,
        string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(tag, ' ' ORDER BY pos) AS tags,
        count(*) AS n FROM ctok GROUP BY corpus, split, sentence_id""",
    "ids": """SELECT *, list_position(['O','B-p','I-p','B-i','I-i','B-g','I-g','B-t','I-t',
        'B-o','I-o'], tag) - 1 AS id FROM gold""",
    "pieces": """SELECT *, unnest(range(ceil(length(token) / 4)::BIGINT)) AS piece FROM ids""",
    "pages_text": r"""SELECT doc_id, archive, list_filter(string_split(text, chr(10)),
        lambda x: x <> '') AS lines FROM docs""",
}


def with_parts(final: str) -> str:
    """``final`` with the parts it names, and those they name, in front."""
    wanted: set[str] = set()

    def need(sql: str) -> None:
        for name in PARTS:
            if name not in wanted and re.search(rf"\b{name}\b", sql):
                wanted.add(name)
                need(PARTS[name])

    need(final)
    parts = ", ".join(f"{name} AS ({sql})" for name, sql in PARTS.items() if name in wanted)
    return f"WITH {parts} {final}" if parts else final


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = with_parts(sql)
        return fn

    return register
