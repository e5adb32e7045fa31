"""Queries of exact search, phrases and conversation repair, and SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm.common import LOWER, UPPER, table
from labelkit.llm.phrases import mine_phrases
from labelkit.llm.repair import audit_conversations, damage
from labelkit.llm.voronoi import top_inner_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# ---- 11: exact top-k search

def op11_voronoi_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return top_inner_products(vectors.where("vec_id % 50 = 0"), vectors).withColumnRenamed("id", "vec_id")


QUERIES["op11_voronoi_topk"] = op11_voronoi_topk
ORACLES["op11_voronoi_topk"] = """
WITH v AS (SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
    FROM v q JOIN v d ON q.no <> d.no WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


# ---- 12: phrases

def op12_phrase_mining(spark: SparkSession, sf: str) -> DataFrame:
    return mine_phrases(table(spark, sf, "documents"))


QUERIES["op12_phrase_mining"] = op12_phrase_mining
ORACLES["op12_phrase_mining"] = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
        '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT doc, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS no FROM d),
w AS (SELECT doc, lang, no, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT doc, lang, no, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
four AS (SELECT lang, word AS w1, w1 || ' ' || lead(word) OVER o AS w2, w2 || ' ' || lead(word, 2) OVER o AS w3,
        w3 || ' ' || lead(word, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY doc, no ORDER BY pos)),
g AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM four GROUP BY ALL
    UNION ALL SELECT lang, 2, w2, count(*) FROM four WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 3, w3, count(*) FROM four WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 4, w4, count(*) FROM four WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, v.k, x.f AS l, y.f AS r,
        ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score FROM c JOIN (VALUES (1), (2), (3)) v(k) ON v.k < size
        JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:v.k], ' ')
        JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[v.k + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t ON s.lang = t.lang AND t.size > s.size
        AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * t.a >= 80 * s.a),
r AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
        FROM low ANTI JOIN inner_ USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000"""


# ---- 13: conversation repair

def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    found = audit_conversations(damage(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").select("conv_id", *[
        F.coalesce(c, empty.get(c, F.lit(0).cast("bigint"))).alias(c) for c in found.columns if c != "_conv"])


QUERIES["op13_conversation_repair"] = op13_conversation_repair
