"""Queries over raw text: splitting, words, chunks, page XML, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelkit import functions as L
from labelkit.functions.text import ABBREVIATIONS
from labelkit.operators import conll_to_tokens as block_tokens
from labelkit.operators import filter_blank, filter_min_fields, split_by_learned_forms, tags_of_lines
from labelkit.operators import short_forms as learned_forms
from labelkit.operators.stats import count_tags, count_tags_total
from labelkit.plans.bridge import (doc_sentences, doc_tokens, documents, gold_tags, page_xml, region_page_xml,
                                   table, token_type)
from labelkit.plans.registry import query


@query("SELECT archive, type AS tag, count(*) AS n FROM typed GROUP BY archive, type")
def tag_counts(spark, sf):
    tags = doc_tokens(spark, sf).select("archive", token_type(F.col("token")).alias("tag"))
    return count_tags(tags, counted=["p", "g", "i", "O"])


@query("""SELECT tag, archive, count(*) AS n FROM (SELECT archive, type AS tag FROM typed)
    GROUP BY ROLLUP (tag, archive)""")
def tag_counts_rollup(spark, sf):
    tags = doc_tokens(spark, sf).select("archive", token_type(F.col("token")).alias("tag"))
    return count_tags_total(tags, counted=["p", "g", "i", "O"])


@query(r"""SELECT archive, tag, count(*) AS n FROM (
    SELECT archive, regexp_extract(trim(line, E' \t\r'), '\S+$') AS tag FROM (
        SELECT archive, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE trim(line, E' \t\r') <> '') GROUP BY archive, tag""")
def last_field_counts(spark, sf):
    tags = tags_of_lines(documents(spark, sf))
    return tags.groupBy("archive", "tag").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sent_no, pos, token FROM tok")
def ws_tokens(spark, sf):
    return doc_tokens(spark, sf).select("doc_id", "sent_no", "pos", "token")


@query(r"""SELECT 'document' AS kind, doc_id AS id, trim(text, E' \t\r\n') AS text FROM documents
    UNION ALL SELECT 'turn', conv_id * 1000 + turn, trim(text, E' \t\r\n') FROM conversations""")
def ws_strip(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "text")
    return docs.unionByName(turns).withColumn("text", L.ws_strip(F.col("text")))


@query("SELECT doc_id, sent_no, sent FROM sents")
def split_sentences(spark, sf):
    return doc_sentences(spark, sf).select("doc_id", "sent_no", "sent")


# An abbreviation's period is masked by chr(2), in two passes since neighbours share a
# character; cuts become chr(1).
_SHORT = rf"(^|[^\p{{L}}\p{{N}}])(\p{{Lu}}|{'|'.join(ABBREVIATIONS)})\."
RULE_SENTENCES = rf"""SELECT doc_id, list_filter(list_transform(string_split(replace(
    regexp_replace(regexp_replace(regexp_replace(text,
        '{_SHORT}', '\1\2' || chr(2), 'g'), '{_SHORT}', '\1\2' || chr(2), 'g'),
        '([.!?…])\s+(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(2), '.'), chr(1)),
    lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS ss FROM docs"""


@query(f"""SELECT doc_id, unnest(ss) AS sent, generate_subscripts(ss, 1) - 1 AS sent_no
    FROM ({RULE_SENTENCES})""")
def split_sentences_rule(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.posexplode(L.split_sentences(F.col("text"))).alias("sent_no", "sent"))


_WORD = r"'^[^\p{L}\p{N}]*(\p{L}+(?:\.\p{L}+)*)(\.?)[^\p{L}\p{N}.]*$'"
SHORT_FORMS = rf"""SELECT lang, word, n_dot, n_plain, n_inside, score,
        score >= 10.83 AND n_plain * 9 <= n_dot AND (n_inside * 10 >= n_dot OR length(word) <= 4) AS is_short FROM (
    SELECT *, CASE WHEN n_dot * al > dots * (n_dot + n_plain) THEN 2 * (n_dot * ln((n_dot / (n_dot + n_plain)) / (dots / al))
        + CASE WHEN n_plain > 0 THEN n_plain * ln((1 - n_dot / (n_dot + n_plain)) / (1 - dots / al)) ELSE 0 END) ELSE 0 END AS score
    FROM (SELECT *, sum(n_dot) OVER (PARTITION BY lang) AS dots, sum(n_dot + n_plain) OVER (PARTITION BY lang) AS al FROM (
        SELECT lang, word, count(*) FILTER (dot) AS n_dot, count(*) FILTER (NOT dot) AS n_plain,
            count(*) FILTER (dot AND inside) AS n_inside FROM (
                SELECT lang, lower(regexp_extract(w, {_WORD}, 1)) AS word, regexp_extract(w, {_WORD}, 2) = '.' AS dot,
                    regexp_matches(after, '^\p{{Ll}}') AS inside FROM (
                    SELECT lang, unnest(ws) AS w, unnest(list_concat(ws[2:], [''])) AS after FROM (
                        SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(text, '\s+'),
                            lambda x: x <> '') AS ws FROM documents)))
        WHERE word <> '' GROUP BY lang, word)) WHERE n_dot >= 5)"""


@query(f"""SELECT lang, word, n_dot, n_plain, n_inside, round(score, 3) AS score, is_short::INT AS is_short
    FROM ({SHORT_FORMS})""")
def short_forms(spark, sf):
    """Words with periods, and which of them are short forms, learned from all documents."""
    return learned_forms(table(spark, sf, "documents")).select(
        "lang", "word", "n_dot", "n_plain", "n_inside", F.round("score", 3).alias("score"), F.col("is_short").cast("int"))


@query(rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS sent_no, sent FROM (
    SELECT doc_id, g, trim(string_agg(piece, '' ORDER BY i), E' \t\r\n') AS sent FROM (
        SELECT *, coalesce(sum((NOT stays)::INT) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM (
            SELECT p.*, last <> '' AND (f.word IS NOT NULL OR regexp_matches(last, '^\p{{Lu}}$')) AS stays FROM (
                SELECT *, regexp_extract(piece, '(^|[^\p{{L}}\p{{N}}.])(\p{{L}}+(?:\.\p{{L}}+)*)\.$', 2) AS last FROM (
                    SELECT doc_id, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
                        SELECT doc_id, coalesce(lang, 'und') AS lang, string_split(regexp_replace(text,
                            '([.!?…])(\s+\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM documents))) p
            LEFT JOIN ({SHORT_FORMS}) f ON f.is_short AND f.lang = p.lang AND f.word = lower(p.last)))
    GROUP BY doc_id, g) WHERE sent <> ''""")
def split_sentences_learned(spark, sf):
    """Sentences by the short forms that the documents of each language teach."""
    docs = table(spark, sf, "documents")
    return split_by_learned_forms(docs, learned_forms(docs)).select(
        "doc_id", F.posexplode("sentences").alias("sent_no", "sent"))


@query(r"SELECT doc_id, sent_no, pos, regexp_replace(token, '\.$', '') AS token FROM tok")
def strip_final_period(spark, sf):
    return doc_tokens(spark, sf).select(
        "doc_id", "sent_no", "pos", L.strip_final_period(F.col("token")).alias("token"))


@query("SELECT doc_id, sent_no, array_to_string(w, ' ') AS sentence FROM wds")
def join_tokens(spark, sf):
    return doc_sentences(spark, sf).select(
        "doc_id", "sent_no", L.join_tokens(F.col("words")).alias("sentence"))


@query(r"""SELECT doc_id, pos, token, s + lead AS "start", s + lead + length(token) AS "end" FROM (
    SELECT doc_id, pos, token, length(gaps[1]) AS lead,
        coalesce(sum(length(token) + length(gaps[pos + 2])) OVER (
            PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            0)::BIGINT AS s
    FROM (SELECT doc_id, gaps, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (
        SELECT doc_id, regexp_split_to_array(text, '\S+') AS gaps,
            list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM docs)))""")
def word_positions(spark, sf):
    words = F.posexplode(L.word_positions(F.col("text"))).alias("pos", "_w")
    return documents(spark, sf).select("doc_id", words).select(
        "doc_id", "pos", "_w.token", "_w.start", "_w.end")


CHUNK_FOLD = """list_reduce(list_transform(w, lambda x: {'n': length(x)::BIGINT, 'c': 0::BIGINT,
        'cs': [0::BIGINT]}), lambda a, x: CASE WHEN a.n + x.n + 1 > 512
        THEN {'n': x.n, 'c': a.c + 1, 'cs': list_append(a.cs, a.c + 1)}
        ELSE {'n': a.n + x.n + 1, 'c': a.c, 'cs': list_append(a.cs, a.c)} END,
        {'n': 0::BIGINT, 'c': 0::BIGINT, 'cs': []::BIGINT[]}).cs"""


@query(f"""SELECT doc_id, chunk - min(chunk) OVER (PARTITION BY doc_id) AS chunk_no,
        min(pos) AS first_word, coalesce(sum(sum(length(token) + 1)) OVER (
            PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            0)::BIGINT AS "offset", string_agg(token, ' ' ORDER BY pos) AS text
    FROM (SELECT doc_id, unnest(w) AS token, unnest(cs) AS chunk,
            generate_subscripts(w, 1) - 1 AS pos
          FROM (SELECT doc_id, w, {CHUNK_FOLD} AS cs FROM (
            SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')
                AS w FROM docs)))
    GROUP BY doc_id, chunk""")
def chunk_words(spark, sf):
    chunks = F.inline(L.chunk_words(L.ws_tokens(F.col("text"))))
    return documents(spark, sf).select("doc_id", chunks).select(
        "doc_id", "chunk_no", "first_word", "offset",
        L.join_tokens(F.col("words")).alias("text"))


@query(f"""SELECT doc_id, pos - min(pos) OVER (PARTITION BY doc_id, chunk) AS ord, chunk - min(chunk)
        OVER (PARTITION BY doc_id) AS chunk_no, s AS "start", s + length(token) AS "end" FROM (
    SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
    FROM (SELECT doc_id, unnest(w) AS token, unnest(cs) AS chunk,
            generate_subscripts(w, 1) - 1 AS pos
          FROM (SELECT doc_id, w, {CHUNK_FOLD} AS cs FROM (
            SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')
                AS w FROM docs))))""")
def shift_spans(spark, sf):
    """Chunk-relative word spans moved to their place in the whole text."""
    chunks = documents(spark, sf).select(
        "doc_id", F.inline(L.chunk_words(L.ws_tokens(F.col("text")))))
    moved = L.shift_spans(L.joined_positions(F.col("words")), F.col("offset"))
    return chunks.select("doc_id", "chunk_no", F.posexplode(moved).alias("ord", "_s")).select(
        "doc_id", "chunk_no", "ord", "_s.start", "_s.end")


@query("""SELECT doc_id, lost, CASE WHEN lost = 0 THEN array_to_string(lines, ' ') END AS text
    FROM pages_text, (VALUES (0), (9)) v(lost)""")
def page_xml_text(spark, sf):
    """Every page whole and cut short: the text of one, nothing of the other."""
    pages = documents(spark, sf).select("doc_id", page_xml(F.col("text")).alias("page"),
                                        F.explode(F.array(F.lit(0), F.lit(9))).alias("lost"))
    whole = F.left("page", F.length("page") - F.col("lost"))
    return pages.select("doc_id", "lost", L.page_xml_text(whole).alias("text"))


@query("""SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no
    FROM pages_text""")
def page_xml_lines(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(
        L.page_xml_lines(page_xml(F.col("text")))).alias("line_no", "line"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY (r + 1) % 3) - 1 AS place, 'r' || r AS region, n,
        replace(replace(joined, '-' || chr(10), ''), chr(10), ' ') AS text
    FROM (SELECT doc_id, (i - 1) % 3 AS r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS joined
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs) WHERE line <> '' GROUP BY ALL)""")
def page_xml_regions(spark, sf):
    """Regions that stand on the page in another order than they are read."""
    pages = documents(spark, sf).select("doc_id", L.page_xml_regions(region_page_xml(F.col("text"))).alias("r"))
    return pages.select("doc_id", F.posexplode("r").alias("place", "r")).select(
        "doc_id", "place", "r.region", F.size("r.lines").cast("bigint").alias("n"), "r.text")


@query("""SELECT doc_id, sent_no, string_agg(tag, ' ' ORDER BY pos) AS tags FROM gold
    GROUP BY doc_id, sent_no""")
def tags_from_lines(spark, sf):
    """Tags read back from the text blocks of labelled sentences."""
    sentences = doc_sentences(spark, sf).where(F.size("words") > 0)
    block = F.array_join(F.zip_with("words", gold_tags(F.col("words")),
                                    lambda w, t: F.concat_ws(" ", w, t)), "\n")
    return sentences.select("doc_id", "sent_no", F.array_join(
        L.tags_from_lines(block), " ").alias("tags"))


@query(r"""SELECT doc_id, sentence_id, pos, word, tag FROM (
    SELECT doc_id, (sum((len(f) = 0 OR line LIKE '-DOCSTART-%')::INT)
            OVER (PARTITION BY doc_id ORDER BY i) + 1)::BIGINT AS sentence_id,
        line LIKE '-DOCSTART-%' AS head, f, f[1] AS word, f[2] AS tag,
        row_number() OVER (PARTITION BY doc_id, grp ORDER BY i) - 1 AS pos
    FROM (SELECT *, sum((len(f) = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp,
            len(f) = 0 AS blank FROM (
        SELECT doc_id, i, line, list_filter(regexp_split_to_array(line, '\s+'),
            lambda x: x <> '') AS f
        FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (
            SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs))))
    WHERE true QUALIFY NOT blank) WHERE NOT head""")
def conll_to_tokens(spark, sf):
    """Every line of a document read as a token line, its first two words as the fields."""
    return block_tokens(documents(spark, sf).select("doc_id", "text"))


@query("""SELECT archive || '/' || doc_id || '.conll' AS name,
    replace(archive, '/', '_') || '_' || doc_id || '.conll' AS flat_name FROM docs""")
def output_name(spark, sf):
    path = F.concat_ws("/", "archive", F.concat(F.col("doc_id").cast("string"), F.lit(".xml")))
    return documents(spark, sf).select(
        L.output_name(path).alias("name"), L.flat_output_name(path).alias("flat_name"))


@query(r"""SELECT doc_id, sent_no, sent || gap AS sent FROM (
        SELECT doc_id, sent_no, sent, w, '' AS gap FROM wds
        UNION ALL SELECT doc_id, sent_no, '', [], chr(160) || ' ' || chr(9) FROM wds) WHERE len(w) > 0""",
       name="filter_blank")
def _filter_blank(spark, sf):
    """Every sentence followed by a line of blanks, which has to go."""
    both = F.array(F.col("sent"), F.lit("\u00a0 \t"))
    rows = doc_sentences(spark, sf).select("doc_id", "sent_no", F.explode(both).alias("sent"))
    return filter_blank(rows, "sent")


@query("""SELECT doc_id, line_no, line FROM (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (
        SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs))
    WHERE len(string_split(line, ' ')) >= 4""", name="filter_min_fields")
def _filter_min_fields(spark, sf):
    lines = documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return filter_min_fields(lines, 4, sep=" ")
