"""The operators over the given tables, and SQL that states the same results."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.llm import searches
from labelkit.llm.chat import format_turns, read_back
from labelkit.llm.common import LOWER, UPPER, table
from labelkit.llm.decontaminate import NAME_RUN, TOKEN, UNIT_AFTER, find_leaks
from labelkit.llm.langid import identify_languages
from labelkit.llm.licenses import LICENSE_WORD, PHRASES, TEMPLATES, _split, scan_licenses
from labelkit.llm.mixing import mixing_copies
from labelkit.llm.pitman_yor import score_texts
from labelkit.llm.quality import LineRules, clean_lines
from labelkit.llm.secrets import BASE_KINDS, RULES, scan_secrets
from labelkit.llm.simhash import near_duplicates
from labelkit.llm.warc import assemble, read_warc, write_warc
from labelkit.folders import saved, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

W = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


# ---- 2: license scans

def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def _license_sql(threshold: float = 0.9) -> str:
    stride = max(len(_split(body)) for _, body in TEMPLATES)
    templates = ", ".join(f"({t}, {quoted(label)}, {_list(dict.fromkeys(_split(body)))})"
                          for t, (label, body) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({quoted(label)}, {quoted(p)})" for label, p in PHRASES)  # of up to 4 words
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '{LICENSE_WORD}') AS ws FROM documents),
tok AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
tmpl AS (SELECT t AS id, label, unnest(ws) AS word, len(ws) AS size FROM (VALUES {templates}) AS v(t, label, ws)),
hit AS (SELECT DISTINCT doc_id, word, b FROM (
        SELECT doc_id, word, n, unnest([pos // {stride}, pos // {stride} - 1]) AS b FROM tok
        WHERE word IN (SELECT word FROM tmpl)) WHERE b BETWEEN 0 AND greatest(n - {stride} - 1, 0) // {stride}),
found AS (SELECT doc_id, label, count(*) / max(size)::DOUBLE AS share FROM hit JOIN tmpl USING (word)
        GROUP BY doc_id, b, id, label HAVING count(*) >= ceil({threshold} * max(size) - 1e-9)),
run AS (SELECT doc_id, pos, word || coalesce(' ' || lead(word) OVER o, '') AS w2,
        coalesce(lead(word, 2) OVER o, '') AS third, coalesce(lead(word, 3) OVER o, '') AS fourth
        FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
placed AS (SELECT doc_id, label, pos AS place FROM run, (VALUES {phrases}) AS v(label, p)
        WHERE starts_with(w2 || ' ' || third || ' ' || fourth || ' ', p || ' ')),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM placed GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (
        SELECT doc_id, label, share FROM found UNION ALL SELECT doc_id, label, 1.0 FROM placed) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)"""


QUERIES["op2_license_scan"] = op2_license_scan
ORACLES["op2_license_scan"] = _license_sql()


# ---- 3: mixing

def op3_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing_copies(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES["op3_source_mix"] = op3_source_mix
ORACLES["op3_source_mix"] = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, [5.0, 2.0, 1.0]::DOUBLE[] AS ws,
        row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
r AS (SELECT source, size, ws[(k - 1) % 3 + 1] AS weight, size * 3.0::DOUBLE / ws[(k - 1) % 3 + 1] AS ratio FROM s),
l AS (SELECT *, ((sum(size) OVER ())::DOUBLE - coalesce(sum(size * 3.0::DOUBLE) OVER earlier, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level FROM r
        WINDOW earlier AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, size AS source_size, least(weight * coalesce(
        (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 0), size * 3.0::DOUBLE) AS target FROM l),
u AS (SELECT doc_id, source, size, floor(('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
        / 4503599627370496.0::DOUBLE * 4096)::BIGINT AS bin FROM d),
q AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE)
        ELSE 0 END AS rate FROM t),
b AS (SELECT source, bin, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS so_far FROM u GROUP BY source, bin),
x AS (SELECT q.source, abs(so_far::DOUBLE - (rate - floor(rate)) * source_size) AS off, bin + 1 AS below
        FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source
        UNION ALL SELECT source, abs((rate - floor(rate)) * source_size), 0 FROM q),
k AS (SELECT source, arg_min(below, (off, below)) AS below FROM x GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (bin < below)::INT))::BIGINT AS taken
FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source JOIN k ON u.source IS NOT DISTINCT FROM k.source"""


# ---- 5: quality rules

def op5_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    return clean_lines(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "lost", "lines_lost")


def _quality_sql(r: LineRules = LineRules()) -> str:
    b = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, regexp_extract_all(text, '{W}') AS ws,
        length(regexp_replace(text, '{b}', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{W}')) AS ls FROM d),
tok AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM f),
win AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS s FROM tok
        WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
win2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win WHERE s IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win2 WHERE n > 1) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(ls) AS x FROM f),
part AS (SELECT doc_id, x, len(regexp_extract_all(x, '{W}')) AS n, length(regexp_replace(x, '{b}', '', 'g')) AS chars,
        len(regexp_extract_all(x, '[#*$%&|<>]')) AS symbols,
        len(list_filter(regexp_extract_all(x, '{W}'), lambda w: w IN ({", ".join(map(quoted, r.separators))}))) AS seps
        FROM line),
gone AS (SELECT doc_id, sum(chars) AS chars_lost, count(*) AS lines_lost FROM part
        WHERE symbols > {r.symbol_share} * chars OR seps >= greatest(2, ceil({r.menu_share} * n))
        OR regexp_matches(x, {quoted(r.menu_words)}) OR regexp_matches(x, {quoted(r.boilerplate)})
        OR (contains(x, {quoted(r.shout)}) AND NOT regexp_matches(x, {quoted(r.small_letter)})
            AND regexp_matches(x, {quoted(r.capitals)})) OR (n < {r.long_line} AND NOT regexp_matches(x, {quoted(r.ending)}))
        GROUP BY doc_id),
e AS (SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
        CASE WHEN word_chars > 0 THEN coalesce(chars_lost, 0) / word_chars::DOUBLE ELSE 0 END AS lost,
        coalesce(lines_lost, 0)::BIGINT AS lines_lost
        FROM f LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM e)
SELECT *, NOT base_failed AND lost <= {r.most_lost} AS kept FROM g"""


QUERIES["op5_line_quality"] = op5_line_quality
ORACLES["op5_line_quality"] = _quality_sql()


# ---- 10: chat formatting

def op10_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return read_back(format_turns(rows), in_order=True).withColumnRenamed("conv", "conv_id")


QUERIES["op10_chat_format"] = op10_chat_format
ORACLES["op10_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c),
m AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END AS fine FROM o)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('### : ' || role || text || ' </turn>' || chr(10)) + len(regexp_extract_all(text, '[\\#/]')))::BIGINT
        AS formatted_chars,
    bool_and(fine) AND last(role ORDER BY turn, role, text) = 'assistant' AS valid
FROM m GROUP BY conv_id"""

# ---- 1: decontamination

def op1_template_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _leak_sql(least_share: float = 0.5, least_literal: int = 3) -> str:
    first = "substr(token, 1, 1)"
    slot = f"({first} <= chr(4) OR {first} BETWEEN '0' AND '9' OR {first} IN ('%', '€', '$', '£'))"
    kind = (f"CASE WHEN {first} BETWEEN '0' AND '9' THEN '0' WHEN {first} = chr(2) THEN {{name}} "
            f"WHEN {first} = chr(4) OR {first} IN ('%', '€', '$', '£') THEN chr(4) ELSE token END")
    plain = "replace(replace(token, chr(2), ''), chr(3), '')"
    forms = [(kind.format(name="chr(2)"), slot), (kind.format(name=plain), f"({slot} AND {first} <> chr(2))")]

    def ahead(column: str) -> str:
        return ", ".join([column, *(f"lead({column}, {k}) OVER o" for k in range(1, 5))])

    windows = " UNION ".join(f"""
        SELECT side, id, pos, key, slots, words FROM (SELECT side, id, pos, concat_ws('|', {ahead("kind")}) AS key,
            concat_ws(chr(10), {ahead("val")}) AS slots, lead(kind, 4) OVER o AS full_window,
            sum(word) OVER (PARTITION BY side, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS words
        FROM (SELECT *, {k} AS kind, CASE WHEN {v} THEN token END AS val, (NOT {slot})::INT AS word FROM tok)
        WINDOW o AS (PARTITION BY side, id ORDER BY pos)) WHERE full_window IS NOT NULL""" for k, v in forms)
    return rf"""
WITH src AS (SELECT 'doc' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark),
marked AS (SELECT side, id, lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x02\x03\x04]', ' ', 'g'),
        '{NAME_RUN}', '\1' || chr(2) || '\2' || chr(3), 'g'), '{UNIT_AFTER}', '\1 ' || chr(4) || '\2\3', 'g')) AS t FROM src),
tok AS (SELECT side, id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos
        FROM (SELECT side, id, regexp_extract_all(t, '{TOKEN}') AS ts FROM marked)),
win AS ({windows}),
items AS (SELECT *, count(DISTINCT pos) OVER (PARTITION BY id) AS n_windows FROM win WHERE side = 'item'
        AND words >= {least_literal}),
hits AS (SELECT *, unnest([spot // (n_windows + 4), spot // (n_windows + 4) - 1]) AS stretch FROM (
        SELECT d.id AS doc_id, i.id AS item_id, n_windows, i.pos AS place, d.pos AS spot, d.pos - i.pos AS shift,
            i.slots AS item_slots, d.slots AS slots FROM win d JOIN items i USING (key) WHERE d.side = 'doc')),
pairs AS (SELECT DISTINCT doc_id, item_id, stretch, shift, unnest(string_split(item_slots, chr(10))) AS i,
        unnest(string_split(slots, chr(10))) AS d FROM hits WHERE slots <> ''),
fits AS (SELECT doc_id, item_id, stretch, shift, count(DISTINCT i) = count(*) AND count(DISTINCT d) = count(*) AS fit,
        bool_or(i <> d) AS changed FROM pairs GROUP BY ALL),
held AS (SELECT doc_id, item_id, stretch, n_windows, count(DISTINCT place) AS matched,
        bool_or(coalesce(fit AND changed, false)) AS changed
        FROM hits LEFT JOIN fits USING (doc_id, item_id, stretch, shift) WHERE slots = '' OR fit GROUP BY ALL)
SELECT doc_id, item_id, n_windows, max(matched) AS matched, max(matched) / n_windows::DOUBLE AS share,
    arg_max(changed, (matched, changed)) AS rewritten
FROM held GROUP BY doc_id, item_id, n_windows HAVING max(matched) >= {least_share} * n_windows"""


QUERIES["op1_template_leaks"] = op1_template_leaks
ORACLES["op1_template_leaks"] = _leak_sql()


# ---- 4: secret scans

def op4_secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = scan_secrets(table(spark, sf, "documents"))

    def written(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE_KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def _any_case(pattern: str) -> str:
    """Keywords of the assignment rule in either case, ASCII letters only."""
    head, rest = pattern.split(")", 1)
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head) + ")" + rest


def _secret_sql() -> str:
    parts = " UNION ALL ".join(f"""
        SELECT doc_id, {k} AS k, {quoted(r.kind)} AS kind, {r.least} AS least, string_split_regex(text, p) AS ps,
            regexp_extract_all(text, p) AS ms, regexp_extract_all(text, p, {r.group}) AS vs
        FROM (SELECT *, {quoted(_any_case(r.pattern) if r.any_case else r.pattern)} AS p FROM d)
        WHERE regexp_matches(text, {quoted(_any_case(r.pattern) if r.any_case else r.pattern)})"""
                               for k, r in enumerate(RULES))
    kinds = ", ".join(f"count(*) FILTER (kind = {quoted(b)}) AS n_{b}" for b in BASE_KINDS)
    zeros = ", ".join(f"coalesce(n_{b}, 0)::BIGINT AS n_{b}" for b in BASE_KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({parts}),
spans AS (SELECT doc_id, k, kind, s, s + length(m) AS e FROM (SELECT doc_id, k, kind, least, ms[i] AS m, vs[i] AS v,
        (list_sum(list_transform(ps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found)) WHERE length(v) >= least),
one AS (SELECT doc_id, {kinds}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind IN ({", ".join(map(quoted, BASE_KINDS))}))
            AS base FROM spans GROUP BY doc_id)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN one USING (doc_id)"""


QUERIES["op4_secret_ledger"] = op4_secret_ledger
ORACLES["op4_secret_ledger"] = _secret_sql()


# ---- 6: WARC

def op6_warc_captures(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark, "warc")
    write_warc(table(spark, sf, "pages"), path)
    captures = assemble(read_warc(spark, path, payloads=False).drop("payload"))
    one = saved(captures.select(
        "capture_id", F.regexp_extract("metadata.fields", r"pageId: (-?\d+)", 1).try_cast("bigint").alias("page_id"),
        F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("to_id"), "copies"), "captures")
    first = one.where("record_type = 'response'").select(F.col("capture_id").alias("to_id"), F.col("page_id").alias("refers_to"))
    return (one.join(first, "to_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


QUERIES["op6_warc_captures"] = op6_warc_captures
ORACLES["op6_warc_captures"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
h AS (SELECT page_id, html, top, sha1(html) AS h FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT,
        1)), '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to FROM h"""


# ---- 7: language model

def op7_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"))


QUERIES["op7_pitman_yor"] = op7_pitman_yor


# ---- 8: language identification

def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return identify_languages(table(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES["op8_language_id"] = op8_language_id


# ---- 9: near-duplicates

def op9_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op9_simhash_groups"] = op9_simhash_groups


# ---- 11 to 13

QUERIES.update(searches.QUERIES)
ORACLES.update(searches.ORACLES)
