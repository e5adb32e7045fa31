"""Queries over tags, label ids and subword alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelkit import functions as L
from labelkit.operators import (batch_rows, drop_columns, encode_with_vocabulary, filter_tags,
                                label_lookup, map_batched, pad_length)
from labelkit.operators import distinct_labels as distinct
from labelkit.plans.bridge import (MODELS, corpus_sentences, doc_sentences, doc_tokens, documents,
                                   gold_tags, model_tags, table, tagged_sentences, token_type)
from labelkit.plans.registry import query
from labelkit.schemas import BSNLP, BSNLP_TO_CANON, CANON, CNEC, MEDIEVAL, MEDIEVAL_CANON


def _text(array):
    return F.array_join(array, " ")


def _sentences(spark, sf):
    return doc_sentences(spark, sf).where(F.size("words") > 0).select(
        "doc_id", "sent_no", "words").withColumn("tags", gold_tags(F.col("words")))


def _upper_tags(tags):
    return F.transform(tags, F.upper)


# Canonical type letters as the named types of other corpora.
_NAMED = {"B-p": "B-PER", "I-p": "I-PER", "B-g": "B-LOC", "I-g": "I-LOC", "B-i": "B-EVT",
          "I-i": "I-EVT", "O": "O"}
_NAMED_SQL = """CASE tag WHEN 'B-p' THEN 'B-PER' WHEN 'I-p' THEN 'I-PER' WHEN 'B-g' THEN 'B-LOC'
    WHEN 'I-g' THEN 'I-LOC' WHEN 'B-i' THEN 'B-EVT' WHEN 'I-i' THEN 'I-EVT' ELSE 'O' END"""


@query("""SELECT doc_id, sent_no, string_agg(tag, ' ' ORDER BY pos) AS tags FROM gold
    GROUP BY doc_id, sent_no""")
def bio_from_types(spark, sf):
    return _sentences(spark, sf).select("doc_id", "sent_no", _text("tags").alias("tags"))


@query(r"""SELECT token, split_part(token, '-', 1) AS prefix, split_part(token, '-', 2) AS type,
    count(*) AS n FROM (SELECT token FROM tok UNION ALL SELECT tag FROM gold)
    WHERE len(string_split(token, '-')) = 2 GROUP BY token""")
def parse_tag(spark, sf):
    """Tokens and tags of two parts around one hyphen."""
    tags = _sentences(spark, sf).select(F.explode(F.concat("words", "tags")).alias("token"))
    return (tags.withColumn("_p", L.parse_tag(F.col("token"))).where(F.col("_p").isNotNull())
            .groupBy("token", F.col("_p.prefix").alias("prefix"), F.col("_p.type").alias("type"))
            .agg(F.count("*").alias("n")))


@query(r"""SELECT tag, CASE WHEN len(p) = 2 THEN p[1] || '-' || CASE p[2] WHEN 'P' THEN 'PER'
        WHEN 'G' THEN 'LOC' WHEN 'I' THEN 'ORG' ELSE 'MISC' END
    WHEN tag = 'O' THEN 'O' ELSE 'MISC' END AS mapped, count(*) AS n
    FROM (SELECT tag, string_split(tag, '-') AS p FROM (
        SELECT upper(tag) AS tag FROM gold UNION ALL SELECT token FROM tok)) GROUP BY tag, p""")
def map_types(spark, sf):
    """Tags in single letters, and arbitrary tokens as malformed ones."""
    tags = _sentences(spark, sf).select(
        F.explode(F.concat(_upper_tags("tags"), "words")).alias("tag"))
    return tags.groupBy("tag", L.map_types(F.col("tag")).alias("mapped")).agg(
        F.count("*").alias("n"))


@query(f"""SELECT doc_id, sent_no, string_agg(CASE {_NAMED_SQL} WHEN 'B-PER' THEN 'B-p'
    WHEN 'I-PER' THEN 'I-p' WHEN 'B-LOC' THEN 'B-g' WHEN 'I-LOC' THEN 'I-g' ELSE 'O' END,
    ' ' ORDER BY pos) AS tags FROM gold GROUP BY doc_id, sent_no""")
def remap_tags(spark, sf):
    """Named tags to canonical ones; a type without a canonical partner is ``O``."""
    named = L.remap_tags(F.col("tags"), _NAMED)
    return _sentences(spark, sf).select(
        "doc_id", "sent_no", _text(L.remap_tags(named, BSNLP_TO_CANON)).alias("tags"))


@query(f"""SELECT doc_id, sent_no, string_agg(CASE {_NAMED_SQL} WHEN 'B-PER' THEN 'B-p'
    WHEN 'I-PER' THEN 'I-p' WHEN 'B-LOC' THEN 'B-g' WHEN 'I-LOC' THEN 'I-g' ELSE 'O' END,
    ' ' ORDER BY pos) AS medieval, string_agg(tag, ' ' ORDER BY pos) AS cnec
    FROM gold GROUP BY doc_id, sent_no""")
def relabel_positional(spark, sf):
    """Two corpora relabelled by the order of their name lists."""
    named = L.remap_tags(F.col("tags"), _NAMED)
    return _sentences(spark, sf).select(
        "doc_id", "sent_no",
        _text(L.relabel_positional(named, MEDIEVAL, MEDIEVAL_CANON)).alias("medieval"),
        _text(F.transform(L.relabel_positional(
            F.transform("tags", lambda t: F.when(t == "O", t).otherwise(
                F.concat(F.left(t, F.lit(2)), F.upper(F.right(t, F.lit(1)))))),
            CNEC, CANON), lambda t: t)).alias("cnec"))


@query("""SELECT doc_id, sent_no, string_agg(CASE WHEN length(token) % 15 > 10 THEN 0
    ELSE length(token) % 15 END::VARCHAR, ' ' ORDER BY pos) AS ids FROM tok
    GROUP BY doc_id, sent_no""")
def clamp_labels(spark, sf):
    ids = F.transform("words", lambda w: F.length(w) % 15)
    return _sentences(spark, sf).select(
        "doc_id", "sent_no", _text(L.clamp_labels(ids).cast("array<string>")).alias("ids"))


@query("""SELECT doc_id, sent_no, string_agg(['O','B-PER','I-PER','B-ORG','I-ORG','B-LOC','I-LOC',
    'B-PRO','I-PRO','B-EVT','I-EVT'][length(token) % 11 + 1], ' ' ORDER BY pos) AS tags FROM tok
    GROUP BY doc_id, sent_no""")
def decode_labels(spark, sf):
    ids = F.transform("words", lambda w: F.length(w) % 11)
    return _sentences(spark, sf).select(
        "doc_id", "sent_no", _text(L.decode_labels(ids, BSNLP)).alias("tags"))


@query("""SELECT doc_id, sent_no, string_agg(coalesce(v.id, -100)::VARCHAR, ' ' ORDER BY pos) AS ids
    FROM gold LEFT JOIN (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS id FROM (
        SELECT DISTINCT tag FROM ctok WHERE split = 'train' AND corpus = 'en')) v USING (tag)
    GROUP BY doc_id, sent_no""")
def encode_labels(spark, sf):
    """Tags to ids of a vocabulary learned from the English train sentences."""
    train = tagged_sentences(spark, sf).where(
        (F.col("split") == "train") & (F.col("corpus") == "en"))
    encoded = encode_with_vocabulary(_sentences(spark, sf), train)
    return encoded.select("doc_id", "sent_no",
                          _text(F.col("label_ids").cast("array<string>")).alias("ids"))


@query("SELECT tag, id, id + id % 2 AS inside, count(*) AS n FROM ids GROUP BY tag, id")
def begin_to_inside(spark, sf):
    ids = _sentences(spark, sf).select(F.explode(F.arrays_zip(
        F.col("tags").alias("tag"), L.encode_labels(F.col("tags"), CANON).alias("id"))).alias("_t"))
    return (ids.groupBy("_t.tag", "_t.id").agg(F.count("*").alias("n"))
            .withColumn("inside", L.begin_to_inside(F.col("id"))))


def _word_ids(words):
    pieces = F.flatten(F.transform(words, lambda w, i: F.array_repeat(
        i, F.ceil(F.length(w) / 4).cast("int"))))
    edge = F.array(F.lit(None).cast("int"))
    return F.concat(edge, pieces, edge)


def _aligned(spark, sf, mode):
    labels = L.encode_labels(F.col("tags"), CANON)
    return _sentences(spark, sf).select(
        "doc_id", "sent_no", "words",
        L.align_labels(labels, _word_ids(F.col("words")), mode).alias("labels"))


def _align_sql(label):
    return f"""SELECT doc_id, sent_no, '-100 ' || string_agg(({label})::VARCHAR, ' '
        ORDER BY pos, piece) || ' -100' AS labels FROM pieces GROUP BY doc_id, sent_no"""


@query(_align_sql("CASE WHEN piece = 0 THEN id ELSE id + id % 2 END"))
def align_labels(spark, sf):
    return _aligned(spark, sf, "first").select(
        "doc_id", "sent_no", _text(F.col("labels").cast("array<string>")).alias("labels"))


@query(_align_sql("id"))
def align_labels_copy(spark, sf):
    return _aligned(spark, sf, "copy").select(
        "doc_id", "sent_no", _text(F.col("labels").cast("array<string>")).alias("labels"))


@query("""SELECT doc_id, sent_no, '-100 ' || string_agg(CASE WHEN kept AND k <= total
        THEN ids[k] ELSE -100 END::VARCHAR, ' ' ORDER BY pos, piece) || ' -100' AS labels
    FROM (SELECT *, sum(kept::INT) OVER (PARTITION BY doc_id, sent_no ORDER BY pos, piece)::BIGINT AS k
        FROM (SELECT *, piece = 0 AND NOT starts_with(token, '##') AS kept FROM pieces))
    JOIN (SELECT doc_id, sent_no, list(id ORDER BY pos) AS ids, count(*) - 1 AS total
          FROM ids GROUP BY doc_id, sent_no) USING (doc_id, sent_no)
    GROUP BY doc_id, sent_no""")
def align_labels_consume(spark, sf):
    """Pieces of four characters take the labels of all words but the last."""
    pieces = F.flatten(F.transform("words", lambda w: F.transform(
        F.sequence(F.lit(0), (F.ceil(F.length(w) / 4) - 1).cast("int")),
        lambda i: F.concat(F.when(i == 0, "").otherwise("##"),
                           F.substring(w, i * 4 + 1, F.lit(4))))))
    pieces = F.concat(F.array(F.lit("[CLS]")), pieces, F.array(F.lit("[SEP]")))
    labels = L.encode_labels(F.col("tags"), CANON)
    labels = F.slice(labels, F.lit(1), F.size("words") - 1)
    return _sentences(spark, sf).select("doc_id", "sent_no", _text(L.consume_labels(
        labels, pieces, ["[CLS]", "[SEP]"]).cast("array<string>")).alias("labels"))


@query("""SELECT doc_id, sent_no, pos, row_number() OVER (PARTITION BY doc_id, sent_no
    ORDER BY pos, piece) AS i, (piece = 0)::INT AS first_piece FROM pieces""")
def align_first_vs_rest(spark, sf):
    """Whether a subword is the first of its word, by comparison with the one before."""
    ids = L.let(_word_ids(F.col("words")), lambda ids: F.transform(ids, lambda w, i: F.struct(
        w.alias("pos"), i.alias("i"),
        (~F.get(ids, i - 1).eqNullSafe(w)).cast("int").alias("first_piece"))))
    return (_sentences(spark, sf).select("doc_id", "sent_no", F.inline(ids))
            .where(F.col("pos").isNotNull()))


@query("""SELECT doc_id, sent_no, s.model, string_agg(g.id::VARCHAR, ' ' ORDER BY g.pos) AS gold,
        string_agg((list_position(['O','B-p','I-p','B-i','I-i','B-g','I-g'], s.tag) - 1)::VARCHAR,
            ' ' ORDER BY g.pos) AS pred
    FROM ids g JOIN said s USING (doc_id, sent_no, pos)
    WHERE g.id <> 0 GROUP BY doc_id, sent_no, s.model""")
def mask_ignored(spark, sf):
    """Positions whose gold label counts, per annotator; ``O`` is set to be ignored here."""
    gold = F.transform(L.encode_labels(F.col("tags"), CANON),
                       lambda i: F.when(i == 0, -100).otherwise(i))
    kept = F.array(*[F.struct(F.lit(m).alias("model"), L.mask_ignored(
        L.encode_labels(model_tags(F.col("words"), m), CANON), gold).alias("k")) for m in MODELS])
    return (_sentences(spark, sf).select("doc_id", "sent_no", F.inline(kept))
            .where(F.size("k") > 0)
            .select("doc_id", "sent_no", "model", _text(F.col("k.gold").cast("array<string>")).alias("gold"),
                    _text(F.col("k.pred").cast("array<string>")).alias("pred")))


@query("""SELECT doc_id, sent_no, array_to_string(list_transform(range(1, 33),
        lambda i: coalesce(ls[i], -100)), ' ') AS labels,
    array_to_string(list_transform(range(1, 33), lambda i: CASE WHEN i <= len(ls) THEN 1 ELSE 0 END),
        ' ') AS mask
    FROM (SELECT doc_id, sent_no, list(id ORDER BY pos) AS ls FROM ids GROUP BY doc_id, sent_no)""")
def pad_truncate(spark, sf):
    labels = L.encode_labels(F.col("tags"), CANON)
    return _sentences(spark, sf).select(
        "doc_id", "sent_no",
        _text(L.pad_truncate(labels, 32, F.lit(-100)).cast("array<string>")).alias("labels"),
        _text(L.attention_mask(labels, 32).cast("array<string>")).alias("mask"))


@query("""SELECT corpus, split, sentence_id, md5(array_to_string(ls, ' ') || repeat(' -100',
        (max(len(ls)) OVER (PARTITION BY corpus, split, sentence_id // 32) - len(ls))::INT)) AS labels
    FROM (SELECT corpus, split, sentence_id, list(id ORDER BY pos) AS ls
        FROM ids JOIN corp USING (corpus, split, doc_id, sent_no) GROUP BY corpus, split, sentence_id)""")
def pad_labels(spark, sf):
    """Labels padded to the longest sentence of their batch of 32."""
    batches = batch_rows(corpus_sentences(spark, sf), 32, ["corpus", "split"], "sentence_id", dense=True)
    wide = pad_length(batches, "tags", ["corpus", "split", "batch"])
    padded = L.pad_truncate(L.encode_labels(F.col("tags"), CANON), F.col("width"), F.lit(-100))
    return wide.select("corpus", "split", "sentence_id",
                       F.md5(_text(padded.cast("array<string>"))).alias("labels"))


@query("""SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS label
    FROM embeddings""")
def argmax_label(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", L.argmax_label(F.col("embedding")).alias("label"))


@query("""SELECT vec_id, CASE WHEN label = 0 THEN 'O' ELSE 'B-' || label END AS tag
    FROM embeddings""")
def rename_label(spark, sf):
    label = F.concat(F.lit("LABEL_"), F.col("label").cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", L.rename_label(label).alias("tag"))


@query("""SELECT doc_id, quality AS id, CASE quality WHEN 0 THEN 'low' ELSE 'high' END AS name
    FROM labels""", name="label_lookup")
def _label_lookup(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("id"))
    names = spark.sql("SELECT * FROM VALUES (0, 'low'), (1, 'high') AS t(id, name)")
    return label_lookup(rows, names)


@query("SELECT DISTINCT tag AS label FROM ctok WHERE split = 'train'")
def distinct_labels(spark, sf):
    return distinct(tagged_sentences(spark, sf).where(F.col("split") == "train"))


@query("SELECT doc_id, sent_no, pos, type FROM typed WHERE type IN ('p', 'g')",
       name="filter_tags")
def _filter_tags(spark, sf):
    tokens = doc_tokens(spark, sf).withColumn("tag", token_type(F.col("token")))
    return filter_tags(tokens, ["p", "g"]).select(
        "doc_id", "sent_no", "pos", F.col("tag").alias("type"))


@query("SELECT doc_id, corpus, split, archive FROM docs", name="drop_columns")
def _drop_columns(spark, sf):
    return drop_columns(documents(spark, sf), "text")


@query("SELECT doc_id, length(text) AS n_chars, upper(lang) AS lang FROM documents",
       name="map_batched")
def _map_batched(spark, sf):
    """A user function over column batches."""
    def measure(batch):
        return batch.assign(n_chars=batch["text"].str.len(), lang=batch["lang"].str.upper())[
            ["doc_id", "n_chars", "lang"]]

    return map_batched(table(spark, sf, "documents").select("doc_id", "text", "lang"), measure,
                       "doc_id bigint, n_chars bigint, lang string")
