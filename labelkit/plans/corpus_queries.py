"""Queries over corpora and files: numbering, orders, unions, readers and writers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from labelkit import functions as L
from labelkit.folders import saved
from labelkit.operators import (annotate, batch_rows, count_tags_total, file_names, filter_split, number_file_lines, number_lines,
                                pair_by_path, pair_documents, pair_files, positional_zip, tags_of_lines)
from labelkit.operators import head_sentences as head
from labelkit.operators import length_stats as lengths
from labelkit.operators import sentence_boundaries as boundaries
from labelkit.operators import sentence_ids as dense_ids
from labelkit.operators import sequential_order as in_order
from labelkit.operators import shuffle_rows as shuffled
from labelkit.operators import split_sizes as sizes
from labelkit.operators import truncation_length as cut_length
from labelkit.operators import union_corpora as union
from labelkit.operators import union_eval_splits as eval_union
from labelkit.operators import unpaired_files as unpaired
from labelkit.plans.bridge import (MODELS, corpus_sentences, doc_sentences, documents, gold_tags,
                                   page_xml, rule_annotators, scratch, table, tagged_sentences,
                                   token_type)
from labelkit.plans.labelling import label_documents, labelled_documents, labelled_lines
from labelkit.plans.registry import ORACLES, QUERIES, query
from labelkit.plans.span_queries import _rule_chain
from labelkit.schemas import CANON, LAYOUTS
from labelkit.sources import archives, conll, corpus

_IN_DOC = [32, 44]


def _ordered(spark, sf):
    """Non-empty sentences with one index that follows document and sentence order."""
    return doc_sentences(spark, sf).where(F.size("words") > 0).withColumn(
        "at", F.shiftleft("doc_id", 32) + F.col("sent_no"))


def _numbered_sql(scope, order, value, base):
    return f"""SELECT doc_id, sent_no, coalesce(sum({value}) OVER (PARTITION BY {scope}
        ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + {base}
        AS first_no, len(w) AS n FROM wds WHERE len(w) > 0"""


def _numbered(df):
    return df.select("doc_id", "sent_no", "first_no", F.size("words").alias("n"))


@query(_numbered_sql("corpus, split", "doc_id, sent_no", "len(w) + 1", 1))
def number_lines_cnec5(spark, sf):
    """From 1 per file, blank lines counted."""
    return _numbered(number_lines(_ordered(spark, sf), ["corpus", "split"], "at", True, 1,
                                  "words", shifts=_IN_DOC))


@query(_numbered_sql("archive", "doc_id, sent_no", "len(w)", 0))
def number_lines_med10(spark, sf):
    """From 0 per file, tokens only."""
    return _numbered(number_lines(_ordered(spark, sf), ["archive"], "at", tokens="words",
                                  shifts=_IN_DOC))


@query(_numbered_sql("corpus, split", "doc_id, sent_no", "len(w)", 0))
def number_lines_wiki3(spark, sf):
    """From 0 per split of a corpus, tokens only."""
    return _numbered(number_lines(_ordered(spark, sf), ["corpus", "split"], "at",
                                  tokens="words", shifts=_IN_DOC))


@query(_numbered_sql("doc_id", "sent_no", "len(w)", 0))
def number_lines_bsnlp3(spark, sf):
    """From 0 per document."""
    return _numbered(number_lines(_ordered(spark, sf), ["doc_id"], "sent_no", tokens="words"))


@query(_numbered_sql("split", "doc_id, sent_no", "len(w)", 1))
def number_lines_poner(spark, sf):
    """From 1 per split."""
    return _numbered(number_lines(_ordered(spark, sf), ["split"], "at", base=1, tokens="words",
                                  shifts=_IN_DOC))


@query("""SELECT doc_id, sent_no, row_number() OVER (PARTITION BY archive
    ORDER BY doc_id, sent_no) - 1 AS sentence_id FROM wds WHERE len(w) > 0""")
def sentence_ids(spark, sf):
    return dense_ids(_ordered(spark, sf), ["archive"], "at", shifts=_IN_DOC).select(
        "doc_id", "sent_no", "sentence_id")


@query("SELECT corpus, split, sentence_id, sentence_id // 32 AS batch FROM corp",
       name="batch_rows")
def _batch_rows(spark, sf):
    return batch_rows(corpus_sentences(spark, sf), 32, ["corpus", "split"], "sentence_id", dense=True).select(
        "corpus", "split", "sentence_id", "batch")


def _archive_lines(spark, sf, lines):
    """``lines`` of every document, written and read as one file in parts per archive."""
    path = scratch(spark, "lines")
    (documents(spark, sf).repartitionByRange("archive", "doc_id")
     .sortWithinPartitions("archive", "doc_id").select("archive", lines.alias("value"))
     .write.partitionBy("archive").text(path))
    return conll.read_lines(spark, path), conll.list_files(spark, path).withColumn(
        "file", F.col("archive"))


@query("""SELECT archive, sum(opens) OVER (PARTITION BY archive
        ORDER BY doc_id, i) - 1 AS sentence_id, line
    FROM (SELECT *, (line <> '' AND coalesce(lag(line) OVER (PARTITION BY archive
            ORDER BY doc_id, i), '') = '')::INT AS opens
        FROM (SELECT archive, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
            FROM (SELECT archive, doc_id, string_split(replace(text, '. ',
                chr(10) || chr(10)), chr(10)) AS lines FROM docs)))
    QUALIFY line <> ''""")
def sentence_boundaries(spark, sf):
    """Lines of each archive numbered by sentence, across its parts and splits."""
    lines = _archive_lines(spark, sf, F.replace("text", F.lit(". "), F.lit("\n\n")))
    return boundaries(*lines, F.col("line") == "").join(file_names(lines[1]), "file_key").select(
        "archive", "sentence_id", "line")


@query("""SELECT corpus, split, min(n) AS min_length, max(n) AS max_length,
    floor(median(n))::BIGINT AS median_length FROM ctags GROUP BY corpus, split""")
def length_stats(spark, sf):
    return lengths(tagged_sentences(spark, sf), by=["corpus", "split"])


@query("""SELECT corpus, least(512, floor(max(n) * 0.5))::INT AS length FROM ctags
    WHERE split = 'train' GROUP BY corpus""")
def truncation_length(spark, sf):
    train = tagged_sentences(spark, sf).where(F.col("split") == "train")
    return lengths(train, by=["corpus"]).select(
        "corpus", cut_length(F.col("max_length")).alias("length"))


@query("SELECT corpus, split, count(*) AS n_sentences FROM corp GROUP BY corpus, split")
def split_sizes(spark, sf):
    return sizes(tagged_sentences(spark, sf))


def _dialogues(spark, sf):
    """A second corpus: dialogue turns as sentences."""
    tokens = L.ws_tokens(F.col("text"))
    return table(spark, sf, "conversations").select(
        F.lit("dialogue").alias("corpus"),
        F.when(F.col("conv_id") % 10 == 0, "test").when(F.col("conv_id") % 10 == 1, "validation")
        .otherwise("train").alias("split"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sentence_id"),
        tokens.alias("tokens"), gold_tags(tokens).alias("tags"))


_DIALOGUE_SQL = r"""SELECT 'dialogue' AS corpus, CASE conv_id % 10 WHEN 0 THEN 'test'
    WHEN 1 THEN 'validation' ELSE 'train' END AS split, conv_id * 1000 + turn AS sentence_id,
    array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ')
        AS tokens FROM conversations"""
_UNION_SQL = f"SELECT corpus, split, sentence_id, tokens FROM ctags UNION ALL {_DIALOGUE_SQL}"


def _joined(df):
    return df.select("corpus", "split", "sentence_id", L.join_tokens(F.col("tokens"))
                     .alias("tokens"))


@query(_UNION_SQL)
def union_corpora(spark, sf):
    return _joined(union(corpus_sentences(spark, sf).drop("doc_id"), _dialogues(spark, sf)))


@query(f"SELECT * FROM ({_UNION_SQL}) WHERE split IN ('test', 'validation')")
def union_eval_splits(spark, sf):
    return _joined(eval_union(corpus_sentences(spark, sf).drop("doc_id"), _dialogues(spark, sf)))


@query("""SELECT corpus, split, sentence_id, tokens FROM ctags
    WHERE split IN ('test', 'validation')""", name="filter_split")
def _filter_split(spark, sf):
    return _joined(filter_split(corpus_sentences(spark, sf)))


@query("""SELECT corpus, split, sentence_id, tokens FROM ctags
    ORDER BY corpus, split, sentence_id LIMIT 101""")
def head_sentences(spark, sf):
    return _joined(head(corpus_sentences(spark, sf), 101))


def _ranked(df):
    """Rows with the place at which they stand, told by the order they are saved in."""
    placed = saved(df.withColumn("at", F.monotonically_increasing_id()), "ordered")
    return dense_ids(placed.withColumn("all", F.lit(0)), ["all"], "at", "rank", shifts=_IN_DOC)


_PLACED = ["corpus", "split", "sentence_id"]


@query("""SELECT corpus, split, sentence_id, row_number() OVER (ORDER BY
    md5(corpus || '|' || split || '|' || sentence_id || '|42'), corpus, split, sentence_id) - 1 AS rank
    FROM corp""")
def shuffle_rows(spark, sf):
    rows = corpus_sentences(spark, sf).select(*_PLACED)
    return _ranked(shuffled(rows, _PLACED)).select(*_PLACED, "rank")


@query("""SELECT corpus, split, sentence_id,
    row_number() OVER (ORDER BY corpus, split, sentence_id) - 1 AS rank FROM corp""")
def sequential_order(spark, sf):
    rows = corpus_sentences(spark, sf).select(*_PLACED)
    return _ranked(in_order(rows, _PLACED)).select(*_PLACED, "rank")


def _lines_of(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n"))
                                       .alias("line_no", "line"))


@query("""WITH l AS (SELECT doc_id, i, list_filter(string_split(line, ' '), lambda x: x <> '') AS w
        FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (
            SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
    SELECT a.doc_id AS base, a.i AS line_no,
        array_to_string(a.w[1:least(len(a.w), len(b.w))], ' ') AS tokens,
        array_to_string(list_transform(b.w[1:least(len(a.w), len(b.w))], lambda x: translate(
            substr(md5(x), 1, 1), '0123456789abcdef', 'ppgiOOOOOOOOOOOO')), ' ') AS tags
    FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i = a.i + 1""", name="positional_zip")
def _positional_zip(spark, sf):
    """Each line with the types of the line after it: lengths differ, the last has none."""
    lines = _lines_of(spark, sf).withColumnRenamed("doc_id", "base")
    tags = lines.select(
        "base", (F.col("line_no") - 1).alias("line_no"),
        F.array_join(F.transform(L.ws_tokens(F.col("line")), token_type), " ").alias("line"))
    zipped = positional_zip(lines, tags)
    return zipped.select("base", "line_no", L.join_tokens(F.col("tokens")).alias("tokens"),
                         L.join_tokens(F.col("tags")).alias("tags"))


def _files(spark, sf):
    """A sentence file for every document, a tag file where it has a label."""
    def names(df, suffix):
        return df.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(suffix))
                         .alias("file"))

    return names(documents(spark, sf), ".sentences.txt").unionByName(
        names(table(spark, sf, "labels"), ".ner_tags.txt"))


@query("""SELECT 'd' || doc_id AS base, 'd' || doc_id || '.sentences.txt' AS file,
    'd' || doc_id || '.ner_tags.txt' AS tag_file FROM documents JOIN labels USING (doc_id)""",
       name="pair_files")
def _pair_files(spark, sf):
    return pair_files(_files(spark, sf))


@query("""SELECT 'd' || doc_id AS base, 'd' || doc_id || '.sentences.txt' AS file
    FROM documents ANTI JOIN labels USING (doc_id)""")
def unpaired_files(spark, sf):
    return unpaired(_files(spark, sf))


def _members(spark, sf):
    """Annotated members for labelled documents, raw members for all of them."""
    docs, labels = documents(spark, sf), table(spark, sf, "labels").select("doc_id")

    def named(df, folder, ending):
        return df.select(F.concat(F.lit(folder), "archive", F.lit("/cs/"),
                                  F.col("doc_id").cast("string"), F.lit(ending)).alias("member"),
                         "text")

    return named(docs.join(labels, "doc_id"), "set/annotated/", ".out").unionByName(
        named(docs, "set/raw/", ".txt"))


@query("""SELECT 'set/annotated/' || archive || '/cs/' || doc_id || '.out' AS member,
    'set/raw/' || archive || '/cs/' || doc_id || '.txt' AS raw_path
    FROM docs JOIN labels USING (doc_id)""", name="pair_by_path")
def _pair_by_path(spark, sf):
    return pair_by_path(_members(spark, sf), "set/annotated/", "set/raw/").select(
        "member", "raw_path")


@query("""SELECT 'set/raw/' || archive || '/cs/' || doc_id || '.txt' AS raw_path,
    text AS raw_text FROM docs JOIN labels USING (doc_id)""", name="pair_documents")
def _pair_documents(spark, sf):
    members = _members(spark, sf)
    pairs = pair_documents(pair_by_path(members, "set/annotated/", "set/raw/"), members)
    return pairs.select("raw_path", "raw_text")


@query(r"""SELECT doc_id AS doc, token AS surface, arg_max('T' || (i % 3), i) AS type FROM (
    SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id,
        list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM docs))
    GROUP BY doc_id, token""")
def read_annotations(spark, sf):
    """Annotation files of a title and one line per word of the document."""
    lines = F.transform(L.ws_tokens(F.col("text")), lambda w, i: F.concat_ws(
        "\t", w, w, F.concat(F.lit("T"), (i % 3).cast("string")), F.lit("id")))
    files = documents(spark, sf).select("doc_id", F.concat(
        F.lit("title\n"), F.array_join(lines, "\n")).alias("text"))
    return conll.read_annotations(files, "doc_id")


@query("""SELECT split AS folder, 'x/' || split || '.conll' AS path, split FROM docs
    UNION ALL SELECT split, 'x/med-' || CASE split WHEN 'train' THEN 'training' ELSE split END
        || '-' || doc_id || '.conll', split FROM docs
    UNION ALL SELECT split, 'x/dev.conll', 'validation' FROM docs WHERE split = 'validation'
    UNION ALL SELECT split, 'x/other.conll', NULL FROM docs""")
def assign_split(spark, sf):
    word = F.when(F.col("split") == "train", "training").otherwise(F.col("split"))
    docs = documents(spark, sf)
    paths = F.array_compact(F.array(
        F.concat(F.lit("x/"), "split", F.lit(".conll")),
        F.concat(F.lit("x/med-"), word, F.lit("-"), F.col("doc_id").cast("string"),
                 F.lit(".conll")),
        F.when(F.col("split") == "validation", "x/dev.conll"), F.lit("x/other.conll")))
    return (docs.select(F.col("split").alias("folder"), F.explode(paths).alias("path"))
            .withColumn("split", conll.assign_split(F.col("path"))))


def _roundtrip(layout):
    spec = LAYOUTS[layout]

    def run(spark, sf):
        path, saved = scratch(spark, layout), scratch(spark, "corpus")
        corpus.write_corpus(corpus_sentences(spark, sf), saved)
        sentences = corpus.read_corpus(spark, saved).withColumn(
            "lemmas", F.transform("tokens", F.lower))
        per_document = ["corpus", "split", "doc_id"] if layout == "bsnlp3" else None
        conll.write_conll(sentences, path, layout, number_scope=per_document, compression="gzip")
        back = conll.read_conll(spark, path, layout)
        columns = [L.join_tokens(F.col(c)).alias(c) for c in ("tokens", "tags")]
        if "lemmas" in spec.extras:
            columns.append(L.join_tokens(F.col("lemmas")).alias("lemmas"))
        if spec.number is not None:
            columns.append(F.get("numbers", F.lit(0)).alias("first_no"))
        return back.select("corpus", "split", *columns)

    return run


def _roundtrip_sql(layout):
    spec = LAYOUTS[layout]
    columns = ["corpus, split, tokens, tags"]
    if "lemmas" in spec.extras:
        columns.append("tokens AS lemmas" if spec.quoted else "lower(tokens) AS lemmas")
    if spec.number is not None:
        scope = "corpus, split, doc_id" if layout == "bsnlp3" else "corpus, split"
        columns.append(f"""coalesce(sum(n + {int(spec.number_blanks)}) OVER (PARTITION BY {scope}
            ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
            + {spec.number_base} AS first_no""")
    return f"SELECT {', '.join(columns)} FROM ctags"


for _layout in LAYOUTS:
    query(_roundtrip_sql(_layout), f"conll_roundtrip_{_layout}")(_roundtrip(_layout))


@query(r"""WITH l AS (SELECT corpus, doc_id, i, line, row_number() OVER (
            PARTITION BY corpus ORDER BY doc_id, i) AS no
        FROM (SELECT lang AS corpus, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
            FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS ls FROM documents)))
    SELECT corpus, CASE WHEN trim(line) = '' THEN ''
        WHEN len(f) >= 4 THEN no || chr(9) || f[1] || chr(9) || f[2] || chr(9) || f[3] || chr(9)
            || CASE WHEN f[4] = 'O' THEN 'O' WHEN len(string_split(f[4], '-')) = 2
                THEN split_part(f[4], '-', 1) || '-MISC' ELSE 'MISC' END
        ELSE no || chr(9) || array_to_string(f, chr(9)) END AS line
    FROM (SELECT *, string_split(line, ' ') AS f FROM l)""")
def convert_cnec_lines(spark, sf):
    """Document lines, their words as fields, numbered as lines of one file per corpus."""
    path = scratch(spark, "lines")
    (documents(spark, sf).repartitionByRange("corpus", "doc_id")
     .sortWithinPartitions("corpus", "doc_id")
     .select("corpus", F.translate("text", " ", "\t").alias("value"))
     .write.partitionBy("corpus").text(path))
    files = conll.list_files(spark, path).withColumn("file", F.col("corpus"))
    return conll.convert_cnec_lines(conll.read_lines(spark, path), files).select(F.col("file").alias("corpus"), "line")


@query("""SELECT archive AS file, row_number() OVER (PARTITION BY archive ORDER BY doc_id, i) - 1 AS line_no,
        CASE WHEN trim(line) = '' THEN '' ELSE row_number() OVER (PARTITION BY archive ORDER BY doc_id, i)
            || chr(9) || line END AS line
    FROM (SELECT archive, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (
        SELECT archive, doc_id, string_split(text, chr(10)) AS lines FROM docs))""")
def write_cnec_lines(spark, sf):
    """Converted lines written in order and read back in the order of the written files."""
    path = scratch(spark, "converted")
    conll.write_cnec_lines(*_archive_lines(spark, sf, F.col("text")), path)
    files = conll.list_files(spark, path).withColumn("file", F.col("file_name"))
    numbered = number_file_lines(conll.read_lines(spark, path), files)
    return numbered.join(file_names(files), "file_key").select("file", "line_no", "line")


@query("""SELECT archive AS base, i AS line_no, tokens, tags FROM (
    SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY doc_id, sent_no) - 1 AS i,
        string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(tag, ' ' ORDER BY pos) AS tags
    FROM gold GROUP BY archive, doc_id, sent_no)""")
def read_parallel_text(spark, sf):
    """A sentence file and a tag file per archive, written first."""
    path = scratch(spark, "parallel")
    sentences = _ordered(spark, sf).select(
        "archive", "at", "words", gold_tags(F.col("words")).alias("tags"))
    for side in ("words", "tags"):
        (sentences.repartitionByRange("archive", "at").sortWithinPartitions("archive", "at")
         .select("archive", F.array_join(side, " ").alias("value"))
         .write.partitionBy("archive").text(f"{path}/{side}"))
    pairs = conll.read_parallel_text(spark, f"{path}/words", f"{path}/tags",
                                     F.col("archive"), F.col("archive"))
    return pairs.select("base", "line_no", L.join_tokens(F.col("tokens")).alias("tokens"),
                        L.join_tokens(F.col("tags")).alias("tags"))


@query("""SELECT corpus, split, sentence_id, tokens, tags FROM ctags
    WHERE split IN ('test', 'validation')""")
def read_corpus(spark, sf):
    """A saved corpus, two of its splits read back."""
    path = scratch(spark, "corpus")
    corpus.write_corpus(corpus_sentences(spark, sf), path)
    back = corpus.read_corpus(spark, path, splits=["test", "validation"])
    return back.select("corpus", "split", "sentence_id", L.join_tokens(F.col("tokens"))
                       .alias("tokens"), L.join_tokens(F.col("tags")).alias("tags"))


@query("SELECT corpus, split, sentence_id, tags FROM ctags")
def read_label_encoded(spark, sf):
    """A saved corpus of integer tags, read as names."""
    path = scratch(spark, "encoded")
    ids = L.encode_labels(F.col("tags"), CANON)
    corpus.write_corpus(corpus_sentences(spark, sf).select(
        "corpus", "split", "sentence_id", ids.alias("ner_tags")), path)
    back = corpus.read_label_encoded(spark, path, CANON)
    return back.select("corpus", "split", "sentence_id",
                       L.join_tokens(F.col("tags")).alias("tags"))


def _zipped(spark, sf, path):
    """Documents as page XML members of one zip archive per source."""
    docs = documents(spark, sf).select(
        F.concat("archive", F.lit(".zip")).alias("archive"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".xml")).alias("member"),
        page_xml(F.col("text")).alias("text"))
    broken = docs.select("archive").distinct().select(
        "archive", F.lit("broken.xml").alias("member"), F.lit("<PcGts><Page>").alias("text"))
    archives.write_archives(docs.unionByName(broken), path)
    return path


def _archive_name(path):
    return F.regexp_extract(path, r"([^/]+)-\d+\.zip$", 1)


@query("""SELECT archive, doc_id || '.xml' AS member, 1 AS well_formed,
        array_to_string(lines, ' ') AS text FROM pages_text
    UNION ALL SELECT DISTINCT archive, 'broken.xml', 0, NULL FROM pages_text""")
def read_archives(spark, sf):
    """Zip archives of page XML: written, unpacked by many tasks, text taken out of whole pages."""
    docs = archives.read_archives(spark, _zipped(spark, sf, scratch(spark, "zip")), check_xml=True)
    return docs.select(_archive_name("archive").alias("archive"), "member",
                       F.col("well_formed").cast("int").alias("well_formed"),
                       L.page_xml_text(F.col("text")).alias("text"))


@query("""SELECT archive, doc_id || '.txt' AS member, strlen(text)::BIGINT AS bytes, sha256(text) AS sha,
    count(*) OVER (PARTITION BY archive) AS listed FROM docs""")
def zip_members(spark, sf):
    """Documents written and read as a format; the commit's record says how many each archive got."""
    path = scratch(spark, "zip-format")
    files = archives.write_archives(documents(spark, sf).select(
        F.concat("archive", F.lit(".zip")).alias("archive"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), "text"), path)
    listed = files.groupBy(F.regexp_replace("archive", r"\.zip$", "").alias("archive")).agg(
        F.sum("members").alias("listed"))
    return spark.read.format("zip_members").load(path).select(
        _archive_name("archive").alias("archive"), "member", F.octet_length("text").cast("bigint").alias("bytes"),
        F.sha2("text", 256).alias("sha")).join(listed, "archive")


@query("SELECT archive, doc_id || '.xml' AS member FROM docs WHERE doc_id::VARCHAR LIKE '%1'")
def read_archives_recursive(spark, sf):
    """Archives found below a folder, members chosen by pattern."""
    path = scratch(spark, "tree")
    _zipped(spark, sf, f"{path}/some/deep")
    docs = archives.read_archives(spark, path, recursive=True, member_glob="*1.xml")
    return docs.select(_archive_name("archive").alias("archive"), "member")


def _rule_annotator(model):
    """One of the rule annotators as a Python function over batches of texts."""
    types, digits = "ppgiOOOOOOOOOOOO", "0123456789abcdef"
    known = {}  # words of a text recur: what is known of a word depends on nothing else

    def heard(word):
        if word not in known:
            if len(known) >= 1 << 16:
                known.clear()
            h = hashlib.md5(word.encode()).hexdigest()
            own = h[2 + 3 * model] if h[1 + 3 * model] < "4" else h[0]
            known[word] = types[digits.index(own)] if word else "O", digits.index(h[3 + 3 * model]) / 15
        return known[word]

    def spans_of(text):
        found, at, run = [], 0, None
        for word in [*text.split(" "), ""]:
            label, score = heard(word)
            if run and run["label"] != label:
                found.append(run)
                run = None
            if label != "O":
                run = run or {"label": label, "start": at, "word": [], "score": []}
                run["word"].append(word)
                run["score"].append(score)
                run["end"] = at + len(word)
            at += len(word) + 1
        return [{"start": r["start"], "end": r["end"], "word": " ".join(r["word"]), "label": r["label"],
                 "score": round(sum(r["score"]) / len(r["score"]), 6)} for r in found]

    return lambda texts: [spans_of(t) for t in texts]


def _loader(model):
    return lambda: _rule_annotator(model)


def label_archives(spark, sf):
    """The whole job: archives of pages in, archives of labelled text out, its tags counted.

    Tags are those of the written members, read again, in all and per archive.
    """
    pages = archives.read_archives(spark, _zipped(spark, sf, scratch(spark, "pages")), member_glob="*.xml",
                                   check_xml=True).where("well_formed")
    docs = pages.select(_archive_name("archive").alias("archive"), "member",
                        L.page_xml_text(F.col("text")).alias("text"))
    labelled = label_documents(docs, lambda c: annotate(c, [_loader(m) for m in MODELS]))
    texts = labelled_documents(labelled, ["archive", "member"]).select(
        F.concat("archive", F.lit(".zip")).alias("archive"), L.output_name(F.col("member")).alias("member"), "text")
    out = scratch(spark, "labelled-zips")
    archives.write_archives(saved(texts, "labelled-texts"), out)
    back = archives.read_archives(spark, out, member_glob="*.conll")
    tags = tags_of_lines(back.withColumn("archive", _archive_name("archive")))
    return count_tags_total(tags, counted=[f"{b}-{t}" for b in "BI" for t in "pgi"] + ["O"])


QUERIES["label_archives"] = label_archives
ORACLES["label_archives"] = _rule_chain("""SELECT tag, archive, count(*) AS n FROM tagged
    JOIN (SELECT doc_id, source AS archive FROM documents) USING (doc_id) GROUP BY ROLLUP (tag, archive)""").replace(
    "WITH docs AS (SELECT doc_id, text, source AS archive FROM documents)",
    """WITH docs AS (SELECT doc_id, source AS archive, array_to_string(list_filter(
        string_split(text, chr(10)), lambda x: x <> ''), ' ') AS text FROM documents)""")


def write_by_archive(spark, sf):
    """The labelling job written per archive, read back and its tags counted."""
    path, saved = scratch(spark, "labelled"), scratch(spark, "saved")
    docs = documents(spark, sf).select("archive", "doc_id", F.concat(
        F.col("doc_id").cast("string"), F.lit(".xml")).alias("member"), "text")
    lines = labelled_lines(label_documents(docs, rule_annotators), ["archive", "member"])
    lines.write.parquet(saved)
    archives.write_by_archive(spark.read.parquet(saved), path, ["sent_no", "chunk_no"])
    tokens = conll.read_conll(spark, path, "infer2")
    tags = tokens.select("archive", F.explode("tags").alias("tag"))
    return tags.groupBy("archive", "tag").agg(F.count("*").alias("n"))


QUERIES["write_by_archive"] = write_by_archive
ORACLES["write_by_archive"] = _rule_chain("""SELECT archive, tag, count(*) AS n
    FROM tagged JOIN docs USING (doc_id) GROUP BY archive, tag""")


@query("""SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY doc_id, i) - 1 AS line_no,
    line FROM (SELECT archive, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
        SELECT archive, doc_id, string_split(text, chr(10)) AS ls FROM docs))""",
       name="number_file_lines")
def _number_file_lines(spark, sf):
    """Lines numbered per archive, across its parts and splits."""
    lines = _archive_lines(spark, sf, F.col("text"))
    return number_file_lines(*lines).join(file_names(lines[1]), "file_key").select(
        "archive", "line_no", "line")


@query("""SELECT doc_id, segment AS sentence_id, string_agg(token || chr(9) || '_' || chr(9) || '_' || chr(9) || tag, chr(10) ORDER BY i)
        || chr(10) AS value FROM (
    SELECT *, coalesce(sum((token LIKE '%.')::INT) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment,
        CASE WHEN substr(md5(token), 1, 1) < '4' THEN 'B-' || substr(md5(token), 1, 1) || 'x' ELSE 'O' END AS tag
    FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM docs)))
    GROUP BY doc_id, segment""")
def groups_to_conll(spark, sf):
    """Labelled words of whole documents, cut into sentences and written in four columns."""
    first = lambda w: F.left(F.md5(w), F.lit(1))
    words = F.transform(L.ws_tokens(F.col("text")), lambda w: F.struct(w.alias("word"), F.when(
        first(w) < "4", F.concat(F.lit("LABEL_"), first(w), F.lit("x"))).otherwise("LABEL_0").alias("label")))
    return conll.groups_to_conll(documents(spark, sf).select("doc_id", words.alias("groups")), ["doc_id"])
