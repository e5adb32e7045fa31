"""Short forms (words whose period does not end a sentence), learned per language from a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.folders import saved
from labelkit.functions.arrays import let
from labelkit.functions.text import BLANKS, ws_strip, ws_tokens

#: A word's letters (periods inside too), then the period that ends it or not.
WORD = r"^[^\p{L}\p{N}]*(\p{L}+(?:\.\p{L}+)*)(\.?)[^\p{L}\p{N}.]*$"


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang), F.lit("und"))


def word_period_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, word, n_dot, n_plain, n_inside``: lower-cased words with and without a period,
    and how often the one after a period begins in lower case.

    Words are counted before they are shuffled. A null language is ``und``; null and empty
    texts have no words.
    """
    pairs = let(ws_tokens(F.col(text)), lambda ws: F.transform(ws, lambda w, i: F.struct(
        F.lower(F.regexp_extract(w, WORD, 1)).alias("word"), (F.regexp_extract(w, WORD, 2) == ".").alias("dot"),
        F.coalesce(F.get(ws, i + 1), F.lit("")).rlike(r"^\p{Ll}").alias("inside"))))
    words = (docs.select(_language(lang).alias("lang"), F.inline(pairs)).where("word <> ''"))
    return words.groupBy("lang", "word").agg(
        F.count_if("dot").alias("n_dot"), F.count_if(~F.col("dot")).alias("n_plain"),
        F.count_if(F.col("dot") & F.col("inside")).alias("n_inside"))


def short_forms(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 5, limit: float = 10.83,
                letters: int = 4) -> DataFrame:
    """``lang, word, n_dot, n_plain, n_inside, score, is_short`` of words with ``least`` periods or more.

    ``score`` is the log-likelihood ratio of word and period as a collocation, 0 where the word
    has fewer periods than words of its language have. A short form scores ``limit``
    (chance of 1 in 1,000) or more, stands with its period at least nine times of
    ten, and is either followed by lower case in a tenth of these, or at most ``letters`` long,
    since titles stand before names. Words that only end sentences are longer as a rule.
    """
    counts = saved(word_period_counts(docs, lang, text), "word-periods")
    whole = counts.groupBy("lang").agg(F.sum("n_dot").alias("_dots"), F.sum(F.col("n_dot") + F.col("n_plain")).alias("_all"))
    n, k = F.col("n_dot") + F.col("n_plain"), F.col("n_dot")
    share, usual = k / n, F.col("_dots") / F.col("_all")
    plain = F.when(k < n, (n - k) * F.ln((1 - share) / (1 - usual))).otherwise(0.0)
    score = F.when((share > usual) & (usual < 1), 2 * (k * F.ln(share / usual) + plain)).otherwise(0.0)
    is_short = ((F.col("score") >= limit) & (F.col("n_plain") * 9 <= k)
                & ((F.col("n_inside") * 10 >= k) | (F.length("word") <= letters)))
    return (counts.where(k >= least).join(whole, "lang").withColumn("score", score).withColumn("is_short", is_short)
            .select("lang", "word", "n_dot", "n_plain", "n_inside", "score", "is_short"))


def sentences_by_forms(text: Column, forms: Column) -> Column:
    """Sentences: a cut at blanks after ``. ! ? …`` and before a capital letter, unless a word of the array
    ``forms`` or a single capital letter ends in that period. Pieces are stripped, blank ones dropped.
    """

    def goes_on(piece: Column) -> Column:
        return let(F.regexp_extract(piece, r"(?<![\p{L}\p{N}.])(\p{L}+(?:\.\p{L}+)*)\.$", 1), lambda w: (w != "") & (
            F.array_contains(forms, F.lower(w)) | w.rlike(r"^\p{Lu}$")))

    def joined(e: Column) -> Column:
        return F.transform(e["ends"], lambda end, k: let(
            F.when(k > 0, F.get(e["ends"], k - 1) + 1).otherwise(0),
            lambda start: ws_strip(F.array_join(F.slice(e["pieces"], start + 1, end - start + 1), ""))))

    def ends(pieces: Column) -> Column:
        places = F.transform(pieces, lambda p, i: F.when(goes_on(p) & (i + 1 < F.size(pieces)), -1).otherwise(i))
        return F.struct(pieces.alias("pieces"), F.array_remove(places, -1).alias("ends"))

    cut = F.split(text, rf"(?<=[.!?…])(?=[{BLANKS}]+\p{{Lu}})")
    return F.array_remove(let(let(cut, ends), joined), "")


def split_by_learned_forms(docs: DataFrame, forms: DataFrame, lang: str = "lang", text: str = "text",
                           name: str = "sentences", salts: int = 64) -> DataFrame:
    """All rows and columns of ``docs`` and ``name``, the sentences by the short ``forms`` of their language.

    ``forms`` holds ``lang, word, is_short``; languages without any split by capitals alone, a null text
    has null sentences. One row of words per language is joined: small, it is sent round; beyond the
    planner's limit it is repeated ``salts`` times, so that one language's documents are dealt to many tasks.
    """
    lists = forms.where("is_short").groupBy(F.col("lang").alias("_lang")).agg(F.sort_array(F.collect_set("word")).alias("_forms"))
    lists = saved(lists, "short-forms").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(text), F.lit(salts)).cast("int")
    return (docs.withColumn("_lang", _language(lang)).withColumn("_salt", salt).join(lists, ["_lang", "_salt"], "left")
            .withColumn(name, sentences_by_forms(F.col(text), F.coalesce("_forms", F.array().cast("array<string>"))))
            .drop("_lang", "_salt", "_forms"))
