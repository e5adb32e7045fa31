"""Quality rules: lines first, then documents by how much text their lines have lost.

Built-in expressions within a row; there is no shuffle, so no key can be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.llm.common import WORD, fresh, let, words

BLANK = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineRules:
    """Which lines go, and how much of a document's text may go with them."""

    #: A line ends a sentence: a mark, perhaps with closing quotes or brackets behind it.
    ending: str = r"[.!?…。！？؟।۔:;][\"'”’»›)\]]*[\x20\x09-\x0D]*$"
    #: Lines with so many words need no ending, e.g. a paragraph that was cut off.
    long_line: int = 12
    #: Separators between menu entries, at least so many, and a share of the words.
    separators: tuple[str, ...] = ("|", "»", "›", ">", "•", "·", "/")
    menu_share: float = 0.2
    menu_words: str = r"(?i)^[\x20\x09-\x0D]*(?:home|menu|search|log ?in|sign ?(?:in|up)|register|next|previous|back to top|read more|contact(?: us)?|about(?: us)?|share|skip to content)[\x20\x09-\x0D.|»›>:]*$"
    boilerplate: str = r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|(?:uses?|accept) cookies|enable javascript|click here|subscribe to our|lorem ipsum|copyright ©|©"
    #: Share of symbol characters from which a line is markup rather than prose.
    symbol_share: float = 0.1
    #: No small letter, capitals in a row, and a mark like "!": each searched for by itself,
    #: since one pattern for all three would go back over long lines again and again.
    small_letter: str = r"[a-zß-öø-ÿ]"
    capitals: str = r"[A-Z]{3}"
    shout: str = "!"
    most_lost: float = 0.5


def line_verdict(line: Column, rules: LineRules = LineRules()) -> Column:
    """Why a line goes: ``symbols, navigation, boilerplate, shouting, punctuation``; null if it stays."""
    n_words = F.regexp_count(line, F.lit(WORD))
    chars = F.length(F.regexp_replace(line, BLANK, ""))
    return (F.when(F.regexp_count(line, F.lit(r"[#*$%&|<>]")) > rules.symbol_share * chars, "symbols")
            .when((F.size(F.filter(words(line), lambda w: w.isin(*rules.separators))) >= F.greatest(
                F.lit(2), F.ceil(rules.menu_share * n_words))) | line.rlike(rules.menu_words), "navigation")
            .when(line.rlike(rules.boilerplate), "boilerplate")
            .when(F.contains(line, F.lit(rules.shout)) & ~line.rlike(rules.small_letter)
                  & line.rlike(rules.capitals), "shouting")
            .when((n_words < rules.long_line) & ~line.rlike(rules.ending), "punctuation"))


def _covered(ws: Column, size: int) -> Column:
    """Number of words inside windows of ``size`` words found twice or more.

    Equal windows stand side by side once (window, place) pairs are sorted; only texts in
    which hashes repeat are sorted at all.
    """
    starts = F.sequence(F.lit(0), F.size(ws) - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[ws[i + k] for k in range(size)]))
    pairs = F.array_sort(F.transform(starts, lambda i: F.struct(
        F.array_join(F.slice(ws, i + 1, size), " ").alias("w"), i.alias("i"))))

    def count(sorted_pairs: Column) -> Column:
        last = F.size(sorted_pairs) - 1
        twice = F.filter(sorted_pairs, lambda p, k: (
            ((k > 0) & (F.get(sorted_pairs, k - 1)["w"] == p["w"]))
            | ((k < last) & (F.get(sorted_pairs, k + 1)["w"] == p["w"]))))
        return F.size(F.array_distinct(F.flatten(F.transform(
            twice, lambda p: F.sequence(p["i"], p["i"] + size - 1)))))

    return F.when(F.size(ws) < size, F.lit(0)).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
            .otherwise(let(pairs, count))))


def text_facts(text: Column) -> Column:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    text = F.coalesce(text, F.lit(""))
    filled = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))
    return F.struct(
        let(words(text), lambda ws: F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            _covered(ws, 3).cast("bigint").alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(filled, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"))


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text",
                prefix: str = "") -> DataFrame:
    """Documents with their cleaned text and the verdict on them.

    Adds (names after ``prefix``) ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, clean_text, lost, lines_lost, kept``. ``lost`` is the share of
    word characters in removed lines; blank lines lose nothing. ``kept`` asks for 50 words,
    for at most half of the words in repeated 3-word windows, and for ``lost`` of at most
    ``rules.most_lost``.

    Null and empty texts have no words, fail, and have an empty clean text. Repeated rows
    are judged alike, an empty table gives an empty table, columns of the new names are
    replaced, other columns stay.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    judged = F.transform(F.split(value, "\n", -1), lambda s: F.struct(
        s.alias("line"), F.when(s.rlike(WORD), line_verdict(s, rules)).alias("why")))

    def verdict(lines: Column) -> Column:
        removed = F.filter(lines, lambda s: s["why"].isNotNull())
        return F.struct(
            F.array_join(F.transform(F.filter(lines, lambda s: s["why"].isNull()), lambda s: s["line"]), "\n")
            .alias("clean_text"),
            F.size(removed).cast("bigint").alias("lines_lost"),
            F.length(F.regexp_replace(F.array_join(F.transform(removed, lambda s: s["line"]), ""), BLANK, ""))
            .cast("bigint").alias("chars_lost"))

    facts_name, lines_name = fresh(docs, "facts", "lines")
    facts, lines = F.col(facts_name), F.col(lines_name)
    name = {n: prefix + n for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                    "base_failed", "clean_text", "lost", "lines_lost", "kept")}
    n_words, repeats = facts["w"]["n_words"], facts["w"]["n_repeat_words"]
    base_failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    lost = F.when(facts["word_chars"] > 0, lines["chars_lost"] / facts["word_chars"]).otherwise(0.0)
    values = {
        name["n_words"]: n_words, name["word_chars"]: facts["word_chars"],
        name["n_symbols"]: facts["n_symbols"], name["n_dup_lines"]: facts["n_dup_lines"],
        name["n_repeat_words"]: repeats, name["base_failed"]: base_failed,
        name["clean_text"]: lines["clean_text"], name["lost"]: lost,
        name["lines_lost"]: lines["lines_lost"], name["kept"]: ~base_failed & (lost <= rules.most_lost)}
    return (docs.withColumns({facts_name: text_facts(F.col(text)), lines_name: let(judged, verdict)})
            .withColumns(values).drop(facts_name, lines_name))
