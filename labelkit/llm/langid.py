"""Language identification by character language models.

One interpolated Kneser-Ney model per language over letters and blanks. The models share
one sorted array of n-gram hashes per order, with a row of log probabilities per gram; a text
goes to the language of the lowest cross-entropy per character, and is rejected where
even that is beyond what was seen on labelled texts kept apart for calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkit.folders import saved
from labelkit.llm.common import fresh

ORDER = 4
_EDGE, _BLANK = 1, 32
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplying keeps keys apart: a perfect hash
_FLOOR = -np.log(65536.0)  # every 16-bit code equally likely


def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() if not 0xD800 <= k < 0xE000 else False for k in range(0x110000)), bool, 0x110000)


_LETTER: list[np.ndarray] = []


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts one after another, the text of each code, and letters per text.

    Letters are lower-cased; stretches of other characters are one blank; each text opens
    with a blank and is set apart from the last by ``ORDER - 1`` edge codes (text -1).
    """
    if not _LETTER:
        _LETTER.append(_letters())
    lowered = [" " + t.lower() for t in texts]
    raw = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _LETTER[0][raw]
    n_letters = np.bincount(owner[letter], minlength=len(texts))
    codes = np.where(letter, raw & 0xFFFF, _BLANK)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    at = np.arange(len(codes)) + (ORDER - 1) * (owner + 1)
    out = np.full(len(codes) + (ORDER - 1) * (len(texts) + 1), _EDGE, np.uint64)
    who = np.full(len(out), -1, np.int64)
    out[at], who[at] = codes, owner
    return out, who, n_letters


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Key of the n-gram that ends at each code (the first n - 1 are cut short): 16 bits a character."""
    key = codes.copy()
    for k in range(1, n):
        key[k:] |= codes[:-k] << np.uint64(16 * k)
    return key


@dataclass(frozen=True)
class LanguageModels:
    """``keys[n]``: sorted hashes of n-grams; ``logp[n]``: a row of log probabilities each, a
    column per language; ``contexts[n], back[n]``: the same for the weight of the next
    lower order. ``limit``: highest accepted cross-entropy per language, in nats."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    back: dict[int, np.ndarray]
    limit: np.ndarray

    def score(self, codes: np.ndarray, n: int = ORDER, at: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each code (or of those at ``at``) given the codes before it."""
        at = np.arange(len(codes)) if at is None else at
        if n == 0:
            return np.full((len(at), len(self.langs)), _FLOOR, np.float32)
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key |= codes[np.maximum(at - k, 0)] << np.uint64(16 * k)
        found, place = _find(self.keys[n], key * _MIX)
        out = np.empty((len(at), len(self.langs)), np.float32)
        out[found] = self.logp[n][place[found]]
        if not found.all():
            rest = ~found
            lower = self.score(codes, n - 1, at[rest])
            held, where = _find(self.contexts[n], (key[rest] >> np.uint64(16)) * _MIX)
            lower[held] += self.back[n][where[held]]
            out[rest] = lower
        return out

    def cross_entropy(self, texts: list[str], most_codes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character and language for each text, and the letters of each text."""
        codes, who, n_letters = letter_codes(texts)
        total = np.zeros((len(texts), len(self.langs)))
        size = np.bincount(who[who >= 0], minlength=len(texts))
        for k in range(0, len(codes), most_codes):
            start = max(0, k - ORDER + 1)  # what comes before the piece is context
            piece, owner = codes[start:k + most_codes], who[k:k + most_codes]
            at = np.nonzero(owner >= 0)[0]
            logp = self.score(piece, ORDER, at + (k - start))
            for c in range(len(self.langs)):
                total[:, c] -= np.bincount(owner[at], logp[:, c], minlength=len(texts))
        return total / np.maximum(size, 1)[:, None], n_letters


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return table[place] == wanted, place


def _kneser_ney(langs: list[str], key: np.ndarray, count: np.ndarray) -> tuple[dict, ...]:
    """Models from the counts (a column per language) of all ``ORDER``-grams."""
    counts = {ORDER: (key, count)}
    for n in range(ORDER - 1, 0, -1):  # lower orders count the different characters in front
        upper, c = counts[n + 1]
        suffix, place = np.unique(upper & np.uint64((1 << 16 * n) - 1), return_inverse=True)
        lower = np.zeros((len(suffix), len(langs)))
        np.add.at(lower, place, (c > 0).astype(float))
        counts[n] = (suffix, lower)
    keys, logp, contexts, back = {}, {}, {}, {}
    below, below_keys = None, None
    for n in range(1, ORDER + 1):
        k, c = counts[n]
        once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        head, place = np.unique(k >> np.uint64(16), return_inverse=True)
        total, kinds = np.zeros((len(head), len(langs))), np.zeros((len(head), len(langs)))
        np.add.at(total, place, c)
        np.add.at(kinds, place, (c > 0).astype(float))
        seen = total > 0
        weight = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
        base = np.exp(_FLOOR) if n == 1 else below[np.searchsorted(below_keys, k & np.uint64((1 << 16 * (n - 1)) - 1))]
        p = np.maximum(c - discount, 0) / np.maximum(total, 1)[place] + weight[place] * base
        below, below_keys = p, k
        for store, rows, values in ((keys, k, logp), (contexts, head, back)):
            mixed = rows * _MIX
            order = np.argsort(mixed)
            store[n] = mixed[order]
            values[n] = np.log(p if store is keys else weight)[order].astype(np.float32)
    return keys, logp, contexts, back


def fit(labelled: DataFrame, per_language: int = 400, calibration: int = 100, slack: float = 0.5, quantile: float = 0.95,
        doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModels:
    """Models of all languages that label a text.

    Bounded sample: of each language ``per_language`` texts, whole, drawn by a hash of their
    ids, are counted; the next ``calibration`` texts set the limit, which is ``slack`` nats above
    the ``quantile`` of their cross-entropies (the highest of several never counts). A language
    of fewer texts shares them out in the same proportion, and its only text by halves, so
    every language has a limit; without calibration (0) none has. Counting is spread over tasks;
    counts of the sample's n-grams come to the driver. Rows without a letter or a label are
    left out; no labelled rows give models of no language.
    """
    wanted = per_language + calibration
    order = Window.partitionBy("lang").orderBy("draw", "id", "text")
    rows = (labelled.select(F.col(lang).alias("lang"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
            .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("draw", F.xxhash64("lang", "id")))
    # a language with many rows first thins out to about four times those wanted, where
    # they are read, so that no task is sent more, however many tasks read them
    counts = saved(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = F.lit(4.0 * wanted + 100) / F.col("n")
    chosen = (rows.join(counts, "lang").where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20))
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
              .withColumn("m", F.count("*").over(Window.partitionBy("lang"))))
    learned, checked = F.col("place") <= per_language, F.lit(False)
    if calibration:
        n_learned = F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.col("m") * per_language / wanted), F.col("m") - 1))
        learned = F.col("place") <= n_learned
        middle = F.greatest(F.lit(1), F.floor((F.length("text") + 1) / 2)).cast("int")
        first, second = F.substring("text", F.lit(1), middle), F.substring("text", middle + 1, F.length("text"))
        # an only text that is letters on one side alone is learned and checked whole
        halves = first.rlike(r"\p{L}") & second.rlike(r"\p{L}")
        alone = F.col("m") == 1
        texts = F.when(alone, F.array(*[F.struct(F.when(halves, half).otherwise(F.col("text")).alias("text"), F.lit(use).alias("learned"))
                                        for half, use in ((first, True), (second, False))])).otherwise(
            F.array(F.struct("text", learned.alias("learned"))))
        chosen = chosen.select("lang", F.inline(texts))
        learned, checked = F.col("learned"), ~F.col("learned")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                for k in range(0, len(part), 200):
                    codes, who, _ = letter_codes(part["text"].tolist()[k:k + 200])
                    key, n = np.unique(grams(codes, ORDER)[who >= 0], return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": key.view(np.int64), "n": n.astype(np.int64)})

    counted = (chosen.where(learned).select("lang", "text")
               .mapInPandas(count, "lang string, gram bigint, n bigint")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counted["lang"].unique())
    key, place = np.unique(counted["gram"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    table = np.zeros((len(key), len(langs)))
    table[place, pd.Categorical(counted["lang"], langs).codes] = counted["n"].to_numpy()
    limit = np.full(len(langs), np.inf)
    models = LanguageModels(langs, *_kneser_ney(langs, key, table), limit) if langs else LanguageModels(
        [], {}, {}, {}, {}, limit)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.iloc[k:k + 200]
                nats, letters = models.cross_entropy(part["text"].tolist())
                own = nats[np.arange(len(part)), pd.Categorical(part["lang"], langs).codes]
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "nats": own})[letters > 0]

    if langs:
        spread = (chosen.where(checked & F.col("lang").isin(langs)).select("lang", "text")
                  .mapInPandas(measure, "lang string, nats double").groupBy("lang").agg(F.sort_array(F.collect_list("nats")).alias("all"))
                  .select("lang", F.get("all", F.floor(F.lit(quantile) * (F.size("all") - 1)).cast("int")).alias("top")))
        top = {r["lang"]: r["top"] for r in spread.collect()}  # one row per language
        limit[:] = [top.get(name, np.inf) + slack for name in langs]
    return models


PREDICTED = "struct<lang:string,score:double,nats:double,rejected:boolean>"


def predict_language(models: LanguageModels, text: Column, most_chars: int = 1 << 19) -> Column:
    """``lang, score, nats, rejected`` of a text, read whole.

    ``lang`` is a label of the models, or ``und`` for null texts and texts without a letter (score
    0, rejected; so is everything if the models know no language). ``score`` is the
    posterior of the language over at most 50 characters' worth of evidence;
    ``rejected``: the cross-entropy ``nats`` is above the language's limit, to which short
    texts get an allowance.
    """

    @F.pandas_udf(PREDICTED)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, held, size = [], [], 0
            for value in [*batch, None]:
                held.append(value)
                size += len(value or "")
                if size > most_chars:
                    parts.append(_predict(models, held))
                    held, size = [], 0
            parts.append(_predict(models, held))
            yield pd.concat(parts, ignore_index=True).iloc[:len(batch)]

    return of(text)


def _predict(models: LanguageModels, texts: list[str | None]) -> pd.DataFrame:
    out = pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0, "nats": np.nan, "rejected": True})
    if not models.langs or not texts:
        return out
    nats, letters = models.cross_entropy([t or "" for t in texts])
    best = nats.argmin(axis=1)
    low = nats[np.arange(len(texts)), best]
    evidence = np.minimum(letters, 50)[:, None]
    score = 1 / np.exp(-(nats - low[:, None]) * evidence).sum(axis=1)
    known = letters > 0
    out.loc[known, "lang"] = np.array(models.langs, dtype=object)[best[known]]
    out.loc[known, "score"] = score[known]
    out.loc[known, "nats"] = low[known]
    # the mean over few letters strays further: 6 nats over the root of their number
    out.loc[known, "rejected"] = low[known] > models.limit[best[known]] + 6 / np.sqrt(letters[known])
    return out


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify_languages(docs: DataFrame, models: LanguageModels | None = None, doc_id: str = "doc_id",
                       text: str = "text", lang: str = "lang", prefix: str = "", **options) -> DataFrame:
    """Documents with ``held_out, lang_pred, score, nats, rejected`` (names after ``prefix``).

    Without given models they are fitted on the labelled rows that are not held out.
    Predictions see the text alone. Repeated rows stay; columns of the new names are
    replaced; an empty table gives an empty table.
    """
    found, = fresh(docs, "found")
    if models is None:
        models = fit(docs.where(~is_held_out(F.col(doc_id))), doc_id=doc_id, text=text, lang=lang, **options)
    p = F.col(found)
    return (docs.withColumn(found, predict_language(models, F.col(text)))
            .withColumns({prefix + "held_out": is_held_out(F.col(doc_id)), prefix + "lang_pred": p["lang"],
                          prefix + "score": p["score"], prefix + "nats": p["nats"],
                          prefix + "rejected": p["rejected"]}).drop(found))


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """Documents whose language is known and whose text the language's model accepts."""
    kept, = fresh(docs, "lang")
    marked = identify_languages(docs, prefix=kept, **options).where(~F.col(kept + "rejected"))
    return marked.select(*docs.columns)
