"""Phrases whose words keep together: candidates in double-array tries, counted by numpy.

Texts become runs of word numbers in which every rarer word is a gap, since a phrase is no
more frequent than its words (Apriori). Level by level, phrases that may be frequent
enough go into a double-array trie that is sent to all tasks; a task moves the states of
all its positions by one word at a time, counts the states where phrases end, and
proposes the phrases of the next level. Counts of all parts are then added up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkit.folders import saved

_BLOCK = 1 << 20  # bytes of text worked on at once
_ROW = 1 << 15  # words in one row of the encoded corpus
_CUT = re.compile(b"[.,;:!?\n-\r]")
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UNKNOWN = np.uint64(1 << 63)  # marks words that have no number yet


class _Words:
    """Words of one block as 64-bit hashes of language and word."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng([20, seed])
        self.letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
        self.base = np.uint64(int(rng.integers(1 << 40, 1 << 62)) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(0, np.uint64)
        self.seed, self.langs = seed, {}

    def lang(self, name: str) -> int:
        if name not in self.langs:
            self.langs[name] = int.from_bytes(hashlib.blake2b(f"{self.seed}:{name}".encode(), digest_size=8).digest(), "little")
        return self.langs[name]

    def __call__(self, langs: list[str], texts: list[bytes]):
        """Hashes, first and last byte of the words, whether one starts a piece, and the bytes."""
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        if len(data) > len(self.up):
            self.up = np.cumprod(np.full(len(data) + _BLOCK, self.base, np.uint64))
            self.down = np.cumprod(np.full(len(data) + _BLOCK, self.inverse, np.uint64))
        kind = _KIND[data]
        edge = np.diff((kind == 0).astype(np.int8), prepend=0, append=0)
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.down[:len(data)])])
        h = (sums[ends] - sums[starts]) * self.up[starts]
        piece = np.cumsum(kind == 2)[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = piece[1:] != piece[:-1]
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        doc = np.searchsorted(first, starts, "right") - 1
        h ^= np.array([self.lang(name) for name in langs], np.uint64)[doc]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h & ~_UNKNOWN, starts, ends, new, data, doc


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Rows ``lang, text`` in blocks; a text longer than a block is cut between pieces."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            lang, text = (c.slice(start, 128) for c in batch.columns)
            for name, whole in zip(lang.to_pylist(), text.cast(pa.binary()).to_pylist(), strict=True):
                at = 0
                while at < len(whole):
                    cut = _CUT.search(whole, at + _BLOCK) if len(whole) > at + _BLOCK else None
                    to = cut.end() if cut else len(whole)
                    langs.append(name)
                    texts.append(whole[at:to])
                    size, at = size + to - at, to
                    if size >= _BLOCK:
                        yield langs, texts
                        langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def _vocabulary(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    words = _Words(seed)
    for langs, texts in _texts(batches):
        h, starts, ends, _, data, doc = words(langs, texts)
        found, at, n = np.unique(h, return_index=True, return_counts=True)
        low = _LOWER[data].tobytes()
        names = [low[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array([langs[d] for d in doc[at].tolist()], pa.string()),
             pa.array(names, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["hash", "lang", "word", "n"])


def _numbered(codes: np.ndarray, hashes: np.ndarray, first: int) -> np.ndarray:
    """Hashes among the sorted ``hashes`` become their places, counted from ``first``."""
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, codes & ~_UNKNOWN), len(hashes) - 1)
        known = (codes & _UNKNOWN).astype(bool) & (hashes[at] == (codes & ~_UNKNOWN))
        codes[known] = (at[known] + first).astype(np.uint64)
    return codes


def _rows(codes: np.ndarray, last: bool) -> pa.RecordBatch:
    """Rows of codes that end in gaps; a run of gaps is one. At the ``last`` part, words
    without a number are gaps too, and codes become 32-bit numbers with -1 for a gap."""
    if last:
        codes = np.where(codes & _UNKNOWN, -1, codes.view(np.int64)).astype(np.int32)
    mark = codes.dtype.type(-1 if last else _UNKNOWN)
    gap = codes == mark
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    codes = np.append(codes[keep], mark)
    ends = np.nonzero(codes == mark)[0] + 1
    cuts = [0, *np.unique(ends[np.minimum(np.searchsorted(ends, np.arange(_ROW, len(codes) + _ROW, _ROW)), len(ends) - 1)]).tolist()]
    parts = [codes[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["codes"])


def _encoded(batches: Iterator[pa.RecordBatch], seed: int, hashes: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    """Texts to 64-bit codes: numbers, hashes marked as unknown, and a bare mark as gap."""
    words = _Words(seed)
    for langs, texts in _texts(batches):
        h, _, _, new, *_ = words(langs, texts)
        place = np.arange(len(h)) + np.cumsum(new)
        codes = np.full(len(h) + int(new.sum()), _UNKNOWN, np.uint64)
        codes[place] = h | _UNKNOWN
        yield _rows(_numbered(codes, hashes, 0), last)


class Trie:
    """A double array: state ``s`` goes on with symbol ``c`` to ``t = base[s] + c`` if ``check[t] == s``.

    State 0 is the root, states 1 to ``n_words`` are single words; a further word is its
    number's digits to the base 256, so that no state has more than 256 children and the
    array stays dense. Where a phrase ends, ``name`` is its id.
    """

    def __init__(self, n_words: int) -> None:
        self.n_words, self.depth = n_words, 1
        self.digits = max(1, -(-(n_words - 1).bit_length() // 8))
        self.base = np.zeros(n_words + 1, np.int64)
        self.check = np.zeros(n_words + 1, np.int64)
        self.name = np.arange(-1, n_words, dtype=np.int64)
        self.check[0] = -1
        self.top = self.low = n_words + 1  # all slots from top on are free, hardly any below low

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.name = np.concatenate([self.name, np.full(more, -1, np.int64)])

    def _offset(self, symbols: np.ndarray) -> int:
        """First place found where all children of a state are free, else behind all."""
        while self.low + 4096 < self.top and (self.check[self.low:self.low + 4096] >= 0).mean() > 0.9:
            self.low += 4096
        free = self.low + np.nonzero(self.check[self.low:min(self.top, self.low + 16_384)] < 0)[0][:1024]
        for k in range(0, len(free), 128):
            bases = free[k:k + 128] - symbols[0]
            fits = (self.check[bases[:, None] + symbols] < 0).all(1)
            if fits.any():
                return int(bases[fits.argmax()])
        return self.top - int(symbols[0])

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States of new children; pairs are distinct and sorted."""
        states, first, count = np.unique(parents, return_index=True, return_counts=True)
        out = np.empty(len(parents), np.int64)
        self._grow(self.top + len(parents) + 600)
        for k in np.argsort(-count, kind="stable")[:int((count > 1).sum())].tolist():
            a, b = first[k], first[k] + count[k]
            self._grow(self.top + 600)
            self.base[states[k]] = base = self._offset(symbols[a:b])
            out[a:b] = slots = base + symbols[a:b]
            self.check[slots] = states[k]
            self.top = max(self.top, int(slots[-1]) + 1)
        alone = first[count == 1]  # single children fill what is free
        self._grow(self.top + len(alone) + 600)
        slots = np.nonzero(self.check[self.n_words + 1:] < 0)[0][:len(alone)] + self.n_words + 1
        self.base[parents[alone]], self.check[slots], out[alone] = slots - symbols[alone], parents[alone], slots
        if len(slots):
            self.top = max(self.top, int(slots[-1]) + 1)
        return out

    def add_level(self, parents: np.ndarray, words: np.ndarray, names: np.ndarray) -> None:
        """Children ``words`` of the states ``parents``, with their ids."""
        state = parents
        for digit in reversed(range(self.digits)):
            pair, back = np.unique(state << 8 | (words >> 8 * digit & 255), return_inverse=True)
            state = self._place(pair >> 8, pair & 255)[back]
        self.name[state] = names
        self.depth += 1

    def closed(self) -> tuple:
        """Arrays for the tasks, padded so that every step stays inside."""
        size = self.top + 256
        self._grow(size)
        small = np.int32 if size < 1 << 31 else np.int64
        return self.base[:size].astype(small), self.check[:size].astype(small), self.name[:size], self.depth, self.digits


def walk(codes: np.ndarray, trie: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a phrase of the trie's full depth starts, and their states."""
    base, check, _, depth, digits = trie
    at = np.nonzero(codes >= 0)[0]
    state = codes[at] + 1
    for level in range(1, depth):
        inside = at + level < len(codes)
        at, state = at[inside], state[inside]
        word = codes[at + level]
        good = word >= 0
        for digit in reversed(range(digits)):
            at, state, word = at[good], state[good], word[good]
            step = base[state] + (word >> 8 * digit & 255)
            good = (step > 0) & (check[step] == state)
            state = step
        at, state = at[good], state[good]
    return at, state


def _counted(batches: Iterator[pa.RecordBatch], trie: tuple, go_on: bool) -> Iterator[pa.RecordBatch]:
    """``prefix, word, n``: with word -1 how often a phrase of full depth occurs, else with
    which word it goes on how often."""
    name, total = trie[2], np.zeros(len(trie[2]), np.int64)

    def rows(prefix, word, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(word.astype(np.int32)), pa.array(n)], ["prefix", "word", "n"])

    held: list[np.ndarray] = []

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal total
        codes = np.concatenate(held).astype(np.int64)
        held.clear()
        at, state = walk(codes, trie)
        total += np.bincount(state, minlength=len(total))
        if go_on:
            inside = at + trie[3] < len(codes)
            word = codes[at[inside] + trie[3]]
            pair = (state[inside][word >= 0].astype(np.int64) << 31) | word[word >= 0]
            pair, n = np.unique(pair, return_counts=True)
            yield rows(name[pair >> 31], pair & ((1 << 31) - 1), n.astype(np.int64))

    for batch in batches:
        for raw in batch.column(0):
            held.append(np.frombuffer(raw.as_py(), np.int32))
            if sum(map(len, held)) >= 16 * _ROW:
                yield from block()
    if held:
        yield from block()
    seen = np.nonzero(total)[0]
    yield rows(name[seen], np.full(len(seen), -1), total[seen])


def _vocabulary_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """All words with their counts, under a hash that tells them all apart."""
    for seed in range(100):
        words = saved(docs.mapInArrow(lambda b, seed=seed: _vocabulary(b, seed), "hash bigint, lang string, word string, n bigint")
                      .groupBy("hash", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if not words.groupBy("hash").count().where("count > 1").head(1):
            return words, seed
    raise RuntimeError("no hash tells the words apart")


def _build(phrases: DataFrame, n_words: int, depth: int) -> Trie:
    """The trie of one shard; its rows, of bounded number, meet on the driver."""
    trie = Trie(n_words)
    rows = phrases.select("id", "prefix", "word", F.size("w").alias("len")).toArrow()
    ids, prefix, word, length = (rows.column(k).to_numpy() for k in range(4))
    for level in range(2, depth + 1):
        here = length == level
        if level == 2:
            parents = prefix[here] + 1
        else:
            slots = np.nonzero(trie.name[n_words + 1:] >= 0)[0] + n_words + 1
            slots = slots[np.argsort(trie.name[slots])]
            parents = slots[np.searchsorted(trie.name[slots], prefix[here])]
        trie.add_level(parents.astype(np.int64), word[here].astype(np.int64), ids[here])
    return trie


def _score(a: Column, both: Column) -> Column:
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(20,0)"), both.cast("decimal(21,0)"))


def mine_phrases(docs: DataFrame, least: int = 30, most_len: int = 4, top: int = 2000, lang: str = "lang", text: str = "text",
                 most_words: int = 4_000_000, most_phrases: int = 300_000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase of 2 to ``most_len`` words occurs ``a >= least`` times inside pieces of text between
    stops, commas and the like. Of its cuts in two the one of lowest score counts, where
    score is ``floor(2000000 * a / (l + r))`` with the counts of both parts; phrases that stand
    in a longer one with at least 0.8 of their count are dropped. n is the number of all
    words of the language. Null texts are empty, a null language is ``und``. Repeated rows count
    each, ties go by count, then by the phrase's bytes; a very long text is worked on in
    parts between pieces. Other columns are ignored; an empty table gives no rows.

    At most ``most_words`` hashes of frequent words, and at most about ``most_phrases`` phrases,
    are sent to the tasks at once; the corpus is gone through again for each further part.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    words, seed = _vocabulary_table(docs)
    totals = saved(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    often = words.where(F.col("n") >= least)
    n_words = often.count()
    if not n_words:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")

    # numbers for frequent words, part by part
    parts, first, codes, tables = -(-n_words // most_words), 0, None, []
    for part in range(parts):
        mine = often.where(F.pmod("hash", F.lit(parts)) == part)
        hashes = np.sort(mine.select("hash").toArrow().column(0).to_numpy()).view(np.uint64)
        shared = spark.sparkContext.broadcast(hashes)

        def number(batches, shared=shared, first=first):
            for batch in batches:
                at = np.searchsorted(shared.value, batch.column(0).to_numpy().view(np.uint64)) + first
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns[1:]], ["word", *batch.schema.names[1:]])

        def known(batches, shared=shared, first=first, last=part == parts - 1):
            for batch in batches:
                for raw in batch.column(0):
                    yield _rows(_numbered(np.frombuffer(raw.as_py(), np.uint64).copy(), shared.value, first), last)

        tables.append(saved(mine.select("hash", "lang", F.col("word").alias("phrase"), "n").mapInArrow(
            number, "word int, lang string, phrase string, n bigint"), "numbers"))
        codes = saved(docs.mapInArrow(lambda b, shared=shared: _encoded(b, seed, shared.value, parts == 1), "codes binary") if codes is None
                      else codes.mapInArrow(known, "codes binary"), "codes")
        first += len(hashes)
    single = tables[0]
    for t in tables[1:]:
        single = single.unionByName(t)

    # phrases, level by level
    found: DataFrame | None = None
    level = single.select(F.col("word").cast("bigint").alias("id"), "lang", "phrase", F.array("word").alias("w"))
    counts: list[DataFrame] = []
    for depth in range(1, most_len + 1):
        shards = 1 if found is None else -(-found.count() // most_phrases)
        results = []
        for shard in range(shards):
            trie = Trie(n_words) if found is None else _build(
                found.where(F.pmod(F.xxhash64(F.slice("w", 1, 2)), F.lit(shards)) == shard), n_words, depth)
            shared = spark.sparkContext.broadcast(trie.closed())
            results.append(saved(codes.mapInArrow(
                lambda b, shared=shared, depth=depth: _counted(b, shared.value, depth < most_len), "prefix bigint, word int, n bigint")
                .groupBy("prefix", "word").agg(F.sum("n").alias("n")).where((F.col("word") < 0) | (F.col("n") >= least)), "counts"))
            shared.unpersist()
        result = results[0]
        for r in results[1:]:
            result = result.unionByName(r)
        if depth > 1:
            counts.append(result.where("word < 0").select(F.col("prefix").alias("id"), F.col("n").alias("f")))
        if depth == most_len:
            break
        up = level.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("p"), "w")
        proposed = result.where("word >= 0").select("prefix", "word")
        level = (proposed.join(up, "prefix").join(single.select("word", F.col("phrase").alias("next")), "word")
                 .select("prefix", "word", "lang", F.concat_ws(" ", "p", "next").alias("phrase"),
                         F.concat("w", F.array("word")).alias("w"), F.monotonically_increasing_id().alias("id")))
        # ids above those of words and of the levels before
        level = saved(level.withColumn("id", F.col("id") + F.lit((depth << 56))), "level")
        found = level if found is None else found.unionByName(level)
        if not level.head(1):
            break
    if not counts:
        counts = [spark.createDataFrame([], "id bigint, f bigint")]
    tally = counts[0]
    for c in counts[1:]:
        tally = tally.unionByName(c)
    phrases = saved(found.join(tally, "id").where(F.col("f") >= least).select("id", "lang", "phrase", "w", "f"), "phrases")

    # scores, and phrases inside others
    known = saved(phrases.select("w", "f").unionByName(single.select(F.array("word").alias("w"), F.col("n").alias("f"))), "known")
    cuts = (phrases.select("id", "w", "f", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
            .select("id", "k", "f", F.slice("w", F.lit(1), F.col("k")).alias("left"), F.slice("w", F.col("k") + 1, F.size("w")).alias("right")))
    left, right = (known.select(F.col("w").alias(side), F.col("f").alias(n)) for side, n in (("left", "l"), ("right", "r")))
    best = (cuts.join(left, "left").join(right, "right")
            .withColumn("score", _score(F.col("f"), F.col("l") + F.col("r")))
            .groupBy("id").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.slice("w", i, m))))
    longer = (phrases.where(F.size("w") > 2).select("f", F.explode(spans).alias("w")).groupBy("w").agg(F.max("f").alias("longest")))
    kept = (phrases.join(longer, "w", "left")
            .where(F.col("longest").isNull() | (F.col("longest").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * 80))
            .join(best, "id"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
