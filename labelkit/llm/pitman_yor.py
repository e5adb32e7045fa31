"""Hierarchical Pitman-Yor language model, sampled by Gibbs.

Words are customers of context restaurants; the context is the word before (0 at the start of a
text), told by its 64-bit hash. All context restaurants send one customer per table to the
shared parent, a restaurant without context, whose own parent is uniform over the known words
and one unknown one.

Words are dealt to buckets by hash, so everything about a word stands in one bucket.
Texts travel once: a stretch of documents sends each bucket its different (word, context)
pairs with counts and its tokens as places in that list. The shuffled data is walked three
times: totals, seating, scores. What a bucket has to know of its contexts elsewhere is asked
from the contexts' own homes, dealt by hash as well: each bucket sends its part of a context, the
home adds up and replies, without the contexts, in the order asked. Only plain numbers reach
the driver.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIRS, _TOKENS, _DOCS, _TOTALS, _TABLES = range(5)  # kinds of rows of a bucket
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PIECE = 1 << 20  # bytes hashed at once
_STRETCH = 1_000_000  # tokens of a stretch
_LOOSE = 1_000_000  # pairs that wait to be put together with equal ones


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64 and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("up", _P), ("down", inverse)):
            table = np.full(max(n, 1 << 16), base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hashed_words(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, 64-bit hash and end of each word of some bytes.

    A-Z count as a-z; a polynomial of the bytes modulo 2**64 is mixed. 0 is never a hash.
    """
    raw = np.frombuffer(joined, np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    hashes[hashes == 0] = 1
    return starts, hashes, ends


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at blanks."""
    at = 0
    while len(text) - at > _PIECE:
        cut = at + _PIECE
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Stretch:
    """Tokens of some documents: word hash (0 ends a text), context, document."""

    def __init__(self, name: str):
        self.name, self.docs, self.waiting, self.size = name, [], [], 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tokens = 0
        self.open: dict[int, int] = {}  # the last word of a text that may go on
        self.endings: dict[int, int] = {}  # each text's last word so far

    def add(self, doc_id, train: bool, text: bytes) -> None:
        doc = len(self.docs)
        self.docs.append((doc_id, train))
        first = True
        for piece in _pieces(text):
            self.waiting.append((doc, first, piece))
            first, self.size = False, self.size + len(piece) + 1
            if self.size >= _PIECE:
                self.hash_waiting()

    def hash_waiting(self) -> None:
        if not self.waiting:
            return
        joined = b"\n".join(piece for _, _, piece in self.waiting)
        starts, words, _ = hashed_words(joined)
        begin = np.cumsum([0, *(len(piece) + 1 for _, _, piece in self.waiting[:-1])])
        piece = np.searchsorted(begin, starts, "right") - 1
        doc = np.array([d for d, _, _ in self.waiting])[piece]
        before = np.zeros(len(words), np.uint64)
        before[1:] = words[:-1]
        new_doc = np.ones(len(doc), bool)
        new_doc[1:] = doc[1:] != doc[:-1]
        before[new_doc] = 0
        if len(doc) and doc[0] in self.open:  # a text that goes on from earlier pieces
            before[0] = self.open[doc[0]]
        if len(doc):
            self.open = {int(doc[-1]): int(words[-1])}
            last = np.nonzero(np.append(doc[1:] != doc[:-1], True))[0]
            self.endings.update(zip(doc[last].tolist(), words[last].tolist(), strict=True))
        self.parts.append((words, before, doc))
        self.tokens += len(words)
        self.waiting, self.size = [], 0

    def rows(self, buckets: int) -> Iterator[tuple]:
        """Rows ``bucket, kind, stretch, data``; kind 0: pairs, 1: tokens, 2: the documents."""
        self.hash_waiting()
        n = len(self.docs)
        ends = np.array([self.endings.get(k, 0) for k in range(n)], np.uint64)
        words = np.concatenate([*(p[0] for p in self.parts), np.zeros(n, np.uint64)])
        ctx = np.concatenate([*(p[1] for p in self.parts), ends])
        doc = np.concatenate([*(p[2] for p in self.parts), np.arange(n)]).astype(np.int64)
        train = np.array([t for _, t in self.docs], bool)
        _, first, place = _distinct(_pair(words, ctx))
        counts = np.bincount(place[train[doc]], minlength=len(first)).astype(np.int32)
        u_word, u_ctx = words[first], ctx[first]
        u_bucket = (_mixed(u_word) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((u_word, u_bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        cuts = np.searchsorted(u_bucket[order], np.arange(buckets + 1))
        t_bucket = u_bucket[place]
        by = np.lexsort((doc, t_bucket))
        t_cuts = np.searchsorted(t_bucket[by], np.arange(buckets + 1))
        t_place, t_doc = rank[place][by], doc[by]
        sizes = np.bincount(doc, minlength=n)
        meta = pa.table({"doc_id": pa.array([d for d, _ in self.docs], pa.int64()), "held_out": ~train, "n_tokens": sizes})
        yield zlib.crc32(self.name.encode()) % buckets, _DOCS, self.name, _packed(meta)
        for b in range(buckets):
            own = order[cuts[b]:cuts[b + 1]]
            if len(own):
                # the pairs by word and, per word, how many they are
                words, sizes = np.unique(u_word[own], return_counts=True)
                yield b, _PAIRS, self.name, _packed(pa.table({"c": u_ctx[own], "n": counts[own]}),
                                                    pa.table({"w": words, "n": sizes.astype(np.uint32)}))
                here = slice(t_cuts[b], t_cuts[b + 1])
                small = np.uint16 if len(own) <= 1 << 16 else np.uint32
                docs, per_doc = np.unique(t_doc[here], return_counts=True)
                yield b, _TOKENS, self.name, _packed(
                    pa.table({"p": (t_place[here] - cuts[b]).astype(small)}), pa.table({"d": docs.astype(np.uint32), "n": per_doc.astype(np.uint32)}))


def _pair(words: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return words + ctx * np.uint64(0xA0761D6478BD642F)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, a place of each and the number of every one, by an unstable sort, which is faster."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ranked[fresh], order[fresh], place


def _packed(*tables: pa.Table) -> bytes:
    out = []
    for t in tables:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(t)
        out.append(sink.getvalue().to_pybytes())
    return b"".join(len(x).to_bytes(8, "little") + x for x in out)


def _unpacked(data: bytes) -> list[dict[str, np.ndarray]]:
    found, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        t = pa.ipc.open_stream(pa.py_buffer(data)[at + 8:at + 8 + size]).read_all()
        found.append({c: t.column(c).to_numpy() if t.column(c).null_count == 0 else np.array(t.column(c).to_pylist(), dtype=object)
                      for c in t.column_names})
        at += 8 + size
    return found


STRETCHES = "bucket int, kind int, stretch string, data binary"


def stretches(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows ``doc_id, train, text`` as stretches for every bucket."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, None

        def out(stretch: _Stretch) -> pa.RecordBatch:
            columns = list(zip(*stretch.rows(buckets), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                                               pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary())],
                                              ["bucket", "kind", "stretch", "data"])

        for batch in batches:
            ids, train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, text in enumerate(batch.column(2)):
                if held is None:
                    held, number = _Stretch(f"{task}-{number}"), number + 1
                held.add(ids[k], train[k], text.as_py() or b"")
                if held.tokens >= _STRETCH:
                    yield out(held)
                    held = None
        if held is not None:
            yield out(held)

    return docs.select("doc_id", "train", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).mapInArrow(cut, STRETCHES)


@dataclass(frozen=True)
class Numbers:
    """Pairs seen once and twice, words with one and two contexts, and how many words, pairs and tokens there are."""

    once: int = 0
    twice: int = 0
    root_once: int = 0
    root_twice: int = 0
    words: int = 0
    pairs: int = 0
    tokens: int = 0

    def __add__(self, other: Numbers) -> Numbers:
        return Numbers(*(a + b for a, b in zip(astuple(self), astuple(other), strict=True)))


@dataclass(frozen=True)
class Totals:
    """Numbers of all buckets, and the customers and different words of the contexts of one."""

    numbers: Numbers
    customers: np.ndarray
    kinds: np.ndarray


class _Bucket:
    """All (word, context) pairs of a bucket with their training counts."""

    def __init__(self):
        self.stretches: dict[str, np.ndarray] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.loose = 0

    def add(self, stretch: str, words: np.ndarray, ctx: np.ndarray, counts: np.ndarray, keep: bool) -> None:
        ctx = ctx.astype(np.uint64)
        if keep:
            self.stretches[stretch] = _pair(words, ctx)
        self.parts.append((words, ctx, counts.astype(np.int64)))
        self.loose += len(words)
        if self.loose > max(_LOOSE, len(self.parts[0][0])):  # the first part holds what was merged before
            self.merge()

    def merge(self) -> None:
        words, ctx, counts = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, t)])
                              for k, t in enumerate((np.uint64, np.uint64, np.int64)))
        key, first, place = _distinct(_pair(words, ctx))
        self.key, self.word, self.before = key, words[first], ctx[first]
        self.count = np.bincount(place, counts, minlength=len(key)).astype(np.int64)
        self.parts, self.loose = [(self.word, self.before, self.count)], 0

    def close(self) -> None:
        """``of`` and ``ctx``: the places of a pair's word and context among those of the bucket."""
        self.merge()
        self.words, self.of = np.unique(self.word, return_inverse=True)
        self.contexts, self.ctx = np.unique(self.before, return_inverse=True)
        self.seen = np.bincount(self.of, self.count, minlength=len(self.words)).astype(np.int64)

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.ctx, values, minlength=len(self.contexts)).astype(np.int64)

    def totals(self) -> Totals:
        n = self.count
        contexts = np.bincount(self.of[n > 0], minlength=len(self.words))
        return Totals(Numbers(int((n == 1).sum()), int((n == 2).sum()), int((contexts == 1).sum()), int((contexts == 2).sum()),
                              int((self.seen > 0).sum()), int((n > 0).sum()), int(n.sum())),
                      self.per_context(n), self.per_context(n > 0))

    def by_home(self, homes: int) -> list[np.ndarray]:
        """Per home the places of its contexts among those of the bucket."""
        home = (_mixed(self.contexts) % np.uint64(homes)).astype(np.int64)
        return np.split(np.argsort(home, kind="stable"), np.searchsorted(np.sort(home), np.arange(1, homes)))


def seat(customers: np.ndarray, strength: np.ndarray, discount: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables after the customers of each dish leave and sit down again one after another.

    Customer i + 1 opens a table with probability a / (a + i - d * tables), where ``strength``
    a is the restaurant's pull to its parent times the dish's probability there. The first
    40 customers sit down singly, later ones in blocks of 5 % of those seated.
    """
    tables = (customers > 0).astype(np.int64)
    order = np.argsort(-customers, kind="stable")
    left, n, a, d, t = customers[order], int((customers > 1).sum()), strength[order], discount[order], tables[order]
    i = 1
    while n:
        m = np.minimum(max(1, i // 20), left[:n] - i)
        p = a[:n] / (a[:n] + i - d[:n] * t[:n])
        t[:n] += rng.binomial(m, np.clip(p, 0.0, 1.0)) if i >= 40 else rng.random(n) < p
        i += max(1, i // 20)
        n = int(np.searchsorted(-left[:n], -i, "left"))
    tables[order] = t
    return tables


@dataclass(frozen=True)
class Sample:
    """Tables of the contexts of a bucket, and the root's customers and tables, over all buckets."""

    tables: np.ndarray
    root_customers: int
    root_tables: int


def _discount(once: int, twice: int) -> float:
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


class _Chain:
    """The seatings of one bucket, sweep by sweep; the same seed gives the same chain."""

    def __init__(self, bucket: _Bucket, totals: Totals, seed: int):
        self.b, self.totals, self.rng = bucket, totals, np.random.default_rng(seed)
        numbers = totals.numbers
        self.discount = _discount(numbers.once, numbers.twice)
        self.root_discount = _discount(numbers.root_once, numbers.root_twice)
        self.base = 1 / (numbers.words + 1)
        self.tables = (bucket.count > 0).astype(np.int64)
        self.own_kinds = bucket.per_context(self.tables)
        self.size = np.log2(totals.customers + 1).astype(np.int64)  # restaurants of like size
        self.size_kinds = np.bincount(self.size, self.own_kinds)
        self.root_seat()

    def root_seat(self) -> None:
        b = self.b
        self.root_customers = np.bincount(b.of, self.tables, minlength=len(b.words)).astype(np.int64)
        # tables of the whole restaurant: of all words, as many per customer as here
        whole = self.totals.numbers.words * 1.2
        strength = np.full(len(b.words), (1 + self.root_discount * whole) * self.base)
        self.root_tables = seat(self.root_customers, strength, np.full(len(b.words), self.root_discount), self.rng)

    def sweep(self) -> None:
        """Seats all customers anew; words of other buckets have as many tables each as those of this bucket in restaurants of like size."""
        b = self.b
        here = b.per_context(self.tables)
        each = np.where(self.size_kinds > 0, np.bincount(self.size, here) / np.maximum(self.size_kinds, 1), 1.0)
        whole = here + (self.totals.kinds - self.own_kinds) * each[self.size]
        scale = self.totals.numbers.pairs / max(self.own_kinds.sum(), 1)
        root = self.root_probability(Sample(whole, int(self.root_customers.sum() * scale), int(self.root_tables.sum() * scale)))
        strength = (1 + self.discount * whole)[b.ctx] * root[b.of]
        self.tables = seat(b.count, strength, np.full(len(b.count), self.discount), self.rng)
        self.root_seat()

    def root_probability(self, s: Sample) -> np.ndarray:
        d = self.root_discount
        return (np.maximum(self.root_customers - d * self.root_tables, 0) + (1 + d * s.root_tables) * self.base) / (1 + s.root_customers)

    def probability(self, s: Sample) -> np.ndarray:
        """Predictive probability of every pair, given the restaurants' totals."""
        b, d = self.b, self.discount
        own = np.maximum(b.count - d * self.tables, 0)
        return (own + (1 + d * s.tables)[b.ctx] * self.root_probability(s)[b.of]) / (1 + self.totals.customers)[b.ctx]

    def sample(self) -> Sample:
        return Sample(self.b.per_context(self.tables), int(self.root_customers.sum()), int(self.root_tables.sum()))


def _bucket_seed(seed: int, bucket: int) -> int:
    return seed * 1_000_003 + bucket


@dataclass(frozen=True)
class Gibbs:
    burn_in: int = 3
    samples: int = 3
    seed: int = 7


def _opened(rows, keep: bool) -> Iterator[tuple[int, _Bucket, Iterator]]:
    """The closed bucket of a partition and the rows from the first reply on; nothing for a partition without rows."""
    rows, number, bucket, after = iter(rows), None, _Bucket(), ()
    for number, (kind, name, data) in rows:
        if kind == _PAIRS:
            pairs, words = _unpacked(data)
            bucket.add(name, np.repeat(words["w"], words["n"]), pairs["c"], pairs["n"], keep)
        elif kind in (_TOTALS, _TABLES):
            after = ((number, (kind, name, data)),)
            break
    if number is not None:
        bucket.close()
        yield number, bucket, itertools.chain(after, rows)


def _told(bucket: _Bucket, homes: int, replies: Iterator, kind: int) -> tuple[list[np.ndarray], np.ndarray, Iterator]:
    """What the homes reply for the contexts of a bucket, their first numbers, and the rows after the replies."""
    places, columns, numbers, rest = bucket.by_home(homes), None, None, ()
    for number, row in replies:
        if row[0] != kind:
            rest = ((number, row),)
            break
        values, extra = _unpacked(row[2])
        columns = columns or [np.zeros(len(bucket.contexts), np.int64) for _ in values]
        for column, value in zip(columns, values.values(), strict=True):
            column[places[row[1]]] = value
        if row[1] == 0:
            numbers = extra["x"]
    return columns, numbers, itertools.chain(rest, replies)


def _asked(rows, homes: int) -> Iterator[tuple]:
    """Rows ``home, (kind, bucket, data)``: the contexts of a bucket with customers and kinds; home 0 is always asked."""
    for number, bucket, _ in _opened(rows, False):
        own = bucket.totals()
        for home, at in enumerate(bucket.by_home(homes)):
            if len(at) or home == 0:
                yield home, (_TOTALS, number, _packed(
                    pa.table({"n": _narrow(own.customers[at]), "k": _narrow(own.kinds[at])}), pa.table({"x": np.zeros(0, np.int64)}),
                    pa.table({"c": bucket.contexts[at]})))


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _replies(rows, kind: int) -> Iterator[tuple]:
    """Rows ``bucket, (kind, home, data)``: what buckets sent of one kind, added up per context, in the order of their questions."""
    contexts, sent, home = {}, {}, None
    for home, (what, bucket, data) in rows:
        parts = _unpacked(data)
        if what == _TOTALS:
            contexts[bucket] = parts[2]["c"]
        if what == kind:
            sent[bucket] = parts[:2]
    if home is None:
        return
    asking = sorted(contexts)
    _, place = np.unique(np.concatenate([contexts[b] for b in asking]), return_inverse=True)
    summed = {name: np.bincount(place, np.concatenate([sent[b][0][name] for b in asking])).astype(np.int64)
              for name in sent[asking[0]][0]}
    numbers = pa.table({"x": sum(sent[b][1]["x"] for b in asking)})
    cuts = np.cumsum([0, *(len(contexts[b]) for b in asking)])
    for k, b in enumerate(asking):
        own = place[cuts[k]:cuts[k + 1]]
        yield b, (kind, home, _packed(pa.table({name: _narrow(v[own]) for name, v in summed.items()}), numbers))


def _seatings(rows, numbers: Numbers, gibbs: Gibbs, homes: int) -> Iterator[tuple]:
    """Rows ``home, (kind, bucket, data)``: per sample the tables of a bucket's contexts, and of the root."""
    for number, bucket, replies in _opened(rows, False):
        (customers, kinds), _, _ = _told(bucket, homes, replies, _TOTALS)
        chain = _Chain(bucket, Totals(numbers, customers, kinds), _bucket_seed(gibbs.seed, number))
        for _ in range(gibbs.burn_in):
            chain.sweep()
        samples = []
        for _ in range(gibbs.samples):
            chain.sweep()
            samples.append(chain.sample())
        root = pa.table({"x": np.array([x for s in samples for x in (s.root_customers, s.root_tables)], np.int64)})
        for home, at in enumerate(bucket.by_home(homes)):
            if len(at) or home == 0:
                yield home, (_TABLES, number, _packed(pa.table({f"t{k}": _narrow(s.tables[at]) for k, s in enumerate(samples)}), root))


def _score_rows(rows, numbers: Numbers, gibbs: Gibbs, homes: int) -> Iterator[tuple[str, bytes]]:
    for number, bucket, replies in _opened(rows, True):
        (customers, kinds), _, replies = _told(bucket, homes, replies, _TOTALS)
        tables, root, others = _told(bucket, homes, replies, _TABLES)
        samples = [Sample(t, int(root[2 * k]), int(root[2 * k + 1])) for k, t in enumerate(tables)]
        chain = _Chain(bucket, Totals(numbers, customers, kinds), _bucket_seed(gibbs.seed, number))
        for _ in range(gibbs.burn_in):
            chain.sweep()
        mean = np.zeros(len(bucket.key))
        for s in samples:
            chain.sweep()
            mean += chain.probability(s) / len(samples)
        log_p, log_c = np.log10(mean), np.log10(bucket.seen + 1.0)[bucket.of]
        known = (bucket.seen > 0)[bucket.of]
        for _, (kind, stretch, data) in others:
            if kind == _DOCS:
                yield stretch, b"M" + data
            if kind != _TOKENS:
                continue
            tokens, docs = _unpacked(data)
            pairs = np.searchsorted(bucket.key, bucket.stretches[stretch])[tokens["p"]]
            cuts = np.concatenate([[0], np.cumsum(docs["n"])[:-1]]).astype(np.int64)
            yield stretch, b"S" + _packed(pa.table({
                "d": docs["d"], "s": np.add.reduceat(log_p[pairs], cuts), "b": np.add.reduceat(log_c[pairs], cuts),
                "k": np.add.reduceat(known[pairs].astype(np.int32), cuts)}))


def _sum_up(rows) -> Iterator[tuple]:
    """Documents of the stretches of a partition, their parts added up in bucket order."""
    meta, parts = {}, {}
    for stretch, data in rows:
        if data[:1] == b"M":
            meta[stretch], = _unpacked(data[1:])
        else:
            parts.setdefault(stretch, []).append(data[1:])
    for stretch, m in meta.items():
        score, base, known = (np.zeros(len(m["n_tokens"])) for _ in range(3))
        for data in sorted(parts.get(stretch, [])):  # any order of arrival gives the same sum
            part, = _unpacked(data)
            for total, name in ((score, "s"), (base, "b"), (known, "k")):
                total[part["d"]] += part[name]
        for k in range(len(score)):
            doc_id = m["doc_id"][k]
            yield (None if doc_id is None else int(doc_id), bool(m["held_out"][k]), int(m["n_tokens"][k]), int(known[k]), float(base[k]), float(score[k]))


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def score_texts(docs: DataFrame, gibbs: Gibbs = Gibbs(), buckets: int | None = None, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` per row.

    The model learns from rows that are not held out and scores all, whole texts each; the
    end of a text is a token. ``score`` adds up the log10 of predictive probabilities, which
    are averaged over the samples; over all known words and an unknown one they add up to
    1 in every context. ``base_score``: the same of the smoothed word frequencies.

    Null texts are empty and have their end alone; rows with a null id are learned from;
    repeated rows stay; other columns are ignored; an empty table gives no rows. The number
    of buckets grows with the root of the number of shuffle partitions. Reruns over the
    same files agree.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = 8 * math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                       (~is_held_out(F.col(doc_id))).alias("train"))
    # one shuffle of the texts; the walks below read its files again
    dealt = stretches(rows, buckets).rdd.map(lambda r: (r[0], (r[1], r[2], bytes(r[3])))).partitionBy(buckets)
    # what goes to buckets and to homes is dealt alike, so a union lays it partition by partition, in the order given
    union = spark.sparkContext.union
    numbers = Numbers()
    if not rows.isEmpty():
        numbers = dealt.mapPartitions(lambda part: (b.totals().numbers for _, b, _ in _opened(part, False))).treeReduce(lambda a, b: a + b)
    asked = dealt.mapPartitions(lambda part: _asked(part, buckets)).partitionBy(buckets)
    totals = asked.mapPartitions(lambda part: _replies(part, _TOTALS)).partitionBy(buckets)
    seated = union([dealt, totals]).mapPartitions(lambda part: _seatings(part, numbers, gibbs, buckets)).partitionBy(buckets)
    tables = union([asked, seated]).mapPartitions(lambda part: _replies(part, _TABLES)).partitionBy(buckets)
    scored = (union([dealt, totals, tables, dealt]).mapPartitions(lambda part: _score_rows(part, numbers, gibbs, buckets))
              .partitionBy(buckets).mapPartitions(_sum_up))
    n, v = numbers.tokens, numbers.words
    return (spark.createDataFrame(scored, SCORED, verifySchema=False)
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"),
                    (F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), "score",
                    F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")))
