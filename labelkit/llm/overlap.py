"""Near-duplicates by SimHash fingerprints, verified by the Jaccard similarity of word shingles.

Candidates have fingerprints of few differing bits; since pairs at the limit often differ in more,
those that share a band of minimum hashes are candidates too. Every link is verified on the whole
shingle sets. Each block of candidates first meets one leader by pairs; members of blocks that this does not
connect are then compared with each other inside the block. Components are found by star
contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.folders import saved
from labelkit.llm.common import fresh
from labelkit.llm.simhash import components, near_links

# a pair at similarity s shares no band with probability (1 - s**4)**32: 4e-8 at 0.8
BANDS, ROWS = 32, 4
_CHUNK = 4096  # shingles whose minima are taken at once
_FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_FOLD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA0761D6478BD642F], np.uint64)


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's shingles; a shorter text is one shingle."""
    ws = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII blanks only
    if not ws:
        return np.empty(0, np.uint64)
    n = max(1, len(ws) - width + 1)
    joined = memoryview(b" ".join(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(width, len(ws)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), "<u8", n))


def _key(shingles: np.ndarray) -> int:
    """Equal sets have equal keys; the empty one has 0."""
    value = xxhash.xxh64_intdigest(shingles.tobytes(), 7) if len(shingles) else 0
    return value - (1 << 64) if value >> 63 else value


def _bands(shingles: np.ndarray) -> np.ndarray:
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, (_FACTORS[:, None] * shingles[None, k:k + _CHUNK]).min(axis=1))
    mixed = least ^ (least >> np.uint64(29))
    return (mixed.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64).view(np.int64)


def _fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set, signed: a bit is set where over half of the shingle hashes have it."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(shingles), _CHUNK):
        bits += np.unpackbits(shingles[k:k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(shingles), bitorder="little").view("<i8")[0])


def shingle_key(text: Column, width: int = 5) -> Column:
    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_key(shingle_set(t, width)) for t in batch], dtype="int64")

    return of(text)


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, text`` to ``doc_id, key, fp, bands``; one text's shingles are held at a time."""
    for batch in batches:
        keys, fps, bands = [], [], []
        for text in batch.column(1):
            shingles = shingle_set(text.as_py(), width)
            keys.append(_key(shingles))
            fps.append(_fingerprint(shingles))
            bands.append(_bands(shingles))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(fps, pa.int64()),
                                          pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "bands"])


def _keyed_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows ``text, wanted`` to ``key, shingles`` where the text has the wanted key; few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            texts, wanted = (c.slice(start, 128).to_pylist() for c in batch.columns)
            found = [(k, s) for t, k in zip(texts, wanted, strict=True) if _key(s := shingle_set(t, width)) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()),
                                              pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["key", "shingles"])


def _spanning(sets: list[np.ndarray], roots: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Pairs at ``least`` or more that connect what they can between different ``roots``."""
    group = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for p, own in enumerate(sets):
        other = group != group[p]
        other[:p + 1] = False  # met before
        other &= np.minimum(sizes, sizes[p]) >= least * np.maximum(sizes, sizes[p])
        if not other.any():
            continue
        part = slice(begin[p + 1], None)
        wanted = other[owner[part]]
        v, o = values[part][wanted], owner[part][wanted]
        place = np.minimum(np.searchsorted(own, v), len(own) - 1)
        both = np.bincount(o[own[place] == v], minlength=len(sets))
        for q in np.nonzero(other & (both >= least * (sizes + sizes[p] - both)))[0]:
            if group[q] != group[p]:
                group[group == group[q]] = group[p]
                yield p, int(q)


def _block_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows ``no, band, key, root, shingles`` sorted by block: verified links, block by block."""
    block, keys, roots, sets = None, [], [], []

    def links() -> pa.RecordBatch:
        found = list(_spanning(sets, np.array(roots), least)) if keys else []
        return pa.RecordBatch.from_arrays([pa.array([keys[p] for p, _ in found], pa.int64()),
                                           pa.array([keys[q] for _, q in found], pa.int64())], ["a", "b"])

    for batch in batches:
        no, band, key, root = (batch.column(k).to_pylist() for k in range(4))
        for k, shingles in enumerate(batch.column(4)):
            if (no[k], band[k]) != block:
                yield links()
                block, keys, roots, sets = (no[k], band[k]), [], [], []
            keys.append(key[k])
            roots.append(root[k])
            sets.append(np.sort(shingles.values.to_numpy().view(np.uint64)))
    yield links()


def _close_pairs(classes: DataFrame, most_bits: int) -> DataFrame:
    """Rows ``key, lead`` to be verified: sets of one fingerprint meet one of them, and those stand
    for their fingerprints where these are linked."""
    named = saved(classes.groupBy("fp").agg(F.min("key").alias("lead")), "named")
    same = classes.join(named, "fp").where("key <> lead").select("key", "lead")
    left, right = (named.select(F.col("fp").alias(end), F.col("lead").alias(name)) for end, name in (("a", "key"), ("b", "lead")))
    return same.unionByName(near_links(named, most_bits, "fp").join(left, "a").join(right, "b").select("key", "lead"))


def _grouped(docs: DataFrame, least: float, width: int, most_bits: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, key, root`` per row: the key of its shingle set, and the key that names its group."""
    kind = docs.schema[doc_id].dataType.simpleString()
    marked = saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda batches: _sketches(batches, width), f"doc_id {kind}, key bigint, fp bigint, bands array<bigint>"), "sketches")
    classes = saved(marked.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")), "classes")
    blocks = classes.select("key", F.posexplode("bands").alias("no", "band"))
    # another leader in each band, so that a large group has many
    led = blocks.groupBy("no", "band").agg(F.min_by("key", F.xxhash64("key", "no")).alias("lead"),
                                           F.count("*").alias("n")).where("n > 1")
    members = saved(blocks.join(led, ["no", "band"]).select("no", "band", "key", "lead", "n"), "members")
    pairs = saved(_close_pairs(classes.where(F.size("bands") > 0), most_bits)
                  .unionByName(members.where("key <> lead").select("key", "lead")).distinct(), "pairs")
    # one row for each set that is a candidate; ids may repeat, so texts are told by their key
    wanted = saved(classes.join(members.select("key").unionAll(pairs.select("key")).unionAll(pairs.select("lead")).distinct(),
                                "key", "left_semi").select(
        "key", F.col("first.doc_id").alias("_id")), "wanted")
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sets = held.join(wanted, held["doc_id"].eqNullSafe(wanted["_id"])).select("text", "key").mapInArrow(
        lambda batches: _keyed_sets(batches, width), "key bigint, shingles array<bigint>")
    if not marked.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        sets = sets.dropDuplicates(["key"])
    sets = saved(sets, "shingles")

    both = (pairs.join(sets.select(F.col("key").alias("lead"), F.col("shingles").alias("x")), "lead")
            .join(sets.withColumnRenamed("shingles", "y"), "key")
            .select("key", "lead", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("both")))
    led_links = saved(both.where(F.col("both") >= least * (F.col("n") - F.col("both")))
                      .select(F.col("key").alias("a"), F.col("lead").alias("b")), "led")
    roots = saved(components(led_links), "roots")

    # blocks of two have met; of the others, those of more than one group
    rooted = members.where("n > 2").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "no", "band", "key", F.coalesce("root", "key").alias("root"))
    # and blocks of the same members, as near texts share many bands, meet once
    members_of = [F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(f"h{k}") for k in range(2))]
    open_blocks = (rooted.groupBy("no", "band").agg(F.min("root").alias("x"), F.max("root").alias("y"), *members_of).where("x <> y")
                   .groupBy("n", "h0", "h1").agg(F.min(F.struct("no", "band")).alias("b")).select("b.no", "b.band"))
    inside = (rooted.join(open_blocks.select("no", "band"), ["no", "band"], "left_semi").join(sets, "key")
              .select("no", "band", "key", "root", "shingles").repartition("no", "band").sortWithinPartitions("no", "band", "key"))
    more = inside.mapInArrow(lambda batches: _block_links(batches, least), "a bigint, b bigint")
    named = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    return marked.drop("fp", "bands").join(named.withColumnRenamed("node", "key"), "key", "left").select(
        "doc_id", "key", F.coalesce("root", "key").alias("root"))


def drop_overlapping(docs: DataFrame, least: float = 0.8, width: int = 5, doc_id: str = "doc_id",
                     text: str = "text", most_bits: int = 3) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Groups are what links of Jaccard similarity ``least`` or more between sets of ``width``-word
    shingles connect; candidates are told by SimHash fingerprints of up to ``most_bits`` differing
    bits and, for the pairs beyond, by bands of minimum hashes. Null and empty texts are one group. A group without any id keeps one
    of its rows; of rows that repeat id and shingles one stays. An empty table gives an empty
    table.
    """
    key, = fresh(docs, "key")
    found = saved(_grouped(docs, least, width, most_bits, doc_id, text), "grouped")
    keep = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("k")).select(
        F.col("k.doc_id").alias("keep_id"), F.col("k.key").alias("keep_key"))
    # texts need hashing again only where an id does not tell the row
    several = found.groupBy("doc_id").agg(F.count("*").alias("rows"))
    known = saved(several.join(keep, several["doc_id"].eqNullSafe(keep["keep_id"]), "left").select(
        "doc_id", "keep_key", "rows", F.col("keep_key").isNotNull().alias("kept")).withColumnRenamed("doc_id", "keep_id"), "kept")
    # ids that go are fewer than those that stay: the texts need not be exchanged for them
    gone = known.where("rows > 1 or not kept").select("keep_id").distinct()
    plain = docs.join(gone, docs[doc_id].eqNullSafe(gone["keep_id"]), "left_anti")
    more = known.where("rows > 1 and kept").select("keep_id", "keep_key")
    if more.isEmpty():
        return plain
    alike = docs.join(more, docs[doc_id].eqNullSafe(more["keep_id"]), "left_semi").withColumn(key, shingle_key(F.col(text), width))
    told = (alike.join(more, alike[doc_id].eqNullSafe(more["keep_id"]) & (alike[key] == more["keep_key"]), "left_semi")
            .dropDuplicates([doc_id, key]).drop(key))
    return plain.unionByName(told)
