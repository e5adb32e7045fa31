"""SimHash near-duplicates: pigeonhole blocks of fingerprints, verified by Hamming distance.

Texts become 64-bit fingerprints where they are read; from there on only distinct
fingerprints travel. Fingerprints are cut into ``most_bits + 3`` pieces, so that a close pair
agrees on three of them: each choice of three pieces is a block key. A block emits a
spanning set of its close pairs, not all of them, and components are found by star
contraction on saved tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.llm.common import fresh
from labelkit.folders import saved

_CHUNK = 1 << 15  # shingles whose bits are counted at once


def text_fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text: bit set where over half of its shingle hashes have it."""
    ws = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII blanks only
    if not ws:
        return 0
    n = max(1, len(ws) - width + 1)
    joined = memoryview(b" ".join(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(width, len(ws)) - 1:].tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(
            starts[k:k + _CHUNK], stops[k:k + _CHUNK], strict=True)), "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """Fingerprints as bigint (the same 64 bits, signed); null and empty texts give 0."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.fromiter((text_fingerprint(t, width, seed) for t in batch), "<u8", len(batch))
            yield pd.Series(found.view("<i8"))

    return of(text)


def _masks(most_bits: int, kept: int = 3) -> list[int]:
    pieces = most_bits + kept
    cuts = [round(64 * k / pieces) for k in range(pieces + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(parts[k] for k in chosen) for chosen in combinations(range(pieces), kept)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_TILE = 1024


def _spanning(fps: np.ndarray, most_bits: int) -> Iterator[tuple[int, int]]:
    """Close pairs of one block that connect all that is connected: at most len - 1."""
    root = np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(0, len(fps), _TILE):
        for b in range(a, len(fps), _TILE):
            near = np.bitwise_count(fps[a:a + _TILE, None] ^ fps[None, b:b + _TILE]) <= most_bits
            for i, j in zip(*np.nonzero(near), strict=True):
                x, y = find(a + i), find(b + j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    yield a + i, b + j


def _block_links(batches: Iterator[pa.RecordBatch], most_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows ``no, key, fp`` sorted by block: verified links, block by block."""
    held = [np.empty(0, np.int64)] * 3

    def links(no: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = (no[1:] != no[:-1]) | (key[1:] != key[:-1])
        block = np.cumsum(new)
        sizes = np.bincount(block)[block]
        small, left, right = sizes <= 64, [], []
        step = 1
        while step < len(fp) and (same := (block[step:] == block[:-step]) & small[step:]).any():
            at = np.nonzero(same)[0]
            at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= most_bits]
            left.append(at)
            right.append(at + step)
            step += 1
        starts = np.nonzero(new & ~small)[0]
        for s in starts:
            pairs = list(_spanning(fp[s:s + sizes[s]], most_bits))
            if pairs:
                left.append(s + np.array([p[0] for p in pairs]))
                right.append(s + np.array([p[1] for p in pairs]))
        a, b = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays(
            [pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

    for batch in batches:
        cols = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)])
                for k, h in enumerate(held)]
        if not len(cols[0]):
            continue
        # the last block may go on in the next batch
        open_block = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        held = [c[open_block] for c in cols]
        if not open_block.all():
            yield links(*[c[~open_block] for c in cols])
    if len(held[0]):
        yield links(*held)


def near_links(fingerprints: DataFrame, most_bits: int = 3, column: str = "fingerprint") -> DataFrame:
    """Links ``a, b`` between distinct fingerprints at up to ``most_bits`` bits: all that is
    needed to connect what close pairs connect. Linear in fingerprints unless close ones
    crowd one block; a crowded block is compared tile by tile in bounded memory."""
    fp = F.col(column)
    keys = F.array(*[F.struct(F.lit(no).alias("no"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key"))
                     for no, mask in enumerate(_masks(most_bits))])
    blocks = (fingerprints.select(fp.alias("fp"), F.explode(keys).alias("k"))
              .select("k.no", "k.key", "fp").repartition("no", "key").sortWithinPartitions("no", "key", "fp"))
    return blocks.mapInArrow(lambda batches: _block_links(batches, most_bits), "a bigint, b bigint").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: root is its component's smallest node.

    Large-star and small-star in turn. A round's links are saved, so lost executors cost
    one round, and only two numbers reach the driver.
    """
    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .where("a < b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .where("a < b").distinct())
        # every node to the smallest of its smaller neighbours, and these to it
        least_of = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(least_of, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
                 .unionAll(least_of.select("m", "b")).where("x <> y")
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        links = saved(small, "links")
        after = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return (links.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .unionAll(links.select("a", "a").distinct()))


def _grouped(docs: DataFrame, most_bits: int, width: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, fingerprint, root, component_id`` per row; root is a fingerprint."""
    marked = saved(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                               fingerprint(F.col(text), width).alias("fingerprint")), "fingerprints")
    classes = saved(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(near_links(classes, most_bits))
    rooted = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(names, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, most_bits: int = 3, width: int = 3, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id among all documents reachable over links of up to
    ``most_bits`` bits. Null and empty texts have fingerprint 0 and are linked like others.
    Rows with a null id take part, but never name a component (a component of null ids
    alone has the id null); repeated rows stay. Other columns are ignored. An empty table
    gives no rows.
    """
    return _grouped(docs, most_bits, width, doc_id, text).select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, most_bits: int = 3, width: int = 3, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    A group without any id keeps one of its rows; of rows that repeat id and fingerprint
    one stays. An empty table gives an empty table.
    """
    fp, = fresh(docs, "fp")
    found = _grouped(docs, most_bits, width, doc_id, text)
    keep = saved(found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "fingerprint")).alias("k")).select(
        F.col("k.doc_id").alias("keep_id"), F.col("k.fingerprint").alias("keep_fp")), "kept")
    marked = docs.withColumn(fp, fingerprint(F.col(text), width))
    return (marked.join(keep, marked[doc_id].eqNullSafe(keep["keep_id"]) & (marked[fp] == keep["keep_fp"]), "left_semi")
            .dropDuplicates([doc_id, fp]).drop(fp))
