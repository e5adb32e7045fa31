"""WARC archives: writing captures, reading records, assembling transactions.

Spark's text writer writes the records (its line end is the end of a WARC record), so any file
system and the commit of whole tasks come with it; archives are read as binary files and
parsed as streams. Request, response and metadata records meet through their
concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.folders import saved

END = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: RFC 4648 alphabet
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's bytes in upper-case base32, five hex digits (20 bits) at a time."""
    digest = F.sha1(payload)
    parts = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record_id(kind: str, *parts: Column) -> Column:
    # nulls differ from empty strings
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(headers: list[Column], block: Column) -> Column:
    """A whole record without its end; null headers are left out."""
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *headers, length), F.lit(END * 2), block)


def _header(name: str, value) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value))


def write_warc(captures: DataFrame, path: str, least_revisit: int = 0, date: str = "2020-01-01T00:00:00Z",
               page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write three records per capture: response or revisit, request, metadata.

    Of captures with equal payloads of at least ``least_revisit`` bytes the one with the largest
    id is the response, the others revisit it. A null payload is empty; a null url or id
    leaves its header out; null ids are the smallest. Rows that repeat id, url and payload
    give equal records, which reading counts. An empty table gives an empty folder.

    Payloads are not shuffled unless very many repeat: only digests are grouped, and the
    saved table of repeated digests is sent round if the planner sees that it is small.
    """
    rows = captures.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                           F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload"))
    repeated = saved(rows.where(F.col("n") >= least_revisit).groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
        .select(F.col("digest").alias("of"), "first"), "repeated")
    joined = rows.join(repeated, (rows["digest"] == repeated["of"]) & (rows["n"] >= least_revisit), "left")
    is_first = F.col("of").isNull() | (F.struct("page_id", "url").eqNullSafe(F.col("first")))
    own = _record_id("capture", F.col("page_id"), F.col("url"), F.col("digest"))
    kind = F.when(is_first, "response").otherwise("revisit")
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    target = _header("WARC-Target-URI", uri)
    common = [_header("WARC-Date", date), target]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "),
                    F.col("n").cast("string"), F.lit(END * 2))
    main = _record([
        _header("WARC-Type", kind), _header("WARC-Record-ID", F.col("own")), *common,
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(~is_first, _header("WARC-Profile", REVISIT)),
        F.when(~is_first, _header("WARC-Refers-To", _record_id(
            "capture", F.col("first.page_id"), F.col("first.url"), F.col("digest")))),
        _header("Content-Type", "application/http; msgtype=response")],
        F.when(is_first, F.concat(http, "payload")).otherwise(http))
    others = [("request", "application/http; msgtype=request",
               F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END * 2}"))),
              ("metadata", "application/warc-fields",
               F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(END)), F.lit("")))]
    records = [main] + [_record([
        _header("WARC-Type", name), _header("WARC-Record-ID", _record_id(name, F.col("own"))), *common,
        _header("WARC-Concurrent-To", F.col("own")), _header("Content-Type", content)], block)
        for name, content, block in others]
    (joined.withColumn("own", own).select(F.explode(F.array(*records)).alias("value"))
     .write.option("lineSep", END * 2).option("compression", "gzip").text(path))


RECORDS = ("file string, record_id string, type string, target_uri string, concurrent_to array<string>, "
           "refers_to string, payload_digest string, payload_bytes bigint, fields string, payload binary")


def _headers(stream: io.BufferedIOBase) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        found.setdefault(name.decode("utf-8", "replace").lower(), []).append(value.strip().decode("utf-8", "replace"))
    return found


def _bare(digest: str | None) -> str | None:
    return digest.split(":", 1)[-1].upper() if digest else None


def parse_records(stream: io.BufferedIOBase, payloads: bool = True) -> Iterator[tuple]:
    """Records of one archive; what follows a damaged record is given as one of type ``broken``."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        head = _headers(stream) if line.startswith(b"WARC/") else {}
        one = {k: v[0] for k, v in head.items()}
        block = stream.read(int(one["content-length"])) if one.get("content-length", "").isdigit() else None
        if block is None or len(block) < int(one["content-length"]):
            yield (None, "broken", None, [], None, None, None, None, None)
            return
        kind, digest, size, payload, fields = one.get("warc-type"), None, None, None, None
        if kind in ("response", "revisit"):
            body = io.BytesIO(block)
            body.readline()
            http = _headers(body)
            if kind == "response":
                payload = body.read()
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:  # of the payload that it does not repeat
                size, digest = int(http.get("content-length", ["0"])[0]), _bare(one.get("warc-payload-digest"))
        elif kind == "metadata":
            fields = block.decode("utf-8", "replace")
        yield (one.get("warc-record-id"), kind, one.get("warc-target-uri"), head.get("warc-concurrent-to", []),
               one.get("warc-refers-to"), digest, size, fields, payload if payloads else None)


def read_warc(spark: SparkSession, path: str, payloads: bool = True, most_bytes: int = 8 << 20) -> DataFrame:
    """Records of all archives below a folder: ``file, record_id, type, target_uri,
    concurrent_to, refers_to, payload_digest, payload_bytes, fields, payload``.

    Files named ``.gz`` are unpacked as streams. Digest and size are those of the payload read;
    a revisit gives what its headers say of the payload it refers to. ``payloads=False``
    leaves the payloads out once they are digested.
    """
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if file.endswith(".gz") else raw
                rows, held = [], 0
                for row in parse_records(stream, payloads):
                    rows.append((file, *row))
                    held += len(row[-1] or b"") + 500
                    if held > most_bytes:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("path", "content"))
    return files.mapInPandas(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, copies, main, request, metadata``.

    Records meet at their response or revisit: through their own concurrent-to, through that
    of the main record, or through a record that is concurrent to it. A capture whose main
    record is missing keeps the others. Of several requests or metadata records the one
    with the smallest id stays; ``copies`` counts equal main records. ``broken`` and other
    types are left out. Only keys are joined; each record travels once, by capture.
    """
    known = records.where(F.col("type").isin("response", "revisit", "request", "metadata"))
    is_main = F.col("type").isin("response", "revisit")
    named = known.select(F.col("record_id").alias("linked_id"), F.explode("concurrent_to").alias("to"), is_main.alias("of_main"))
    # keys alone are looked up several times, so they are saved: payloads are read once
    named = saved(named, "links")
    # a main record names the others; the others name the main record, or one another
    down = named.where("of_main").select(F.col("to").alias("linked_id"), F.col("linked_id").alias("main_id"))
    up = named.where("not of_main").select("linked_id", F.col("to").alias("main_id"))
    direct = saved(down.unionAll(up).groupBy("linked_id").agg(F.min("main_id").alias("main_id")), "links")
    ids = known.select("record_id", is_main.alias("is_main"), *[c for c in known.columns if c != "record_id"])
    keyed = ids.join(direct, ids["record_id"] == direct["linked_id"], "left")
    further = direct.select(F.col("linked_id").alias("via"), F.col("main_id").alias("top"))
    keyed = keyed.join(further, (keyed["main_id"] == further["via"]) & ~keyed["is_main"], "left")
    key = F.when(F.col("is_main"), F.col("record_id")).otherwise(F.coalesce("top", "main_id", "record_id"))
    whole = F.struct(*[F.col(c) for c in records.columns])

    def part(condition: Column) -> Column:
        return F.min_by(F.when(condition, whole), F.when(condition, F.col("record_id")))

    return keyed.groupBy(key.alias("capture_id")).agg(
        F.sum(F.col("is_main").cast("bigint")).alias("copies"), part(F.col("is_main")).alias("main"),
        part(F.col("type") == "request").alias("request"), part(F.col("type") == "metadata").alias("metadata"))
