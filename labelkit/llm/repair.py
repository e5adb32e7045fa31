"""Repair of conversation structure: a grammar-compressed dynamic program.

A turn is a symbol: its role and its fault. A conversation is legal if its role initials
read ``s?(ua)+`` or if it is empty, so a symbol is a min-plus matrix over the four states
*start*, *user next*, *assistant next* and *may end*; each entry holds a cost and an audit
rope of edits. Sequences are cut into bounded segments, equal segments are worked out
once, and Re-Pair rules learned from all of them share the products: one matrix per rule,
from the bottom up. Costs and audits of segments are then chained per conversation.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.folders import saved

# fixed values: costs of the edits, roles and blanks of the task
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL_PAIRS = ("su", "ua", "au")

SEGMENT = 4096  # symbols of a segment, and copies of a turn in one row
ROUNDS, RULES_A_ROUND = 6, 16  # a rule is at most 2 ** ROUNDS symbols long
_FIRST_RULE = 0xE000
_STATES = range(4)
_NEXT = ("user", "user", "assistant", "user")  # role that a rerole or insert gives in a state
_THEN = (2, 2, 3, 2)  # and the state after it
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}

# A rope is a string or a pair of ropes; a matrix maps (from, to) to (cost, rope).


def flat(rope) -> str:
    out, left = [], [rope]
    while left:
        top = left.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            left += [top[1], top[0]]
    return "".join(out)


def _better(new, old) -> bool:
    """Cheaper, or as cheap and smaller in ASCII. Of ropes between the same states at the
    same cost none begins another, so what follows can't turn the order."""
    return old is None or new[0] < old[0] or new[0] == old[0] and flat(new[1]) < flat(old[1])


def times(a: dict, b: dict) -> dict:
    out: dict = {}
    for (p, m), (c, rope) in a.items():
        for q in _STATES:
            if (m, q) in b:
                d, tail = b[m, q]
                joined = rope if tail == "" else tail if rope == "" else (rope, tail)
                if _better((c + d, joined), out.get((p, q))):
                    out[p, q] = (c + d, joined)
    return out


def _inserts() -> dict:
    """Any number of inserts; more than two never pay."""
    out = {(p, p): (0, "") for p in _STATES}
    for p in _STATES:
        at = p
        for n in (1, 2):
            at = _THEN[at]
            if _better(new := (INSERT * n, "I" * n), out.get((p, at))):
                out[p, at] = new
    return out


def base_matrices() -> dict[str, dict]:
    """One matrix per symbol, each with the inserts that may follow it. ``x`` must go; letters
    are roles (``o``: none of the three), capital ones truncated turns."""
    gap, out = _inserts(), {}
    out["x"] = times({(p, p): (DELETE, "D") for p in _STATES}, gap)
    for role, kept in _KEPT.items():
        for symbol, more in ((role, 0), (role.upper(), TRUNCATED)):
            edits: dict = {(p, p): (DELETE, "D") for p in _STATES}
            for p in _STATES:
                for new, q in (((more, "K"), kept[p]), ((REROLE + more, "R"), _THEN[p])):
                    if q is not None and _better(new, edits.get((p, q))):
                        edits[p, q] = new
            out[symbol] = times(edits, gap)
    return out


def compressed(symbols: str, rules: list[str]) -> str:
    """Rules applied in the order in which they were learned."""
    for n, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(_FIRST_RULE + n))
    return symbols


def rule_matrices(rules: list[str]) -> dict[str, dict]:
    out = base_matrices()
    for n, (a, b) in enumerate(rules):
        out[chr(_FIRST_RULE + n)] = times(out[a], out[b])
    return out


def sequence_matrix(symbols: str, rules: list[str], matrices: dict[str, dict]) -> dict:
    out: dict | None = None
    for symbol in compressed(symbols, rules):
        out = matrices[symbol] if out is None else times(out, matrices[symbol])
    return out or {}


def learn_rules(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = RULES_A_ROUND) -> list[str]:
    """Re-Pair over the distinct ``symbols``: each round replaces the most frequent adjacent
    pairs. Only a round's chosen pairs reach the driver."""
    rules: list[str] = []
    for _ in range(rounds):
        def pairs(batches: Iterator[pa.RecordBatch], known=tuple(rules)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tally: Counter = Counter()
                for s in batch.column(0).to_pylist():
                    s = compressed(s, list(known))
                    tally.update(map("".join, zip(s, s[1:], strict=False)))
                yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())],
                                                 ["pair", "n"])

        top = (sequences.select("symbols").mapInArrow(pairs, "pair string, n bigint").groupBy("pair")
               .agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(per_round).collect())
        if not top:
            break
        rules += [r.pair for r in top]
    return rules


# ---- turns to symbols

def _turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Equal rows as one with their number; null role and text are one space."""
    return (rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
            .groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
            .withColumn("digest", F.sha2("text", 256))
            .withColumn("ending", F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)))


def _copies(turns: DataFrame) -> DataFrame:
    """Rows of at most ``SEGMENT`` copies, numbered."""
    pieces = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SEGMENT).cast("int"))
    return (turns.withColumn("piece", F.explode(pieces))
            .withColumn("m", F.least(F.lit(SEGMENT), F.col("n") - SEGMENT * F.col("piece").cast("bigint")).cast("int")))


ORDER = ("conv", "turn", "role", "digest", "piece")


def _symbols(turns: DataFrame) -> DataFrame:
    """Per row of copies its symbols and faults."""
    again = (turns.groupBy("conv", "role", "digest").agg(
        F.count("*").alias("times"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
        .where("times > 1").select(F.col("conv").alias("c2"), F.col("role").alias("r2"), F.col("digest").alias("d2"), "first"))
    keyed = turns.select("conv", "turn", "role", "digest", "ending", "n")
    joined = keyed.join(again, keyed["conv"].eqNullSafe(again["c2"]) & (keyed["role"] == again["r2"])
                        & (keyed["digest"] == again["d2"]), "left")
    later = F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn")) > F.col("first"), F.lit(False))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    blank, dup = F.col("ending") == "", later | (F.col("piece") > 0)
    cut = ~F.col("ending").isin(*ENDS)
    own = F.when(blank | dup, F.lit("x")).when(cut, F.upper(letter)).otherwise(letter)
    return _copies(joined).select(
        *ORDER, F.concat(own, F.repeat(F.lit("x"), F.col("m") - 1)).alias("symbols"),
        F.when(blank, F.col("m")).otherwise(0).cast("bigint").alias("blank"),
        F.when(blank, 0).when(dup, F.col("m")).otherwise(F.col("m") - 1).cast("bigint").alias("duplicate"),
        F.when(~blank & ~dup & cut, 1).otherwise(0).cast("bigint").alias("truncated"))


def _typed(df: DataFrame, *more: str) -> str:
    return ", ".join([f"conv {df.schema['conv'].dataType.simpleString()}", "turn bigint", "role string", "digest string",
                      "piece int", *more])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments of about ``SEGMENT`` symbols of one conversation, with the key
    of their first row."""
    task, held, schema = TaskContext.get().partitionId() << 32, None, None
    number = 0
    for batch in batches:
        schema, out = batch.schema, []
        for row in batch.to_pylist():
            if held and held[0]["conv"] == row["conv"] and held[1] < SEGMENT:
                held[1] += len(row["symbols"])
                held[2].append(row["symbols"])
                for f in ("blank", "duplicate", "truncated"):
                    held[0][f] += row[f]
            else:
                if held:
                    out.append(held[0] | {"symbols": "".join(held[2]), "seg": task + number})
                    number += 1
                held = [row, len(row["symbols"]), [row["symbols"]]]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema.append(pa.field("seg", pa.int64())))
    if held:
        yield pa.RecordBatch.from_pylist([held[0] | {"symbols": "".join(held[2]), "seg": task + number}],
                                         schema.append(pa.field("seg", pa.int64())))


# ---- segments to audits

def _matrices(sequences: DataFrame, rules: list[str]) -> DataFrame:
    matrices = rule_matrices(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                names = batch.column(0).slice(start, 256).to_pylist()
                found = [sequence_matrix(s, rules, matrices) for s in names]
                cells = [[m.get((p, q)) for p in _STATES for q in _STATES] for m in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([[c and c[0] for c in m] for m in cells], pa.list_(pa.int64())),
                     pa.array([[c and flat(c[1]) for c in m] for m in cells], pa.list_(pa.string()))],
                    ["symbols", "costs", "audits"])

    return sequences.select("symbols").mapInArrow(work, "symbols string, costs array<bigint>, audits array<string>")


class _Path:
    """The edits of a segment, after those of the segments before."""

    __slots__ = ("before", "cost", "edits")

    def __init__(self, before, cost: int, edits: str) -> None:
        self.before, self.cost, self.edits = before, cost, edits

    def beats(self, other) -> bool:
        if other is None or self.cost != other.cost:
            return other is None or self.cost < other.cost
        a, b, mine, theirs = self, other, [], []
        while a is not b:
            mine.append(a.edits)
            theirs.append(b.edits)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def _chained(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments sorted by conversation: the edits of each on the cheapest way through all.
    Holds one conversation's keys and the edits of at most four ways."""
    keys: list[dict] = []
    ways: dict[int, _Path] = {}
    out: list[dict] = []

    def finish() -> None:
        best = None
        for q in (0, 3):
            if q in ways and ways[q].beats(best):
                best = ways[q]
        total, edits = best.cost, []
        while best is not None:
            edits.append(best.edits)
            best = best.before
        edits = edits[::-1]
        edits[:2] = ["".join(edits[:2])]  # inserts in front of all
        out.extend(k | {"edits": e, "cost": total} for k, e in zip(keys, edits, strict=True))

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for row in batch.slice(start, 256).to_pylist():
                costs, audits = row.pop("costs"), row.pop("audits")
                if keys and keys[-1]["conv"] != row["conv"]:
                    finish()
                    keys = []
                if not keys:
                    ways = {q: _Path(None, *cell) for (p, q), cell in _inserts().items() if p == 0}
                keys.append(row)
                new: dict[int, _Path] = {}
                for p, way in ways.items():
                    for q in _STATES:
                        if (c := costs[4 * p + q]) is not None:
                            path = _Path(way, way.cost + c, audits[4 * p + q])
                            if path.beats(new.get(q)):
                                new[q] = path
                ways = new
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    if keys:
        finish()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


# ---- edits to repaired turns

class _Conversation:
    """What one conversation's sorted rows and edits add up to."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.edits, self.at = conv, 0, "", 0
        self.audit: list[str] = []
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.made = 0
        self.low = self.high = self.initial = None
        self.hash = hashlib.sha256()

    def turn_made(self, role: str, text: str) -> tuple[str, str]:
        self.hash.update(f"{chr(10) if self.made else ''}{role}:{text}".encode())
        self.made += 1
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            role, self.state = _NEXT[self.state], _THEN[self.state]
            yield self.turn_made(role, "")

    def take(self, row: dict) -> Iterator[tuple[str, str]]:
        """The repaired turns that a row gives; a row with edits gives the inserts left over."""
        if row["edits"] is not None:
            yield from self.inserted()
            self.edits, self.at, self.cost = row["edits"], 0, row["cost"]
            self.audit.append(self.edits)
            for f in ("blank", "duplicate", "truncated"):
                setattr(self, f, getattr(self, f) + row[f])
            return
        if (turn := row["turn"]) is not None:
            if turn != self.high:
                self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = row["role"][:1]
        if self.initial is not None and self.initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.illegal, self.initial = self.illegal + row["m"] - 1, initial
        for _ in range(row["m"]):
            yield from self.inserted()
            edit, self.at = self.edits[self.at], self.at + 1
            if edit == "K":
                self.state = {"s": 1, "u": 2, "a": 3}[initial]
                yield self.turn_made(row["role"], row["text"])
            elif edit == "R":
                role, self.state = _NEXT[self.state], _THEN[self.state]
                yield self.turn_made(role, row["text"])

    def summary(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _told(batches: Iterator[pa.RecordBatch], schema: pa.Schema, turns: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows and edits to repaired turns, or to one summary per conversation."""
    now, out = None, []

    def made(pairs: Iterator[tuple[str, str]]) -> None:
        for role, text in pairs:
            if turns:
                out.append({"conv": now.conv, "place": now.made - 1, "role": role, "text": text})

    def finish() -> None:
        made(now.inserted())
        if not turns:
            out.append(now.summary())

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for row in batch.slice(start, 256).to_pylist():
                if now is None or now.conv != row["conv"]:
                    if now is not None:
                        finish()
                    now = _Conversation(row["conv"])
                made(now.take(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    if now is not None:
        finish()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def _repaired(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, turns: bool) -> DataFrame:
    kept = saved(_turns(rows, conv_id, turn, role, text), "turns")
    symbols = _symbols(kept)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first(c) for c in ORDER]
    segments = saved(symbols.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _segments, _typed(kept, "symbols string", "blank bigint", "duplicate bigint", "truncated bigint", "seg bigint")), "segments")
    sequences = saved(segments.select("symbols").distinct(), "sequences")
    matrices = saved(_matrices(sequences, learn_rules(sequences)), "matrices")
    facts = ("blank bigint", "duplicate bigint", "truncated bigint", "seg bigint", "edits string", "cost bigint")
    wanted = [c for c in segments.columns if c != "symbols"]
    conv = pa.field("conv", _arrow(kept))
    keys = pa.schema([conv, ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("piece", pa.int32()),
                      ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("seg", pa.int64()),
                      ("edits", pa.string()), ("cost", pa.int64())])
    edits = (segments.join(matrices, "symbols").select(*wanted, "costs", "audits").repartition("conv")
             .sortWithinPartitions("conv", "seg").mapInArrow(lambda b: _chained(b, keys), _typed(kept, *facts)))
    both = edits.drop("seg").unionByName(
        _copies(kept).select(*ORDER, "text", "m"), allowMissingColumns=True).withColumn("_edits", F.col("edits").isNull())
    streamed = both.repartition("conv").sortWithinPartitions(*order, "_edits")
    if turns:
        schema = pa.schema([conv, ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        out = f"conv {kept.schema['conv'].dataType.simpleString()}, place bigint, role string, text string"
    else:
        numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        schema = pa.schema([conv, *[(n, pa.int64()) for n in numbers], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out = (f"conv {kept.schema['conv'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in numbers)
               + ", audit string, repaired_sha256 string")
    return streamed.mapInArrow(lambda b: _told(b, schema, turns), out).withColumnRenamed("conv", conv_id)


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv"].dataType)


def audit_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per
    conversation: its faults, and the cheapest edits that make its roles legal.

    Turns stand in order of ``turn``, null first; ties by role, then by the text's SHA-256.
    Null roles and texts are one space, so such texts are blank; a null conversation id is
    one conversation. Repeated rows are duplicates. Texts without a character other than
    blanks count as empty; very long ones are read once. Other columns are ignored. An empty
    table gives no rows. One conversation's hash is one task's stream, of which nothing but
    the audit is kept; its dynamic program is cut into segments of many tasks.
    """
    return _repaired(rows, conv_id, turn, role, text, False)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """``conv_id, place, role, text``: the repaired turns, numbered from 0; see
    ``audit_conversations``. Conversations without a turn left have no rows."""
    return _repaired(rows, conv_id, turn, role, text, True)


# ---- damage, as the query has it

def fault_number(conv_id: Column, turn: Column) -> Column:
    """Number from 0 to 19 that follows from conversation and turn (null: one space)."""
    key = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    return F.crc32(F.encode(key, "utf-8")) % 20


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults put in: dropped, emptied, cut, repeated, or of another role."""
    fault = fault_number(F.col("conv_id"), F.col("turn"))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
            .where("fault <> 0")
            .withColumn("text", F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDS, ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", "role", "text"))
