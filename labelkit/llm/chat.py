"""Chat formatting: role state machine, declarative template, segments with loss flags.

Every conversation is a sorted stretch of rows that one task walks through, so neither
a conversation's turns nor its text are ever gathered in one place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``{role}`` stands for the role. In texts and roles the escape mark and the characters
    of ``escaped_chars`` get the mark in front, so no control string is left whole in them.

    ``moves`` names the roles that may follow a state; a state is the last role, or
    ``start``. A conversation may stop in the states of ``ends``.
    """

    opening: str = "### {role}: "
    closing: str = " </turn>\n"
    escape: str = "\\"
    escaped_chars: str = "#/"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def escaped(self, text: str) -> str:
        return re.sub(f"[{re.escape(self.escape + self.escaped_chars)}]",
                      lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", lambda m: m[1], text, flags=re.DOTALL)

    def opened(self, role: str) -> str:
        """Colons and line ends of a role are written as letters behind the mark."""
        role = self.escaped(role).replace(":", self.escape + "c").replace("\n", self.escape + "n")
        return self.opening.format(role=role)

    def role_of(self, opening: str) -> str:
        before, after = self.opening.split("{role}")
        return re.sub(re.escape(self.escape) + "(.)",
                      lambda m: {"c": ":", "n": "\n"}.get(m[1], m[1]),
                      opening[len(before):len(opening) - len(after)])


SEGMENTS = "conv bigint, turn bigint, seq bigint, segment int, value string, loss boolean, ok boolean, last boolean"


def format_turns(rows: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments ``conv, turn, seq, segment, value, loss, ok, last`` of all conversations.

    Each turn gives three segments: its opening, its text (``loss`` for the template's
    loss roles) and its closing; ``value`` of all segments by ``seq, segment`` is the
    formatted conversation. ``ok``: the turns up to here follow the state machine;
    ``last`` marks the last segment, whose ``ok`` also asks for a permitted end.

    Invalid conversations are formatted too. Null texts are empty, a null role is the
    role ``""`` (never permitted); turns sort by number, null first, equal numbers by role
    and text; repeated rows stay. Rows without a conversation id are one conversation.
    Other columns are ignored. An empty table gives no segments.
    """
    chosen = rows.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                         F.coalesce(F.col(role), F.lit("")).alias("role"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = (chosen.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, ok, seq, held = "start", True, 0, None
        current: object = walk  # no conversation yet

        def segments(row, ends: bool):
            conv_id, at, number, name, value, fine = row
            done = fine and (not ends or name in template.ends)
            loss = name in template.loss_roles
            return [(conv_id, at, number, 0, template.opened(name), False, fine, False),
                    (conv_id, at, number, 1, template.escaped(value), loss, fine, False),
                    (conv_id, at, number, 2, template.closing, False, done, ends)]

        for batch in batches:
            out = []
            for c, t, r, x in zip(batch["conv"].astype(object), batch["turn"].astype(object),
                                  batch["role"], batch["text"], strict=True):
                c, t = (None if pd.isna(v) else int(v) for v in (c, t))
                new = c != current
                if held is not None:
                    out += segments(held, new)
                if new:
                    current, state, ok, seq = c, "start", True, 0
                ok = ok and r in template.moves.get(state, ())
                held, state, seq = (c, t, seq, r, x, ok), r, seq + 1
            if out:
                yield _segments(out)
        if held is not None:
            yield _segments(segments(held, True))

    # nullable ids pass as text-free pairs: pandas would turn them into floats
    typed = grouped.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"),
                           "role", "text")
    return typed.mapInPandas(walk, SEGMENTS)


def _segments(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv", "turn", "seq", "segment", "value", "loss", "ok", "last"]
    return pd.DataFrame(rows, columns=names).astype({"conv": "Int64", "turn": "Int64"})


READ = ("conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, valid boolean")


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate(),
              in_order: bool = False) -> DataFrame:
    """Roles and texts recovered from the segments, as digests per conversation.

    ``in_order``: the segments come straight from ``format_turns``, conversation after
    conversation; others are brought into that order first.

    ``conv, n_turns, turns_sha256`` (role, line end, text, line end per turn),
    ``loss_chars, loss_sha256`` (texts under the loss mask), ``formatted_chars, valid``.
    Digests grow segment by segment; segments of a conversation never meet in memory.
    """
    ordered = segments.select(F.col("conv").cast("string").alias("conv"), "seq", "segment", "value",
                              "loss", "ok", "last")
    if not in_order:
        ordered = ordered.repartition("conv").sortWithinPartitions("conv", "seq", "segment")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        for batch in batches:
            out = []
            for c, part, value, masked, ok, last in zip(
                    batch["conv"].astype(object), batch["segment"], batch["value"], batch["loss"],
                    batch["ok"], batch["last"], strict=True):
                chars += len(value)
                if part == 0:
                    turns.update(f"{template.role_of(value)}\n".encode())
                    n += 1
                elif part == 1:
                    plain = template.unescaped(value)
                    turns.update(f"{plain}\n".encode())
                    if masked:
                        loss.update(plain.encode())
                        loss_chars += len(plain)
                if last:
                    out.append((None if pd.isna(c) else int(c), n, turns.hexdigest(), loss_chars,
                                loss.hexdigest(), chars, bool(ok)))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
            if out:
                names = [c.split()[0] for c in READ.split(", ")]
                yield pd.DataFrame(out, columns=names).astype({"conv": "Int64"})

    return ordered.mapInPandas(read, READ)


def parse_formatted(formatted: str, template: ChatTemplate = ChatTemplate()) -> list[tuple[str, str]]:
    """Roles and texts of one formatted conversation: an exact inverse of the formatting.

    Texts hold no closing and roles no colon, so the first of each is the real one.
    """
    after = template.opening.split("{role}")[1]
    turns, at = [], 0
    while at < len(formatted):
        start = formatted.index(after, at) + len(after)
        stop = formatted.index(template.closing, start)
        turns.append((template.role_of(formatted[at:start]), template.unescaped(formatted[start:stop])))
        at = stop + len(template.closing)
    return turns
