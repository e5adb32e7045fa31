"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, named by the SHA-256 of its content. The ledger holds
what each rule version found in each blob; only pairs that it lacks are scanned, each
blob once however many paths hold it. Findings are then joined back to all paths.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.llm.common import fresh, let
from labelkit.folders import saved


@dataclass(frozen=True)
class SecretRule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` is shorter than
    ``least`` are dropped after matching. ``hints``: one of these stands in every lower-cased
    text that can match (none: every text is searched). ``part``: a regular expression, alike in Java
    and Python, that stands in every match of a rule without hints."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    any_case: bool = False
    part: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, lowered: str) -> Iterator[tuple[int, int]]:
        if self.hints and not any(h in lowered for h in self.hints):
            return
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        for m in re.compile(self.pattern, flags).finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


BASE_KINDS = ("assign", "access", "hex")

RULES = (
    SecretRule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               2, 6, ("passw", "secret", "token", "api"), True),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    # a run of 24 or more starts where its first digit stands, as the run itself does
    SecretRule("hex", 1, r"[0-9a-f]{24,}", part="[0-9a-f]{24}"),
    SecretRule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    SecretRule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    SecretRule("google", 1, r"\bAIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
    SecretRule("stripe", 1, r"\b[rs]k_live_[A-Za-z0-9]{16,}", hints=("k_live_",)),
    SecretRule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
)

LEDGER = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"
_SPAN = "array<struct<start:bigint,kind:string,end:bigint>>"


def blob_of(text: Column) -> Column:
    """Content address of a text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def may_match(text: Column, rules: Sequence[SecretRule] = RULES) -> Column:
    """False only for texts in which no rule can find anything; never null."""
    hints = {h for r in rules for h in r.hints}
    if not all((r.hints or r.part) and "".join(r.hints).isascii() for r in rules):
        return F.lit(True)
    value = F.coalesce(text, F.lit(""))
    hinted = let(F.lower(value), lambda v: functools.reduce(Column.__or__, [v.contains(h) for h in sorted(hints)], F.lit(False)))
    return functools.reduce(Column.__or__, [value.rlike(r.part) for r in rules if not r.hints], hinted)


def _scan(batches: Iterator[pd.DataFrame], rules: Sequence[SecretRule]) -> Iterator[pd.DataFrame]:
    names = ["blob", "rule", "spans"]
    for batch in batches:
        rows = []
        for blob, text, seen in zip(batch["blob"], batch["text"], batch["seen"], strict=True):
            text = text or ""  # null: nothing can be found
            lowered, seen = text.lower(), set(() if seen is None else seen)
            rows += [(blob, r.key, [{"start": a, "end": b} for a, b in r.spans(text, lowered)])
                     for r in rules if r.key not in seen]
        yield pd.DataFrame(rows, columns=names)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[SecretRule] = RULES,
                  text: str = "text") -> DataFrame:
    """New ledger rows ``blob, rule, spans`` for the pairs that ``ledger`` lacks.

    Places count code points, end exclusive. A pair without findings has an empty list,
    so that it is not scanned again. Texts are dealt out by content; equal ones are put
    together before they are sent, so a text that fills a third of the table is one row
    per task. Of a text without any rule's hint the name alone is sent.
    """
    blobs = (docs.select(blob_of(F.col(text)).alias("blob"), F.when(may_match(F.col(text), rules), F.col(text)).alias("text"))
             .dropDuplicates(["blob"]))
    if ledger is None:
        todo = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    else:
        keys = [r.key for r in rules]
        seen = ledger.where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(keys))
    rules = tuple(rules)
    return todo.mapInPandas(lambda batches: _scan(batches, rules), LEDGER)


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[SecretRule] = RULES,
                 text: str = "text", spans: str = "spans") -> tuple[DataFrame, DataFrame]:
    """Documents with all findings of the rules, and the new ledger rows (saved).

    ``spans`` is an array of ``start, kind, end`` by start, then by the order of the rules;
    it replaces a column of that name. Null texts are empty; repeated texts are scanned
    once and all get the findings; other columns stay; an empty table gives empty tables.
    """
    added = saved(update_ledger(docs, ledger, rules, text), "ledger")
    keys = [r.key for r in rules]
    known = added if ledger is None else added.unionByName(ledger.select("blob", "rule", "spans"))
    blob, found = fresh(docs, "blob", "found")
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("rule"))
    kind = F.regexp_replace("rule", "@[0-9]+$", "")
    flat = known.where(F.col("rule").isin(keys) & (F.size("spans") > 0)).select("blob", F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), place.alias("place"), kind.alias("kind"),
                                    s["end"].alias("end"))).alias("part"))
    # one row per blob: the findings of one text; only texts with findings
    by_blob = saved(flat.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("all")), "findings")
    by_blob = by_blob.select(F.col("blob").alias(blob), F.transform("all", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias(found))
    # texts without any rule's hint have no findings and need not be exchanged for them; the ledger may hold findings of earlier hints
    may = may_match(F.col(text), rules) if ledger is None else F.lit(True)
    none = F.array().cast(_SPAN)
    joined = (docs.where(may).withColumn(blob, blob_of(F.col(text))).join(by_blob, blob, "left")
              .withColumn(spans, F.coalesce(F.col(found), none)).drop(blob, found))
    return (joined if ledger is not None else joined.unionByName(docs.where(~may).withColumn(spans, none))), added


def redact_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES, text: str = "text",
                   mark: str = "[secret]") -> DataFrame:
    """Documents with every finding replaced by ``mark``; overlapping ones by one mark."""
    spans, = fresh(docs, "spans")
    found, _ = scan_secrets(docs, rules=rules, text=text, spans=spans)

    @F.pandas_udf("string")
    def redacted(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for value, marks in zip(texts, places, strict=True):
            parts, at = [], 0
            for m in marks:
                if m["start"] >= at:
                    parts += [value[at:m["start"]], mark]
                at = max(at, m["end"])
            out.append("".join([*parts, value[at:]]))
        return pd.Series(out)

    value = F.when(F.size(spans) == 0, F.col(text)).otherwise(redacted(F.coalesce(F.col(text), F.lit("")), F.col(spans)))
    return found.withColumn(text, value).drop(spans)
