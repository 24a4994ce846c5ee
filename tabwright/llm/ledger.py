"""Secret scans with an incremental ledger of content-addressed texts.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds
the pairs of text and rule version that have been scanned, with the spans found; a run
scans one copy of each text whose pair is not in it, adds those, and joins the spans
back to all paths that have the text. A new rule version, or a new text, is all that a
later run has to read again.

Null text is scanned as empty text. Repeated rows and copies are rows of their own in
the result. Base rules are fixed; further rules only add spans. Null ids are paths
like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import saved
from tabwright.sources.workspace import fresh_path

#: Fixed values, in the order in which spans of one start are listed: kind, pattern,
#: group to measure, least length of that group.
BASE_RULES = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
    ("url", r"://[^\s/:@]+:([^\s/:@]+)@", 1, 1),
)
BASE_KINDS = tuple(kind for kind, *_ in BASE_RULES)
SPAN = "array<struct<start: long, kind: int, `end`: long>>"
LEDGER = f"blob binary, version string, spans {SPAN}"
#: What one of the kinds needs to be there; texts without it are not looked at further.
_NEEDED = {
    "assign": re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII),
    "access": re.compile(r"AKIA"),
    "hex": re.compile(r"[0-9a-f]{32}"),
    "pem": re.compile(r"-----BEGIN "),
    "jwt": re.compile(r"eyJ"),
    "url": re.compile(r"://"),
}
RULES = tuple(
    (i, kind, re.compile(pattern, re.ASCII), group, least)
    for i, (kind, pattern, group, least) in enumerate((*BASE_RULES, *MORE_RULES))
)
#: Rules are told apart by what they are, so an edited rule is a new version.
RULES_VERSION = hashlib.sha256(repr((BASE_RULES, MORE_RULES)).encode()).hexdigest()[:16]


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all rules, in order; positions are code points."""
    found = []
    for number, kind, pattern, group, least in RULES:
        if _NEEDED[kind].search(text):
            found += [
                (m.start(), number, m.end())
                for m in pattern.finditer(text)
                if len(m.group(group)) >= least
            ]
    return sorted(found)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [
            [{"start": s, "kind": k, "end": e} for s, k, e in spans_of(t or "")]
            for t in batch["text"]
        ]
        yield pd.DataFrame({"blob": batch["blob"], "spans": spans})


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def addressed(docs: DataFrame) -> DataFrame:
    """The frame with ``blob``, the address of its text."""
    return docs.withColumn("blob", _address(F.col("text")))


def _address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_unseen(docs: DataFrame, ledger: DataFrame, version: str = RULES_VERSION) -> DataFrame:
    """The rows to add to the ledger: one per text of ``docs`` whose pair with the rule
    version is not in it. Addresses alone settle which path is read for each text (the
    smallest), so that copies, however many, are dropped by a join on address and path
    together, which no text dominates; few pending texts are joined without moving
    the others."""
    rows = addressed(docs.select("doc_id", "text")).select(
        "blob", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("path"), "text"
    )
    seen = ledger.where(F.col("version") == version).select("blob")
    reps = rows.groupBy("blob").agg(F.min("path").alias("path"))
    pending = saved(reps.join(seen, "blob", "left_anti"), "pending")
    read = rows.join(pending, ["blob", "path"], "left_semi").select("blob", "text")
    scanned = read.mapInPandas(_scan, f"blob binary, spans {SPAN}")
    return scanned.dropDuplicates(["blob"]).select(
        "blob", F.lit(version).alias("version"), "spans"
    )


def findings(docs: DataFrame, ledger: DataFrame, version: str = RULES_VERSION) -> DataFrame:
    """The frame with ``spans``: what the ledger says of each row's text. Only texts
    with a finding are joined; the rest get an empty list. A pair that overlapping runs
    have put into the ledger twice counts once. A column ``spans`` of the frame gives way
    to the findings; all others are carried as one struct and come back as they were."""
    names = [c for c in docs.columns if c != "spans"]
    hits = ledger.where((F.col("version") == version) & (F.size("spans") > 0))
    hits = hits.dropDuplicates(["blob"]).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    rows = docs.select(F.struct(*names).alias("_row"), _address(F.col("text")).alias("_blob"))
    joined = rows.join(hits, "_blob", "left")
    return joined.select(
        *(F.col("_row")[c].alias(c) for c in names),
        F.coalesce("_spans", F.array().cast(SPAN)).alias("spans"),
    )


def scan_corpus(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` has not seen, append it there, and give
    every row its spans. Without a path the ledger starts empty in the shared folder."""
    spark = docs.sparkSession
    if ledger_path is None:
        ledger_path = fresh_path(spark, "ledger")
        empty_ledger(spark).write.parquet(ledger_path)
    ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    scan_unseen(docs, ledger).write.mode("append").parquet(ledger_path)
    return findings(docs, spark.read.schema(LEDGER).parquet(ledger_path))


def _joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(kind) for _, kind, *_ in RULES))
    one = F.transform(
        spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])
    )
    return F.array_join(one, ",")


def _count(kind: int) -> Column:
    """The spans of one kind. A second parameter of the function, even one with a value
    of its own, would be given the place in the array."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest_rows(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    counts = [_count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redacted(found: DataFrame) -> DataFrame:
    """``text`` with each stretch covered by spans replaced by one mark; rows without
    spans are left as they are, and ``n_chars``, if there, is counted again."""
    text = F.expr("""
        case when size(spans) = 0 then text else aggregate(
            spans,
            struct('' as done, 0L as at),
            (s, x) -> case when x.`end` <= s.at then s else struct(
                case when x.start >= s.at
                     then concat(s.done, substring(text, int(s.at) + 1, int(x.start - s.at)), '[secret]')
                     else s.done end as done,
                x.`end` as at) end,
            s -> concat(s.done, substring(text, int(s.at) + 1)))
        end""")
    out = found.withColumn("text", text)
    if "n_chars" in found.columns:
        count = F.when(F.size("spans") > 0, F.length("text").cast("long"))
        out = out.withColumn("n_chars", F.coalesce(count, F.col("n_chars")))
    return out.drop("spans")
