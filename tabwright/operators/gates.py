"""Data checks of a growing Parquet table that scan each file once.

What the rules measure (counts, extremes, which allowed values occur) is kept per file,
one small row each, in a table next to the data. Measures merge, so the report on the
whole table is a fold of those rows, and after an append only the new files are read.

A file is known by its path, length and time of change: one that was rewritten is read
again, and one that was removed no longer counts. Rows kept under other rules or other
columns are not used. Files without rows are kept too. Two runs at a time may both keep
the same file's row; it counts once. Rows are only ever appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.validate import ColumnsPresent, Rule, measures, merges, report

STATE = "file string, length bigint, modified timestamp, rules string, measures map<string,bigint>"
FILE = ["file", "length", "modified"]
#: The column that carries a row's file through the scan.
_FROM = "_gate_file"

Rules = Sequence[Rule | ColumnsPresent]


@dataclass(frozen=True)
class Gates:
    """The report on all files, one row per rule, and how many were read for it."""

    report: DataFrame
    files: int
    scanned: tuple[str, ...]


def _one_spelling(path: Column) -> Column:
    """Readers write a local path with one slash or with three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _decoded(path: Column) -> Column:
    """The path of a row's file, which a scan writes as an address."""
    return _one_spelling(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, modified) of the table's Parquet files, from their listing alone."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return listed.select(
        _one_spelling(F.col("path")).alias("file"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def fingerprint(rules: Rules, columns: Sequence[str], derived: Mapping[str, Column]) -> str:
    """Of what is measured, so that rows kept under other rules are told apart."""
    named = {f"column {n}": str(c) for n, c in derived.items()}
    named |= {f"measure {n}": str(c) for n, c in measures(rules, columns).items()}
    return hashlib.sha256(repr(sorted(named.items())).encode()).hexdigest()[:32]


def file_states(rows: DataFrame, rules: Rules, columns: Sequence[str]) -> DataFrame:
    """(file, length, modified, measures) of the files that have rows. One aggregation;
    a file's rows are added up in each task before the few sums meet."""
    found = measures(rules, columns)
    per_file = rows.groupBy(_FROM).agg(*[c.cast("bigint").alias(n) for n, c in found.items()])
    cells = [x for n in found for x in (F.lit(n), F.col(n))]
    file = [F.col(_FROM)[c].alias(c) for c in FILE]
    return per_file.select(*file, F.create_map(*cells).alias("measures"))


def merged(states: DataFrame, rules: Rules, columns: Sequence[str]) -> DataFrame:
    """The one row of measures of all these files."""
    parts = merges(rules, columns)
    return states.agg(*[fold(F.col("measures")[n]).alias(n) for n, fold in parts.items()])


def _kept(spark: SparkSession, state_path: str, rules: str) -> DataFrame:
    try:
        rows = spark.read.schema(STATE).parquet(state_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STATE)
    return rows.where(F.col("rules") == rules).dropDuplicates(FILE)


def gate_table(
    spark: SparkSession,
    path: str,
    state_path: str,
    rules: Rules,
    derived: Mapping[str, Column] | None = None,
) -> Gates:
    """Check the Parquet table at ``path`` and keep what its new files gave at
    ``state_path``, which must lie outside of it. ``derived`` columns are worked out
    for each row before the rules. The driver gets the paths of the files to read, which
    Spark's own listing holds as well, and nothing else."""
    derived = dict(derived or {})
    whole = spark.read.parquet(path)
    columns = [*whole.columns, *(n for n in derived if n not in whole.columns)]
    mark = fingerprint(rules, columns, derived)
    files = files_of(spark, path)
    kept = _kept(spark, state_path, mark)
    pending = files.join(kept, FILE, "left_anti").select(*FILE)
    paths = sorted(r["file"] for r in pending.select("file").collect())
    if paths:
        source = F.struct(
            _decoded(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_size").alias("length"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        scan = spark.read.schema(whole.schema).option("basePath", path).parquet(*paths)
        rows = scan.withColumn(_FROM, source).withColumns(derived)
        states = pending.join(file_states(rows, rules, columns), FILE, "left")
        new = states.select(*FILE, F.lit(mark).alias("rules"), "measures")
        new.coalesce(1 + len(paths) // 100_000).write.mode("append").parquet(state_path)
        kept = _kept(spark, state_path, mark)
    present = kept.join(files, FILE, "left_semi")
    return Gates(report(merged(present, rules, columns), rules, columns), files.count(), tuple(paths))
