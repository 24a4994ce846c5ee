"""Data checks: any number of rules, one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.vectors import vector_size


class ValidationError(ValueError):
    """At least one rule of severity 'error' does not hold."""


Results = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """``measures`` are aggregates over the table; ``ok`` and ``observed`` are built
    from their results. A rule on absent columns fails without being evaluated. Measures
    of parts of a table add up, but for those whose function is in ``merge``."""

    name: str
    expected: str
    measures: dict[str, Column]
    ok: Callable[[Results], Column]
    observed: Callable[[Results], Column]
    columns: tuple[str, ...] = ()
    severity: str = "error"
    merge: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnsPresent:
    """Answered from the schema; no data is read for it."""

    columns: tuple[str, ...]
    name: str = "columns_present"
    severity: str = "error"


def columns_present(*columns: str) -> ColumnsPresent:
    return ColumnsPresent(tuple(columns))


def _none(name: str, bad: Column, columns=(), severity: str = "error") -> Rule:
    """No row is bad."""
    return Rule(
        name=name,
        expected="0",
        measures={"bad": F.count_if(bad)},
        ok=lambda r: r["bad"] == 0,
        observed=lambda r: r["bad"],
        columns=columns,
        severity=severity,
    )


def no_nulls(column: str) -> Rule:
    return _none(f"no_nulls:{column}", F.col(column).isNull(), (column,))


def none_where(name: str, condition: Column, severity: str = "error") -> Rule:
    return _none(name, condition, severity=severity)


def numeric_text(column: str) -> Rule:
    """Every value of the text column is present and reads as a number."""
    unreadable = F.col(column).try_cast("double").isNull()
    return _none(f"numeric:{column}", unreadable, (column,))


def not_empty() -> Rule:
    return Rule(
        name="not_empty",
        expected=">0",
        measures={"rows": F.count(F.lit(1))},
        ok=lambda r: r["rows"] > 0,
        observed=lambda r: r["rows"],
    )


def row_count_is(expected: int, severity: str = "error") -> Rule:
    return Rule(
        name="row_count",
        expected=str(expected),
        measures={"rows": F.count(F.lit(1))},
        ok=lambda r: r["rows"] == expected,
        observed=lambda r: r["rows"],
        severity=severity,
    )


def domain(column: str, allowed: Sequence, complete: bool = False) -> Rule:
    """Only allowed values occur; with ``complete`` each of them does occur. Counts
    are kept per allowed value, so a column of many values stays cheap. NULLs are
    left to ``no_nulls``."""
    value = F.col(column)
    seen = {f"seen{i}": F.count_if(value == v) for i, v in enumerate(allowed)}

    def absent(r: Results) -> Column:
        return reduce(Column.__add__, [(r[s] == 0).cast("bigint") for s in seen])

    return Rule(
        name=f"domain:{column}",
        expected=("equal " if complete else "subset ") + ",".join(map(str, allowed)),
        measures={"outside": F.count_if(~value.isin(*allowed)), **seen},
        ok=lambda r: (r["outside"] + absent(r) if complete else r["outside"]) == 0,
        observed=lambda r: F.concat(F.lit("outside="), r["outside"], F.lit(" absent="), absent(r)),
        columns=(column,),
    )


def width_is(vector: str, expected: int, severity: str = "error") -> Rule:
    """Every vector has the expected length: smallest and largest over all rows."""
    size = vector_size(vector)
    return Rule(
        name=f"width:{vector}",
        expected=str(expected),
        measures={"low": F.min(size), "high": F.max(size)},
        ok=lambda r: (r["low"] == expected) & (r["high"] == expected),
        observed=lambda r: F.concat_ws("-", r["low"], r["high"]),
        columns=(vector,),
        severity=severity,
        merge={"low": F.min, "high": F.max},
    )


def _measured(
    rules: Sequence[Rule | ColumnsPresent], columns: Iterable[str]
) -> list[tuple[Rule, dict[str, str]]]:
    """The rules that data is read for, and the names of their measures in one aggregate."""
    present = set(columns)
    return [
        (rule, {m: f"{place}_{m}" for m in rule.measures})
        for place, rule in enumerate(rules)
        if isinstance(rule, Rule) and set(rule.columns) <= present
    ]


def measures(rules: Sequence[Rule | ColumnsPresent], columns: Iterable[str]) -> dict[str, Column]:
    """Every measure of the rules over a table of these columns, by name."""
    named = {"rows": F.count(F.lit(1))}
    for rule, names in _measured(rules, columns):
        named |= {names[m]: c for m, c in rule.measures.items()}
    return named


def merges(
    rules: Sequence[Rule | ColumnsPresent], columns: Iterable[str]
) -> dict[str, Callable[[Column], Column]]:
    """How each measure of a whole comes from those of its parts. Without parts a count
    is zero, an extreme NULL, as over no rows."""

    def total(part: Column) -> Column:
        return F.coalesce(F.sum(part), F.lit(0))

    named = {"rows": total}
    for rule, names in _measured(rules, columns):
        named |= {names[m]: rule.merge.get(m, total) for m in rule.measures}
    return named


def report(
    totals: DataFrame, rules: Sequence[Rule | ColumnsPresent], columns: Iterable[str]
) -> DataFrame:
    """One row (rule, severity, ok, observed, expected) per rule, from the one row of
    their measures."""
    present = set(columns)
    known = {id(rule): names for rule, names in _measured(rules, present)}
    entries = []
    for rule in rules:
        if isinstance(rule, ColumnsPresent):
            missing = [c for c in rule.columns if c not in present]
            entries.append(
                _entry(rule, F.lit(not missing), F.lit(",".join(missing)), "")
            )
        elif id(rule) not in known:
            entries.append(
                _entry(rule, F.lit(False), F.lit("missing column"), rule.expected)
            )
        else:
            results = {m: F.col(n) for m, n in known[id(rule)].items()}
            entries.append(
                _entry(rule, rule.ok(results), rule.observed(results), rule.expected)
            )
    return totals.select(F.inline(F.array(*entries)))


def validate(df: DataFrame, rules: Sequence[Rule | ColumnsPresent]) -> DataFrame:
    """One row (rule, severity, ok, observed, expected) per rule, from one pass."""
    totals = df.agg(*[m.alias(name) for name, m in measures(rules, df.columns).items()])
    return report(totals, rules, df.columns)


def _entry(rule, ok: Column, observed: Column, expected: str) -> Column:
    return F.struct(
        F.lit(rule.name).alias("rule"),
        F.lit(rule.severity).alias("severity"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        observed.cast("string").alias("observed"),
        F.lit(expected).alias("expected"),
    )


def enforce(report: DataFrame) -> list[str]:
    """Raise if a rule of severity 'error' fails; give back the failed warnings.
    The report has one row per rule, so collecting it is bounded."""
    failed = report.filter(~F.col("ok")).collect()
    lines = [
        f"{r['rule']}: observed {r['observed']}, expected {r['expected']}" for r in failed
    ]
    errors = [x for r, x in zip(failed, lines) if r["severity"] == "error"]
    if errors:
        raise ValidationError("; ".join(errors))
    return lines
