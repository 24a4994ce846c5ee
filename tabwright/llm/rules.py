"""Quality rules: a decision list learnt by sequential covering from labelled
statistics of texts, and emitted as ordered conditional expressions of Spark.

A rule is a conjunction of thresholds on statistics. It is grown literal by literal for
the most information gain on two thirds of the labelled rows not covered yet, pruned
to the beginning that does best on the last third, and kept while it is right more
often than not there. A row gets the verdict of the first rule that fits; else "keep".

Null and empty texts have no words: every statistic is zero. Statistics are of whole
texts, by column functions only. A window is compared by a 64-bit hash of its words.
Without labels of both kinds the list is empty and keeps everything. Other columns of
the input are not looked at; repeated rows are rows of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import FIT_ROWS, WORD_GAP, labelled_sample, saved

WINDOW = 5
CUTS = 32
MAX_RULES = 12
MAX_LITERALS = 4
#: A rule must be right on more than this share of the rows it covers when pruned.
LEAST_PRECISION = 0.5
SUPPORT = 5


def statistics() -> dict[str, Column]:
    """Statistics that rules may test, from the base columns."""

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "marks": share("n_marks", "n_words"),
        "capitals": share("n_upper", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
    }


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the base columns n_words, word_chars, n_symbols, n_marks,
    n_upper, n_digits, n_lines, n_dup_lines and n_repeat_words (long) of a text.

    Only a text with a window that occurs twice sorts its windows; equal ones then lie
    side by side, and the words they cover are counted by a fold over their places."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def matching(pattern: str) -> Column:
        return (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")

    step = df.withColumn("_t", whole)
    step = step.withColumn("_w", F.array_remove(F.split("_t", WORD_GAP), "")).withColumn(
        "_l", F.filter(F.split("_t", "\n"), lambda x: F.regexp_replace(x, WORD_GAP, "") != "")
    )
    hashed = ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
    step = step.withColumn(
        "_h",
        F.expr(
            f"case when size(_w) < {WINDOW} then array() else "
            f"transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({hashed})) end"
        ),
    )
    repeated = F.expr(f"""
        case when size(array_distinct(_h)) = size(_h) then 0L else aggregate(
            transform(
                array(sort_array(transform(_h, (h, i) -> struct(h as h, i as i)))),
                s -> sort_array(transform(
                    filter(
                        transform(s, (x, k) -> struct(x.i as i,
                            (k > 0 and s[greatest(k - 1, 0)].h = x.h) or
                            (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h) as twice)),
                        y -> y.twice),
                    y -> y.i)))[0],
            struct(0L as n, 0 as upto),
            (a, i) -> struct(a.n + i + {WINDOW} - greatest(a.upto, i) as n, i + {WINDOW} as upto),
            a -> a.n) end""")
    return step.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": matching("[#*$%&|<>]+"),
            "n_marks": matching("[!?]+"),
            "n_upper": matching("\\p{Lu}+"),
            "n_digits": matching("[0-9]+"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": repeated,
        }
    ).drop("_t", "_w", "_l", "_h")


@dataclass(frozen=True)
class Literal:
    """``statistic > cut`` if ``above``, else ``statistic <= cut``. ``place`` is the
    cut's number among those of the statistic."""

    statistic: str
    above: bool
    cut: float
    place: int

    def condition(self, value: Column) -> Column:
        return value > self.cut if self.above else value <= self.cut

    def binned(self) -> Column:
        column = F.col(self.statistic)
        return column > self.place if self.above else column <= self.place


Rule = tuple[Literal, ...]


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gained by a literal on the rows it keeps."""
    if not bad:
        return 0.0
    return bad * (
        math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before))
    )


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the literal of most gain until the rule covers no good row."""
    rule: Rule = ()
    while len(rule) < MAX_LITERALS:
        kept = rows.where(_all(x.binned() for x in rule))
        bins = F.explode(
            F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("b")) for s in cuts))
        )
        table = (
            kept.select("bad", bins.alias("x"))
            .groupBy("x.s", "x.b")
            .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
            .collect()
        )
        if not table:
            break
        one = next(iter(cuts))
        bad_all = sum(r["bad"] for r in table if r["s"] == one)
        good_all = sum(r["good"] for r in table if r["s"] == one)
        if not bad_all or not good_all:
            break
        best: tuple[float, Literal] | None = None
        for name, values in cuts.items():
            counts = {r["b"]: (r["bad"], r["good"]) for r in table if r["s"] == name}
            bad = good = 0
            for place, cut in enumerate(values):  # rows with bin <= place
                more = counts.get(place, (0, 0))
                bad, good = bad + more[0], good + more[1]
                for above, b, g in ((False, bad, good), (True, bad_all - bad, good_all - good)):
                    value = gain(b, g, bad_all, good_all)
                    if b >= SUPPORT and (best is None or value > best[0]):
                        best = (value, Literal(name, above, cut, place))
        if best is None or best[0] <= 0.1:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float]:
    """The beginning of the rule with the best (bad - good) / (bad + good), and its
    share of bad rows; the shorter of equals."""
    sums = []
    for n in range(1, len(rule) + 1):
        fits = _all(x.binned() for x in rule[:n]).cast("long")
        sums += [F.sum(fits * F.col("bad")).alias(f"b{n}"), F.sum(fits).alias(f"n{n}")]
    row = rows.agg(*sums).first()
    worth = [(row[f"b{n}"] or 0, row[f"n{n}"] or 0) for n in range(1, len(rule) + 1)]
    shares = [b / n if n else 0.0 for b, n in worth]
    best = max(range(len(rule)), key=lambda i: (shares[i], -i))
    return rule[: best + 1], shares[best]


def learn(sample: DataFrame) -> list[Rule]:
    """The decision list from a bounded written table (doc_id, text, label), label 1
    for rows to keep. What reaches the driver is a histogram of each statistic."""
    names = statistics()
    stats = with_base(sample).select(
        (1 - F.col("label")).cast("long").alias("bad"),
        (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0).alias("pruning"),
        *(c.cast("double").alias(s) for s, c in names.items()),
    )
    stats = saved(stats.repartition(4), "statistics")
    quantiles = [i / CUTS for i in range(1, CUTS)]
    found = stats.agg(*(F.percentile_approx(s, quantiles, 10_000).alias(s) for s in names)).first()
    cuts = {s: sorted({*(found[s] or [])}) for s in names}
    cuts = {s: v for s, v in cuts.items() if v}
    if not cuts:
        return []
    binned = [
        sum(((F.col(s) > cut).cast("int") for cut in v), F.lit(0)).alias(s)
        for s, v in cuts.items()
    ]
    rows = saved(stats.select("bad", "pruning", *binned), "binned")
    grown, pruned = rows.where(~F.col("pruning")), rows.where("pruning")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow(grown, cuts)
        if not rule:
            break
        rule, precision = _prune(pruned, rule)
        if precision <= LEAST_PRECISION:
            break
        rules.append(rule)
        left = ~_all(x.binned() for x in rule)
        grown, pruned = grown.where(left), pruned.where(left)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule
    that fits, from 1, or 0."""
    names = statistics()
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(x.condition(names[x.statistic]) for x in rule), number).otherwise(out)
    return out


def described(rules: list[Rule]) -> list[str]:
    return [
        " and ".join(f"{x.statistic} {'>' if x.above else '<='} {x.cut:.6g}" for x in rule)
        for rule in rules
    ]


def judged(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rule) of every document; rule is the number of the first rule
    that fits, 0 if none."""
    sample = saved(labelled_sample(docs, labels, F.col("quality"), bound), "quality_sample")
    rules = learn(sample)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    based = with_base(docs.select("doc_id", "text")).drop("text")
    return based.withColumns({"base_failed": failed, "rule": verdict(rules)}).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"),
        "rule",
    )
