"""Mixing documents to target shares of domains by soft membership.

A classifier trained from labels gives each document a posterior over the domains. A
document's rate is how often it is to be taken; the expected tokens of a domain are
the sum of rate x posterior x tokens. Rates are the nonnegative least squares fit of
those totals to the targets, each domain's miss measured as a share of its own target,
so that a small domain counts as much as a large one. Projected gradient from rates of
one: the gradient of a document is a combination of its own posteriors, so a step is an
expression over a document's own columns and an aggregation of the totals; no step moves
documents. The gradient is scaled by the second moments of the documents that are free
to move (in the two-metric form, where those at their bound that it would push beyond it
stay), which meets targets that can be met in a few steps. Where such a step does not
help, as no rates meet the targets, accelerated steps go on to the optimum, each document
by a length of its own: the posteriors bound the curvature by a diagonal, so a pure
document of a small domain does not hold back those of a large one. After a scaled step,
and after every ``REPLAYED`` of the others, its few numbers per document are written and
read back; the steps since then are worked out again, so a step is one aggregation.

The fit ends when all totals are at their targets, or when no step can bring them
nearer: the projected gradient is zero. The miss that is left is a column of the result,
and no number of steps ends the fit before.

Null and empty texts have no tokens: they weigh nothing, and their rate follows their
posterior like any other. A domain without tokens cannot be met and is left out of the
fit. Repeated rows have one rate each. Missing labels: all domains alike. Without tokens
all rates are one. Columns of the input do not clash: a row is carried as one struct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import FIT_ROWS, labelled_sample, saved
from tabwright.llm.grams import GramModel, fit, words_of

#: Domains by label: good, bad, toxic.
DOMAINS = ("clean", "junk", "toxic")
#: Shares of the tokens that are to come from each domain.
TARGETS = (0.96, 0.035, 0.005)
#: The fit ends if each total is this near its target (as a share of it), or if a step
#: along the gradient, of one length for all documents, would change the rates by no more
#: than this (root of the mean square over tokens).
TOLERANCE, STILL = 1e-4, 1e-6
#: So many accelerated steps are worked out again before their state is written.
REPLAYED = 16
SEED = 11


def domain_of() -> F.Column:
    """The domain's number from the two labels; null if either is unknown."""
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return F.when(
        known, F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    )


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> GramModel:
    sample = saved(labelled_sample(docs, labels, domain_of(), bound), "domain_sample")
    return fit(sample, len(DOMAINS), lambda: words_of)


def with_posteriors(docs: DataFrame, model: GramModel) -> DataFrame:
    """The frame with ``tokens`` (words) and ``posterior`` (array over the domains)."""

    @F.arrow_udf("tokens long, posterior array<double>")
    def posterior(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            tokens, shares = model.shares(texts)
            ends = np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(shares.ravel()))
            yield pa.StructArray.from_arrays([pa.array(tokens), lists], ["tokens", "posterior"])

    both = docs.withColumn("_mix", posterior("text"))
    return both.withColumns(
        {"tokens": F.col("_mix.tokens"), "posterior": F.col("_mix.posterior")}
    ).drop("_mix")


@dataclass(frozen=True)
class Step:
    """What a document's posteriors are multiplied by to get its move; the gradient that
    says which documents are free, in scaled steps; what the posteriors are multiplied by
    to get the number that divides the move, and the momentum, in the other ones."""

    move: np.ndarray
    gradient: np.ndarray | None = None
    bounds: np.ndarray | None = None
    momentum: float = 0.0


@dataclass
class Fit:
    """The steps that lead from rates of one to the fitted ones, the tokens then expected
    of each domain, those wanted, and which domains have any."""

    steps: list[Step]
    totals: np.ndarray
    wanted: np.ndarray
    reachable: np.ndarray

    @property
    def gap(self) -> float:
        """The largest miss of a domain that has tokens, as a share of its target."""
        miss = np.abs(self.totals - self.wanted)[self.reachable]
        return float((miss / self.wanted[self.reachable]).max(initial=0.0))


def _after(posteriors, floors, ahead, move: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rates after a step of each document's own length."""
    curvature = posteriors @ bounds
    return np.maximum(floors, ahead - posteriors @ move / np.where(curvature > 0, curvature, 1.0))


def _moved(posteriors, floors, rate, ahead, steps: Sequence[Step]) -> tuple[np.ndarray, ...]:
    """(rate, ahead) after the steps. Accelerated ones start ``ahead`` of the rate, moved
    on by the momentum of the one before."""
    for step in steps:
        if step.gradient is not None:
            free = (rate > floors) | (posteriors @ step.gradient < 0)
            rate = np.where(free, np.maximum(floors, rate - posteriors @ step.move), rate)
            ahead = rate
        else:
            after = _after(posteriors, floors, ahead, step.move, step.bounds)
            ahead, rate = after + step.momentum * (after - rate), after
    return rate, ahead


def rates(posteriors: np.ndarray, floors: np.ndarray, steps: Sequence[Step]) -> np.ndarray:
    """Rates after the steps, from one each."""
    ones = np.ones(len(posteriors))
    return _moved(posteriors, floors, ones, ones, steps)[0]


def _matrix(posteriors: pd.Series) -> np.ndarray:
    return np.stack(posteriors.to_list()) if len(posteriors) else np.zeros((0, len(DOMAINS)))


def least_rate(keep_first: bool) -> Column:
    """One for documents that are most likely of the first domain, if they are to be
    kept; else zero."""
    likely = F.col("posterior")[0] >= F.array_max("posterior")
    return F.when(likely & F.lit(keep_first), 1.0).otherwise(0.0)


def fit_rates(
    members: DataFrame,
    targets: Sequence[float],
    first_times: float | None = None,
    floor: Column | None = None,
) -> Fit:
    """Fit over (tokens, posterior). All the tokens wanted are as many as there are, or
    with ``first_times`` so many that the first domain is wanted so many times over. No
    rate goes below its ``floor``, which is one at most."""
    k = len(targets)
    names = [f"p{i}" for i in range(k)]
    state = saved(
        members.select(
            F.col("tokens").cast("double").alias("tokens"),
            *(F.col("posterior")[i].alias(name) for i, name in enumerate(names)),
            (F.lit(0.0) if floor is None else floor).alias("floor"),
            F.lit(1.0).alias("rate"),
            F.lit(1.0).alias("ahead"),
        ),
        "posteriors",
    )
    squares = [F.sum(F.col("tokens") * F.col(a) * F.col(b)) for a in names for b in names]
    first = state.agg(F.sum("tokens"), *squares).first()
    total = float(first[0] or 0)
    share = np.array(targets, float) / sum(targets)
    if not total:
        return Fit([], np.zeros(k), share, np.zeros(k, bool))
    gram = np.array(first[1:], np.float64).reshape(k, k) / total
    now = gram.sum(axis=1)  # the posteriors of a document add up to one
    want = share if first_times is None else share * (first_times * now[0] / share[0])
    reachable = (np.diag(gram) > 0) & (want > 0)
    scale = np.divide(1.0, want, out=np.zeros(k), where=reachable)

    def along(vector: np.ndarray) -> Column:
        return sum((F.lit(float(v)) * F.col(p) for v, p in zip(vector, names)), F.lit(0.0))

    def measured(frame: DataFrame, *more: Column) -> np.ndarray:
        """Totals after the step, and further sums over the tokens."""
        sums = [F.sum(F.col("tokens") * F.col(p) * F.col("after")) for p in names]
        row = frame.agg(*sums, *(F.sum(F.col("tokens") * c) for c in more)).first()
        return np.array(row, float) / total

    def missed(totals: np.ndarray) -> float:
        return float((((totals - want) * scale) ** 2).sum())

    fit = Fit([], now * total, want * total, reachable)

    def taken(step: Step, totals: np.ndarray) -> None:
        fit.steps.append(step)
        fit.totals = totals * total

    def written(frame: DataFrame, rate: str, ahead: str) -> DataFrame:
        """The state as a table."""
        both = F.col(rate).alias("rate"), F.col(ahead).alias("ahead")
        return saved(frame.select("tokens", *names, "floor", *both), "rates")

    def replayed(steps: Sequence[Step], move: np.ndarray, bounds: np.ndarray) -> DataFrame:
        """The state after ``steps`` (rate, ahead), the rate after one more, and what a step
        of one length for all would change."""

        @F.pandas_udf("rate double, ahead double, after double, change double")
        def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for *columns, floors, rate, ahead in batches:
                p, floors = np.stack([np.asarray(c, float) for c in columns], axis=1), floors.to_numpy()
                rate, ahead = _moved(p, floors, rate.to_numpy(), ahead.to_numpy(), steps)
                after = _after(p, floors, ahead, move, bounds)
                change = np.maximum(floors, ahead - p @ (move / steepest)) - ahead
                yield pd.DataFrame({"rate": rate, "ahead": ahead, "after": after, "change": change})

        now_at = each(*names, "floor", "rate", "ahead").alias("s")
        return state.select("tokens", *names, "floor", now_at).select("tokens", *names, "floor", "s.*")

    helps = True
    while helps and fit.gap >= TOLERANCE:
        gradient = scale**2 * (now - want)
        free = (F.col("rate") > F.col("floor")) | (along(gradient) < 0)
        row = state.where(free).agg(*squares).first()
        moments = np.array([v or 0.0 for v in row], float).reshape(k, k) / total
        move = np.linalg.lstsq(scale[:, None] * moments, scale * (now - want), rcond=1e-10)[0]
        for length in (1.0, 0.25, 0.0625):
            moved = F.greatest("floor", F.col("rate") - along(length * move))
            frame = state.withColumn("after", F.when(free, moved).otherwise(F.col("rate")))
            totals = measured(frame)
            helps = missed(totals) < (1 - 0.1 * length) * missed(now)
            if helps:
                taken(Step(length * move, gradient), totals)
                state, now = written(frame, "after", "after"), totals
                break
    steepest = float(np.linalg.eigvalsh(gram * np.outer(scale, scale))[-1])
    bounds = scale**2 * gram.sum(axis=1)  # no entry is negative: row sums bound the curvature
    pace, ahead_now, still, since = 1.0, now, False, []
    while fit.gap >= TOLERANCE and not still:
        move = scale**2 * (ahead_now - want)
        if len(since) == REPLAYED:
            state, since = written(replayed(since, move, bounds), "rate", "ahead"), []
        frame = replayed(since, move, bounds)
        *totals, change = measured(frame, F.col("change") * F.col("change"))
        totals = np.array(totals)
        if missed(totals) > missed(now):  # the momentum led astray: start it afresh
            pace, momentum = 1.0, 0.0
        else:
            following = (1 + (1 + 4 * pace**2) ** 0.5) / 2
            pace, momentum = following, (pace - 1) / following
        ahead_now = totals + momentum * (totals - now)  # totals are linear in the rates
        since.append(Step(move, bounds=bounds, momentum=momentum))
        taken(since[-1], totals)
        now, still = totals, change**0.5 < STILL
    return fit


def with_rate(members: DataFrame, fit: Fit, floor: Column | None = None) -> DataFrame:
    """The frame with ``rate``: the steps are worked out again for each document."""

    @F.pandas_udf("double")
    def rate(posteriors: pd.Series, floors: pd.Series) -> pd.Series:
        return pd.Series(rates(_matrix(posteriors), floors.to_numpy(float), fit.steps))

    return members.withColumn("rate", rate("posterior", F.lit(0.0) if floor is None else floor))


def copies(rate: F.Column, doc_id: F.Column) -> F.Column:
    """How often a document is taken: the whole part of its rate, and once more with
    the probability of the rest, drawn from a hash of its id."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies, target_gap) of every document; the
    gap, one value, is the largest miss of a domain as a share of its target."""
    model = train(docs, labels)
    members = saved(
        with_posteriors(docs.select("doc_id", "text"), model).drop("text"), "members"
    )
    fitted = fit_rates(members, targets)
    rated = with_rate(members, fitted)
    return rated.select(
        "doc_id",
        "tokens",
        *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)),
        "rate",
        copies(F.col("rate"), F.col("doc_id")).alias("copies"),
        F.lit(fitted.gap).alias("target_gap"),
    )


def resampled(
    docs: DataFrame,
    labels: DataFrame,
    targets: Sequence[float] = TARGETS,
    first_times: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with its own columns. With
    ``first_times``, documents most likely of the first domain are never left out."""
    model = train(docs, labels)
    names = docs.columns
    whole = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "_row.text")
    scored = saved(with_posteriors(whole, model).drop("text"), "members")
    floor = least_rate(first_times is not None)
    rated = with_rate(scored, fit_rates(scored, targets, first_times, floor), floor)
    times = copies(F.col("rate"), F.col("_row.doc_id"))
    return (
        rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times)))
        .select(*(F.col("_row")[c].alias(c) for c in names))
    )
