"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided
Jacobi on the triangular factor.

Entries are put on a grid of whole numbers, ``x = floor(GRID * c) + OFFSET``, and the fit
runs over each distinct grid vector once. Tasks add up their vectors' sums (exact) and,
in a second pass, the scatter about the mean; both are of the vectors' width, whatever
the number of rows, and are added up on Spark. The scatter is factored, V = L L', with
the largest remaining pivot first, so the factor stops at the rank. Rotations of pairs
of its columns make them orthogonal: their norms are then the roots of the eigenvalues,
and the columns divided by them the components. Neither the scatter's eigenvalues nor
its square root are ever sought by another way.

Vectors that are null or empty, or hold a null or non-finite entry, take no part; nor do
entries beyond the grid (2^52 steps), and vectors of another length than most rows (of
lengths equally frequent, the longer). Repeated rows and null ids are rows of the
result like any other. Other columns are not looked at. Directions without variance
cannot be whitened and give no component: there are as many as the rank allows, none if
all vectors are equal. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import saved

GRID, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: A pivot below this share of the first one counts as none.
RANK = 1e-13
#: Columns count as orthogonal at this cosine; that many rounds at most.
ORTHOGONAL, SWEEPS = 1e-15, 60
#: Rows that a task turns into one block of numbers.
BLOCK = 4_096


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with the sums of their entries, the components as columns
    (largest eigenvalue first), the eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def on_grid(vector: str, grid: int = GRID, offset: int = OFFSET) -> Column:
    """The grid vector, or null if the vector takes no part."""
    entry = F.col(vector).cast("array<double>")
    limit = float(1 << 52)
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * grid) >= limit))
    cells = F.transform(entry, lambda c: F.floor(c * grid).cast("long") + offset)
    return F.when((F.size(entry) > 0) & ~bad, cells)


def pivoted_cholesky(matrix: np.ndarray, tolerance: float = RANK) -> np.ndarray:
    """L (rows in the matrix's order, a column per pivot) with L L' equal to the
    matrix; a lower triangle once its rows are in the pivots' order."""
    rest = np.diag(matrix).astype(float).copy()
    first = rest.max(initial=0.0)
    columns: list[np.ndarray] = []
    while len(columns) < len(matrix):
        pivot = int(rest.argmax())
        if rest[pivot] <= tolerance * first or rest[pivot] <= 0:
            break
        column = matrix[:, pivot].astype(float)
        for earlier in columns:
            column = column - earlier[pivot] * earlier
        done = rest == -np.inf
        column = np.where(done, 0.0, column) / np.sqrt(rest[pivot])
        column[pivot] = np.sqrt(rest[pivot])
        columns.append(column)
        rest = np.where(done, -np.inf, rest - column**2)
        rest[pivot] = -np.inf
    return np.stack(columns, axis=1) if columns else np.zeros((len(matrix), 0))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs that together are all pairs of 0 .. n-1, as in a
    tournament where one player keeps the place and the others move round."""
    players = list(range(n + n % 2))
    half = len(players) // 2
    for _ in range(len(players) - 1):
        left, right = np.array(players[:half]), np.array(players[half:][::-1])
        real = (left < n) & (right < n)
        yield left[real], right[real]
        players = [players[0], players[-1], *players[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, eigenvalues), largest first, of factor times its
    transpose: columns are rotated in pairs until all are orthogonal."""
    g = factor.copy()
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in _rounds(g.shape[1]):
            a, b = (g[:, i] ** 2).sum(axis=0), (g[:, j] ** 2).sum(axis=0)
            c = (g[:, i] * g[:, j]).sum(axis=0)
            size = np.sqrt(a * b)
            cosine = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > ORTHOGONAL
            i, j, a, b, c = i[turn], j[turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            x, y = g[:, i], g[:, j]
            g[:, i], g[:, j] = cos * (x - t * y), cos * (t * x + y)
        if worst <= len(g) * ORTHOGONAL:
            break
    norms = np.sqrt((g**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return g[:, order] / norms[order], norms[order] ** 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch in blocks, with its grid vectors as rows of a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            cells = part.column("x").flatten().to_numpy(zero_copy_only=False)
            yield part, cells.reshape(part.num_rows, -1)


def _added(fit: DataFrame, kind: str, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of what ``partial`` makes of a block of them. A task
    sends one row per place of the result, and the places are added up on Spark, so
    what is collected is of the result's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            made = partial(x)
            total = made if total is None else total + made
        if total is not None:
            place = np.arange(total.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(total.ravel())], names=["place", "value"]
            )

    parts = fit.select("x").mapInArrow(run, f"place long, value {kind}")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, with the whole part taken off exactly first."""
    whole = sums // n
    return (x - whole) - (sums - whole * n) / n


def with_grid(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that take part, with their grid vectors, as a table."""
    cells = df.select(F.col(vec_id).cast("long").alias("vec_id"), on_grid(vector).alias("x"))
    cells = saved(cells.where(F.col("x").isNotNull()), "grid")
    width = cells.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = width.orderBy(F.desc("n"), F.desc("width")).first()
    return cells.where(F.size("x") == most["width"]) if most else cells


def fit(cells: DataFrame) -> tuple[Whitening, DataFrame]:
    """The whitening of (vec_id, x), and the fit list: each distinct x once."""
    distinct = saved(cells.select("x").distinct(), "fit_list")
    sums = _added(distinct, "long", lambda x: np.append(x.sum(axis=0), len(x)))
    if not len(sums):
        return Whitening(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0), distinct
    n, sums = int(sums[-1]), sums[:-1]
    width = len(sums)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums)
        return y.T @ y

    covariance = _added(distinct, "double", scatter).reshape(width, width) / n
    covariance = (covariance + covariance.T) / 2
    components, eigenvalues = one_sided_jacobi(pivoted_cholesky(covariance))
    return Whitening(n, sums, components, eigenvalues, float(np.trace(covariance))), distinct


def projected(x: np.ndarray, model: Whitening, count: int) -> np.ndarray:
    """Whitened vectors: a column per component."""
    scale = np.sqrt(model.eigenvalues[:count])
    return _centred(x, model.n, model.sums) @ model.components[:, :count] / scale


def deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    """The exact sum of (n x - sums)^2 of each row. One that no long can hold is an
    error, not another number."""
    apart = model.n * (x - model.sums // model.n) - model.sums % model.n
    if (apart.astype(float) ** 2).sum(axis=1).max(initial=0.0) < 2.0**62:
        return (apart * apart).sum(axis=1)
    exact = [sum(int(v) ** 2 for v in row) for row in apart]
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation is too large for a long")
    return np.array(exact, np.int64)


def identity_error(distinct: DataFrame, model: Whitening, count: int) -> float:
    """The largest entry, without sign, of the whitened fit list's covariance minus
    the identity, from the list itself: means first, then products about them."""
    mean = _added(distinct, "double", lambda x: projected(x, model, count).sum(axis=0)) / model.n

    def scatter(x: np.ndarray) -> np.ndarray:
        y = projected(x, model, count) - mean
        return y.T @ y

    covariance = _added(distinct, "double", scatter).reshape(count, count) / model.n
    return float(np.abs(covariance - np.eye(count)).max(initial=0.0))


def whiten(cells: DataFrame, model: Whitening, count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, deviation, whitened) of every row and component."""
    count = min(count, len(model.eigenvalues))
    schema = "vec_id long, component int, deviation long, whitened double"
    if not count:
        return cells.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            rows = pa.array(np.repeat(np.arange(len(x)), count))
            numbers = np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(rows),
                    pa.array(numbers),
                    pa.array(np.repeat(deviations(x, model), count)),
                    pa.array(projected(x, model, count).ravel()),
                ],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return cells.select("vec_id", "x").mapInArrow(run, schema)


def whitened(df: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """Fit and apply: (vec_id, component, n, deviation, whitened, explained,
    identity_error) of every row that takes part and each of the first components."""
    cells = with_grid(df)
    model, distinct = fit(cells)
    count = min(count, len(model.eigenvalues))
    error = identity_error(distinct, model, count) if count else 0.0
    shares = [float(e / model.trace) for e in model.eigenvalues[:count]]
    explained = F.array(*map(F.lit, shares)) if count else F.array().cast("array<double>")
    return whiten(cells, model, count).select(
        "vec_id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.try_element_at(explained, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
