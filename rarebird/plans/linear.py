"""Many linear models in one scan: logistic regression and squared-hinge SVM, L1 or L2 penalty.

Each fit has its own loss, penalty, C, class weights, scaler and held-out fold, and minimises

    penalty(v) + C * sum_i w_i loss(s_i (v . x_i + b)),   s_i = +-1,

over the rows outside its fold. All fits go on in step by proximal Newton (Lee, Sun & Saunders,
2014): one Spark job evaluates every fit at its own trial point (a matrix product of the batch
with all coefficient vectors), sums loss, gradient and Hessian of each in the tasks, adds the
sums by position and returns (d + 1)(d + 4) / 2 + 1 numbers a fit. The driver solves
the small quadratic models, by coordinate descent under L1, and halves a step that raised its
objective. A fit ends when its optimality conditions hold. The job's plan is the same in every
step; only the coefficients that its function carries change. Scaling in a fold is a change of
coordinates of the sums, so rows are never scaled or copied for a fold.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No fold has this number.
NONE = -(1 << 31)


@dataclass(frozen=True)
class Linear:
    """One fit. ``hold`` is the fold it leaves out (None: none), ``class_weights`` those of labels 0 and 1,
    ``penalise_intercept`` counts b as a feature of value 1, as the reference library's primal does."""

    loss: str = "logistic"
    penalty: str = "l2"
    C: float = 1.0
    hold: int | None = None
    class_weights: tuple[float, float] = (1.0, 1.0)
    penalise_intercept: bool = False

    def __post_init__(self) -> None:
        if self.loss not in ("logistic", "squared_hinge") or self.penalty not in ("l1", "l2"):
            raise ValueError(f"no fit with loss {self.loss} and penalty {self.penalty}")


@dataclass
class Solved:
    """Coefficients (a row for each fit, in scaled coordinates) and intercepts; ``jobs`` is the number of scans."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    violations: np.ndarray
    jobs: int


class Coordinates:
    """Centres and scales of each fold's scaler, as matrices on [x, 1]; no scaler is the identity."""

    def __init__(self, d: int, scalers: dict[int | None, tuple[np.ndarray, np.ndarray]] | None) -> None:
        self.d, self.scalers = d, scalers or {}

    def matrix(self, hold: int | None) -> np.ndarray:
        """T with [scaled x, 1] = T [x, 1]; a constant column is 0."""
        t = np.eye(self.d + 1)
        if hold in self.scalers:
            centre, scale = self.scalers[hold]
            inverse = np.divide(1.0, scale, out=np.zeros(self.d), where=scale != 0)
            t[:self.d, :self.d] = np.diag(inverse)
            t[:self.d, self.d] = -centre * inverse
        return t


def _frame(batch, d: int):
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return x, *(np.asarray(batch.column(c)) for c in ("y", "w", "fold"))


def _sums(fits: list[Linear], raw: np.ndarray, d: int):
    """Task function: (pos, v), the fits' losses, gradients and upper Hessians over [x, 1]."""
    logistic = np.array([f.loss == "logistic" for f in fits])
    hold = np.array([NONE if f.hold is None else f.hold for f in fits])
    weight = np.array([f.class_weights for f in fits])
    up, down = np.triu_indices(d + 1)
    # (row, fit) arrays of half a megabyte stay in a core's cache
    step = max(64, (1 << 16) // max(len(up), len(fits)))
    some_logistic, some_hinge = logistic.any(), not logistic.all()

    def run(batches):
        import pyarrow as pa

        loss, grad, hess = np.zeros(len(fits)), np.zeros((len(fits), d + 1)), np.zeros((len(fits), len(up)))
        for batch in batches:
            x, y, w, fold = _frame(batch, d)
            for at in range(0, len(x), step):
                some = slice(at, at + step)
                xa = np.concatenate([x[some], np.ones((len(x[some]), 1))], axis=1)
                s = np.where(y[some] == 1, 1.0, -1.0)[:, None]
                z = s * (xa @ raw.T)
                row = w[some][:, None] * np.where(s > 0, weight[:, 1], weight[:, 0]) * (fold[some][:, None] != hold)
                value = slope = curve = 0.0
                if some_logistic:
                    e = np.exp(-np.abs(z))  # one exponential for the loss and its derivatives, without overflow
                    slope = np.where(z > 0, e, 1.0) / (1 + e)
                    value, curve = np.maximum(-z, 0) + np.log1p(e), slope * (1 - slope)
                if some_hinge:
                    slack = np.maximum(1 - z, 0)
                    value, slope, curve = (np.where(logistic, a, b) for a, b in ((value, slack * slack), (slope, 2 * slack), (curve, 2.0 * (slack > 0))))
                loss += np.einsum("ij,ij->j", row, value)
                grad += (row * -s * slope).T @ xa
                hess += (row * curve).T @ (xa[:, up] * xa[:, down])
        flat = np.concatenate([loss[:, None], grad, hess], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["pos", "v"])

    return run


def evaluate(rows: DataFrame, fits: list[Linear], at: np.ndarray, coordinates: Coordinates):
    """(losses, gradients, Hessians) of the fits at the points ``at`` (scaled coefficients, then the intercept): one job."""
    d = coordinates.d
    change = [coordinates.matrix(f.hold) for f in fits]
    raw = np.stack([t.T @ v for t, v in zip(change, at, strict=True)])
    sums = rows.mapInArrow(_sums(fits, raw, d), "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    up, down = np.triu_indices(d + 1)
    flat = np.zeros((len(fits), 2 + d + len(up)))
    for r in sums:  # a number for each fit and each pair of coefficients
        flat.flat[r.pos] = r.v
    hess = np.zeros((len(fits), d + 1, d + 1))
    hess[:, up, down] = hess[:, down, up] = flat[:, d + 2:]
    grad = flat[:, 1:d + 2]
    return flat[:, 0], np.stack([t @ g for t, g in zip(change, grad, strict=True)]), np.stack([t @ h @ t.T for t, h in zip(change, hess, strict=True)])


def _penalised(fit: Linear, d: int) -> np.ndarray:
    return np.append(np.ones(d), 1.0 if fit.penalise_intercept else 0.0)


def _penalty(fit: Linear, v: np.ndarray, on: np.ndarray) -> float:
    return float((np.abs(v) * on).sum() if fit.penalty == "l1" else (v * v * on).sum() / 2)


def violation(fit: Linear, v: np.ndarray, grad: np.ndarray) -> float:
    """How far the optimality conditions are from holding; ``grad`` is C times the loss's gradient."""
    on = _penalised(fit, len(v) - 1)
    if fit.penalty == "l2":
        return float(np.abs(grad + on * v).max())
    return float(np.where((v == 0) & (on > 0), np.maximum(np.abs(grad) - 1, 0), np.abs(grad + on * np.sign(v))).max())


def _direction(fit: Linear, v: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """The step to the least of the quadratic model with the penalty."""
    on = _penalised(fit, len(v) - 1)
    ridge = 1e-12 * max(1.0, np.trace(hess))
    if fit.penalty == "l2":
        return np.linalg.solve(hess + np.diag(on + ridge), -(grad + on * v))
    u, slope = v.copy(), grad.copy()  # slope: of the smooth part at u
    diagonal = np.diag(hess) + ridge
    for _ in range(1000):
        most = 0.0
        for j in range(len(v)):
            x = u[j] - slope[j] / diagonal[j]
            new = np.sign(x) * max(abs(x) - on[j] / diagonal[j], 0.0)
            change = new - u[j]
            if change:
                slope += hess[:, j] * change
                slope[j] += ridge * change
                u[j] = new
                most = max(most, abs(change) * diagonal[j])
        if most <= 1e-12 * max(1.0, np.abs(grad).max()):
            break
    return u - v


def fit_linear(rows: DataFrame, d: int, fits: list[Linear], scalers: dict | None = None, max_iter: int = 100, tol: float = 1e-7) -> Solved:
    """Fit all of ``fits`` on rows (x array<double> of d values, y 0/1, w weight, fold int; -1 for none).

    ``scalers`` has (centres, scales) by held-out fold. Rows are read once a step: persist them.
    A fit ends when its conditions hold up to ``tol`` times its first gradient (1 at least).
    """
    coordinates, m = Coordinates(d, scalers), len(fits)
    at, trial = np.zeros((m, d + 1)), np.zeros((m, d + 1))
    value, step, bound = np.full(m, np.inf), np.ones(m), np.ones(m)
    move, left = np.zeros((m, d + 1)), np.full(m, np.inf)
    live, jobs = list(range(m)), 0
    while live and jobs < max_iter:
        losses, grads, hessians = evaluate(rows, [fits[j] for j in live], trial[live], coordinates)
        jobs += 1
        now, live = live, []
        for i, j in enumerate(now):
            fit = fits[j]
            new = fit.C * losses[i] + _penalty(fit, trial[j], _penalised(fit, d))
            if new <= value[j] + 1e-12 * abs(new):
                at[j], value[j] = trial[j], new
                left[j] = violation(fit, at[j], fit.C * grads[i])
                bound[j] = max(1.0, np.abs(fit.C * grads[i]).max()) if jobs == 1 else bound[j]
                if left[j] <= tol * bound[j]:
                    continue
                move[j], step[j] = _direction(fit, at[j], fit.C * grads[i], fit.C * hessians[i]), 1.0
            else:
                step[j] /= 2
                if step[j] < 1e-8:  # rounding: no point nearby is lower
                    continue
            trial[j] = at[j] + step[j] * move[j]
            live.append(j)
    if live:
        warnings.warn(f"{len(live)} of {m} linear fits: no convergence to {tol} in {max_iter} steps", stacklevel=2)
    return Solved(at[:, :d], at[:, d], left, jobs)


def _cells(fits: list[Linear], raw: np.ndarray, d: int):
    """Task function: (fit, label, prediction, n) over each fit's held-out rows."""
    hold = np.array([NONE if f.hold is None else f.hold for f in fits])

    def run(batches):
        import pyarrow as pa

        n = np.zeros((len(fits), 2, 2), np.int64)
        for batch in batches:
            x, y, _, fold = _frame(batch, d)
            guess = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ raw.T > 0
            test = fold[:, None] == hold
            for label in (0, 1):
                of = test & (y == label)[:, None]
                n[:, label, 1] += (of & guess).sum(0)
                n[:, label, 0] += (of & ~guess).sum(0)
        fit, label, prediction = np.nonzero(n >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in ((fit, pa.int32()), (label, pa.int32()), (prediction, pa.int32()), (n.ravel(), pa.int64()))],
                                         names=["fit", "label", "prediction", "n"])

    return run


def held_out_counts(rows: DataFrame, d: int, fits: list[Linear], solved: Solved, scalers: dict | None = None) -> DataFrame:
    """(fit, tp, fp, tn, fn) of every fit on its held-out fold, in one scan."""
    coordinates = Coordinates(d, scalers)
    points = np.column_stack([solved.coefficients, solved.intercepts])
    raw = np.stack([coordinates.matrix(f.hold).T @ v for f, v in zip(fits, points, strict=True)])
    cell = lambda y, p: F.sum(F.when((F.col("label") == y) & (F.col("prediction") == p), F.col("n")).otherwise(0))
    return rows.mapInArrow(_cells(fits, raw, d), "fit int, label int, prediction int, n long").groupBy("fit").agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))
