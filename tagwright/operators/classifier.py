"""One-vs-rest linear SVM training (C3-C5) with distributed aggregation.

C3 reproduces the squared-hinge, L2-regularised linear SVM (C = 1, intercept
as an extra constant feature that is regularised too, balanced class
weights).  Its objective is smooth and strictly convex, so a Newton method
reaches the same optimum as any other exact solver.  Every Newton round is
two passes over the training features:

1. per partition (``mapInPandas``, numpy on Arrow batches) the gradient and
   the active-set Hessian of *all* tags are accumulated and emitted as
   ``(tag, k, value)`` rows; a ``groupBy(tag, k).sum`` combines them (the
   shuffle carries ``tags * 21 * 22`` numbers per partition);
2. the objective of every tag at a ladder of step sizes is accumulated the
   same way for a backtracking line search.

Only the 21 x 21 systems per tag are solved on the driver.  C4 uses Spark
ML's ``LinearSVC`` (plain hinge, unregularised intercept).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLASSIFIER_FEATURES
from ..session import cut_lineage, release
from .scale import Standardizer
from .tagger import LinearTagModel

STEPS = [1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625, 0.0078125, 0.00390625, 0.001953125]


class ConvergenceWarning(UserWarning):
    """A fit ended before it settled."""


def _design(pdf: pd.DataFrame, d: int) -> np.ndarray:
    x = np.ones((len(pdf), d + 1))
    for j in range(d):
        x[:, j] = pdf[f"z{j}"].to_numpy(dtype=float)
    return x


def _accumulate(pdf: pd.DataFrame, x: np.ndarray, w: np.ndarray, cw: np.ndarray, c: float, g, h, obj) -> None:
    """Add one Arrow batch's loss, gradient and active-set Hessian."""
    for k in range(w.shape[0]):
        y = pdf[f"y{k}"].to_numpy(dtype=float) * 2 - 1
        cost = np.where(y > 0, cw[k, 0], cw[k, 1]) * c
        margin = x @ w[k]
        viol = 1 - y * margin
        act = viol > 0
        if not act.any():
            continue
        xa, ca = x[act], cost[act]
        obj[k] += float(np.sum(ca * viol[act] ** 2))
        g[k] += 2 * ((ca * (margin[act] - y[act])) @ xa)
        h[k] += 2 * (xa.T * ca) @ xa


def _emit(g, h, obj, d: int) -> list[tuple[int, int, float]]:
    rows = []
    for k in range(g.shape[0]):
        rows.append((k, -1, float(obj[k])))
        rows += [(k, j, float(v)) for j, v in enumerate(g[k])]
        rows += [(k, d + 1 + j, float(v)) for j, v in enumerate(h[k].ravel())]
    return rows


def _grad_hess_fn(w: np.ndarray, cw: np.ndarray, c: float, d: int):
    """Partition function: partial loss, gradient and Hessian of all tags."""
    t = w.shape[0]

    def fn(batches):
        g, h, obj = np.zeros((t, d + 1)), np.zeros((t, d + 1, d + 1)), np.zeros(t)
        for pdf in batches:
            if not pdf.empty:
                _accumulate(pdf, _design(pdf, d), w, cw, c, g, h, obj)
        yield pd.DataFrame(_emit(g, h, obj, d), columns=["tag", "k", "v"])

    return fn


def _step_fn(w: np.ndarray, step_dir: np.ndarray, cw: np.ndarray, c: float, d: int):
    """One pass for a Newton round: the loss at every step size of the ladder
    (``k = -2 - s``) and the loss, gradient and Hessian at the full step
    (``k >= -1`` as in :func:`_grad_hess_fn`), for all tags."""
    t = w.shape[0]
    wf = w + step_dir

    def fn(batches):
        ladder = np.zeros((t, len(STEPS)))
        g, h, obj = np.zeros((t, d + 1)), np.zeros((t, d + 1, d + 1)), np.zeros(t)
        for pdf in batches:
            if pdf.empty:
                continue
            x = _design(pdf, d)
            for k in range(t):
                y = pdf[f"y{k}"].to_numpy(dtype=float) * 2 - 1
                cost = np.where(y > 0, cw[k, 0], cw[k, 1]) * c
                base, delta = x @ w[k], x @ step_dir[k]
                for s_, a in enumerate(STEPS):
                    viol = np.maximum(0.0, 1 - y * (base + a * delta))
                    ladder[k, s_] += float(np.sum(cost * viol**2))
            _accumulate(pdf, x, wf, cw, c, g, h, obj)
        rows = [(k, -2 - s_, float(ladder[k, s_])) for k in range(t) for s_ in range(len(STEPS))]
        yield pd.DataFrame(rows + _emit(g, h, obj, d), columns=["tag", "k", "v"])

    return fn


def _sum_rows(df: DataFrame, fn) -> dict[tuple[int, int], float]:
    out = df.mapInPandas(fn, "tag int, k int, v double").groupBy("tag", "k").agg(F.sum("v").alias("v"))
    return {(r["tag"], r["k"]): r["v"] for r in out.collect()}


def fit_squared_hinge(
    train: DataFrame,
    n_tags: int,
    class_weights: np.ndarray,
    d: int,
    c: float = 1.0,
    max_iter: int = 30,
    tol: float = 1e-10,
) -> tuple[np.ndarray, int]:
    """Newton with backtracking for all tags at once.  ``train`` holds
    ``z0..z{d-1}`` and ``y0..y{T-1}`` (0/1).  Returns the (T, d+1) weights
    (last entry = intercept) and the number of rounds; a ``ConvergenceWarning``
    names how many tags have not settled by then.

    A round is one pass in the usual case: the pass that scores the step-size
    ladder also accumulates the gradient and Hessian at the full Newton step,
    which is what the next round needs whenever the full step is accepted.
    """
    w = np.zeros((n_tags, d + 1))
    done = np.zeros(n_tags, dtype=bool)
    stuck = np.zeros(n_tags, dtype=bool)
    sums = _sum_rows(train, _grad_hess_fn(w, class_weights, c, d))
    rounds = 0
    for rounds in range(1, max_iter + 1):
        step_dir = np.zeros_like(w)
        grads = np.zeros_like(w)
        obj0 = np.zeros(n_tags)
        for k in range(n_tags):
            g = w[k] + np.array([sums.get((k, j), 0.0) for j in range(d + 1)])
            h = np.eye(d + 1) + np.array(
                [sums.get((k, d + 1 + j), 0.0) for j in range((d + 1) * (d + 1))]
            ).reshape(d + 1, d + 1)
            obj0[k] = 0.5 * w[k] @ w[k] + sums.get((k, -1), 0.0)
            grads[k] = g
            if done[k] or np.linalg.norm(g) <= tol * max(1.0, np.linalg.norm(w[k])):
                done[k] = True
                continue
            step_dir[k] = -np.linalg.solve(h, g)
        if done.all():
            break
        res = _sum_rows(train, _step_fn(w, step_dir, class_weights, c, d))
        nxt: dict[tuple[int, int], float] = {}
        stale = False
        for k in range(n_tags):
            if done[k]:
                continue
            gd = float(grads[k] @ step_dir[k])  # directional derivative (< 0)
            for s_, a in enumerate(STEPS):
                wn = w[k] + a * step_dir[k]
                f = 0.5 * wn @ wn + res.get((k, -2 - s_), 0.0)
                if f <= obj0[k] + 1e-4 * a * min(gd, 0.0):
                    w[k] = wn
                    if abs(obj0[k] - f) <= 1e-15 * max(1.0, abs(obj0[k])):
                        done[k] = True
                    if s_ == 0:
                        nxt.update({key: v for key, v in res.items() if key[0] == k and key[1] >= -1})
                    else:
                        stale = True
                    break
            else:  # no step lowers the objective: its last bits, or a fit that stays where it is
                done[k] = True
                stuck[k] = abs(gd) > 1e-12 * max(1.0, abs(obj0[k]))
        if stale:
            sums = _sum_rows(train, _grad_hess_fn(w, class_weights, c, d))
        else:
            sums = nxt
    open_tags = int((~done | stuck).sum())
    if open_tags:
        warnings.warn(f"{open_tags} of {n_tags} tags have not settled in {rounds} rounds", ConvergenceWarning, stacklevel=2)
    return w, rounds


def gradient_norms(train: DataFrame, w: np.ndarray, class_weights: np.ndarray, d: int, c: float = 1.0) -> np.ndarray:
    """Invariant check for C3: the gradient norm of every tag at ``w``."""
    sums = _sum_rows(train, _grad_hess_fn(w, class_weights, c, d))
    return np.array(
        [np.linalg.norm(w[k] + np.array([sums.get((k, j), 0.0) for j in range(d + 1)])) for k in range(w.shape[0])]
    )


def prepare_training(
    labelled: DataFrame, classes: Sequence[str], features: Sequence[str] = CLASSIFIER_FEATURES, tags_col: str = "tags"
) -> tuple[DataFrame, Standardizer, np.ndarray, list[int]]:
    """Standardise the features (M1) and binarise the tags (C1); class
    weights (C2) from one aggregate.  Returns the compact training frame,
    the scaler, the (T, 2) weights and the positive counts."""
    scaler = Standardizer.fit(labelled, features)
    cols = [scaler.column(j).alias(f"z{j}") for j in range(len(features))]
    ys = [F.array_contains(F.col(tags_col), F.lit(t)).cast("int").alias(f"y{k}") for k, t in enumerate(classes)]
    train = labelled.select(*cols, *ys)
    agg = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y{k}").alias(f"p{k}") for k in range(len(classes))]).first()
    n = int(agg["n"])
    pos = [int(agg[f"p{k}"] or 0) for k in range(len(classes))]
    cw = np.array([[n / (2.0 * p) if p else 0.0, n / (2.0 * (n - p)) if n - p else 0.0] for p in pos])
    return train, scaler, cw, pos


def train_tagger(
    labelled: DataFrame,
    tags_col: str = "tags",
    features: Sequence[str] = CLASSIFIER_FEATURES,
    engine: str = "linear-svc",
    max_iter: int = 30,
) -> LinearTagModel:
    """Fit the one-vs-rest tagger on rows carrying the feature columns
    and an ``array<string>`` of tags.  ``engine='linear-svc'`` is the squared
    hinge (C3); ``'svc'`` is the plain hinge with support-vector counts (C4).
    A tag present in every row is a constant scorer with score 1.0 (C5)."""
    from .tagger import tag_classes

    # the text features are computed once and written to the shared
    # checkpoint folder; every later pass (scaler, class counts, Newton
    # rounds) reads the compact table instead of re-running the regexes
    labelled = cut_lineage(labelled.select(*features, tags_col))
    classes = tag_classes(labelled, tags_col)
    train, scaler, cw, pos = prepare_training(labelled, classes, features, tags_col)
    train = cut_lineage(train)
    n = int(train.count())
    if n == 0 or not classes:
        raise ValueError("there are no training responses with tags")
    d = len(features)
    const = [p == n or p == 0 for p in pos]
    fit_idx = [k for k in range(len(classes)) if not const[k]]
    weights = np.zeros((len(classes), d + 1))
    svc_counts = None
    if fit_idx:
        sub = train.select(*[f"z{j}" for j in range(d)], *[F.col(f"y{k}").alias(f"y{i}") for i, k in enumerate(fit_idx)])
        if engine == "linear-svc":
            w, _ = fit_squared_hinge(sub, len(fit_idx), cw[fit_idx], d, max_iter=max_iter)
        elif engine == "svc":
            w, svc_counts_fit = fit_hinge_ml(sub, len(fit_idx), cw[fit_idx], d, n)
            svc_counts = {classes[k]: svc_counts_fit[i] for i, k in enumerate(fit_idx)}
        else:
            raise ValueError("engine must be linear-svc or svc")
        for i, k in enumerate(fit_idx):
            weights[k] = w[i]
    intercepts = [1.0 if pos[k] == n and const[k] else float(weights[k, d]) for k in range(len(classes))]
    if any(const):  # a constant scorer has no support vectors to count, so the run reports none at all
        svc_counts = None
    release(train)
    release(labelled)
    return LinearTagModel(
        tags=list(classes),
        weights=[list(map(float, weights[k, :d])) for k in range(len(classes))],
        intercepts=intercepts,
        mean=scaler.mean,
        scale=scaler.scale,
        features=list(features),
        engine=engine,
        training_examples=n,
        support_vector_counts=svc_counts,
    )


def fit_hinge_ml(train: DataFrame, n_tags: int, cw: np.ndarray, d: int, n: int, tol: float = 1e-6, max_iter: int = 100):
    """C4: plain hinge per tag with Spark ML ``LinearSVC`` (regParam = 1/n
    because the balanced weights sum to n; intercept not regularised).  The
    tags are fitted from concurrent driver threads (each fit is its own
    distributed job), and the support vectors - rows with ``y * f <= 1 +
    1e-6`` - of all tags are counted in one aggregation."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    vec = train.select(array_to_vector(F.array(*[F.col(f"z{j}") for j in range(d)])).alias("features"), "*").cache()

    def fit(k: int):
        data = vec.select(
            "features",
            F.col(f"y{k}").cast("double").alias("label"),
            F.when(F.col(f"y{k}") == 1, F.lit(float(cw[k, 0]))).otherwise(F.lit(float(cw[k, 1]))).alias("weight"),
        )
        m = LinearSVC(
            regParam=1.0 / n, standardization=False, weightCol="weight", maxIter=max_iter, tol=tol, fitIntercept=True
        ).fit(data)
        return np.append(m.coefficients.toArray(), m.intercept)

    with ThreadPoolExecutor(max_workers=min(8, max(1, n_tags))) as pool:
        w = np.vstack(list(pool.map(fit, range(n_tags))))
    counts = []
    aggs = []
    for k in range(n_tags):
        margin = F.lit(float(w[k, d]))
        for j in range(d):
            margin = margin + F.lit(float(w[k, j])) * F.col(f"z{j}")
        y = F.col(f"y{k}") * 2 - 1
        aggs.append(F.sum((y * margin <= 1 + 1e-6).cast("long")).alias(f"sv{k}"))
    row = train.agg(*aggs).first()
    counts = [int(row[f"sv{k}"] or 0) for k in range(n_tags)]
    vec.unpersist()
    return w, counts
