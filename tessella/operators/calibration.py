"""Probability calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import clip
from tessella.functions.scalars import logit
from tessella.operators.isotonic import interpolate, isotonic_pools
from tessella.session import stage

EPS = 1e-6


def _inputs(prob: str, form: str) -> Column:
    p = clip(prob, EPS, 1 - EPS)
    if form == "platt":
        return F.array(logit(prob, EPS))
    return F.array(F.ln(p), -F.ln(1 - p))


def _same(by: Sequence[str], left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on ``by``; null group values meet."""
    on = F.lit(True)
    for b in by:
        on = on & left[b].eqNullSafe(right[f"_{b}"])
    return left.join(right, on).drop(*[f"_{b}" for b in by])


def grouped_logistic(df: DataFrame, by: Sequence[str], x: Column, label: str, ridge: float = 0.0, tolerance: float = 1e-10, rounds: int = 100) -> DataFrame:
    """(by..., w): intercept and slopes of a logistic regression for every group at once.

    ``x``: array of the features.  ``ridge`` is the penalty ``ridge / 2 * |slopes|^2`` on the summed
    loss.  One Newton step is one pass: the sums of gradient and Hessian are partial aggregates by
    group, and the small systems are solved side by side, in tasks.  It ends when the mean gradient
    of every group is at most ``tolerance``.  Steps longer than 4 are cut to 4, which keeps a
    separated group from overshooting.  ``w`` is null for groups of one class and of equal features
    without ridge."""
    d = stage(df.select(*by, F.lit(0).alias("_all"), F.concat(F.array(F.lit(1.0)), x).alias("x"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull()))
    first = d.select(F.size("x")).first()
    m = first[0] if first else 2
    keys = [*by, "_all"]
    names = [f"_{b}" for b in keys]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    zero = F.array(*[F.lit(0.0)] * m)
    share = F.avg("y")
    known = d.groupBy(*[F.col(b).alias(n) for b, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("n"), share.alias("share"))
    start = F.concat(F.array(F.ln(F.col("share") / (1 - F.col("share")))), F.slice(zero, 2, m - 1))
    open_ = (F.col("share") > 0) & (F.col("share") < 1)
    w = stage(known.select(*names, "n", F.when(open_, start).alias("w"), F.when(open_, F.lit(float("inf"))).otherwise(0.0).alias("left")))

    def solve(parts):
        for pdf in parts:
            g = np.stack(pdf["g"].to_numpy()).astype(float)
            h = np.zeros((len(pdf), m, m))
            for k, (i, j) in enumerate(pairs):
                h[:, i, j] = h[:, j, i] = [v[k] for v in pdf["h"]]
            now = np.stack(pdf["w"].to_numpy()).astype(float)
            n = pdf["n"].to_numpy(float)
            g[:, 1:] -= ridge * now[:, 1:]
            h[:, range(1, m), range(1, m)] += ridge
            left = np.abs(g).max(1) / n
            size = np.sqrt(np.einsum("kii->ki", h))
            scaled = h / np.where(size > 0, size, 1)[:, :, None] / np.where(size > 0, size, 1)[:, None, :]
            flat = (np.linalg.eigvalsh(scaled)[:, 0] < 1e-12) & (left > tolerance)
            h[flat] = np.eye(m)
            step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            step *= np.minimum(1, 4 / np.maximum(np.abs(step).max(1), 4))[:, None]
            out = [None if f else (v if done else v + s).tolist() for f, done, v, s in zip(flat, left <= tolerance, now, step, strict=True)]
            yield pdf.assign(w=pd.Series(out, index=pdf.index, dtype=object), left=np.where(flat, 0.0, left))[[*names, "n", "w", "left"]]

    while rounds and w.where(F.col("left") > tolerance).limit(1).count():
        rounds -= 1
        going = w.where(F.col("left") > tolerance)
        j = _same(keys, d, going.select(*names, "w"))
        eta = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        j = j.withColumn("mu", 1 / (1 + F.exp(-clip(eta, -700.0, 700.0))))
        j = j.withColumn("v", F.col("mu") * (1 - F.col("mu")))
        at = lambda i: F.get("x", F.lit(i))
        sums = j.groupBy(*[F.col(b).alias(n) for b, n in zip(keys, names, strict=True)]).agg(
            F.array(*[F.sum((F.col("y") - F.col("mu")) * at(i)) for i in range(m)]).alias("g"),
            F.array(*[F.sum(F.col("v") * at(i) * at(k)) for i, k in pairs]).alias("h"))
        renamed = going.select(*[F.col(n).alias(f"_{n}") for n in names], "n", "w")
        solved = _same(names, sums, renamed).mapInPandas(solve, w.select(*names, "n", "w", "left").schema)
        w = stage(w.where(F.col("left") <= tolerance).unionByName(solved))
    return w.select(*[F.col(f"_{b}").alias(b) for b in by], "w")


def calibrate_logistic(fit: DataFrame, apply: DataFrame, prob: str = "probability", label: str = "label", form: str = "platt",
                       out: str = "calibrated", by: Sequence[str] = ()) -> DataFrame:
    """Platt scaling on the logit, or beta calibration on (ln p, -ln(1-p)), with a ridge of 1.

    With ``by`` every group is calibrated by its own fit; a group without one stays null."""
    w = grouped_logistic(fit, by, _inputs(prob, form), label, 1.0)
    w = w.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("w").alias("_w"))
    x = F.concat(F.array(F.lit(1.0)), _inputs(prob, form))
    on = F.lit(True)
    for b in by:
        on = on & apply[b].eqNullSafe(w[f"_{b}"])
    z = F.aggregate(F.zip_with(x, "_w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    both = apply.join(w, on, "left") if by else apply.withColumn("_w", w.select("_w").scalar())
    return both.withColumn(out, 1 / (1 + F.exp(-clip(z, -30.0, 30.0)))).drop("_w", *[f"_{b}" for b in by])


def calibration_regression(df: DataFrame, by: Sequence[str], prob: str = "probability", label: str = "label") -> DataFrame:
    """Intercept and slope of the logistic regression of the label on the logit, per group.

    The slope has a ridge of 1e-6 only.  Groups of one class have nulls."""
    w = grouped_logistic(df, by, _inputs(prob, "platt"), label, 1e-6)
    return w.select(*by, F.get("w", F.lit(0)).alias("calibration_intercept"), F.get("w", F.lit(1)).alias("calibration_slope"))


def calibrate_isotonic(fit: DataFrame, apply: DataFrame, prob: str = "probability", label: str = "label", out: str = "calibrated") -> DataFrame:
    """Isotonic regression, linear between its pools, clipped away from 0 and 1."""
    return interpolate(apply, isotonic_pools(fit, prob, label), prob, "_iso").withColumn(out, clip("_iso", EPS, 1 - EPS)).drop("_iso")


def _scaled(kind: str, prob: str, param: Column, prior: Column) -> Column:
    if kind == "temperature":
        return 1 / (1 + F.exp(-clip(logit(prob, EPS) / param, -30.0, 30.0)))
    return param * F.col(prob) + (1 - param) * prior


def loss_grid(df: DataFrame, kind: str, grid: Sequence[float], prob: str = "probability", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Log-loss of every parameter of a ``temperature`` or ``shrinkage`` grid in one pass.

    With ``by`` per group; shrinkage pulls towards the group's own mean label."""
    prior = df.select(F.avg(F.col(label).cast("double"))).scalar() if not by else F.col("_prior")
    if by and kind == "shrinkage":
        df = df.join(df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("_prior")), [*by])
    g = df.withColumn("param", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    q = clip(_scaled(kind, prob, F.col("param"), prior), EPS, 1 - EPS)
    y = F.col(label).cast("double")
    return g.groupBy(*by, "param").agg(F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"))


BOUNDS = {"temperature": (0.1, 10.0), "shrinkage": (0.0, 1.0)}


def calibrate_scalar(fit: DataFrame, apply: DataFrame, kind: str, prob: str = "probability", label: str = "label", points: int = 20, tolerance: float = 1e-6, out: str = "calibrated") -> DataFrame:
    """Minimise the log-loss over one parameter by grids refined until their step is below
    ``tolerance``, then apply it."""
    fit = stage(fit.select(prob, label))
    lo, hi = BOUNDS[kind]
    best, step = lo, hi - lo
    while step > tolerance:
        step = (hi - lo) / points
        best = loss_grid(fit, kind, [lo + k * step for k in range(points + 1)], prob, label).orderBy("log_loss", "param").first()["param"]
        lo, hi = max(BOUNDS[kind][0], best - step), min(BOUNDS[kind][1], best + step)
    prior = fit.select(F.avg(F.col(label).cast("double"))).scalar()
    return apply.withColumns({out: clip(_scaled(kind, prob, F.lit(best), prior), EPS, 1 - EPS), "param": F.lit(best)})


def compare(fit: DataFrame, apply: DataFrame, prob: str = "probability", label: str = "label") -> DataFrame:
    """Brier score and log-loss of every calibration method on the same rows."""
    methods = {
        "uncalibrated": apply.withColumn("calibrated", clip(prob, EPS, 1 - EPS)), "platt": calibrate_logistic(fit, apply, prob, label),
        "beta": calibrate_logistic(fit, apply, prob, label, "beta"), "isotonic": calibrate_isotonic(fit, apply, prob, label),
        "temperature": calibrate_scalar(fit, apply, "temperature", prob, label).drop("param"), "prior_shrinkage": calibrate_scalar(fit, apply, "shrinkage", prob, label).drop("param")}
    out = None
    for name, d in methods.items():
        one = d.select(F.lit(name).alias("method"), F.col("calibrated").alias("p"), F.col(label).cast("double").alias("y"))
        out = one if out is None else out.unionByName(one)
    p, y = F.col("p"), F.col("y")
    return out.groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(clip("p", EPS, 1 - EPS)) + (1 - y) * F.ln(1 - clip("p", EPS, 1 - EPS)))).alias("log_loss"))


