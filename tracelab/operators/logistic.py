"""Logistic regressions of many groups at once, by grouped Newton steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 10
RIDGE = 1.0  # weight of half the squared coefficients; the constant term is free

Models = dict[str, list[str]]


def terms(features: list[str]) -> list[str]:
    return ["1.0D", *features]


def coefficient(model: str, j: int) -> str:
    return f"{model}_{j}"


def score(model: str, features: list[str]) -> str:
    """The linear score of a row, as SQL text."""
    return " + ".join(f"{coefficient(model, j)} * {x}" for j, x in enumerate(terms(features)))


def step_sums(models: Models, label: str, weight: str) -> list[Column]:
    """Sums of one Newton step: the gradient and the lower half of the Hessian of every model, in one aggregate."""
    out = []
    for model, features in models.items():
        x = terms(features)
        chance = f"(1 / (1 + exp(-({score(model, features)}))))"
        for i, a in enumerate(x):
            out.append(F.expr(f"sum({weight} * ({label} - {chance}) * {a})").alias(f"{model}_g{i}"))
            for j, b in enumerate(x[: i + 1]):
                out.append(F.expr(f"sum({weight} * {chance} * (1 - {chance}) * {a} * {b})").alias(f"{model}_h{i}{j}"))
    return out


def solved(model: str, size: int) -> list[tuple[str, str]]:
    """Named stages that turn the sums into a model's next coefficients.

    The matrix is symmetric and positive, so it is factored without pivots into L D L\u1d40; then one pass forward and one back. The ridge stands on its diagonal,
    but for the constant term.
    """
    v = lambda kind, *at: f"{model}_{kind}{''.join(map(str, at))}"
    out = []
    for j in range(size):
        own = f"{v('h', j, j)}{f' + {RIDGE}' if j else ''}"
        out.append((v("d", j), own + "".join(f" - {v('l', j, k)} * {v('l', j, k)} * {v('d', k)}" for k in range(j))))
        for i in range(j + 1, size):
            out.append((v("l", i, j), f"({v('h', i, j)}" + "".join(f" - {v('l', i, k)} * {v('l', j, k)} * {v('d', k)}" for k in range(j)) + f") / {v('d', j)}"))
    for i in range(size):
        grad = f"{v('g', i)}{f' - {RIDGE} * {coefficient(model, i)}' if i else ''}"
        out.append((v("u", i), grad + "".join(f" - {v('l', i, k)} * {v('u', k)}" for k in range(i))))
    for i in reversed(range(size)):
        out.append((v("s", i), f"{v('u', i)} / {v('d', i)}" + "".join(f" - {v('l', k, i)} * {v('s', k)}" for k in range(i + 1, size))))
    return out


def fit_groups(points: DataFrame, keys: list[str], models: Models, label: str = "y", weight: str = "w", steps: int = STEPS) -> DataFrame:
    """Coefficients of every model in every group that has both labels: ``keys`` and ``<model>_0`` (constant), ``<model>_1``, ...

    ``points`` has one row per distinct point of a group with its number of rows, staged: each step reads it once and one grouped sum, combined before
    the shuffle, serves all fits. The number of steps is fixed. Groups with one label only are left out.
    """
    names = [coefficient(m, j) for m, features in models.items() for j in range(len(features) + 1)]
    both = points.groupBy(*keys).agg(F.sum(weight).alias("_n"), F.sum(F.expr(f"{weight} * {label}")).alias("_p")).where("_p > 0 AND _p < _n")
    coefficients = both.select(*keys, *[F.lit(0.0).alias(n) for n in names])
    for _ in range(steps):
        now = points.join(coefficients, keys).groupBy(*keys, *names).agg(*step_sums(models, label, weight))
        for model, features in models.items():
            for name, expr in solved(model, len(features) + 1):
                now = now.withColumn(name, F.expr(expr))
        moved = [F.expr(f"{n} + {n.replace('_', '_s')}").alias(n) for n in names]
        coefficients = now.select(*keys, *moved)
    return coefficients
