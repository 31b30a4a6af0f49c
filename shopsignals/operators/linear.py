"""Linear models in closed form from one mergeable aggregate.

All that least squares needs of a table are counts, sums and sums of products:
one aggregate, combined map-side, whose size is the square of the number of
features whatever the number of rows. Aggregated by fold, the folds' models come
from it too (the total less the fold), as do their errors on the fold left out.
The small systems are solved on the driver; a model is an SQL expression over the
features, kept as a Spark ML stage so that it is saved, loaded and applied like
any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.operators.ranks import medians


class Moments:
    """Count, sums and sums of products of (features shifted by ``shift``, label)."""

    def __init__(self, features: list[str], shift: list[float], table: np.ndarray):
        self.features, self.shift, self.table = features, np.array(shift), table  # 1, features, label

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.features, self.shift.tolist(), self.table - other.table)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.features, self.shift.tolist(), self.table + other.table)

    def fit(self, alpha: float = 0.0) -> np.ndarray:
        """(intercept, coefficients) over the shifted features of least squares on
        features scaled by their sample deviation, with penalty ``alpha``."""
        n, s, p = self.table[0, 0], self.table[0, 1:], self.table[1:, 1:]
        k = len(self.features)
        if n < 1:
            return np.zeros(k + 1)
        mean = s / n
        cov = p - n * np.outer(mean, mean)
        var = np.diag(cov)[:k] / max(n - 1, 1)
        some = var > 1e-12 * np.maximum(np.diag(p)[:k] / n, 1e-300)  # a constant feature has no weight
        scale = np.where(some, np.sqrt(np.where(some, var, 1.0)), 1.0)
        a = cov[:k, :k] / np.outer(scale, scale)
        b = cov[:k, k] / scale
        a, b = a[np.ix_(some, some)] + alpha * np.eye(some.sum()), b[some]
        w = np.zeros(k)
        w[some] = np.linalg.lstsq(a, b, rcond=None)[0]
        w /= scale
        return np.concatenate(([mean[k] - w @ mean[:k]], w))

    def r2(self, coef: np.ndarray) -> float:
        """R² of a model on the rows of these moments."""
        c = np.append(coef, -1.0)
        n, y, yy = self.table[0, 0], self.table[0, -1], self.table[-1, -1]
        rest = yy - y * y / n if n else 0.0
        return float(1 - c @ self.table @ c / rest) if rest > 0 else float("nan")


def _filled(features: list[str], fill: list[float] | None) -> list[str]:
    cast = [f"CAST(`{f}` AS DOUBLE)" for f in features]
    return cast if fill is None else [f"coalesce({c}, {float(m)!r}D)" for c, m in zip(cast, fill)]


def moments(df: DataFrame, features: list[str], label: str, fill: list[float] | None = None, by: str | None = None,
            products: list[tuple[int, int]] = ()) -> dict[int, Moments]:
    """The moments of the rows that have a label, per value of ``by`` (an integer
    column; without one all under 0). NULL features are ``fill``; ``products``
    adds products of two features as further ones."""
    x = _filled(features, fill)
    names = features + [f"{features[i]}*{features[j]}" for i, j in products]
    shift = [0.0] * len(names) if fill is None or products else [float(m) for m in fill]
    terms = [f"({e} - ({m!r}D))" for e, m in zip(x + [f"({x[i]} * {x[j]})" for i, j in products], shift)]
    terms = ["1.0D", *terms, f"CAST(`{label}` AS DOUBLE)"]
    rows = df.where(F.col(label).isNotNull()).select(F.expr(by or "0").cast("int").alias("_by"), *[F.expr(t).alias(f"_{i}") for i, t in enumerate(terms)])
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = rows.groupBy("_by").agg(F.array(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i, j in pairs]).alias("m"))
    out = {}
    for r in sums.toLocalIterator():  # one row a fold
        t = np.zeros((len(terms), len(terms)))
        for (i, j), v in zip(pairs, r["m"]):
            t[i, j] = t[j, i] = np.nan if v is None else v
        out[r["_by"]] = Moments(names, shift, t)
    return out


def model(features: list[str], coef: np.ndarray, shift, fill: list[float] | None = None, products=()) -> PipelineModel:
    """A fitted linear model as a stage that adds ``prediction``."""
    x = _filled(features, fill)
    x += [f"({x[i]} * {x[j]})" for i, j in products]
    parts = [f"({float(c)!r}D) * ({e} - ({float(m)!r}D))" for c, e, m in zip(coef[1:], x, shift)]
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {float(coef[0])!r}D + {' + '.join(parts)} AS prediction FROM __THIS__")])


def median_fill(df: DataFrame, features: list[str]) -> list[float]:
    """The exact median of each feature (0 without values)."""
    m = medians(df, features).first()
    return [0.0 if m[f] is None else float(m[f]) for f in features]


def cross_validate_ridge(df: DataFrame, features: list[str], label: str, alpha: float, fold: str, folds: int = 5) -> DataFrame:
    """J8 for the ridge model: (fold, n, r2) of each fold under the model of all
    others, from one pass over the rows; ``fold`` is an SQL expression for the
    row's fold number. Features are filled by the medians of all rows."""
    fill = median_fill(df.where(F.col(label).isNotNull()), features)
    by = moments(df, features, label, fill, fold)
    total = sum((m for m in by.values()), Moments(features, fill, np.zeros((len(features) + 2,) * 2)))
    rows = [(k, int(by[k].table[0, 0]), by[k].r2((total - by[k]).fit(alpha))) for k in range(folds) if k in by]
    return df.sparkSession.createDataFrame(rows, "fold int, n long, r2 double")
