"""Local regression of series: smooth curves through points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_fit(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float, degree: int) -> np.ndarray:
    """Values at `at` of polynomials that are fitted to the nearest points of (x, y), x sorted, with tricube weights.

    A fit sees the span's share of the points, the nearest ones, and more where several are as far as the last of these; their distance at most is
    the weights' range (times the span beyond 1). Where the points that have a weight can't carry the degree, the next lower one is taken.
    """
    n = len(x)
    take = min(n, max(1, int(n * span + 1e-5)))
    out = np.empty(len(at))
    for k, point in enumerate(at):
        low = min(max(np.searchsorted(x, point) - take, 0), n - 1)
        near = np.abs(x[low : low + 2 * take + 1] - point)  # the nearest are among these
        reach = np.partition(near, take - 1)[take - 1] * max(1.0, span)
        a, b = np.searchsorted(x, [point - reach, point + reach])
        b = max(b, a + 1) if reach else np.searchsorted(x, point, "right")
        d, v = x[a:b] - point, y[a:b]
        w = np.clip(1 - np.abs(d / reach) ** 3, 0, None) ** 3 if reach else np.ones(len(d))
        use = w > 0
        d, v, w = d[use], v[use], w[use]
        power = min(degree, len(np.unique(d)) - 1)
        if power < 0:
            out[k] = y[np.abs(x - point).argmin()]
        elif power == 0:
            out[k] = np.average(v, weights=w)
        else:
            scale = np.abs(d).max()
            terms = np.vander(d / scale, power + 1, increasing=True) * np.sqrt(w)[:, None]
            out[k] = np.linalg.lstsq(terms, v * np.sqrt(w), rcond=None)[0][0]
    return out


def local_regression(df: DataFrame, x: str, y: str, keys: Sequence[str] = ("athlete_id",), span: float = 0.75, degree: int = 2, points: int = 80) -> DataFrame:
    """keys, x and fitted: a smooth curve of each key's series, at `points` places from its first x to its last (one place where these are equal).

    x may be a date or a number; places of dates are days since 1970. Rows without x or y are left out, and a key without others has no curve.
    A task holds one key's pairs of numbers at a time.
    """
    kind = df.schema[x].dataType.typeName()
    place = F.unix_date(x) if kind == "date" else F.col(x)
    rows = df.select(*keys, place.cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null")

    def curve(table: pa.Table) -> pa.Table:
        xs, ys = (table.column(c).to_numpy() for c in ("__x", "__y"))
        order = np.lexsort((ys, xs))
        xs, ys = xs[order], ys[order]
        at = np.linspace(xs[0], xs[-1], points) if xs[-1] > xs[0] else xs[:1]
        own = {k: pa.array([table.column(k)[0].as_py()] * len(at), table.schema.field(k).type) for k in keys}
        return pa.table({**own, x: at, "fitted": local_fit(xs, ys, at, span, degree)})

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(curve, f"{schema}, `{x}` double, fitted double")


def span_of(days: int) -> float:
    """The share of the points that a curve over so many days follows."""
    return 0.75 if days <= 30 else 0.3 if days <= 90 else 0.1
