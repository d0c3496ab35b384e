"""Local regression against plain fits, point by point."""

from datetime import date, timedelta

import numpy as np
import pytest

from stridewell.operators.smoothing import local_regression, span_of


def plain(x, y, at, span, degree):
    out = []
    for p in at:
        d = np.sort(np.abs(x - p))
        reach = d[max(1, int(len(x) * span + 1e-5)) - 1 if span <= 1 else len(x) - 1] * max(1, span)
        w = np.where(np.abs(x - p) < reach, (1 - (np.abs(x - p) / reach) ** 3) ** 3, 0)
        out.append(np.polyfit(x - p, y, degree, w=np.sqrt(w))[-1])
    return np.array(out)


@pytest.mark.parametrize("span", [0.15, 0.3, 0.75, 1.5])
@pytest.mark.parametrize("degree", [1, 2])
def test_curves_are_those_of_plain_fits(spark, span, degree):
    rng = np.random.default_rng(int(span * 100))
    rows, series = [], {}
    for athlete in (1, 2):
        x = np.sort(rng.choice(700, 130, replace=False))
        y = 50 + 8 * np.sin(x / 60) + rng.normal(0, 2, len(x))
        series[athlete] = x, y
        rows += [(athlete, date(2020, 1, 1) + timedelta(days=int(d)), float(v)) for d, v in zip(x, y, strict=True)]
    rows += [(1, None, 5.0), (1, date(2020, 5, 5), None), (3, date(2020, 1, 1), None), (4, date(2020, 1, 1), 7.0), (4, date(2020, 1, 1), 9.0)]
    df = spark.createDataFrame(rows, "athlete_id long, date date, rhr double").repartition(3)
    got = local_regression(df, "date", "rhr", span=span, degree=degree, points=40)
    curves = {}
    for r in got.orderBy("athlete_id", "date").collect():
        curves.setdefault(r["athlete_id"], []).append((r["date"], r["fitted"]))
    assert set(curves) == {1, 2, 4} and [v for _, v in curves[4]] == [8.0]
    start = (date(2020, 1, 1) - date(1970, 1, 1)).days
    for athlete, (x, y) in series.items():
        at = np.linspace(x[0], x[-1], 40)
        assert np.allclose([a - start for a, _ in curves[athlete]], at, atol=1e-9)
        assert np.abs(np.array([v for _, v in curves[athlete]]) - plain(x, y, at, span, degree)).max() < 1e-9
    assert local_regression(df.limit(0), "date", "rhr").count() == 0


def test_spans():
    assert [span_of(d) for d in (30, 31, 90, 91)] == [0.75, 0.3, 0.3, 0.1]
