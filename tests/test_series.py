"""Series analytics against NumPy, on lengths around every limit."""

import numpy as np
import pytest
from conftest import rows

from remitlake.operators import series


def months(n, start=2020 * 12):
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(start, start + n)]


def frame(spark, **named):
    data = [(name, m, v) for name, values in named.items() for m, v in zip(months(len(values)), values)]
    return spark.createDataFrame(data, "series string, period string, value double")


def bounds(values):
    known = np.array([v for v in values if v is not None])
    if len(known) < 4:
        return None, None
    q1, q3 = np.percentile(known, [25, 75])
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def outliers(values):
    low, high = bounds(values)
    return [low is not None and v is not None and (v < low or v > high) for v in values]


@pytest.fixture(scope="module")
def cases():
    rnd = np.random.default_rng(3)
    out = {f"n{n}": [float(v) for v in rnd.normal(100, 10, n)] for n in (3, 4, 5, 6, 7, 11, 12, 30)}
    spiked = [float(v) for v in rnd.normal(100, 5, 24)]
    spiked[5], spiked[17], spiked[9] = 400.0, -200.0, None
    out["spiked"] = spiked
    out["wave"] = [100 + 50 * float(np.sin(2 * np.pi * i / 12)) + float(rnd.normal()) for i in range(36)]
    out["flat"] = [7.0] * 14
    out["zeros"] = [0.0, 1.0, 0.0, 2.0, 1.0, 0.0, 3.0, 0.0]
    return out


def test_anomalies(spark, cases):
    found = {}
    for r in rows(series.detect_anomalies(frame(spark, **cases))):
        found.setdefault(r["series"], []).append(r)
    for name, values in cases.items():
        points = sorted(found[name], key=lambda r: r["period"])
        low, high = bounds(values)
        assert [r["is_anomaly"] for r in points] == outliers(values)
        if low is None:
            assert points[0]["lower_bound"] is None
        else:
            assert points[0]["lower_bound"] == pytest.approx(low) and points[0]["upper_bound"] == pytest.approx(high)


def test_seasonality(spark, cases):
    found = {r["series"]: r for r in rows(series.detect_seasonality(frame(spark, **cases)))}
    patterns = {r["series"] for r in rows(series.seasonal_pattern(frame(spark, **cases)))}
    for name, values in cases.items():
        known = [(m, v) for m, v in zip(months(len(values)), values) if v is not None]
        strength = 0.0
        whole = np.var([v for _, v in known])
        if len(known) >= 12 and whole > 0:
            by_month = {}
            for m, v in known:
                by_month.setdefault(m[5:], []).append(v)
            strength = min(np.var([np.mean(v) for v in by_month.values()]) / whole, 1.0)
        assert (name in patterns) == (len(known) >= 12 and whole > 0)
        assert found[name]["strength"] == pytest.approx(strength)
        assert found[name]["level"] == ("strong" if strength >= 0.5 else "moderate" if strength >= 0.3 else "none")
    assert found["wave"]["level"] == "strong"


def test_month_that_cannot_be_read_has_no_season(spark):
    data = [("s", "oops" if i == 3 else m, float(i)) for i, m in enumerate(months(15))]
    odd = spark.createDataFrame(data, "series string, period string, value double")
    assert rows(series.detect_seasonality(odd)) == [{"series": "s", "strength": 0.0, "level": "none"}]


def test_forecast(spark, cases):
    found = {}
    for r in rows(series.linear_forecast(frame(spark, **cases)).orderBy("series", "step")):
        found.setdefault(r["series"], []).append(r)
    for name, values in cases.items():
        known = [v for v in values if v is not None]
        flags = outliers(known)
        used = [i for i, bad in enumerate(flags) if not bad]
        if len(used) < 4:
            assert name not in found
            continue
        x, y = np.array(used, float), np.array([known[i] for i in used])
        line = np.polyfit(x, y, 1)
        spread = np.std(y - np.polyval(line, x))
        assert [r["period"] for r in found[name]] == months(3, 2020 * 12 + len(values))
        for i, r in enumerate(found[name]):
            expected = np.polyval(line, len(known) + i)
            assert r["projected"] == pytest.approx(expected, abs=1e-7)
            assert r["upper"] == pytest.approx(expected + spread, abs=1e-7)
            assert r["lower"] == pytest.approx(expected - spread, abs=1e-7)


def test_model_stats(spark, cases):
    found = {r["series"]: r for r in rows(series.model_stats(frame(spark, **cases)))}
    for name, values in cases.items():
        known = [v for v in values if v is not None]
        y = np.array([v for v, bad in zip(known, outliers(known)) if not bad])
        if len(y) < 6:
            assert name not in found
            continue
        split = max(int(len(y) * 0.75), 4)
        x = np.arange(len(y), dtype=float)
        line = np.polyfit(x[:split], y[:split], 1)
        error = y - np.polyval(line, x)
        r = found[name]
        assert (r["train_points"], r["test_points"]) == (split, len(y) - split)
        for side, part in (("train", slice(None, split)), ("test", slice(split, None))):
            whole = np.sum((y[part] - y[part].mean()) ** 2)
            r2 = 1 - np.sum(error[part] ** 2) / whole if whole > 0 else 0.0
            assert r[f"r2_{side}"] == pytest.approx(r2, abs=1e-7)
            assert r[f"mae_{side}"] == pytest.approx(np.mean(np.abs(error[part])), abs=1e-7)
            nonzero = y[part] != 0
            if nonzero.any():
                mape = np.mean(np.abs(error[part][nonzero] / y[part][nonzero])) * 100
                assert r[f"mape_{side}"] == pytest.approx(mape, abs=1e-6)
            else:
                assert r[f"mape_{side}"] is None


def test_unlabelled_last_month(spark):
    data = [("s", None if i == 5 else m, float(i)) for i, m in enumerate(months(6))]
    odd = spark.createDataFrame(data, "series string, period string, value double")
    assert [r["period"] for r in rows(series.linear_forecast(odd).orderBy("step"))] == ["+1m", "+2m", "+3m"]


def test_summary_against_benchmark(spark):
    rising = frame(spark, days_in_ar=[30.0, 31.0, 32.0, 33.0, 34.0], denial_rate=[9.0, 8.0, 7.0, 6.0], collections=[5.0] * 4)
    found = {r["series"]: r for r in rows(series.forecast_summary(rising))}
    assert found["days_in_ar"]["against_benchmark"] == "above" and found["days_in_ar"]["direction"] == "upward"
    assert found["denial_rate"]["against_benchmark"] == "within" and found["denial_rate"]["direction"] == "downward"
    assert found["collections"]["against_benchmark"] is None and found["collections"]["projected_total"] == pytest.approx(15)
