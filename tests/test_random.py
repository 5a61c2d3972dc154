"""Operators on many random groups at once, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockaudit.functions.stats import corr_pvalue, pairs, pearson
from stockaudit.operators import ranking, summaries, windows

GROUPS = 120


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(11)
    rows = []
    for g in range(GROUPS):
        size = int(rng.integers(1, 40))
        spread = int(rng.choice([1, 3, 10, 500]))
        for i, v in enumerate(rng.integers(0, spread, size)):
            rows.append((g, i, int(v), None if rng.random() < 0.1 else int(v + rng.integers(0, 8))))
    return pd.DataFrame(rows, columns=["g", "i", "v", "w"])


@pytest.fixture(scope="module")
def df(spark, groups):
    rows = [(r.g, r.i, r.v, None if pd.isna(r.w) else int(r.w)) for r in groups.itertuples()]
    return spark.createDataFrame(rows, "g int, i int, v int, w int")


def test_quantiles(df, groups):
    got = {(r["g"], r["measure"]): r for r in summaries.numeric_summary(df, ["g"], ["v", "w"]).collect()}
    assert len(got) == 2 * groups["g"].nunique()
    for (g, measure), row in got.items():
        values = groups.loc[groups["g"] == g, measure]
        known = values.dropna()
        assert row["nulls"] == len(values) - len(known)
        if len(known):
            want = [known.min(), *np.percentile(known, [25, 50, 75]), known.mean(), known.max()]
            assert [row[n] for n in ("min", "q1", "median", "q3", "mean", "max")] == pytest.approx(want)


def test_box(df, groups):
    for row in summaries.box_stats(df, ["g"], "w").collect():
        values = groups.loc[groups["g"] == row["g"], "w"].dropna().to_numpy()
        q1, q3 = np.percentile(values, [25, 75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        got = (row["whisker_low"], row["whisker_high"], row["outliers"], row["rows"])
        assert got == (min(inside.min(), q1), max(inside.max(), q3), len(values) - len(inside), len(values))


def test_average_rank(df, groups):
    want = groups.assign(r=groups.groupby("g")["v"].rank(ascending=False, method="average"))
    want = {(r.g, r.i): r.r for r in want.itertuples()}
    got = df.withColumn("r", windows.average_rank("v", ["g"])).collect()
    assert {(r["g"], r["i"]): r["r"] for r in got} == want


def test_running_share(df, groups):
    order = [F.desc("v"), F.asc("i")]
    got = {(r["g"], r["i"]): r["s"] for r in df.withColumn("s", windows.cumulative_share("v", order, ["g"])).collect()}
    for g, part in groups.sort_values(["v", "i"], ascending=[False, True]).groupby("g"):
        total = part["v"].sum()
        for i, running in zip(part["i"], part["v"].cumsum()):
            assert got[g, i] == (None if total == 0 else pytest.approx(running / total))


def test_correlation_and_p_value(df, groups):
    got = df.groupBy("g").agg(pearson(F.col("v"), F.col("w")).alias("r"), pairs(F.col("v"), F.col("w")).alias("n"))
    for row in got.withColumn("p", corr_pvalue(F.col("r"), F.col("n"))).collect():
        part = groups[groups["g"] == row["g"]].dropna()
        assert row["n"] == len(part)
        if len(part) < 3 or part["v"].nunique() == 1 or part["w"].nunique() == 1:
            assert row["r"] is None and row["p"] is None
            continue
        r = np.corrcoef(part["v"], part["w"])[0, 1]
        assert row["r"] == pytest.approx(r, abs=1e-9)
        if abs(r) < 0.999:
            # The density of a sample correlation under independence, integrated numerically.
            x = np.linspace(-1, 1, 400_001)[1:-1]
            density = (1 - x * x) ** ((len(part) - 4) / 2)
            if len(part) >= 5:
                want = density[np.abs(x) >= abs(r)].sum() / density.sum()
                assert row["p"] == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("k", [1, 7, 60])
def test_top_k_with_ties(df, groups, k):
    cutoff = groups["w"].dropna().nlargest(k).min()
    want = sorted(groups.loc[groups["w"] >= cutoff, "w"].astype(int))
    assert sorted(r["w"] for r in ranking.top_n_ties(df, "w", k).collect()) == want


@pytest.mark.parametrize("fraction", [0.003, 0.01, 0.37, 0.9])
def test_top_fraction_with_ties(df, groups, fraction):
    ranks = groups["w"].rank(ascending=False, method="min")
    want = sorted(groups.loc[ranks <= fraction * len(groups), "w"].astype(int))
    spread = df.repartition(7)
    assert sorted(r["w"] for r in ranking.top_fraction_ties(spread, "w", fraction).collect()) == want


def test_top_fraction_survives_a_wrong_sketch(df, groups, monkeypatch):
    """With a bound far too high, the count check sends the search to all rows."""
    monkeypatch.setattr(type(df), "approxQuantile", lambda self, column, probabilities, error: [1e9])
    want = (groups["w"].rank(ascending=False, method="min") <= 0.2 * len(groups)).sum()
    assert ranking.top_fraction_ties(df, "w", 0.2).count() == want
