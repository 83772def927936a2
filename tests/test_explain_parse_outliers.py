"""Target explanation, parse success and robust outliers against plain Python."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explain as exp
from tidemark.operators import outliers as out
from tidemark.operators import parsing as par


def entropy(items):
    n, c = len(items), Counter(items)
    return -sum(v / n * math.log(v / n) for v in c.values()) + (len(c) - 1) / (2 * n)


def test_explanation_against_plain_entropies(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        a, b, noise = rng.choice("xyz"), rng.choice(["p", "q", None]), rng.choice("1234567")
        y = ("hi" if a == "x" else "lo") if rng.random() < 0.8 else rng.choice(["hi", "lo", None])
        if b == "q" and rng.random() < 0.5:
            y = "mid"
        rows.append((y, a, b, noise, a + "!", "same"))
    df = spark.createDataFrame(rows, "y string, a string, b string, noise string, copy string, const string").repartition(4)
    got = {r["column"]: r for r in exp.explain_target(df, "y", ["a", "b", "noise", "copy", "const", "y"]).collect()}
    ys = [r[0] for r in rows]
    for i, c in enumerate(["a", "b", "noise", "copy", "const"], 1):
        xs = [r[i] for r in rows]
        want = entropy(xs) + entropy(ys) - entropy(list(zip(xs, ys)))
        assert got[c]["corrected"] == pytest.approx(want, abs=1e-9) and got[c]["share"] == pytest.approx(want / entropy(ys), abs=1e-9)
        if c != "a":
            zs = [r[1] for r in rows]
            more = entropy(list(zip(zs, xs))) + entropy(list(zip(zs, ys))) - entropy(list(zip(zs, xs, ys))) - entropy(zs)
            assert got[c]["beside"] == pytest.approx(more, abs=1e-9)
    assert got["a"]["given"] == "a" and got["a"]["beside"] is None and got["a"]["place"] == 1 and got["copy"]["place"] == 2  # ties go by name
    assert got["copy"]["beside"] == pytest.approx(0, abs=1e-9) and got["b"]["beside"] > 0.05 and abs(got["const"]["corrected"]) < 1e-9
    assert got["noise"]["information"] > got["noise"]["corrected"]  # chance alone looks like information


def test_explanation_bins_numbers_by_quantiles(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 1.0, 1.0, rng.gauss(0, 1), float("inf"), float("nan"), None]) for _ in range(500)]
    df = spark.createDataFrame([(v, "t") for v in values], "v double, y string")
    got = Counter(r["v"] for r in exp.binned(df, ["v"], 4).collect())
    real = sorted(v for v in values if v is not None and not math.isnan(v))
    cuts = []
    for q in (0.25, 0.5, 0.75):
        pos = q * (len(real) - 1)
        lo, hi = real[math.floor(pos)], real[math.ceil(pos)]
        cuts.append(lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos)))
    want = Counter("" if v is None or math.isnan(v) else str(sum(v > c for c in cuts)) for v in values)
    assert got == want
    empty = exp.explain_target(df.where("false"), "y", ["v"]).collect()
    assert empty == []
    alone = exp.explain_target(df, "y", ["v", "y"]).first()  # one column, and a target without entropy
    assert alone["column"] == "v" and alone["share"] is None and alone["beside"] is None


@pytest.mark.parametrize("form, good, bad", [
    ("integer", ["1", "-20", "+3"], ["x"]), ("decimal", ["1.5", ".5", "2."], ["1,5"]), ("scientific", ["1e5", "2.5E-3", "4"], ["e5"]),
    ("grouped", ["1,234", "12,345,678.9", "1,000"], ["1,23"]), ("decimal comma", ["1,5", "22,75"], ["1.5"]), ("currency", ["$1,000.50", "€ 5"], ["5"]),
    ("percent", ["5%", "7.25 %"], ["5"]), ("yyyy-MM-dd", ["2024-02-29", "1999-12-31"], ["2023-02-29"]), ("dd/MM/yyyy", ["31/12/2020", "01/02/2021"], ["32/01/2020"]),
    ("MM/dd/yyyy", ["12/31/2020", "01/30/2021"], ["13/31/2020"]), ("yyyyMMdd", ["20240101", "19991231", "x"], ["y"]),
    ("dd.MM.yyyy", ["28.02.2023"], ["30.02.2023"]), ("yyyy-MM-dd HH:mm:ss", ["2024-01-01 23:59:59"], ["2024-01-01 25:00:00"]),
])
def test_each_format(spark, form, good, bad):
    if form == "yyyyMMdd":  # eight digits are an integer as well, which is narrower
        good, bad = ["20240101", "19991231"], ["20241301"]
        df = spark.createDataFrame([(v,) for v in good + bad], "v string")
        counts = {r["format"]: r["parsed"] for r in par.format_counts(par.shapes(df, ["v"])).collect()}
        assert counts["yyyyMMdd"] == 2 and counts["integer"] == 3
        return
    df = spark.createDataFrame([(f" {v} ",) for v in good * 3 + bad] + [(None,), ("",), ("  ",)], "v string")
    r = par.parse_success(df, ["v"]).first()
    assert (r["format"], r["values"], r["parsed"], r["failing"]) == (form, 3 * len(good) + 1, 3 * len(good), bad[0])
    assert r["kind"] == ("date" if form in par.DATES else "number")


def test_parse_success_of_columns(spark):
    rows = [(str(i), "n/a" if i % 4 == 0 else f"{i}.5", "x" * 5000 if i % 2 else "words here", None, f"2024-01-{i % 40 + 1:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").repartition(3)
    got = {r["column"]: r for r in par.parse_success(df, ["a", "b", "c", "d", "e"]).collect()}
    assert got["a"]["format"] == "integer" and got["a"]["share"] == 1 and got["a"]["failing"] is None and got["a"]["alert"] is None
    assert got["b"]["format"] == "decimal" and got["b"]["share"] == 0.75 and got["b"]["failing"] == "n/a" and got["b"]["alert"] == "high"
    assert got["c"]["kind"] == "text" and got["c"]["format"] is None and got["c"]["alert"] is None and "d" not in got
    assert got["e"]["format"] == "yyyy-MM-dd" and got["e"]["parsed"] == 31 and got["e"]["failing"] == "2024-01-32" and got["e"]["alert"] == "medium"
    assert par.parse_success(df.where("false"), ["a"]).collect() == []


def quantile(values, q):
    s, pos = sorted(values), q * (len(values) - 1)
    lo, hi = s[math.floor(pos)], s[math.ceil(pos)]
    return lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))


def test_outliers_against_plain_rules(spark):
    rng = random.Random(3)
    columns = {
        "plain": [rng.gauss(0, 1) for _ in range(500)] + [15.0, -20.0], "ties": [1.0] * 300 + [2.0] * 150 + [float(x) for x in range(52)],
        "inf": [float(x % 17) for x in range(500)] + [float("inf"), float("-inf")], "const": [3.0] * 502, "gaps": [None, float("nan")] * 245 + [1.0, 2.0, 3.0, 4.0, 5.0, 99.0, 2.0, 3.0, 4.0, 3.0, 3.0, 2.0],
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame([list(r) for r in rows], ", ".join(f"{c} double" for c in columns)).withColumn("t", F.lit("x")).repartition(5)
    got = {r["column"]: r for r in out.outlier_summary(df).collect()}
    assert set(got) == set(columns)
    for name, values in columns.items():
        real = [v for v in values if v is not None and not math.isnan(v)]
        finite = [v for v in real if math.isfinite(v)]
        p25, med, p75 = (quantile(real, q) for q in (0.25, 0.5, 0.75))
        mad = quantile([0.0 if v == med else abs(v - med) for v in real], 0.5)
        r = got[name]
        assert (r["rows"], r["p25"], r["median"], r["p75"], r["mad"]) == (len(real), pytest.approx(p25), pytest.approx(med), pytest.approx(p75), pytest.approx(mad))
        for rule, step, low, high in (("iqr", 1.5 * (p75 - p25), p25, p75), ("z", 3 * statistics.stdev(finite), *[statistics.mean(finite)] * 2),
                                      ("mad", 3.5 * mad / 0.6745, med, med)):
            want = sum(v < low - step or v > high + step for v in real) if step > 0 else 0
            assert r[f"{rule}_rows"] == want and r[f"{rule}_share"] == pytest.approx(want / len(real)), (name, rule)
            assert (r[f"{rule}_low"] is None) == (step <= 0)
    assert got["const"]["level"] is None and got["plain"]["level"] == "info" and got["inf"]["iqr_rows"] == 2
    named = out.outlier_rows(df, ["plain", "gaps"], least=2).collect()
    assert sorted(x["value"] for r in named for x in r["outlying"] if x["column"] == "plain" and abs(x["value"]) > 10) == [-20.0, 15.0]
    assert any(x["value"] == 99.0 for r in named for x in r["outlying"])
    assert out.outlier_summary(df.where("false")).collect() == [] and out.outlier_rows(df.where("false"), ["plain"]).collect() == []
    assert out.outlier_summary(df.select("t")).collect() == []
