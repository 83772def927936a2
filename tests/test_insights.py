"""Date continuity, relationships, anomaly timelines and contributions against plain Python."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomalies as ano
from tidemark.operators import continuity as con
from tidemark.operators import contribution as ctr
from tidemark.operators import relations as rel

DAY = dt.timedelta(1)
D0 = dt.date(2023, 12, 27)


def dates(spark, rows):
    return spark.createDataFrame(rows, "key string, date date")


def brute_continuity(have, calendar, as_of):
    """have: key -> dates; all on the calendar."""
    out = {}
    for key, own in have.items():
        at = sorted(calendar.index(d) for d in own if d in calendar)
        if not at:
            continue
        runs, gaps = [[at[0]]], []
        for a, b in zip(at, at[1:]):
            if b == a + 1:
                runs[-1].append(b)
            else:
                runs.append([b])
                gaps.append((b - a - 1, calendar[a], calendar[b]))
        worst = max(gaps, key=lambda g: (g[0], -g[2].toordinal()), default=(0, None, None))
        behind = max(0, sum(d <= as_of for d in calendar) - 1 - at[-1])
        out[key] = (len(at), calendar[at[0]], calendar[at[-1]], len(runs), sum(g[0] for g in gaps), max(map(len, runs)), *worst, behind, behind > 5)
    return out


def test_continuity_against_plain_lists(spark):
    rng = random.Random(1)
    have = {k: {D0 + DAY * rng.randrange(200) for _ in range(n)} for k, n in (("a", 150), ("b", 40), ("c", 1), ("d", 199))}
    have["e"] = {D0 + DAY * i for i in range(20)} | {D0 + DAY * i for i in range(25, 30)} | {D0 + DAY * i for i in range(35, 40)}  # two equal gaps
    rows = [(k, d) for k, ds in have.items() for d in ds for _ in range(rng.randrange(1, 3))] + [(None, D0), ("f", None), (None, None)]
    as_of = D0 + DAY * 150
    found = con.presence(dates(spark, rows).repartition(5), "key")
    for calendar, days in ((con.shared_calendar(found), sorted(set().union(*have.values()))), (con.weekday_calendar(found), None)):
        if days is None:
            months = {d.replace(day=1) for ds in have.values() for d in ds}
            days = [d for i in range(400) if (d := dt.date(2023, 12, 1) + DAY * i).weekday() < 5 and d.replace(day=1) <= max(months)]
        got = {r["key"]: (r["dates"], r["first_date"], r["last_date"], r["runs"], r["missing"], r["longest_run"], r["longest_gap"], r["gap_after"],
                          r["gap_until"], r["behind"], r["stale"]) for r in con.continuity(found, calendar, as_of).collect()}
        assert got == brute_continuity(have, days, as_of)
    every = [(r["key"], r["missing"]) for r in con.gaps(found, con.shared_calendar(found)).collect()]
    by_month = {}
    for r in con.missing_by_month(found, con.shared_calendar(found)).collect():
        assert r["expected"] == r["present"] + r["missing"]
        by_month[r["key"]] = by_month.get(r["key"], 0) + r["missing"]
    for k in have:
        assert by_month[k] == sum(n for key, n in every if key == k)


def test_presence_merges_by_or(spark):
    rows = [("a", D0), ("a", D0 + DAY), ("a", D0 + DAY * 40), ("b", D0 + DAY * 4), ("a", D0)]
    whole = con.presence(dates(spark, rows), "key")
    parts = [con.presence(dates(spark, rows[i:i + 2]), "key") for i in (0, 2, 4)]
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(con.merge_presence(*parts)) == key(whole) and whole.count() == 3
    days = {r["month"]: r["days"] for r in whole.where("key = 'a'").collect()}
    assert days[dt.date(2023, 12, 1)] == (1 << 26) | (1 << 27)


def test_continuity_of_nothing(spark):
    found = con.presence(dates(spark, [(None, None)]), "key")
    for calendar in (con.shared_calendar(found), con.weekday_calendar(found)):
        assert con.continuity(found, calendar, D0).collect() == []
        assert con.gaps(found, calendar).collect() == [] and con.missing_by_month(found, calendar).collect() == []


def test_relationships_find_foreign_keys(spark):
    rng = random.Random(2)
    parents = spark.createDataFrame([(i, f"name {i}", "x" * 100 + str(i)) for i in range(500)], "id long, name string, long string")
    children = spark.createDataFrame(
        [(i, rng.choice([None, rng.randrange(500)]), f"name {rng.randrange(500)}", "x" * 100 + str(i % 50), rng.randrange(520), [1.0]) for i in range(3000)],
        "cid int, parent long, label string, text string, mostly int, v array<double>")
    empty = spark.createDataFrame([], "id long, nothing string")
    nulls = spark.createDataFrame([(None, None)] * 3, "id long, s string")
    got = {(r["tbl"], r["col"], r["ref_tbl"], r["ref_col"]): r for r in rel.relationships(
        {"parents": parents, "children": children, "empty": empty, "nulls": nulls}, threshold=0.95).collect()}
    assert {k[1] for k in got if k[0] == "children"} == {"parent", "label", "text", "mostly"}
    r = got["children", "mostly", "parents", "id"]
    seen = {x["mostly"] for x in children.select("mostly").collect()}
    assert r["contained"] == len([x for x in seen if x < 500]) and r["values"] == len(seen) and r["containment"] == r["contained"] / r["values"]
    assert got["parents", "id", "children", "cid"]["containment"] == 1.0  # numbers of any width, and ids that run from 0
    assert ("children", "cid", "parents", "id") not in got and ("children", "parent", "children", "cid") not in got


def test_sketches_merge_and_name_large_candidates(spark):
    big = spark.range(60_000).select(F.col("id").alias("k"))
    part = spark.range(200_000).select(F.expr("id % 50000").alias("ref"), F.expr("id % 61000").alias("almost"), F.expr("id + 40000").alias("other"))
    tables = {"big": big.repartition(7), "part": part.repartition(5)}
    near = {(r["col"], r["ref_col"]): r["estimate"] for r in rel.candidates(rel.column_sketches(tables), 0.95).collect()}
    assert abs(near["ref", "k"] - 1) < 0.05 and abs(near["almost", "k"] - 60 / 61) < 0.08 and ("other", "k") not in near
    got = {(r["tbl"], r["col"], r["ref_col"]): r["containment"] for r in rel.relationships(tables).collect()}
    assert got == {("part", "ref", "k"): 1.0, ("part", "almost", "k"): 60000 / 61000}


def test_small_columns_in_a_large_key_are_not_lost(spark):
    """A sketch of the key shows a few of a small column's values, or none at all."""
    big = spark.range(400_000).select((F.col("id") * 7).alias("k"))
    small = spark.range(40).select(*[(F.col("id") % n * 7 * 9001).alias(f"c{n}") for n in (1, 2, 3, 8, 40)], (F.col("id") * 7 + 1).alias("none"))
    got = {r["col"]: r["containment"] for r in rel.relationships({"big": big, "small": small}).collect()}
    assert got == {f"c{n}": 1.0 for n in (1, 2, 3, 8, 40)}


def series(seed, n, shifts, noise=100.0, season=50.0):
    """Values by day with a weekly season and steps at the given days."""
    rng, level, out = random.Random(seed), 1000.0, []
    for i in range(n):
        level += shifts.get(i, 0)
        out.append(round(level + season * (i % 7) + rng.gauss(0, noise), 2))
    return out


def brute_left(values):
    units = [round(v / 0.01) for v in values]
    expected = {s: statistics.median(u for i, u in enumerate(units) if i % 7 == s) for s in range(min(7, len(units)))}
    left = [u - int(expected[i % 7] // 1) for i, u in enumerate(units)]
    return left, statistics.median(map(abs, left))


def brute_shifts(left, scale, sigmas, least, depth, start=0, level=1):
    n, best = len(left), None
    for k in range(least, n - least + 1):
        a, b = sum(left[:k]), sum(left[k:])
        gain = a * a / k + b * b / (n - k) - (a + b) * (a + b) / n
        strength = max(gain, 0.0) ** 0.5 / (1.4826 * scale)
        if strength > sigmas and (best is None or strength > best[0]):
            best = (strength, k)
    if best is None or level > depth:
        return []
    k = best[1]
    return [(start + k, level)] + brute_shifts(left[:k], scale, sigmas, least, depth, start, level + 1) + brute_shifts(
        left[k:], scale, sigmas, least, depth, start + k, level + 1)


def points(spark, named):
    rows = [(s, D0 + DAY * i, v) for s, vs in named.items() for i, v in enumerate(vs)]
    rows += [(None, D0, 1.0), ("x", None, 1.0), ("x", D0, None), ("x", D0 + DAY, float("nan"))]
    return spark.createDataFrame(rows, "series string, at date, value double").repartition(6)


def week():
    return F.pmod(F.datediff("at", F.lit(D0)), F.lit(7))


def test_planted_shifts_are_found_as_by_search(spark):
    named = {"flat": series(1, 400, {}), "step": series(2, 400, {200: 400}), "three": series(3, 500, {100: 500, 220: -700, 400: 300}),
             "const": [5.0] * 50, "one": [1.0]}
    left = ano.baseline(points(spark, named), week())
    got = {}
    for r in ano.level_shifts(left, sigmas=8.0, least=15, depth=4).collect():
        got.setdefault(r["series"], []).append(((r["at"] - D0).days, r["level"]))
    for name, values in named.items():
        mine, scale = brute_left(values)
        want = brute_shifts(mine, scale, 8.0, 15, 4) if scale else []
        assert sorted(got.get(name, [])) == sorted(want), name
    assert "flat" not in got and [k for k, _ in got["step"]] and abs(got["step"][0][0] - 200) <= 3
    assert all(any(abs(k - at) <= 4 for k, _ in got["three"]) for at in (100, 220, 400))
    rows = {(r["series"], r["at"]): (r["left"], r["scale"]) for r in left.collect()}
    mine, scale = brute_left(named["three"])
    assert [rows["three", D0 + DAY * i] for i in range(500)] == [(x, scale) for x in mine]


def test_shifts_do_not_depend_on_blocks(spark):
    named = {"a": series(5, 300, {150: 600}), "b": series(6, 300, {40: 800, 250: -900})}
    left = ano.baseline(points(spark, named), week())
    key = lambda df: sorted(map(tuple, df.collect()))
    months = key(ano.level_shifts(left))
    assert len(months) >= 3 and months == key(ano.level_shifts(left, block=F.col("at"))) == key(ano.level_shifts(left, block=F.lit(1)))


def test_outliers(spark):
    values = series(9, 300, {}, noise=10)
    values[77] += 500
    values[200] -= 400
    left = ano.baseline(points(spark, {"s": values, "const": [1.0] * 20}), week())
    mine, scale = brute_left(values)
    got = {(r["at"] - D0).days: r["score"] for r in ano.outliers(left, 5.0).collect()}
    want = {i: x / (1.4826 * scale) for i, x in enumerate(mine) if abs(x / (1.4826 * scale)) > 5}
    assert got == pytest.approx(want) and {77, 200} <= set(got)
    nothing = ano.baseline(points(spark, {}).where("false"), week())
    assert nothing.collect() == [] and ano.level_shifts(nothing).collect() == [] and ano.outliers(nothing).collect() == []


@pytest.mark.parametrize("values", [[3], [1, 2], [5, 5, 5, 9], list(range(-3000, 3000, 7)), [-1, 10 ** 12, 4]])
def test_medians_in_blocks(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 4)], "g string, v long")
    got = {r["g"]: r["median"] for r in ano._medians(df, ["g"], "v").collect()}
    assert got["g"] == statistics.median(values)


DIMS = ["a", "b", "c"]


def sales(spark, seed, n=800):
    rng = random.Random(seed)
    rows = [(rng.choice("xyz"), rng.choice(["p", "q", None]), rng.choice("1234"), rng.choice([rng.randrange(-50, 300), None]), rng.choice([0, 1, 1, None, 2])) for _ in range(n)]
    rows += [("x", "p", "4", 20_000, 1), ("only", "q", "1", -9_000, 0)]
    return rows, spark.createDataFrame(rows, "a string, b string, c string, v long, p int").repartition(3)


def brute_cells(rows, levels):
    from itertools import combinations

    out = {}
    for n in range(levels + 1):
        for some in combinations(range(3), n):
            for row in rows:
                if row[3] is None or row[4] not in (0, 1):
                    continue
                cell = (n, ",".join(DIMS[i] for i in some), *[row[i] if i in some else None for i in range(3)])
                c = out.setdefault(cell, [0, 0, 0, 0])
                c[row[4]] += 1
                c[2 + row[4]] += row[3]
    return out


@pytest.mark.parametrize("seed, k", [(1, 5), (2, 12), (3, 40)])
def test_contributions_against_plain_sums(spark, seed, k):
    rows, df = sales(spark, seed)
    base = ctr.cells(df, DIMS, F.col("v"), F.col("p"))
    want = brute_cells(rows, 3)
    got = {(r["level"], r["dims"], r["a"], r["b"], r["c"]): r for r in ctr.lattice(base, DIMS, 3).collect()}
    assert {key: [r["n0"], r["n1"], r["v0"], r["v1"]] for key, r in got.items()} == want
    total = got[0, "", None, None, None]["change"]
    for some in {r["dims"] for r in got.values()}:
        assert sum(r["change"] for r in got.values() if r["dims"] == some) == total
    for r in got.values():
        assert r["volume"] + r["rate"] == pytest.approx(r["change"])
        if r["n0"] and r["n1"]:
            assert r["rate"] == pytest.approx((r["v1"] / r["n1"] - r["v0"] / r["n0"]) * (r["n0"] + r["n1"]) / 2)
    order = lambda x: (-abs(x[1][3] - x[1][2]), x[0][0], x[0][1], *[(v is not None, v or "") for v in x[0][2:]])
    top = sorted(((key, v) for key, v in want.items() if key[0] > 0), key=order)[:k]
    shown = [(r["level"], r["dims"], r["a"], r["b"], r["c"]) for r in ctr.top_contributions(base, DIMS, 3, k).collect()]
    assert sorted(shown, key=str) == sorted([key for key, _ in top], key=str)


def test_contributions_of_nothing(spark):
    _, df = sales(spark, 1)
    base = ctr.cells(df.where("false"), DIMS, F.col("v"), F.col("p"))
    assert ctr.top_contributions(base, DIMS, 2, 5).collect() == []
    assert [(r["change"], r["n0"]) for r in ctr.lattice(base, DIMS, 1).collect()] == [(0, 0)]  # the total is there, and it is nothing
