"""Window building blocks.

A market table holds at most one bar per (ticker, date). A window over one ticker therefore never holds more rows
than there are calendar days (about 36,525 per century), however large the table grows; the same bound covers every
table with one row per date. Windows in this package are only put over such bounded groups. Ranks over one date, and
rolling means over a whole table, have no such bound and go through ``operators.ordering`` instead.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_LONG_FRAME = 50
_AGGREGATES = {"avg": "avg", "std": "stddev_samp", "max": "max", "min": "min", "count": "count", "cov": "covar_samp"}


def series(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy(order)


def running(*keys: str, order: str = "date") -> WindowSpec:
    return series(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def _over(keys: tuple[str, ...], order: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} {frame})"


_GROWING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def with_rolling(df: DataFrame, n: int, stats: dict[str, tuple[str, str]], keys: tuple[str, ...] = ("ticker",),
                 order: str = "date", need: int | None = None) -> DataFrame:
    """Add statistics of the last n rows, null until ``need`` (default n) of them hold a value.

    ``stats`` maps an output to (kind, column), kind being avg, std, max, min, count, or cov with a pair "x,y" of
    columns that are null together. Short frames use plain sliding windows. Long ones are cut into blocks of n rows:
    each frame is the tail of one block and the head of the next, so running aggregates taken forward and backward
    and one merge per row replace n updates per row.
    """
    need = n if need is None else need
    names = {x: x.replace(",", "_") for _, x in stats.values()}
    first = {x: x.split(",")[0] for x in names}
    if n < _LONG_FRAME:
        frame = _over(keys, order, f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
        inner = df.selectExpr(
            "*", *[f"count({first[x]}) {frame} AS _c_{v}" for x, v in names.items()],
            *[f"{_AGGREGATES[kind]}({x}) {frame} AS _r_{out}" for out, (kind, x) in stats.items()])
        return inner.selectExpr(
            *df.columns, *[f"CASE WHEN _c_{names[x]} >= {need} THEN _r_{out} END AS {out}" for out, (_, x) in stats.items()])
    parts = {}
    for x, v in names.items():
        cols = x.split(",")
        kinds = {kind for kind, y in stats.values() if y == x}
        parts[f"c_{v}"] = f"count({cols[0]})"
        if kinds & {"avg", "std", "cov"}:
            parts[f"m_{v}"] = f"avg({cols[0]})"
        if "std" in kinds:
            parts[f"v_{v}"] = f"var_pop({x})"
        if "cov" in kinds:
            parts |= {f"m2_{v}": f"avg({cols[1]})", f"v_{v}": f"covar_pop({x})"}
        parts |= {f"{k}_{v}": f"{k}({x})" for k in kinds & {"max", "min"}}
    row = _over(keys, order)
    head, tail = (_over((*keys, "_blk"), o, _GROWING) for o in (order, f"{order} DESC"))
    # A frame that ends with its block has no tail from the block before.
    inner = (
        df.selectExpr("*", f"row_number() {row} - 1 AS _pos")
        .selectExpr("*", f"_pos div {n} AS _blk")
        .selectExpr("*", *[f"{agg} {head} AS _h_{k}" for k, agg in parts.items()])
        .selectExpr("*", *[f"{agg} {tail} AS _t_{k}" for k, agg in parts.items()])
        .selectExpr("*", *[f"lag(_t_{k}, {n - 1}) {row} AS _l_{k}" for k in parts])
        .selectExpr("*", *[f"CASE WHEN _pos - _blk * {n} < {n - 1} THEN _l_{k} END AS _o_{k}" for k in parts])
        .selectExpr("*", *[f"_h_c_{v} + coalesce(_o_c_{v}, 0) AS _n_{v}" for v in names.values()])
    )

    def merged(kind: str, x: str) -> str:
        v = names[x]
        if kind in ("max", "min"):
            return f"{'greatest' if kind == 'max' else 'least'}(_h_{kind}_{v}, _o_{kind}_{v})"
        if kind == "count":
            return f"_n_{v}"
        a, b, total = f"_h_c_{v}", f"coalesce(_o_c_{v}, 0)", f"nullif(_n_{v}, 0)"
        part = lambda k: (f"coalesce(_h_{k}_{v}, 0D)", f"coalesce(_o_{k}_{v}, 0D)")
        (ma, mb) = part("m")
        mean = f"(({a} * {ma} + {b} * {mb}) / {total})"
        if kind == "avg":
            return mean
        va, vb = part("v")
        if kind == "cov":
            na, nb = part("m2")
            return f"try_divide({a} * {va} + {b} * {vb} + ({ma} - {mb}) * ({na} - {nb}) * {a} * {b} / {total}, _n_{v} - 1)"
        spread = f"({a} * {va} + {b} * {vb} + ({ma} - {mb}) * ({ma} - {mb}) * {a} * {b} / {total})"
        # Merging leaves rounding dust where all values are equal; such a frame has no spread.
        return f"CASE WHEN {spread} <= {total} * {mean} * {mean} * 1e-26 THEN 0D ELSE sqrt(try_divide({spread}, _n_{v} - 1)) END"

    return inner.selectExpr(
        *df.columns, *[f"CASE WHEN _n_{names[x]} >= {need} THEN {merged(kind, x)} END AS {out}" for out, (kind, x) in stats.items()])


def change(x: Column, k: int, w: WindowSpec) -> Column:
    """Relative change against the value k rows before."""
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def with_zscores(df: DataFrame, n: int, values: dict[str, str], keys: tuple[str, ...] = ("ticker",),
                 order: str = "date", need: int | None = None) -> DataFrame:
    """Add (value - mean) / std of the last n rows for each column -> output of ``values``."""
    stats = {f"_{k}_{x}": (k, x) for x in values for k in ("avg", "std")}
    return with_rolling(df, n, stats, keys, order, need).selectExpr(
        *df.columns, *[f"try_divide({x} - _avg_{x}, _std_{x}) AS {out}" for x, out in values.items()])


def with_calendar_index(df: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Number the dates of the universe 1, 2, .. as ``di``.

    The calendar has one row per day, so its ordering window and its broadcast are bounded by the calendar.
    """
    days = (df if dates is None else dates).select("date").distinct()
    calendar = days.select("date", F.row_number().over(Window.orderBy("date")).alias("di"))
    return df.join(F.broadcast(calendar), "date")


def calendar_lag(x: Column, k: int, *keys: str) -> Column:
    """Value on the k-th previous date of the universe; null when the ticker had no bar that day."""
    return F.max(x).over(series(*keys, order="di").rangeBetween(-k, -k))


def calendar_change(x: Column, k: int, *keys: str) -> Column:
    return F.try_divide(x, calendar_lag(x, k, *keys)) - 1


def calendar_mean(x: Column, n: int, *keys: str) -> Column:
    frame = series(*keys, order="di").rangeBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


DECAY = 50  # an input that has faded by e^-50 no longer shows in a double


def _fading(alpha: float, step: str) -> str:
    """Log of how much older values fade when a value comes ``step`` rows after the one before it; 0 without a step."""
    return f"if({step} IS NULL, 0D, least(700D, ln(1 + {alpha!r}D * pow({(1 - alpha)!r}D, -({step})))))"


def with_ema(df: DataFrame, groups: dict[str, list[tuple[str, str, float]]], key: str = "ticker", order: str = "date") -> DataFrame:
    """Exponential means ``(out, input column, alpha)`` seeded with the first non-null input.

    The inputs of one group are null on the same rows as the column the group is named after.

    The mean moves by y = (w y' + alpha x) / (w + alpha) with w = (1-alpha)^steps, where steps counts the rows since the last
    value, rows without one included: after a gap a new value counts for more. Rows without a value repeat the last mean.
    Written as a sum of inputs weighted by how far they have faded, the series is cut into blocks of a fading of ``DECAY`` in
    the slowest mean of the group; a running sum inside the block plus the total of the block before it gives the mean
    with windows only and no fold over the rows.
    """
    out_columns = df.columns
    grow = _over((key,), order, _GROWING)
    past = _over((key,), order, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    df = df.selectExpr("*", f"row_number() {_over((key,), order)} AS _row")
    for g, specs in groups.items():
        slow = min(alpha for _, _, alpha in specs)
        worst = max(math.log1p(a * (1 - a) ** -s) / math.log1p(slow * (1 - slow) ** -s) for _, _, a in specs for s in range(1, 60))
        if worst * DECAY > 600:
            raise ValueError("smoothing factors of one group differ too much for a common block")
        step, b, place, last = f"_step_{g}", f"_b_{g}", f"_at_{g}", f"_len_{g}"
        inside = _over((key, b), order, _GROWING)
        before = _over((key,), b, "RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING")
        # Fading of a value is (1-alpha)^place, times exp(-gaps) for what steps of more than one row add to it.
        more = {out: f"CASE WHEN {step} > 1 THEN {_fading(alpha, step)} - {_fading(alpha, '1')} ELSE 0D END" for out, _, alpha in specs}
        df = (
            df.selectExpr("*", f"count({g}) {grow} AS _n_{g}", f"CASE WHEN {g} IS NOT NULL THEN _row - max(CASE WHEN {g} IS NOT NULL THEN _row END) {past} END AS {step}")
            .selectExpr("*", f"CAST(floor(sum({_fading(slow, step)}) {grow} / {DECAY}) AS BIGINT) AS {b}",
                        *[f"{m} AS _more_{out}" for out, m in more.items()])
            .selectExpr("*", f"count({g}) {inside} - 1 AS {place}", f"count({g}) {before} AS {last}",
                        *[f"first_value(_more_{out}) {inside} AS _first_{out}" for out, _, _ in specs],
                        *[f"sum(_more_{out}) {inside} - first_value(_more_{out}) {inside} AS _gaps_{out}" for out, _, _ in specs])
            .selectExpr("*", *[
                f"{x} * CASE WHEN {step} IS NULL THEN 1D WHEN {step} = 1 THEN {alpha!r}D ELSE 1 / (1 + pow({(1 - alpha)!r}D, {step}) / {alpha!r}D) END"
                f" * pow({(1 - alpha)!r}D, -{place}) * exp(_gaps_{out}) AS _w_{out}" for out, x, alpha in specs])
            .selectExpr("*", *[f"sum(_w_{out}) {inside} AS _in_{out}" for out, _, _ in specs],
                        *[f"sum(_w_{out}) {before} AS _before_{out}" for out, _, _ in specs],
                        *[f"max(_gaps_{out}) {before} AS _till_{out}" for out, _, _ in specs])
        )
        out_columns += [
            f"CASE WHEN _n_{g} > 0 THEN pow({(1 - alpha)!r}D, {place}) * exp(-_gaps_{out}) * (coalesce(_in_{out}, 0D) + coalesce("
            f"_before_{out} * pow({(1 - alpha)!r}D, {last}) * exp(-_till_{out} - _first_{out}), 0D)) END AS {out}" for out, _, alpha in specs]
    return df.selectExpr(*out_columns)


def with_window_drawdown(df: DataFrame, price: str, n: int, out: str, key: str = "ticker", order: str = "date") -> DataFrame:
    """Worst fall from a peak inside the last n+1 prices.

    The series is cut into blocks of n+1 rows. Every frame is the tail of one block followed by the head of the
    next, so running extremes taken forward and backward inside the blocks give each frame in constant time.
    """
    size = n + 1
    row = _over((key,), order)
    head, tail = (_over((key, "_blk"), o, _GROWING) for o in (order, f"{order} DESC"))
    p = price
    return (
        df.selectExpr("*", f"row_number() {row} - 1 AS _pos")
        .selectExpr("*", f"_pos div {size} AS _blk")
        .selectExpr("*", f"max({p}) {head} AS _peak", f"min({p}) {head} AS _low")
        .selectExpr("*", f"min(try_divide({p}, _peak) - 1) {head} AS _head")
        .selectExpr("*", f"min({p}) {tail} AS _next_low", f"max({p}) {tail} AS _top")
        .selectExpr("*", f"min(try_divide(_next_low, {p}) - 1) {tail} AS _tail")
        .selectExpr("*", f"lag(_tail, {n}) {row} AS _old_tail", f"lag(_top, {n}) {row} AS _old_top")
        .selectExpr(*df.columns, f"""CASE WHEN _pos < {n} THEN NULL WHEN _pos - _blk * {size} = {n} THEN _head
            ELSE least(_head, _old_tail, try_divide(_low, _old_top) - 1) END AS {out}""")
    )
