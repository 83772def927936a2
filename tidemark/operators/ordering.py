"""Global numbering, ranks and exact quantiles for groups of any size.

Nothing here puts a whole group into one task: equal values are counted before the shuffle, ordered values are cut
into buckets, and only per-bucket totals are summed in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import pin
from tidemark.sources.tables import stored


BUCKETS = 128  # value buckets of a group, bounded by its own approximate quantiles
ACCURACY = 100_000  # the approximate ranks of a group are off by at most 1 / ACCURACY of it


def ranks_within(df: DataFrame, by: list[str], value: str, descending: bool) -> DataFrame:
    """For every distinct non-null (by, value): ``below`` rows ranked strictly before it, ``ties`` rows equal to it
    and ``total`` non-null rows of the group.

    Distinct values are cut at the group's own quantiles, so buckets hold about as many each however the values cluster,
    infinite ones included.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("_cuts"))
    bucket = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    counts = counts.join(cuts, by).withColumn("_bucket", bucket).drop("_cuts")
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    sizes = counts.groupBy(*by, "_bucket").agg(F.sum("ties").alias("_rows"))
    before = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *by, "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("total"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_inside", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
        .join(starts, [*by, "_bucket"])
        .select(*by, value, (F.col("_start") + F.col("_inside")).alias("below"), "ties", "total")
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group, one column per entry of ``probs``.

    The same two passes for every size. The first finds values that enclose each wanted rank, from a mergeable sketch with
    a wide margin. The second counts, with map-side combine, the rows below the enclosed stretch and the distinct values in
    it, about 1 / 10,000 of the group; a running count over those places the ranks. Values are only compared, so infinite
    ones are values like others. Should a sketch ever fall short of its promise, the query fails rather than answer wrong.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    named = [F.coalesce(F.to_json(F.struct(F.col(b).alias("v"))), F.lit("")).alias(k) for b, k in zip(by, keys)]
    rows = df.where(F.col(value).isNotNull()).select(*by, *named, F.lit(1).alias("_all"), F.col(value).cast("double").alias("_v"))
    keys = [*keys, "_all"]
    margin = 10 / accuracy
    near = [min(1.0, max(0.0, p + side * margin)) for p in probs.values() for side in (-1, 1)]
    groups = rows.groupBy(*keys).agg(
        *[F.first(b).alias(b) for b in by], F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", near, accuracy).alias("_near"))
    groups = stored(groups, "quantile-brackets")
    wide = F.col("_n") * margin < 2  # a margin of less than two rows: the ends enclose all of so few
    bracket = lambda i, p: F.struct(
        F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
        F.when(wide, F.col("_min")).otherwise(F.col("_min") if p <= margin else F.get("_near", F.lit(2 * i))).alias("lo"),
        F.when(wide, F.col("_max")).otherwise(F.col("_max") if p >= 1 - margin else F.get("_near", F.lit(2 * i + 1))).alias("hi"))
    brackets = groups.select(*keys, F.array(*[bracket(i, p) for i, p in enumerate(probs.values())]).alias("_b"))
    tried = rows.select(*keys, "_v").join(brackets, keys).select(*keys, "_v", F.explode("_b").alias("b")).where(F.col("_v") <= F.col("b.hi"))
    counted = tried.groupBy(*keys, F.col("b.i").alias("_i"), F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_x")).agg(
        F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*keys, "_i").orderBy(F.col("_x").asc_nulls_first())
    upto = counted.withColumn("_end", F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("_i") + 1)
    pos = prob * (F.col("_n") - 1)
    at = upto.join(groups.select(*keys, "_n"), keys).withColumn("_pos", pos)
    holds = lambda k: F.col("_x").isNotNull() & (F.col("_end") > k) & (F.col("_end") - F.col("_c") <= k)
    ends = at.groupBy(*keys, "_i", "_pos").agg(
        F.max(F.when(holds(F.floor("_pos")), F.col("_x"))).alias("_lo"), F.max(F.when(holds(F.ceil("_pos")), F.col("_x"))).alias("_hi"))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    placed = F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double")).when(
        (F.col("_lo") == F.col("_hi")) | (F.col("_pos") == F.floor("_pos")), F.col("_lo")).otherwise(between)
    found = ends.withColumn("_q", placed).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(probs)])
    return found.join(groups.select(*keys, *by), keys).select(*by, *probs)


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Number all rows 0, 1, .. in the given total order, through a range sort of the cluster.

    The sorted rows are pinned first: the numbers depend on where the range boundaries fell.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = pin(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), local.alias("_at")))
    # One row per sort partition.
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    starts = parts.select("_part", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_start"))
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )


def rolling_mean_over_all(df: DataFrame, value: str, order: list[str], n: int, out: str, block: int = 65536) -> DataFrame:
    """Mean of the last n rows of the whole table in the given order, from the first row on.

    Rows are cut into blocks of consecutive numbers; the last n-1 rows of a block are copied to the next block.
    """
    block = max(block, n)
    rows = numbered(df, order, "_n")
    home = F.floor(F.col("_n") / block)
    near_end = F.col("_n") - home * block >= block - (n - 1)
    spread = rows.withColumn("_home", home).withColumn(
        "_blk", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    frame = Window.partitionBy("_blk").orderBy("_n").rowsBetween(-(n - 1), 0)
    return spread.withColumn(out, F.avg(value).over(frame)).where(F.col("_blk") == F.col("_home")).drop("_n", "_home", "_blk")
