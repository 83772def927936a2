"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidemark.llm.common import pick
from tidemark.sources.tables import stored

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0  # a target is at most so many times its source's size, and a document is taken at most so often
BLOCK_DOCS = 2_000  # documents whose rounding is carried on together


def _key() -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def sizes(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, source, carried columns, size): words of every row; null text has none."""
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = pick(docs, "doc_id", "text", "source", *[c for c in carry if c not in ("doc_id", "text", "source")])
    return rows.withColumn("size", count.cast("bigint"))


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, docs, source_size, target): the shares of all words by weight, none above ``cap`` times its source.

    Resharing the excess by weight ends at target = min(cap * size, level * weight) with one level for all; the level rises
    from round to round until no source passes its cap. A source without words has target 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = stored(by_source.withColumn("weight", weight), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.lit(cap) * F.col("source_size") <= F.lit(level) * F.col("weight")
        free, fixed = table.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, cap * F.col("source_size")))).first()
        new = (total - (fixed or 0.0)) / free if free else level
        if not free or new <= level:
            break
        level = new
    return table.withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.lit(level) * F.col("weight"))).drop("weight")


def rates(by_size: DataFrame, goals: DataFrame, rounds: int = 40, tolerance: float = 1e-8) -> DataFrame:
    """(source, a, b): a document of size s in a source of mean size m is taken exp(a + b * (s / m - 1)) times.

    Among all rates these stay closest to 1 in relative entropy while each source's words come to its target and its
    documents to the same share, which keeps long and short documents in proportion. (a, b) solve the convex dual by Newton
    steps; a step is one aggregation of the (source, size, n) table into three sums a source. Steps are halved in length
    where they would leave (-4, 4), so that no exponential runs away. Size deviations of a whole source sum to 0, so the
    solution is b = 0 and a = log(target / source_size): one plain rate a source.
    """
    live = goals.where((F.col("target") > 0) & (F.col("source_size") > 0)).withColumn("key", _key())
    ratio, mean = F.col("target") / F.col("source_size"), F.col("source_size") / F.col("docs")
    state = stored(live.select("key", ratio.alias("ratio"), mean.alias("mean"), "docs", F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), "mix-tilt")
    table = by_size.withColumn("key", _key()).drop("source")
    for _ in range(rounds):
        z = F.col("size") / F.col("mean") - 1
        w = F.col("n") * F.exp(F.col("a") + F.col("b") * z)
        sums = table.join(state, "key").groupBy("key").agg(
            F.sum(w).alias("s0"), F.sum(w * z).alias("s1"), F.sum(w * z * z).alias("s2"))
        # Gradient (s0 - ratio * docs, s1 - 0): the size deviations of a whole source sum to 0.
        g0, det = F.col("s0") - F.col("ratio") * F.col("docs"), F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        flat = det <= 1e-12 * F.col("s0") * F.col("s0")
        da = F.when(flat, g0 / F.col("s0")).otherwise((F.col("s2") * g0 - F.col("s1") * F.col("s1")) / det)
        db = F.when(flat, F.lit(0.0)).otherwise((F.col("s0") * F.col("s1") - F.col("s1") * g0) / det)
        short = F.greatest(F.lit(1.0), F.abs(da) / 4, F.abs(db) / 4)
        state = stored(state.join(sums, "key").select(
            "key", "ratio", "mean", "docs", (F.col("a") - da / short).alias("a"), (F.col("b") - db / short).alias("b"),
            (F.abs(g0) / (F.col("ratio") * F.col("docs"))).alias("off")), "mix-tilt")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < tolerance:
            break
    return state.select("key", "a", "b", "mean")


def _round_block(rows: pa.Table) -> pa.Table:
    """Copies of each document of a block, large ones first; words owed or overdrawn are carried to the next document."""
    rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
    owed, copies = 0.0, []
    for size, rate, cap in zip(rows["size"].to_pylist(), rows["rate"].to_pylist(), rows["cap"].to_pylist()):
        want = rate * size + owed
        n = min(cap, max(0, int(want / size + 0.5))) if size else int(rate + 0.5)
        owed = want - n * size
        copies.append(n)
    return rows.append_column("copies", pa.array(copies, pa.int32()))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, carried columns, size, source_size, target, rate, copies, taken) for every row of ``docs``.

    ``copies`` is 0 to ``cap``; ``taken`` is copies * size. Rates are rounded within blocks of one source, at most about
    ``BLOCK_DOCS`` documents chosen by hash, and what rounding owes is carried from long documents to short ones, so a
    block misses its words by less than half of one of its last documents. Null source is a source, ranked last; a null id
    sorts last in its block; rows of equal id and text share a block. Documents without words have size 0 and taken 0.
    """
    rows = sizes(docs, carry).withColumn("text_hash", F.xxhash64("text")).drop("text").withColumn("key", _key())
    rows = stored(rows, "mix-sizes")
    by_size = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    by_source = by_size.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(by_source, weights, cap)
    # Written, so that its size is known when the join is planned: a source with a third of all rows need not be shuffled.
    tilt = stored(goals.withColumn("key", _key()).drop("source").join(rates(by_size, goals), "key", "left"), "mix-rates")
    # Six digits: what the order of floating sums changes must not change a copy.
    rate = F.round(F.exp(F.col("a") + F.col("b") * (F.col("size") / F.col("mean") - 1)), 6)
    block = F.pmod(F.xxhash64("doc_id", "text_hash"), F.ceil(F.col("docs") / BLOCK_DOCS))
    rated = rows.join(tilt, "key").select(
        *rows.columns, "source_size", "target", F.least(F.coalesce(rate, F.lit(0.0)), F.lit(cap)).alias("rate"), block.alias("block"),
        F.lit(int(cap)).alias("cap"))
    schema = rated.select(*[c for c in rated.columns if c not in ("key", "block", "cap", "text_hash")]).schema.add("copies", IntegerType())
    out = rated.groupBy("key", "block").applyInArrow(lambda rows: _round_block(rows).select(schema.names), schema)
    return out.withColumn("taken", F.col("copies") * F.col("size"))
