"""Personal data: labelers vote on candidate spans, EM weighs the labelers, a span classifier learns from the result."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, join_rows
from tidemark.sources.tables import stored

LOCAL = "[A-Za-z0-9._%+-]"

# Where a run may begin: not inside a run of its own characters, except right after the last match. It saves trying every
# character of a long run; possessive repeats save the regex engine's stack. The matches are those of the plain patterns.
RULES = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "written_email": rf"{LOCAL}{{1,64}} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{{1,63}})++",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(RULES)
NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "written_email": r"[(\[](?:at|AT)[)\]]",
         "local_phone": "[0-9][ .-][0-9]", "ssn": "[0-9]-[0-9]", "iban": "[A-Z][A-Z][0-9][0-9]"}

# Gazetteers and context words (fixed values).
TLDS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co", "us", "it", "nl", "ch", "at"]
IBAN_COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
CALLING_CODE = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69]\d|3[578]\d|42\d|5[09]\d|6[789]\d|8[58]\d|9[679]\d)"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
FOR = r"(?i)(?:\b(?:e-?mail|mail|contact|call|tel|phone|telefon|móvil|fax|mobile|card|visa|iban|account|ip|host|server|ssn)\b)"
AGAINST = r"(?i)(?:\b(?:version|isbn|issn|order|invoice|page|section|build|release|part|serial)\b)"
LABELERS = ("shape", "gazetteer", "context", "edge")
FEATURES = ("length", "digits", "separators", "before", "after")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
    fold = lambda v: F.when(v > 9, v - 9).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + fold(value(i))) % 10 == 0


def _octets(m: Column) -> Column:
    bare = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3)
                    & (F.coalesce(F.nullif(bare(p), F.lit("")), F.lit("0")).try_cast("int") <= 255))


def _mod97(m: Column) -> Column:
    bare = F.translate(m, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    number = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda s, c: F.when(number(c) > 9, s * 100 + number(c)).otherwise(s * 10 + number(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _shape() -> Column:
    m, digits = F.col("m"), F.length(_digits(F.col("m")))
    return (
        F.when(_is("ip"), _octets(m))
        .when(_is("card"), digits.between(14, 19) & _luhn(_digits(m)))
        .when(_is("phone"), digits.between(10, 15))
        .when(_is("local_phone"), digits.between(9, 12))
        .when(_is("ssn"), ~m.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(_is("iban"), _mod97(m))
        .otherwise(F.lit(True))
    )


def _gazetteer() -> Column:
    m = F.col("m")
    return (
        F.when(F.col("kind").isin("email", "written_email"), F.lower(F.regexp_extract(F.right(m, F.lit(40)), r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1)).isin(TLDS))
        .when(_is("ip"), ~m.rlike(r"^0*(?:0|22[4-9]|2[3-5]\d)\."))
        .when(_is("card"), m.rlike(CARD_PREFIX))
        .when(_is("phone"), m.rlike(CALLING_CODE))
        .when(_is("local_phone"), ~_digits(m).rlike("^[01]"))
        .when(_is("iban"), F.substring(m, 1, 2).isin(IBAN_COUNTRIES))
        .otherwise(F.lit(True))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, kind, start, stop, votes, features, base): matches of all patterns with their places in code points.

    Matches and the gaps between them are cut out by the same pattern; running sums of their lengths over the matches of a
    document give the places. Numbers too short or too long to be anything are left out after that.
    """
    texts = documents(docs).where(F.col("text").rlike("[@0-9(\\[]"))
    for kind, rule in RULES.items():
        has = F.col("text").rlike(NEEDS[kind])
        texts = texts.withColumn(f"m_{kind}", F.when(has, F.regexp_extract_all("text", F.lit(rule), F.lit(0))))
    cut = texts
    for kind, rule in RULES.items():
        cut = cut.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", rule, -1)))

    def rows(kind: str) -> Column:
        gap = lambda i: F.get(F.col(f"g_{kind}"), i)
        return F.coalesce(F.transform(f"m_{kind}", lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(gap(i)).alias("gap"), m.alias("m"),
            F.right(gap(i), F.lit(24)).alias("left"), F.left(gap(i + 1), F.lit(2)).alias("right"))), F.array())

    found = cut.select("doc_id", "tk", F.explode(F.concat(*map(rows, KINDS))).alias("c")).select("doc_id", "tk", "c.*")
    # One exchange by document serves the removal of repeated rows and the running sums.
    once = found.repartition("doc_id", "tk").dropDuplicates(["doc_id", "tk", "kind", "i"])
    upto = Window.partitionBy("doc_id", "tk", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("m")).over(upto)
    placed = once.withColumn("stop", stop.cast("bigint")).withColumn("start", F.col("stop") - F.length("m"))
    n = F.length(_digits(F.col("m")))
    placed = placed.where(~_is("card") | n.between(12, 22))
    shape = _shape()
    vote = lambda c: F.when(c, 1).otherwise(0)
    edge = ~F.col("left").rlike("[A-Za-z0-9]$") & ~F.col("right").rlike("^[A-Za-z0-9]")
    context = F.when(F.col("left").rlike(AGAINST), 0).when(F.col("left").rlike(FOR), 1).otherwise(2)
    side = lambda c: F.when(c == "", "none").when(c.rlike("^[ \t-\r]$"), "space").when(c.rlike("^[A-Za-z0-9]$"), "word").otherwise("mark")
    return placed.select(
        "doc_id", "tk", "kind", "start", "stop",
        F.struct(vote(shape).alias("shape"), vote(_gazetteer()).alias("gazetteer"), context.alias("context"), vote(edge).alias("edge")).alias("votes"),
        F.struct(F.least(F.length("m") / 4, F.lit(12)).cast("int").cast("string").alias("length"),
                 F.least(n / 2, F.lit(12)).cast("int").cast("string").alias("digits"),
                 F.size(F.array_distinct(F.split(F.regexp_replace("m", "[A-Za-z0-9]", ""), ""))).cast("string").alias("separators"),
                 side(F.right(F.col("left"), F.lit(1))).alias("before"), side(F.left(F.col("right"), F.lit(1))).alias("after")).alias("features"),
        (F.col("kind").isin(*BASE) & shape).alias("base"))


@dataclass
class SpanModel:
    reliability: dict[str, dict[tuple[int, int], float]]  # labeler -> (vote, truth) -> probability
    prior: dict[str, float]  # kind -> log odds
    weight: dict[str, float]  # "kind feature value" -> log odds

    def score(self) -> Column:
        """Log odds that a candidate is personal data."""
        known = F.create_map(*[F.lit(x) for kv in self.weight.items() for x in kv]) if self.weight else None
        total = F.coalesce(F.create_map(*[F.lit(x) for kv in self.prior.items() for x in kv])[F.col("kind")], F.lit(0.0))
        for f in FEATURES if known is not None else ():
            total = total + F.coalesce(known[F.concat_ws(" ", "kind", F.lit(f), f"features.{f}")], F.lit(0.0))
        return total


def fit(found: DataFrame, rounds: int = 25) -> SpanModel:
    """Count the vote and feature patterns of all candidates, then run EM and train the classifier on those counts.

    A pattern is a kind, four votes and five features of a few values each, so the table of counts has a bound that does
    not depend on the data. The truth of a pattern starts at its majority vote.
    """
    counted = found.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted([(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in counted])
    truth = [min(0.95, max(0.05, sum(v == 1 for v in votes) / max(1, sum(v != 2 for v in votes)))) for _, votes, _, _ in rows]
    reliability: dict[str, dict[tuple[int, int], float]] = {}
    prior: dict[str, float] = {}
    for _ in range(rounds):
        mass = {k: [1.0, 1.0] for k in KINDS}
        table = {j: {(v, y): 1.0 for v in (0, 1, 2) for y in (0, 1)} for j in LABELERS}
        for (kind, votes, _, n), p in zip(rows, truth):
            for y, share in ((1, p), (0, 1 - p)):
                mass[kind][y] += n * share
                for j, v in zip(LABELERS, votes):
                    table[j][v, y] += n * share
        for j, cells in table.items():
            total = {y: sum(cells[v, y] for v in (0, 1, 2)) for y in (0, 1)}
            reliability[j] = {(v, y): c / total[y] for (v, y), c in cells.items()}
        prior = {k: math.log(m[1] / m[0]) for k, m in mass.items()}
        truth = [1 / (1 + math.exp(-max(-30.0, min(30.0, prior[kind] + sum(
            math.log(reliability[j][v, 1] / reliability[j][v, 0]) for j, v in zip(LABELERS, votes)))))) for kind, votes, _, _ in rows]
    held = {k: [1.0, 1.0] for k in KINDS}
    cells: dict[str, list[float]] = {}
    for (kind, _, features, n), p in zip(rows, truth):
        for y, share in ((1, p), (0, 1 - p)):
            held[kind][y] += n * share
            for f, x in zip(FEATURES, features):
                cells.setdefault(f"{kind} {f} {x}", [1.0, 1.0])[y] += n * share
    weight = {key: math.log(c[1] / held[key.split(" ")[0]][1]) - math.log(c[0] / held[key.split(" ")[0]][0]) for key, c in sorted(cells.items())}
    return SpanModel(reliability, {k: math.log(m[1] / m[0]) for k, m in held.items()}, weight)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every row of ``docs`` with its spans (start, rank, kind, stop, base, score), in order.

    Base spans (email, ip, card, phone that pass their checks) always stay. Other candidates stay if the classifier gives
    at least even odds and they overlap no base span and no earlier one. Null text is empty; rows without spans have an
    empty list; repeated rows get equal results.
    """
    found = stored(candidates(docs), "candidates")
    model = fit(found)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    likely = found.withColumn("score", model.score()).where(F.col("base") | ((F.col("score") >= 0) & (F.col("votes.shape") == 1)))
    order = Window.partitionBy("doc_id", "tk").orderBy("start", "stop", "kind")
    before = F.max(F.when(F.col("base"), F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    earlier = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    alone = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after >= F.col("stop"), F.lit(True))) \
        & (F.coalesce(earlier, F.lit(0)) <= F.col("start"))
    kept = likely.withColumn("alone", alone).where(F.col("base") | F.col("alone"))
    spans = kept.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_list(
        F.struct("start", rank.alias("rank"), "kind", "stop", "base", "score"))).alias("spans"))
    return join_rows(documents(docs).select("doc_id", "tk"), spans).select(
        "doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
