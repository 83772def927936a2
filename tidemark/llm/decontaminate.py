"""Benchmark decontamination through a positional index of the rarest benchmark terms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, documents, join_rows, pick
from tidemark.sources.tables import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # all that is not [^\x00-\x2F\x3A-\x60\x7B-\x7F]
PIECE = 32  # words of a text that are indexed together
FILTER_BITS = 1 << 20  # fixed size of the term filter that every task holds: 128 KB


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FILTER_BITS))


def term_filter(terms: DataFrame) -> Column:
    """Array of ``FILTER_BITS`` bits in longs with the bit of every term set; its size does not depend on the terms."""
    slots = terms.select(_slot(F.col("word")).alias("s")).groupBy(F.expr("s div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    bits = [0] * (FILTER_BITS // 64)
    for row in slots.collect():
        bits[row["at"]] = row["bits"]
    return F.from_json(F.lit(json.dumps(bits)), "array<bigint>")


def _passes(bits: Column, word: Column) -> Column:
    slot = _slot(word)
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1


def items(benchmark: DataFrame) -> DataFrame:
    """(item, words): items that have words. A null item_id counts as the item named by the empty string."""
    named = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return pick(benchmark, "item_id", "text").select(named, words(F.coalesce("text", F.lit(""))).alias("words")).where(
        F.size("words") > 0)


def anchors(found: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(word, item, width, around): the item places that are the rarest of some window, with the words around each.

    Of equally frequent words in a window the first in order of the word, then of the place, is taken.
    """
    places = found.select("item", "words", F.xxhash64("words").alias("ik"), F.posexplode("words").alias("p", "word"))
    known = places.join(counts, "word", "left").groupBy("item", "ik").agg(
        F.first("words").alias("words"),
        F.array_sort(F.collect_set(F.struct("p", F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("at"))
    width = F.least(F.size("words"), F.lit(window))
    ranked = F.transform("at", lambda x: F.struct(x["n"], x["word"], x["p"]))
    best = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1),
                       lambda s: F.array_min(F.slice(F.col("ranked"), s, F.col("width"))))
    rarest = known.withColumn("width", width).withColumn("ranked", ranked).select(
        "item", "width", "words", F.explode(F.array_distinct(best)).alias("a"))
    return rarest.select(F.col("a.word").alias("word"), "item", "width",
                         _around(F.col("words"), F.col("a.p"), window).alias("around"))


def _around(all_words: Column, p: Column, window: int) -> Column:
    """The 2 * window - 1 words centred at p; null beyond either end."""
    return F.transform(F.sequence(p - (window - 1), p + (window - 1)), lambda j: F.get(all_words, j))


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, tk, piece): texts in pieces of ``PIECE`` words with the words beside them, so that a posting carries the
    neighbourhood of its word and never a whole text."""
    start = F.sequence(F.lit(0), F.size("words") - 1, F.lit(PIECE))
    cut = lambda at: F.struct(
        at.alias("at"), F.least(at, F.lit(window - 1)).alias("lead"),
        F.slice(F.col("words"), at - F.least(at, F.lit(window - 1)) + 1, F.least(at, F.lit(window - 1)) + (PIECE + window - 1)).alias("words"))
    return texts.where(F.size("words") > 0).select("doc_id", "tk", F.explode(F.transform(start, cut)).alias("piece"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, near: int = 8) -> DataFrame:
    """(doc_id, tk, item, kind, start, stop): where items occur in documents, by word position, ends included.

    Postings are kept for anchors only: the rarest term (by its count over all documents) of each window. A posting and
    an anchor place fix an alignment; the words beside it are compared outwards. A run of at least the window's width is a
    ``phrase``; at least ``near`` equal words around the anchor without such a run are a ``near`` match.
    """
    found = items(benchmark)
    texts = documents(docs).select("doc_id", "tk", words(F.col("text")).alias("words"))
    bench_terms = found.select(F.explode("words").alias("word")).distinct()
    counts = texts.select(F.explode("words").alias("word")).where(_passes(term_filter(bench_terms), F.col("word"))) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    wanted = stored(anchors(found, counts, window), "anchors")
    piece = F.col("piece")
    postings = (
        _pieces(texts, window)
        .select("doc_id", "tk", "piece", F.posexplode("piece.words").alias("i", "word"))
        .where((F.col("i") >= piece["lead"]) & (F.col("i") < piece["lead"] + PIECE) & _passes(term_filter(wanted), F.col("word")))
        .select("doc_id", "tk", (piece["at"] - piece["lead"] + F.col("i")).alias("pos"), "word",
                _around(piece["words"], F.col("i"), window).alias("beside"))
    )
    same = F.zip_with("beside", "around", lambda a, b: F.coalesce(a == b, F.lit(False)))
    run = lambda side: F.coalesce(F.nullif(F.array_position(side, False), F.lit(0)), F.lit(window)) - 1
    aligned = (
        postings.join(wanted, "word").select("doc_id", "tk", "item", "width", "pos", same.alias("same"))
        .select("doc_id", "tk", "item", "width", "pos", "same",
                run(F.reverse(F.slice("same", 1, window - 1))).alias("left"),
                run(F.slice("same", window + 1, window - 1)).alias("right"))
    )
    equal = F.size(F.filter("same", lambda x: x))
    kind = F.when(F.col("left") + F.col("right") + 1 >= F.col("width"), "phrase").when(equal >= near, "near")
    return aligned.select(
        "doc_id", "tk", "item", kind.alias("kind"), (F.col("pos") - F.col("left")).alias("start"),
        (F.col("pos") + F.col("right")).alias("stop")).where(F.col("kind").isNotNull())


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, near: int = 8,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, n_words, n_hit, n_near, items): every row of ``docs``.

    A window is ``window`` consecutive item words; an item of fewer words is one window; null or empty texts have no
    words. ``n_hit`` counts document words inside phrase matches, ``items`` lists their items in order; ``n_near`` counts
    near matches. Repeated rows get equal results; an empty benchmark hits nothing.
    """
    found = stored(matches(docs, benchmark, window, near), "matches")
    phrases = found.where("kind = 'phrase'")
    # Hit words as bits of blocks of 64 words: overlapping matches merge in the aggregation.
    blocks = phrases.select("doc_id", "tk", F.explode(F.sequence("start", "stop")).alias("at")).groupBy(
        "doc_id", "tk", F.expr("at div 64").alias("block")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    hit = blocks.groupBy("doc_id", "tk").agg(F.sum(F.bit_count("bits")).alias("n_hit"))
    named = found.groupBy("doc_id", "tk").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "phrase", F.col("item")))).alias("items"),
        F.count_if(F.col("kind") == "near").alias("n_near"))
    summary = stored(join_rows(named, hit), "contaminated")
    rows = documents(docs, *carry).select("doc_id", "tk", *carry, F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    return join_rows(rows, summary).select(
        "doc_id", *carry, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
