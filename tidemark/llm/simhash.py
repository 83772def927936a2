"""SimHash near-duplicates, with candidates filtered by chains on a ring of segments."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, add_columns, pick
from tidemark.llm.components import components
from tidemark.sources.tables import stored

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BUCKET = 64  # fingerprints of a bucket that are compared with each other; larger buckets go another exact way


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, as a signed number. bytes.split() parts at exactly [\\x20\\x09-\\x0D]."""
    words = text.encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    octets = h.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS for j in range(8)])
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, fp) of every row; a null text has no words and fingerprint 0."""
    rows = pick(docs, "doc_id", "text", *[c for c in carry if c != "text"])
    return add_columns(rows, "fp long", lambda: lambda text: (fingerprint(text, shingle, seed),), keep_text="text" in carry)


def _turned(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def chain_bits(distance: int, segments: int) -> int:
    """Bits that the strict part of a chain spans.

    If two fingerprints differ in at most ``distance`` bits, some chain of consecutive segments on the ring has, for every
    length l, at most l * distance / segments differences in its first l segments; below l = segments / distance that is none.
    """
    return 64 // segments * (-(-segments // distance) - 1)


def _chain_holds(a: Column, b: Column, segment: int, distance: int, segments: int) -> Column:
    """The differences from ``segment`` on stay within the proportional budget at every length."""
    width = 64 // segments
    diff = _turned(a.bitwiseXOR(b), segment * width)
    ok = F.bit_count(diff) <= distance
    for length in range(1, segments):
        ok = ok & (F.bit_count(F.shiftrightunsigned(diff, 64 - width * length)) <= length * distance // segments)
    return ok


def links(prints: DataFrame, distance: int = 2, segments: int = 8) -> DataFrame:
    """(u, v): links that connect distinct fingerprints (fp) exactly as all pairs within ``distance`` would.

    Buckets are the strict part of each chain. In a bucket of up to ``BUCKET`` fingerprints, pairs are checked along the
    chain, then by Hamming distance. Fingerprints of larger buckets are linked through what they have in common: two are
    within 2 bits if and only if flipping at most one bit of each gives the same number. Those flips lead to at most 65
    fingerprints each, the smallest of which stands for the rest, so no bucket is ever expanded into its pairs.
    """
    if distance != 2 or 64 % segments:
        raise ValueError("links are worked out for a distance of 2 and segments that divide 64")
    width, strict = 64 // segments, chain_bits(distance, segments)
    chains = F.array(*[
        F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(_turned(F.col("fp"), i * width), 64 - strict).alias("bits"))
        for i in range(segments)])
    keyed = prints.select("fp", F.explode(chains).alias("k")).select("fp", "k.segment", "k.bits")
    sized = stored(keyed.groupBy("segment", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = stored(keyed.join(sized, ["segment", "bits"]), "bucket-members")
    few = shared.where(F.col("n") <= BUCKET)
    pair = few.select("segment", "bits", F.col("fp").alias("u")).join(few.select("segment", "bits", F.col("fp").alias("v")), ["segment", "bits"])
    held = F.lit(False)
    for i in range(segments):
        held = held | ((F.col("segment") == i) & _chain_holds(F.col("u"), F.col("v"), i, distance, segments))
    near = pair.where((F.col("u") > F.col("v")) & held).select("u", "v")
    many = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(64)])
    met = many.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("mid"))
    lowest = met.groupBy("mid").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    through = met.join(lowest, "mid").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    return near.unionAll(through)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int = 8, seed: int = 42,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, fp, component_id, keep): every row, with the smallest doc_id reachable over links.

    Rows of equal fingerprint form one class, so copies are never paired. Rows without words have fingerprint 0 and are
    linked like any other. Null ids are in a class but never name it; a class of null ids only has a null component_id.
    ``keep`` is true for one row of each component: one with its smallest id.
    """
    numbered = fingerprints(docs, shingle, seed, carry).withColumn("row", F.monotonically_increasing_id())
    rows = stored(numbered, "fingerprints")  # written, so the row numbers hold
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    classes = stored(rows.groupBy("fp").agg(least), "classes")
    roots = components(links(classes.select("fp"), distance, segments))
    named = classes.join(roots, classes["fp"] == roots["id"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    component = named.groupBy("root").agg(F.min("least").alias("first"))
    by_print = named.join(component, "root").select("fp", "first")
    return rows.join(by_print, "fp").select(
        "doc_id", *carry, "fp", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("keep"))
