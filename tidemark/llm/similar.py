"""Near-duplicates by exact Jaccard similarity of word shingles: candidates from SimHash, then what prefixes of the ordered shingles add."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns, pick
from tidemark.llm.components import components
from tidemark.llm.simhash import FOLD, fingerprint, links
from tidemark.sources.tables import stored

SAMPLED = 4  # one shingle in so many (by hash, a power of two) is counted everywhere
COMMON = 64  # shingles known to stand in more rows than this come last in the order
ORDERED = 500_000  # common shingles that tasks hold; any order of the shingles gives the same result
BITS, MOST_BITS = 16, 1 << 27  # bits of the filter per repeated shingle, and at most; a full one spares less, loses nothing
LEADERS = 3  # rounds in which members of a bucket meet one of them only
LANES = 16  # words of 64 bits in the map that bounds how much two texts share


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; a text of fewer words is one shingle. Words as in ``simhash``."""
    words = text.encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    wide = min(shingle, len(words))
    n = len(words) - wide + 1
    out = np.full(n, wide, np.uint64)
    for i in range(wide):
        out ^= h[i:i + n]
        for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            out ^= out >> np.uint64(by)
            out *= np.uint64(factor)
        out ^= out >> np.uint64(31)
    return np.unique(out)


class Order:
    """One order of all shingles: those known to be in one row only, those not counted, repeated ones, common ones.

    Similar texts share a shingle of their prefixes under any order; the rarer those are, the fewer dissimilar texts meet.
    """

    def __init__(self, common: np.ndarray, repeated: np.ndarray):
        by_hash = np.argsort(common)  # given rarest first
        self.common, self.rank = common[by_hash], by_hash
        self.repeated, self.shift = repeated, np.uint64(64 - (len(repeated) * 64 - 1).bit_length())

    def prefix(self, h: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the first shingles of a text in this order, without those that no other row has.

        There are so many that another text which shares ``least`` of this one's shingles has one of them.
        """
        counted = h & np.uint64(SAMPLED - 1) == 0
        bit = h >> self.shift
        again = (self.repeated[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        late = np.where(counted, np.where(again, 2, 0), 1)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            late = np.where(self.common[at] == h, 3 + self.rank[at], late)
        first = np.argsort(late, kind="stable")[:len(h) - -(-len(h) * least.numerator // least.denominator) + 1]
        place = np.flatnonzero(late[first] > 0)
        return place, h[first[place]]


def bit_map(h: np.ndarray) -> np.ndarray:
    """Which of 1,024 values the top bits of the hashes take."""
    bits = np.zeros(64 * LANES, np.uint8)
    bits[(h >> np.uint64(64 - (64 * LANES - 1).bit_length())).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _order(texts: DataFrame, shingle: int) -> Order:
    """The order of the shingles of all rows, from two bounded parts: a bitmap of repeated ones and a list of common ones.

    A fixed share of the shingles is counted in all rows; of the others only what repeats within a batch is added up, which
    finds the very common ones. Both only make the order better.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, m = np.unique(np.concatenate(held), return_counts=True)
            some = (h & np.uint64(SAMPLED - 1) == 0) | (m > 1)
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(m[some], pa.int64())], ["h", "m"])

        for batch in batches:
            for text in batch.column("text"):
                held.append(shingle_hashes(text.as_py() or "", shingle))
                size += len(held[-1])
                if size > 2_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = texts.select("text").mapInArrow(work, "h long, m long").groupBy("h").agg(F.sum("m").alias("m")).where("m > 1")
    counts = stored(counts, "repeated-shingles")
    often = counts.where(F.col("m") > COMMON).orderBy(F.desc("m"), "h").limit(ORDERED).orderBy("m", "h").toArrow()
    common = often.column("h").to_numpy().view(np.uint64)
    size = 64
    again = counts.where(F.col("h").bitwiseAND(F.lit(SAMPLED - 1)) == 0)
    while size < min(MOST_BITS, BITS * again.count()):
        size *= 2
    bit = F.shiftrightunsigned("h", 64 - (size - 1).bit_length())
    lanes = again.groupBy(F.shiftright(bit, 6).alias("lane")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("bits")).toArrow()
    repeated = np.zeros(size // 64, np.int64)
    repeated[lanes.column("lane").to_numpy()] = lanes.column("bits").to_numpy()
    return Order(common, repeated.view(np.uint64))


def _prints(texts: DataFrame, shingle: int, least: Fraction, order: Order) -> DataFrame:
    """(row, n, at, h, bits): number of shingles, places and hashes of the prefix, and the map."""
    def start():
        def one(text: str) -> tuple:
            h = shingle_hashes(text, shingle)
            place, prefix = order.prefix(h, least)
            return len(h), place, prefix.view(np.int64), bit_map(h)

        return one

    return add_columns(texts, "n long, at array<int>, h array<long>, bits array<long>", start)


def _may_hold(n: Column, i: Column, m: Column, j: Column, least: Fraction) -> Column:
    """Texts of n and m shingles whose first common one has place i and j can still have the similarity."""
    return F.least(n - i, m - j) * (least.numerator + least.denominator) >= (n + m) * least.numerator


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs (u, v, lu, lv) of rows whose texts have the similarity."""
    both = pairs.join(texts.select(F.col("row").alias("u"), F.col("text").alias("a")), "u").join(
        texts.select(F.col("row").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "lu", "lv", "a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def hashes(row: int, text: str | None) -> np.ndarray:
            if row not in known:
                if len(known) >= 128:  # a cache only
                    known.clear()
                known[row] = shingle_hashes(text or "", shingle)
            return known[row]

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                keep = []
                for u, v, _, _, x, y in zip(*(c.to_pylist() for c in b.columns)):
                    p, q = hashes(u, x), hashes(v, y)
                    meet = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(meet * least.denominator >= (len(p) + len(q) - meet) * least.numerator)
                yield b.select(["u", "v", "lu", "lv"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(work, "u long, v long, lu long, lv long")


def _bounded(pairs: DataFrame, prints: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (u, v, lu, lv) whose maps still allow the similarity: a bit that one map has alone is a shingle it has alone."""
    side = lambda r, n, bits: prints.select(F.col("row").alias(r), F.col("n").alias(n), F.col("bits").alias(bits))
    return pairs.join(side("u", "nu", "bu"), "u").join(side("v", "nv", "bv"), "v").where(
        _maps_allow(F.col("nu"), F.col("bu"), F.col("nv"), F.col("bv"), least)).select("u", "v", "lu", "lv")


def _maps_allow(n: Column, a: Column, m: Column, b: Column, least: Fraction) -> Column:
    alone = lambda x, y: sum((F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in range(LANES)), F.lit(0))
    return F.least(n - alone(a, b), m - alone(b, a)) * (least.numerator + least.denominator) >= (n + m) * least.numerator


def _near_prints(classes: DataFrame) -> DataFrame:
    """(u, v): rows of ``classes`` that SimHash links. The first row of each fingerprint meets its other rows and those of linked ones."""
    heads = stored(classes.groupBy("fp").agg(F.min("row").alias("head")), "heads")
    within = classes.join(heads, "fp").where("row <> head").select(F.col("row").alias("u"), F.col("head").alias("v"))
    side = lambda fp, head: heads.select(F.col("fp").alias(fp), F.col("head").alias(head))
    across = links(heads.select("fp")).join(side("u", "hu"), "u").join(side("v", "hv"), "v")
    return within.unionAll(across.select(F.col("hu").alias("u"), F.col("hv").alias("v")))


def _links(texts: DataFrame, classes: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """(id, root) of the rows of ``classes`` that have a similar text: components exactly as all similar pairs give them.

    Pairs that SimHash links are compared first and merge labels; similar texts whose fingerprints lie further apart are found
    by prefixes. Rows that share a shingle of their prefixes form a bucket, which is never gathered: its least and greatest label and one
    leader are aggregates that join back. Members first meet the leader, another one each round; buckets of one label are
    done. Pairs are bounded by number of shingles, place and map before any text is read. In what stays apart after the last
    round, pairs that these bounds allow are compared.
    """
    order = _order(texts, shingle)
    prints = stored(_prints(texts, shingle, least, order).join(classes.select("row"), "row", "left_semi"), "prints")
    prefixes = prints.select("row", "n", F.explode(F.arrays_zip("at", "h")).alias("p")).select("row", "n", F.col("p.at").alias("pos"), F.col("p.h").alias("h"))
    shared = prefixes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
    now = stored(prefixes.join(shared, "h").withColumn("label", F.col("row")), "bucket-members")
    roots = now.select(F.col("row").alias("id"), F.col("label").alias("root")).distinct()

    def merged(pairs: DataFrame) -> DataFrame | None:
        """(id, root) of labels that pairs of similar texts connect, if there are any."""
        asked = stored(_bounded(pairs.distinct(), prints, least), "asked")
        if asked.isEmpty():
            return None
        rows = asked.select(F.explode(F.array("u", "v")).alias("row")).distinct()
        found = _verified(asked, stored(texts.join(rows, "row", "left_semi"), "asked-texts", "zstd"), shingle, least)
        return components(found.select(F.col("lu").alias("u"), F.col("lv").alias("v")))

    def named(df: DataFrame, label: str, moved: DataFrame) -> DataFrame:
        to = moved.select(F.col("id").alias("_from"), F.col("root").alias("_to"))
        return df.join(to, df[label] == F.col("_from"), "left").withColumn(label, F.coalesce("_to", label)).drop("_from", "_to")

    near = _near_prints(classes)
    moved = merged(near.select("u", "v", F.col("u").alias("lu"), F.col("v").alias("lv")))
    if moved is not None:
        moved = stored(moved, "moved")
        now, roots = stored(named(now, "label", moved), "apart"), stored(named(roots, "root", moved), "roots")
    for turn in range(LEADERS + 1):
        lead = F.min(F.struct(F.xxhash64(F.lit(turn), F.col("row")).alias("key"), "row", "n", "pos", "label")).alias("f")
        heads = now.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), lead).where("lo < hi")
        alive = stored(now.join(heads.select("h", "f"), "h"), "apart")
        if alive.isEmpty():
            break
        if turn < LEADERS:
            pairs = alive.where((F.col("label") != F.col("f.label")) & _may_hold(F.col("n"), F.col("pos"), F.col("f.n"), F.col("f.pos"), least)).select(
                F.col("row").alias("u"), F.col("f.row").alias("v"), F.col("label").alias("lu"), F.col("f.label").alias("lv"))
        else:
            both = alive.select("row", "n", "pos", "h", "label").join(prints.select("row", "bits"), "row")
            a, b = both.alias("a"), both.alias("b")
            held = (F.col("a.h") == F.col("b.h")) & (F.col("a.row") > F.col("b.row")) & (F.col("a.label") != F.col("b.label"))
            held = held & _may_hold(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), least)
            held = held & _maps_allow(F.col("a.n"), F.col("a.bits"), F.col("b.n"), F.col("b.bits"), least)
            pairs = a.join(b, held).select(F.col("a.row").alias("u"), F.col("b.row").alias("v"), F.col("a.label").alias("lu"), F.col("b.label").alias("lv"))
        now = alive.drop("f")
        moved = merged(pairs)
        if moved is not None:
            moved = stored(moved, "moved")
            now = stored(named(now, "label", moved), "apart")
            roots = stored(named(roots, "root", moved), "roots")
    return roots


def without_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns): one row of each component of texts whose shingle sets have the Jaccard ``similarity``.

    That is the row with the smallest doc_id; a null id is kept only where there is no other. Texts of equal words are
    one class from the start, and those without words are another. Every similar pair counts; there is no chance in it.
    """
    least = Fraction(str(similarity))
    if not 0 < least <= 1:
        raise ValueError("similarity must be above 0 and at most 1")

    def start():
        def one(text: str) -> tuple:
            d = xxhash.xxh3_128_intdigest(b" ".join(text.encode("utf-8", "replace").translate(FOLD).split()))
            halves = np.array([d >> 64, d & (1 << 64) - 1], np.uint64).view(np.int64).tolist()
            return (*halves, fingerprint(text, shingle))

        return one

    rows = pick(docs, "doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")])
    numbered = add_columns(rows, "d1 long, d2 long, fp long", start, keep_text=True).withColumn("row", F.monotonically_increasing_id())
    rows = stored(numbered, "digests", "zstd")  # written, so the row numbers hold
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    classes = stored(rows.groupBy("d1", "d2").agg(order, F.min("fp").alias("fp")).withColumn("row", F.col("least.row")), "classes")
    roots = _links(rows.select("row", "text"), classes, shingle, least)
    named = classes.join(roots, classes["row"] == roots["id"], "left").select("d1", "d2", F.coalesce("root", "row").alias("root"), "least")
    kept = named.groupBy("root").agg(F.min("least").alias("first"))
    stays = named.join(kept, "root").select("d1", "d2", F.col("first.row").alias("stays"))
    gone = rows.select("d1", "d2", "row").join(stays, ["d1", "d2"]).where("row <> stays").select("row")
    return rows.join(gone, "row", "left_anti").select("doc_id", *carry)
