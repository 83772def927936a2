"""Phrase collocations: count streams kept in suffix and in prefix order, walked in step for the counts of all parts."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.operators.upsert import union_all
from tidemark.session import pin
from tidemark.sources.tables import stored

BREAKS = b".,;:!?\n\x0b\x0c\r"  # between pieces
BREAK = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
WINDOW = 4 << 20  # bytes of text worked on together
BITS, MOST_BITS = 16, 1 << 27  # bits of the filter per phrase, and at most; a full filter spares less and loses nothing

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
KIND = np.zeros(256, np.uint8)  # 0: letter of a word, 1: between words, 2: between pieces
KIND[[32, 9]] = 1
KIND[list(BREAKS)] = 2


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts of about ``WINDOW`` bytes at a time; a longer text is cut between two of its pieces."""
    langs, texts, held = [], [], 0
    for lang, text in itertools.chain.from_iterable(
            zip(*(batch.slice(at, 64).column(c).to_pylist() for c in ("lang", "text"))) for at in range(0, batch.num_rows, 64)):
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > WINDOW and (cut := BREAK.search(text, at + WINDOW)):
                stop = cut.end()
            langs.append(lang)
            texts.append(text[at:stop])
            held += stop - at
            at = stop
            if held >= WINDOW:
                yield langs, texts
                langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hash(word: str | bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class _Words:
    """The words of a window: numbers of language and word at each place, and whether the next word is in the same piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        kind = KIND[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[starts] = inside[starts]
        begin = np.flatnonzero(first)
        doc = np.searchsorted(starts, begin, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
        self.joined = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        letters = np.cumsum(inside, dtype=np.int32)
        ends = np.append(letters[begin[1:]] - 1, letters[-1]) if len(begin) else np.empty(0, np.int32)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(LOWERED[data[inside]])])
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        named = pa.array(langs, pa.string()).dictionary_encode()
        self.langs = named.dictionary
        self.lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]

    def places(self, n: int) -> np.ndarray:
        """Where phrases of n words begin."""
        if len(self.word) < n:
            return np.empty(0, np.int64)
        whole = np.ones(len(self.word) - n + 1, bool)
        for i in range(n - 1):
            whole &= self.joined[i:i + len(whole)]
        return np.flatnonzero(whole)

    def hashes(self, n: int) -> np.ndarray:
        """Hash of the n words from each place on (only meaningful at ``places(n)``)."""
        of = np.fromiter(map(_hash, self.words.to_pylist()), np.uint64, len(self.words))
        h = np.fromiter(map(_hash, self.langs.to_pylist()), np.uint64, len(self.langs))[self.lang[:len(self.word) - n + 1]]
        for i in range(n):
            h = _mixed(h, of[self.word[i:i + len(h)]])
        return h

    def counted(self, n: int, at: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, f) of the phrases that begin at the places ``at``."""
        wide, codes = max(len(self.words), 1), []
        code = self.lang[at]
        for i in range(n):
            code = code * wide + self.word[at + i]
            if i < n - 1 and i % 2 == 1:  # two factors at a time stay inside 64 bits
                known, code = np.unique(code, return_inverse=True)
                codes.append((i, known))
        code, f = np.unique(code, return_counts=True)
        parts = [None] * n
        for i in range(n - 1, -1, -1):
            if codes and codes[-1][0] == i:
                code = codes.pop()[1][code]
            parts[i], code = self.words.take(pa.array(code % wide)), code // wide
        phrase = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(code)), phrase, pa.array(f, pa.int64())], ["lang", "phrase", "f"])


def _counts(texts: DataFrame, n: int, known: np.ndarray | None, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of n words found ``least`` times, and for n = 1 (lang, '', number of all words).

    ``known`` is a filter that holds every phrase of n - 1 words found as often; a phrase that begins or ends with another
    is not counted. Each window combines its counts; most phrases are rare, so tasks do not try to combine them again before
    the shuffle, and the commonest phrase leaves one row per window.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, parts in _windows(batch):
                w = _Words(langs, parts)
                at = w.places(n)
                if n == 1:
                    names, total = np.unique(w.lang, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [w.langs.take(pa.array(names)), pa.array([""] * len(names), pa.string()), pa.array(total, pa.int64())], ["lang", "phrase", "f"])
                else:
                    bit = w.hashes(n - 1) & np.uint64(len(known) * 64 - 1)
                    held = (known[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)
                    at = at[(held[at] & held[at + 1]) == 1]
                yield w.counted(n, at)

    rows = texts.mapInArrow(work, "lang string, phrase string, f long").repartition("lang", "phrase")
    found = rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return stored(found.where((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases-{n}")


def _filter(counts: DataFrame) -> np.ndarray:
    """A bitmap of the phrases' hashes, 16 bits each, 16 MB at most."""
    phrases = counts.where("phrase <> ''")
    size = 64
    while size < min(MOST_BITS, BITS * phrases.count()):
        size *= 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                h = np.array([_hash(lang)], np.uint64)
                for word in phrase.split(" "):
                    h = _mixed(h, np.array([_hash(word)], np.uint64))
                bits.append(int(h[0]) & (size - 1))
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], ["bit"])

    lanes = phrases.select("lang", "phrase").mapInArrow(work, "bit long").groupBy(F.shiftright("bit", 6).alias("lane")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[lanes.column("lane").to_numpy()] = lanes.column("bits").to_numpy()
    return out.view(np.uint64)


def _edges(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Per sort partition and length j: the last count of that length, and what its first rows add to an earlier phrase."""
    state: dict[int, list[list]] = {}
    for batch in batches:
        part, m, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "m", "f"))
        for p in np.unique(part):
            rows = state.setdefault(int(p), [[None, 0, True] for _ in range(longest)])
            mp, fp = m[part == p], f[part == p]
            for j in range(1, longest):
                own, ends = np.flatnonzero(mp == j), np.flatnonzero(mp <= j)
                if rows[j][2]:
                    head = fp[:ends[0] if len(ends) else None][mp[:ends[0] if len(ends) else None] == j + 1]
                    rows[j][1] = max(rows[j][1], int(head.max(initial=0)))
                    rows[j][2] = not len(ends)
                if len(own):
                    rows[j][0] = int(fp[own[-1]])
    flat = [(p, j, *rows[j]) for p, rows in state.items() for j in range(1, longest)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    columns = list(zip(*flat)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "j", "last", "lead", "open"])


def _walk(stream: DataFrame, longest: int, tag: str, suffix: bool) -> DataFrame:
    """``stream`` with, per phrase, the counts of its first (with ``suffix``: last) 1, 2, ... words and the largest count
    of a phrase one word longer that begins (ends) with it: columns tag1, tag2, ..., tag_more.

    Sorted by words (from the last one on), a phrase follows all its beginnings and precedes all its extensions. So one
    pass over each sorted range needs the last count of every length and one open phrase of every length, and no lookups.
    Ranges are cut anywhere, also within a word's phrases; what passes from one to the next is a few numbers per range.
    """
    words = F.split("phrase", " ")
    key = F.reverse(words) if suffix else words
    kept = stream.columns
    order = pin(stream.withColumn("m", F.size(words)).repartitionByRange("lang", key).sortWithinPartitions("lang", key)
                .withColumn("part", F.spark_partition_id()))
    ends: dict[int, dict[int, tuple]] = {}
    edge_rows = order.select("part", "m", "f").mapInArrow(lambda b: _edges(b, longest), "part int, j int, last long, lead long, open boolean")
    for r in edge_rows.collect():  # a few rows per sort partition
        ends.setdefault(r["part"], {})[r["j"]] = (r["last"], r["lead"], r["open"])
    before: dict[int, list[int]] = {}
    after: dict[int, list[int]] = {}
    last = [0] * longest
    for p in sorted(ends):
        before[p] = list(last)
        last = [0] + [last[j] if ends[p][j][0] is None else ends[p][j][0] for j in range(1, longest)]
    more = [0] * longest
    for p in sorted(ends, reverse=True):
        after[p] = list(more)
        more = [0] + [max(ends[p][j][1], more[j] if ends[p][j][2] else 0) for j in range(1, longest)]
    names = [f"{tag}{j}" for j in range(1, longest)] + [f"{tag}_more"]
    columns = [*kept, *names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_rows, part = None, {}, None

        def closed(j: int, most: int) -> pa.RecordBatch:
            row, found = open_rows.pop(j)
            return pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([max(found, most)], pa.int64())], columns)

        for batch in batches:
            m, f = batch.column("m").to_numpy(zero_copy_only=False), batch.column("f").to_numpy(zero_copy_only=False)
            if not len(m):
                continue
            if part is None:
                part = batch.column("part")[0].as_py()
                last = list(before[part])
            place, counts = np.arange(len(m)), []
            more, hold = np.zeros(len(m), np.int64), {}
            for j in range(1, longest):
                at = np.maximum.accumulate(np.where(m == j, place, -1))
                value = np.where(at >= 0, f[at], last[j])
                counts.append(pa.array(np.where(m > j, value, 0), pa.int64()))
                last[j] = int(value[-1])
                if j == 1:
                    continue  # single words are no candidates
                child, bounds = np.where(m == j + 1, f, 0), np.flatnonzero(m <= j)
                head = int(child[:bounds[0] if len(bounds) else None].max(initial=0))
                if j in open_rows:
                    open_rows[j] = (open_rows[j][0], max(open_rows[j][1], head))
                if len(bounds):
                    if j in open_rows:
                        yield closed(j, 0)
                    most = np.maximum.reduceat(child, bounds)
                    own = m[bounds] == j
                    more[bounds[own]] = most[own]
                    if own[-1]:
                        hold[j] = int(bounds[-1])
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *counts, pa.array(more)], columns)
            for j, i in hold.items():
                open_rows[j] = (out.slice(i, 1), int(more[i]))
            yield out.filter(pa.array(~np.isin(place, list(hold.values()))))
        for j in list(open_rows):
            yield closed(j, after[part][j])

    schema = ", ".join([f"{c} {stream.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} long" for c in names])
    return order.mapInArrow(work, schema)


def _scored(found: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the weakest cut of each phrase; exact, also where products pass 64 bits."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, m = r["f"], r["m"]
                cuts = [(1000000 * a * a // (r[f"p{k}"] * r[f"s{m - k}"]), k) for k in range(1, m)]
                score, k = min(cuts)
                rows.append((r["lang"], r["phrase"], a, r[f"p{k}"], r[f"s{m - k}"], score))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang", "phrase", "a", "l", "r", "score"])

    return found.withColumn("m", F.size(F.split("phrase", " "))).mapInArrow(work, "lang string, phrase string, a long, l long, r long, score long")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Text is lower-cased (A-Z) and cut into pieces at punctuation and line ends; phrases lie within a piece and count with
    overlaps, in every row, repeated ones too. A null text is empty, a null language is 'und'. Phrases found ``least``
    times count unless a longer such phrase that holds them has ``share`` per cent of their count: it is enough to look at
    those one word longer, as they are at least as frequent. ``score`` is that of the weakest cut, the smaller left part
    on ties; equal scores go by count, then by phrase. Empty tables give no rows; very long texts are read piece by piece.
    """
    rows = pick(docs, "lang", "text")
    texts = rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).where("length(text) > 0")
    streams = [_counts(texts, 1, None, least)]
    for n in range(2, longest + 1):
        streams.append(_counts(texts, n, _filter(streams[-1]), least))
    totals = streams[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    by_end = _walk(union_all(*streams).where("phrase <> ''"), longest, "s", suffix=True)
    both = _walk(by_end, longest, "p", suffix=False)
    loose = both.where((F.instr("phrase", " ") > 0) & (100 * F.greatest("s_more", "p_more") < share * F.col("f")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = _scored(loose, longest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
