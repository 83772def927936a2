"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SF
from tidemark.llm import phrases as ph
from tidemark.llm import queries
from tidemark.llm.common import pick


def brute(rows, longest=3, least=10, share=50, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, words[i:i + m]) for i in range(len(words) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= share * f[lang, p[i:i + m]]:
                    gone.add((lang, p[i:i + m]))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, total[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top]))


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def made(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "Cc", "d\x01", "\x00", "é", "E", "日本", "x-y", "\x1f", "\x85z"]
    gap = [" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", "?!", " , "]
    text = lambda: "".join(rng.choice(words) + rng.choice(gap) for _ in range(rng.randrange(40)))
    return [(rng.choice(["en", "de", None, "und", "a b", ""]), rng.choice([text(), text(), text() + " new york city", None, "", " \t"])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, LANG int, f string")


@pytest.mark.parametrize("options", [{}, {"longest": 2, "least": 3}, {"longest": 4, "least": 4, "share": 80}, {"longest": 5, "least": 2, "share": 20, "top": 7}])
def test_against_plain_counting(spark, options):
    rows = made(len(options))
    assert got(ph.collocations(frame(spark, rows).repartition(5), **options)) == brute(rows, **options)


@pytest.mark.parametrize("ranges", [1, 40])
def test_many_ranges_and_small_windows(spark, monkeypatch, ranges):
    """Counts cross the borders of ranges, batches and windows wherever these fall."""
    monkeypatch.setattr(ph, "WINDOW", 64)
    rows = made(9, 120) + [("en", "hot word here " * 400)] + [("en", "hot word here ") for _ in range(50)]
    settings = {"spark.sql.shuffle.partitions": str(ranges), "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert got(ph.collocations(frame(spark, rows), longest=4, least=2, share=60)) == brute(rows, 4, 2, 60)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(ph, "MOST_BITS", 64)
    rows = made(4)
    assert got(ph.collocations(frame(spark, rows), least=3)) == brute(rows, least=3)


def test_products_beyond_64_bits(spark):
    big = 3 * 10 ** 12
    df = spark.createDataFrame([("en", "a b c", big, big + 7, big + 5, big + 1, big + 2)], "lang string, phrase string, f long, p1 long, p2 long, s1 long, s2 long")
    row = ph._scored(df, 3).first()
    scores = [1000000 * big * big // ((big + 7) * (big + 2)), 1000000 * big * big // ((big + 5) * (big + 1))]
    assert row["score"] == min(scores) and (row["l"], row["r"]) == ((big + 7, big + 2) if scores[0] <= scores[1] else (big + 5, big + 1))


def test_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in pick(odd, "lang", "text").collect()]
    assert got(ph.collocations(odd, least=2)) == brute(rows, least=2)
    assert got(ph.collocations(none)) == []


def test_codes_of_long_phrases():
    langs, texts = ["x", "y"], [b"a b c d e f g a b c d e f g", b"a b c d e f g"]
    w = ph._Words(langs, texts)
    out = w.counted(7, w.places(7)).to_pylist()
    assert {(r["lang"], r["phrase"]): r["f"] for r in out}[("x", "a b c d e f g")] == 2
    assert sum(r["f"] for r in out) == 9 and w.hashes(2).dtype == np.uint64


def test_registered_query(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    assert got(queries.op12_phrases(spark, SF)) == brute(rows)
