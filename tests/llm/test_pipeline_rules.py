"""The rules of pipeline stages that differ from those of the single operators."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline as pipe
from tests.llm.test_native import brute_lines
from tidemark.llm import similar, simhash
from tidemark.sources.tables import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(docs):
    """Ids that stay when all pairs of 5-word Jaccard similarity of 0.8 or more are linked."""
    sets = {i: shingles(t) for i, t in docs}
    groups = defaultdict(list)
    for i, s in sets.items():
        groups[s].append(i)
    keys = list(groups)
    parent = dict.fromkeys(range(len(keys)))
    parent = {k: k for k in parent}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    linked = 0
    for i, a in enumerate(keys):
        for j in range(i):
            b = keys[j]
            if a and b and 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * (n := len(a & b)) >= 4 * (len(a) + len(b) - n):
                parent[find(i)] = find(j)
                linked += 1
    least = defaultdict(list)
    for i, s in enumerate(keys):
        least[find(i)] += groups[s]
    return {min(ids) for ids in least.values()}, linked


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)


def made():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(500))
    texts = []
    for size in (4, 5, 9, 40, 150, 400):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 14):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = [word()]
            texts.append(" ".join(w))
    crowd, common = [word() for _ in range(120)], [word() for _ in range(60)]  # a large group, and a passage in dissimilar texts
    for _ in range(90):
        w = list(crowd)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
        texts.append(" ".join(common + [word() for _ in range(rng.choice((5, 12, 20, 40)))]))
    chain = [word() for _ in range(200)]  # neighbours are similar, ends are not
    for i in range(30):
        texts.append(" ".join(chain[:100] if not i else chain[i:i + 100]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("common, leaders", [(64, 4), (8, 1), (10**6, 0)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, common, leaders):
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "LEADERS", leaders)
    texts = made()
    want, linked = brute_kept(enumerate(texts))
    assert linked > 500
    got = [r["doc_id"] for r in pipe.drop_near_duplicates(spark, corpus(spark, texts), "").collect()]
    assert sorted(got) == sorted(want)


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 1 or doc_id in (917, 596)")
    want, linked = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = [r["doc_id"] for r in pipe.drop_near_duplicates(spark, docs, "").collect()]
    assert linked and sorted(got) == sorted(want) and 917 not in got


def test_one_whole_text_of_many_copies_stays(spark):
    rng = random.Random(8)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(n))
    groups = [(text(6), 10), (text(40), 25), (text(1), 12), (text(5), 3)]
    texts = [t for t, n in groups for _ in range(n)] + [text(4) + "\nShared  line" for _ in range(15)]
    rng.shuffle(texts)
    docs = stored(pipe.drop_repeated_lines(spark, corpus(spark, texts), ""), "stage")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == brute_lines(texts, 10, keep_first=True)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    alone = stored(pipe.drop_near_duplicates(spark, docs, ""), "stage")
    fair = [r["text"] for r in pipe.drop_benchmark(spark, alone, "/root/testdata/sf0.001").collect()]
    for whole, _ in groups:
        assert fair.count(whole) == 1
    assert sum("Shared  line" in t for t in fair) == 1


def test_repeated_rows_and_rows_without_id_keep_their_lines_once(spark):
    """A line that ten and more rows share stays in exactly one of them, also where rows are equal or have no id."""
    a, b, c = "line one\nline two\nthe end", "no id here\nnor there", "mixed A\nmixed B"
    rows = [(1, a)] * 12 + [(None, b)] * 12 + [(None, c)] * 6 + [(5, c)] * 6 + [(6, "mixed a\nits own\nmixed b\nMIXED A")] + [(7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(5)
    out = stored(pipe.drop_repeated_lines(spark, docs, ""), "stage").collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"] or "") for r in out)
    texts = lambda i: sorted(r["text"] or "" for r in out if r["doc_id"] == i)
    assert texts(1) == [""] * 11 + [a]
    assert texts(None) == [""] * 17 + [b]
    assert texts(5) == [""] * 5 + [c]  # a row without an id has them only if no other has
    assert texts(6) == ["its own"]
    alone = pipe.drop_near_duplicates(spark, stored(pipe.drop_repeated_lines(spark, docs, ""), "stage"), "").collect()
    assert sorted((r["text"] or "") for r in alone) == sorted(["", a, b, c, "its own"])


@pytest.mark.parametrize("sampled, bits", [(1, 1 << 27), (4, 64), (8, 1 << 12)])
def test_any_order_of_shingles_gives_the_same_groups(spark, monkeypatch, sampled, bits):
    monkeypatch.setattr(similar, "SAMPLED", sampled)
    monkeypatch.setattr(similar, "MOST_BITS", bits)
    monkeypatch.setattr(similar, "COMMON", 3)
    texts = made()
    got = [r["doc_id"] for r in pipe.drop_near_duplicates(spark, corpus(spark, texts), "").collect()]
    assert sorted(got) == sorted(brute_kept(enumerate(texts))[0])


def test_maps_never_forbid_similar_texts(spark):
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(40), rng.randrange(1, 40))) for _ in range(60)]
    hashes = np.array([rng.getrandbits(64) for _ in range(40)], np.uint64)
    rows = [(i, len(s), [int(x) for x in similar.bit_map(hashes[s])]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "row long, n long, bits array<long>")
    pairs = spark.createDataFrame([(i, j, 0, 0) for i in range(60) for j in range(i)], "u long, v long, lu long, lv long")
    for least in (Fraction(4, 5), Fraction(1, 2), Fraction(1)):
        kept = {(r["u"], r["v"]) for r in similar._bounded(pairs, df, least).collect()}
        for i in range(60):
            for j in range(i):
                a, b = set(sets[i]), set(sets[j])
                if len(a & b) >= least * len(a | b):
                    assert (i, j) in kept
        assert len(kept) < 60 * 59 / 2


def test_candidates_come_through_simhash_before_prefixes(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[:200] + ["new"] * 30 + base[200:]), " ".join(base[::-1]), ""]
    linked = []

    def links(prints):
        linked.append({r["fp"] for r in prints.collect()})
        return simhash.links(prints)

    monkeypatch.setattr(similar, "links", links)
    got = {r["doc_id"] for r in pipe.drop_near_duplicates(spark, corpus(spark, texts), "").collect()}
    assert linked == [{simhash.fingerprint(t, 5) for t in texts}]
    assert got == brute_kept(enumerate(texts))[0] == {0, 3, 4}


def test_simhash_pairs_rows_of_equal_and_of_linked_fingerprints(spark):
    classes = spark.createDataFrame([(1, 0b1000), (2, 0b1000), (3, 0b1011), (4, -1), (5, 0b1000)], "row long, fp long")
    assert {(max(p), min(p)) for p in similar._near_prints(classes).collect()} == {(2, 1), (5, 1), (3, 1)}
