"""Chunks of texts against a plain greedy cut."""

import random
import re

import pytest

from tidemark.operators import chunks as ch

WORD = r"[^ \t\n\r]+"


def brute_parts(text, most):
    cut = re.sub(r"([.!?][ \t\n\r]+|\n[ \t\n\r]*)", "\\1\0", text).split("\0") if "\0" not in text else [text]
    out = []
    for s in cut:
        if not s:
            continue
        n = len(re.findall(WORD, s))
        if n <= most:
            out.append(s)
        else:
            out += re.findall(rf"[ \t\n\r]*(?:{WORD}[ \t\n\r]*){{1,{most}}}", s)
    return [(s, len(re.findall(WORD, s))) for s in out]


def brute(text, budget, overlap):
    if text is None or not re.search(WORD, text):
        return []
    groups, own = [[]], budget - overlap
    for s, n in brute_parts(text, own):
        held = sum(w for _, w in groups[-1])
        if held and n and held + n > own:
            groups.append([])
        groups[-1].append((s, n))
    out, at = [], 0
    for i, g in enumerate(groups):
        back = []
        for s, n in reversed(groups[i - 1] if i else []):
            if sum(w for _, w in back) + n > overlap:
                break
            back.insert(0, (s, n))
        lead, body = "".join(s for s, _ in back), "".join(s for s, _ in g)
        out.append((i, len(groups), at - len(lead), at + len(body), len(lead), sum(n for _, n in back + g), lead + body))
        at += len(body)
    return out


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé日😀.") for _ in range(rng.randint(1, 6)))
    end = lambda: rng.choice([" ", " ", " ", ". ", "? \n", "\n\n", "\t", "!  ", "..."])
    return ["".join(word() + end() for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.mark.parametrize("budget, overlap", [(20, 4), (7, 0), (30, 29), (1, 0), (10_000, 10)])
def test_against_a_plain_cut(spark, budget, overlap):
    texts = made(budget, 60) + [None, "", " \n\t", "one", "w " * 700 + "end.", "a. b. c. d. " * 50, "x" * 5000 + " y", "\n\nlead. tail\n\n", "has \x1f\x1ecut\x1e\x1f. inside it. twice"]
    df = spark.createDataFrame([(i, t, "t", 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, cuts int")
    got = {}
    for r in ch.chunk_texts(df.repartition(3), budget=budget, overlap=overlap).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, t in enumerate(texts):
        mine = sorted(got.get(i, []))
        if t is None or "\x1f" not in t:
            assert mine == brute(t, budget, overlap), (i, t)
        if t and mine:
            assert "".join(c[-1][c[4]:] for c in mine) == t  # chunks rejoin to the text
            assert all(t[c[2]:c[3]] == c[-1] for c in mine)
            assert all(c[5] <= budget for c in mine)


def test_refuses_an_overlap_without_progress(spark):
    with pytest.raises(ValueError):
        ch.chunk_texts(spark.createDataFrame([], "doc_id long, text string"), budget=5, overlap=5)


def test_whole_documents_rejoin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in ch.chunk_texts(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk"], r["text"][r["repeated"]:]))
    for r in docs.collect():
        assert "".join(t for _, t in sorted(got.get(r["doc_id"], []))) == (r["text"] if r["text"] and r["text"].strip(" \t\n\r") else "")
    assert ch.chunk_texts(docs.where("false")).collect() == []
