"""Line dedup, decontamination and personal data against brute force."""

import collections
import re

from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import decontaminate as dec
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.pii import BASE, personal_data

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(texts, min_docs, keep_first=False):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    docs = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    seen, out = set(), []
    for t in texts:
        kept = []
        for x in (t or "").split("\n"):
            k = key(x)
            if not k or docs[k] < min_docs or keep_first and k not in seen:
                kept.append(x)
            seen.add(k)
        out.append("\n".join(kept))
    return out


def test_line_dedup(spark):
    texts = [f"Head \n own {i}\n\t head\nlast {i % 3}" for i in range(9)] + [None, "", "\n", "\n".join(f"line {j}" for j in range(200)) + "\nhead"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for keep_first in (False, True):
        got = {r["doc_id"]: r for r in line_dedup(docs, min_docs=3, keep_first=keep_first).collect()}
        for i, want in enumerate(brute_lines(texts, 3, keep_first)):
            assert got[i]["text"] == want, (i, keep_first)
            assert got[i]["n_lines"] == len((texts[i] or "").split("\n"))
            assert got[i]["n_lines"] - got[i]["n_dropped"] == (len(want.split("\n")) if want or got[i]["n_dropped"] < got[i]["n_lines"] else 0)


def test_line_dedup_odd_rows(odd, none):
    rows = line_dedup(odd, min_docs=3, carry=("lang", "source")).collect()
    assert len(rows) == odd.count()
    by = collections.Counter((r["doc_id"], r["text"]) for r in rows)
    assert by[(1, "\n")] == 2 and by[(7, "\n")] == 1 and by[(None, "")] == 1 and by[(None, "no id here")] == 1
    assert line_dedup(none).count() == 0


def brute_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    words, hit, named = split(text), set(), set()
    for name, t in items:
        w = split(t)
        n = min(window, len(w))
        wins = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
        for s in range(len(words) - n + 1):
            if tuple(words[s:s + n]) in wins:
                hit.update(range(s, s + n))
                named.add(name)
    return len(words), len(hit), sorted(named)


def test_decontaminate_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "the the the the the the the the the the the the"), (3, "Short one"), (4, None), (5, ""), (None, "null named item"), (10, "same long " + long),
             (11, "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9")]
    texts = [long, "x " + " ".join(f"W{i}" for i in range(5, 17)) + " y", "the " * 40, "a short one, and Short-ONE", None, "", "null NAMED item",
             " ".join(f"w{i}" for i in range(9)), " ".join(f"w{i}" if i != 12 else "z" for i in range(30)), "same long w0 w1 w2 w3 w4 w5 w6 w7 w8",
             "q0 q1 q2 q3 q4 q5 q6 q7 q8 z", "q1 q2 q3 q4 q5 q6 q7 q8 q9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in dec.decontaminate(docs, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, named = brute_hits(t, [("" if k is None else str(k), x) for k, x in items])
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, named), (i, t)
    assert [got[i]["n_near"] for i in (4, 10, 11)] == [0, 1, 0]  # nine words around the rarest one, but no phrase


def test_decontaminate_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "word other thing word other thing word other thing word"), (1, "word other thing word other thing word other thing word")],
                                  "item_id long, text string").withColumn("word", F.lit(1))
    rows = dec.decontaminate(odd, bench, carry=("text", "lang")).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["n_hit"] for r in rows if r["n_hit"]} == {4: 59_998}  # the last two words begin no whole window
    assert dec.decontaminate(odd, bench.where("false")).where("n_hit > 0").count() == 0
    assert dec.decontaminate(none, bench).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    checks = [("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
              ("card", CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 10 <= len(digits(m)) <= 15)]
    out = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(checks) for m in p.finditer(text or "") if ok(m.group())]
    return sorted(out)


def test_personal_data_against_brute_force(spark):
    cases = [
        "mail a.b@c-d.example.com, x@y.z_w@v.u and @no.no a@b", "é😀 ip 1.2.3.4.5.6.7.8 and 256.1.1.1, 007.000.0255.1 10.0.0.1",
        "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 378282246310005; 4111  1111", "+1 (555) 123-4567 +44.20.7946.0958. + 1 +123",
        None, "", "a" * 200_000 + "@x.y", "1 " * 50_000, "x@" + "a." * 30_000 + "b", "4111111111111111" * 2 + " 4111111111111111",
        "a@b.c,d@e.f\n+15551234567@x.org 12.34.56.78.", "tel (555) 123-4567 or ssn 123-45-6789, me (at) home (dot) org",
    ]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal_data(docs).collect()}
    for i, t in enumerate(cases):
        base = [(s["start"], BASE.index(s["kind"]), s["kind"], s["stop"]) for s in got[i] if s["base"]]
        assert base == brute_personal(t), (i, t and t[:80])
        assert all(a["stop"] <= b["start"] for a, b in zip(got[i], got[i][1:]) if not (a["base"] and b["base"]))


def test_personal_data_on_documents(spark, small, odd, none):
    got = {r["doc_id"]: r["spans"] for r in personal_data(small).collect()}
    for r in small.collect():
        assert [(s["start"], BASE.index(s["kind"]), s["kind"], s["stop"]) for s in got[r["doc_id"]] if s["base"]] == brute_personal(r["text"])
    assert personal_data(odd).count() == odd.count()
    assert personal_data(none).count() == 0


def test_native_plans_hold_no_python(spark, small):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df in (line_dedup(small), dec.decontaminate(small, bench), personal_data(small)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
