"""Mixing, language ID, secrets, toxicity and near-duplicates."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import components, language, mixing, secrets, simhash
from tidemark.llm import toxicity as tox


def brute_targets(size, weights=(5.0, 2.0, 1.0), cap=3.0):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(size.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= cap * size[s]]
        if not over:
            return {**share, **fixed}
        fixed.update({s: cap * size[s] for s in over})


def check_mix(rows, tolerance):
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= tolerance * max(target[s], 1), (s, taken[s], target[s])
    return size


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    size = check_mix(rows, 0.02)
    for r in rows:
        assert r["source_size"] == size[r["source"]]
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert all(r["size"] == words[r["doc_id"]] for r in rows)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, rows))


def test_mix_splits_a_large_source(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"),
                                     F.when(F.col("id") < 8_000, "a").when(F.col("id") < 8_990, "b").alias("source"))
    check_mix(mixing.mix(docs).collect(), 0.01)


def test_mix_odd_rows(odd, none):
    rows = mixing.mix(odd, carry=("lang", "n_chars")).collect()
    assert len(rows) == odd.count()
    assert {r["source"] for r in rows} == {None, "s1", "s2", "s3"}
    assert sum(r["taken"] for r in rows if r["source"] is None) == 0
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    rows = language.detect(docs, model, carry=("lang",)).collect()
    letters = {r["doc_id"]: any(c.isalpha() for c in r["text"] or "") for r in docs.collect()}
    import zlib
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and letters[r["doc_id"]]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_backs_off_to_shorter_grams():
    grams = {"^aa": 0, "b": 1}
    model = language.LanguageModel(["x", "y"], {"known": 0}, np.array([[1.0, -1.0]]), grams, np.array([[2.0, -2.0], [-3.0, 3.0]]))
    scorer = language.Scorer(model)
    assert scorer("known")[0] == "x" and scorer("aab")[0] == "x" and scorer("cb")[0] == "y"
    assert scorer("123 ²")[0] == "und" and scorer("")[0] == "und"
    assert scorer("known known known")[1] > scorer("known")[1] > 0.5


def test_language_odd_rows(odd, none):
    model = language.fit(odd)
    got = Counter((r["doc_id"], r["lang_pred"]) for r in language.detect(odd, model).collect())
    assert sum(got.values()) == odd.count()
    assert got[(2, "und")] == got[(3, "und")] == got[(8, "und")] == 1
    assert {r["lang_pred"] for r in language.detect(odd, language.fit(none)).collect()} == {"und"}
    assert language.detect(none, model).count() == 0


def brute_secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m.group(1)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def test_secrets(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = [(10**9, "Paſſword: abcdefgh PASSWORD = 'short' Api_Key:\"ABCDEF12.34\" apikey=x token=token=abcdefgh"), (10**9 + 1, "AKIA" * 5 + " 😀 " + "0af" * 30_000),
            (10**9 + 2, None), (10**9 + 3, "")]
    docs = docs.unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    model = secrets.fit(docs)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, model).collect()}
    for r in docs.collect():
        base = [(s["start"], secrets.KINDS.index(s["kind"]), s["stop"]) for s in got[r["doc_id"]] if s["kind"] != "learned"]
        assert base == brute_secrets(r["text"]), r["doc_id"]
    assert secrets.scan(odd, model).count() == odd.count()
    assert secrets.scan(none, secrets.fit(none)).count() == 0


def test_secret_network_learns_what_secrets_look_like():
    rng = random.Random(3)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 40)))
    plain = lambda: "-".join(rng.choice(["alpha", "beta", "2024", "version", "42"]) for _ in range(4)) + "1a"
    made = [(s(), y) for _ in range(150) for s, y in ((secret, 1), (plain, 0))]
    one = lambda x, context: secrets.encode(secrets.symbols(f"see {x} here"), 4, 4 + len(x), context)
    samples = [one(x, i % 2 == 0) for i, (x, _) in enumerate(made)]
    truth = np.array([y for _, y in made], float)
    model = secrets._train(samples[:200], truth[:200], 6, 1)
    secrets._calibrate(model, samples[200:], truth[200:], 0.95)
    p = model.probabilities([one("9f8e7d6c5b4a39281706f5e4d3c2b1a0", True), one("alpha-42-version-beta1a", True)])
    assert p[0] >= model.threshold > p[1]
    piece = "9f8e7d6c" * 3000
    best, where = model.pooled([one(piece, False), one(piece[:9000], False), one("ab", False)])
    assert np.allclose(best[0], best[1]) and where.min() >= 0
    alone = [model.pooled([x])[0][0] for x in (one(piece, False), one(piece[:9000], False), one("ab", False))]
    assert np.allclose(best, np.stack(alone))  # lengths do not touch each other


def test_candidates_are_all_strings_outside_base_spans():
    text = 'see Xk29fQ7zLmA, wordword. "..abcdefgh.." token = "abcdefgh12" short =a/b+c_d-e='
    base = secrets.base_spans(text)
    assert [text[a:b] for a, b in secrets.candidates(text, base)] == ["Xk29fQ7zLmA", "wordword", "abcdefgh", "=a/b+c_d-e="]
    assert [text[slice(*secrets.body_of(text, s))] for s in base] == ["abcdefgh12"]
    codes = secrets.symbols("ab😀c")
    assert codes[secrets.LEFT:-secrets.RIGHT].tolist() == [ord("a") - 31, ord("b") - 31, 0, ord("c") - 31]


@pytest.mark.parametrize("sf, planted_recall", [("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_secret_network_on_held_back_documents(spark, sf, planted_recall):
    """Trained on the given documents; secrets that no fixed pattern finds are planted into some it has not seen."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    held = docs.where("doc_id % 4 = 0")
    model = secrets.fit(docs.where("doc_id % 4 <> 0"))
    assert model.threshold < 1 and np.abs(model.kernel).sum() > 0
    rng = random.Random(4)
    shapes = ["Xk29fQ7zLmA", "".join(rng.choices("0123456789abcdef", k=28)), "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=20)),
              "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32)), "".join(rng.choices("0123456789abcdef", k=16))]
    rows, want = [], {}
    for r in held.orderBy("doc_id").limit(200).collect():
        key = "".join(rng.sample(shapes[rng.randrange(5)], k=11)) if r["doc_id"] % 8 else rng.choice(shapes)
        head = (r["text"] or "")[:300]
        if any(c.isdigit() for c in key) and len(key) >= 10:
            want[r["doc_id"]] = (len(head) + 1, len(head) + 1 + len(key))
        rows.append((r["doc_id"], f"{head} {key} and so on"))
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    caught = sum(any((s["start"], s["stop"]) == want.get(r["doc_id"]) for s in r["spans"]) for r in found)
    assert caught >= planted_recall * len(want)
    spans = [(r["doc_id"], s) for r in secrets.scan(held, model).collect() for s in r["spans"]]
    base = [s["score"] >= model.threshold for _, s in spans if s["kind"] != "learned"]
    learned = [s for _, s in spans if s["kind"] == "learned"]
    texts = sum(len(re.findall(r"[A-Za-z0-9+/_=.-]{8,}", r["text"] or "")) for r in held.collect())
    assert np.mean(base) >= 0.9 and len(learned) <= 0.01 * texts


def test_joined_texts_have_the_candidates_of_each():
    rng = random.Random(5)
    bits = ["token=abcdefgh12", "Paſſword: x", "AKIA" + "Z" * 14, "0af3" * 9, "..----..", "-", ".", "a" * 7, "Qw-" * 4, " ", "\n", "é", "\x7f", "😀", "=+/_", "secret: '", "İapi_key=12345678"]
    texts = ["", *["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(400)], "abcdefgh", "....", "\x00abcdefghi"]
    got = secrets._Texts.of(texts)
    for i, text in enumerate(texts):
        base = [(a, secrets.KINDS.index(kind), b) for a, kind, b in got.base[i]]
        assert base == brute_secrets(text)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=.-]{8,}", text):
            a, b = m.end() - len(m.group().lstrip(".-")), m.start() + len(m.group().rstrip(".-"))
            if b - a >= 8 and not any(x < b and a < y for x, _, y in base):
                want.append((a, b))
        mine = got.owner == i
        assert list(zip(got.starts[mine] - got.begins[i], got.stops[mine] - got.begins[i])) == want
        if want:
            codes, lengths = secrets._cut_out(got.codes, got.starts[mine], got.stops[mine], np.arange(len(want)) % 2 == 0)
            for k, (a, b) in enumerate(want):
                assert np.array_equal(codes[:lengths[k], k], secrets.encode(secrets.symbols(text), a, b, k % 2 == 0)) and not codes[lengths[k]:, k].any()


def test_secret_network_learns_from_every_finding(spark, monkeypatch):
    """No document and no candidate is left out, and tasks that learn apart agree on one model, however the rows lie."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(8, 12))) for _ in range(500)]
    rows = [(i if i % 9 else None, " ".join(rng.choices(words, k=10)) + (f" password = {rng.getrandbits(60):x}00" if i % 5 == 0 else "")) for i in range(2000)]
    parts = np.zeros((2, 2), int)  # others and secrets; held back and learned from
    for _, text in rows:
        base, turn = secrets.base_spans(text), zlib.crc32(text.encode())
        for y, n in enumerate((len(secrets.candidates(text, base)), len(base))):
            for i in range(n):
                parts[y, int((turn + i) % 3 > 0)] += 1
    assert parts[0].sum() == 20_000 and parts[1].sum() == 400
    seen, averaged, settle = {"rounds": []}, secrets._averaged, secrets._settle

    def spy_round(*args):
        out = averaged(*args)
        seen["rounds"].append((args[3], out[1]))
        return out

    def spy_settle(model, bins, found, others, recall):
        seen["held"] = (others.sum(), found.sum())
        settle(model, bins, found, others, recall)

    monkeypatch.setattr(secrets, "_averaged", spy_round)
    monkeypatch.setattr(secrets, "_settle", spy_settle)
    monkeypatch.setattr(secrets, "TASK", 40_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = secrets.fit(docs, epochs=1)
    assert len(seen["rounds"]) > 3
    assert {t for t, _ in seen["rounds"]} == {(parts[0, 1], parts[1, 1])}
    assert sum(n for _, n in seen["rounds"]) == parts[1, 1]
    assert seen["held"] == (parts[0, 0], 9 * parts[1, 0])
    assert np.array_equal(model.kernel, secrets.fit(docs.repartition(5), epochs=1).kernel)
    assert model.threshold < 1


def test_one_secret_serves_for_both_parts(spark):
    rows = [(i, f"ordinary{i} sentences without anything") for i in range(50)] + [(99, 'api_key="q8Zk2LmN0pRt"')]
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"), epochs=1)
    assert model.threshold < 1 and np.abs(model.kernel).sum() > 0
    assert secrets.fit(spark.createDataFrame(rows[:50], "doc_id long, text string")).threshold > 1  # nothing to learn


def test_automaton_matches_all_words_within_the_distance():
    terms, stems = {"idiot": 1.0, "worthless": 1.0, "disgusting": 1.0, "scum": 1.0}, {"lowei": 1.0, "pathetica": 1.0}
    a = tox.Automaton(tox.Lexicon(terms, stems))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    rng = random.Random(1)
    words = set()
    for t in [*terms, *stems] * 150:
        w = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "e", "s"])
        words.add("".join(w) + rng.choice(["", "", "tum"]))
    for w in words - {""}:
        near = [distance(w, t) for t in terms if distance(w, t) <= tox.edits(t, False)]
        near += [min(distance(w[:k], t) for k in range(len(w) + 1)) for t in stems if min(distance(w[:k], t) for k in range(len(w) + 1)) <= tox.edits(t, True)]
        hit = a.match(w)
        assert (hit[1] if hit else None) == (min(near) if near else None), w
    assert a.match("id1ot")[0] == "idiot" and a.match("worthle$s")[0] == "worthless"


def test_quotation_counts_apart():
    a = tox.Automaton(tox.Lexicon({"idiot": 5.0}, {}))
    assert [f[4] for f in tox.findings('you idiot, you "total idiot" he said: idiot', a)] == [False, True, True]
    assert tox.features('"idiot"', a)[0] == 0 and tox.features("idiot", a)[0] > 0


def test_toxicity_on_held_out_labels(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit(docs, labels)
    assert {"idiot", "moron"} <= set(model.lexicon.words)
    rows = tox.toxicity(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    bad, good = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9 and np.mean(np.array(good) >= 0.5) < 0.02
    got = tox.toxicity(odd, model, carry=("text", "lang")).collect()
    assert len(got) == odd.count() and all(r["score"] < 0.5 for r in got)
    empty = tox.fit(none, labels)
    assert {round(r["score"], 6) for r in tox.toxicity(odd, empty).collect()} == {round(1 / (1 + np.exp(4)), 6)}
    assert tox.toxicity(none, model).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    groups, parent = defaultdict(list), {}
    for i, f in prints:
        groups[f].append(i)
    keys = list(groups)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for f, ids in groups.items():
        least[find(f)] += ids
    return {i: min(ids) for ids in least.values() for i in ids}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(1000).select("doc_id", "text")
    rows = docs.collect()
    prints = [(r["doc_id"], brute_print(r["text"])) for r in rows]
    want = brute_components(prints)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, want[i]) for i, f in prints}
    assert len(set(want.values())) < len(want)


def test_links_in_large_buckets_and_at_every_place(spark, monkeypatch):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    near = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(20)}
    crowd = {seeds[0] ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}  # hundreds in one bucket
    prints = sorted(near | crowd | {0, 1, 3, 7, 2**64 - 1, 2**63})
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    for bucket in (64, 4):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        root = {r["id"] % 2**64: r["root"] for r in components.components(simhash.links(rows)).collect()}
        groups = defaultdict(set)
        for i, p in enumerate(prints):
            groups[root.get(p, ("alone", p))].add(i)
        theirs = defaultdict(set)
        for i, c in want.items():
            theirs[c].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 400)] + [(7, 7), (9, 8), (8, 9)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(200, 400)]}, 8: 8, 9: 8}


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, carry=("text", "lang")).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if not (r["text"] or "").strip(" \t\x0b\x0c\r\n")]
    assert len(empty) == 4 and {r["fp"] for r in empty} == {0} and {r["component_id"] for r in empty} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 7)} == {1}
    groups = defaultdict(int)
    for r in rows:
        groups[r["component_id"]] += r["keep"]
    assert set(groups.values()) == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_labels_with_nulls_and_repeats(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd_labels = labels.unionByName(labels).unionByName(labels.limit(5).select(F.lit(None).cast("long").alias("doc_id"), "quality", "toxic")).unionByName(
        labels.limit(5).select("doc_id", "quality", F.lit(None).cast("int").alias("toxic")))
    a, b = tox.fit(small, labels), tox.fit(small, odd_labels)
    assert a.lexicon == b.lexicon and np.allclose(a.coef, b.coef)
