"""Toxicity: Levenshtein automata over a lexicon trie find toxic terms and their misspellings, context decides."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns, fold, pick, training_share
from tidemark.sources.tables import stored

TOKEN = re.compile(r"[^\W_]+(?:[@$!*0-9]+[^\W_]+)*")
LOOKALIKES = str.maketrans("0134578@$!", "oieastbasi")  # digits and signs that stand for letters
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
REPORTING = frozenset("said says wrote called quote quoted citation dit dijo sagte schrieb".split())
CONTEXT = 40  # characters looked at on either side of a term


@dataclass
class Lexicon:
    """Terms with their log odds. A stem stands for all words that begin with it."""

    words: dict[str, float]
    stems: dict[str, float]


def edits(term: str, stem: bool) -> int:
    """Edits that a term may be away: none for short terms and stems, whose neighbourhoods are full of other words.

    Terms under a stem stand in the lexicon beside it, so that a short stem takes nothing from their own edits.
    """
    if stem:
        return 1 if len(term) >= 8 else 0
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


@dataclass
class Automaton:
    """Trie of the lexicon times the Levenshtein automata of its terms, made deterministic as tokens ask for states.

    A state is the set of (trie node, edits spent) that spelled the token so far, without those that another one covers.
    The end of a stem also leads to a node of its own, its tail, where any letters may follow; terms go on from the end.
    """

    lexicon: Lexicon
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[tuple[str, bool] | None] = field(default_factory=lambda: [None])
    budget: list[int] = field(default_factory=lambda: [0])
    tails: dict[int, int] = field(default_factory=dict)
    steps: dict[tuple[frozenset, str], frozenset] = field(default_factory=dict)
    found: dict[str, tuple[str, int, bool]] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)  # tokens known not to match

    def __post_init__(self) -> None:
        for terms, stem in ((self.lexicon.words, False), (self.lexicon.stems, True)):
            for term in sorted(terms):
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = self._new()
                    self.budget[node] = max(self.budget[node], edits(term, stem))
                    node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits(term, stem))
                if stem:
                    self.tails[node] = node = self._new()
                    self.budget[node] = edits(term, stem)
                self.ends[node] = (term, stem)
        self.start = self._closed({0: 0})

    def _new(self) -> int:
        self.children.append({})
        self.ends.append(None)
        self.budget.append(0)
        return len(self.children) - 1

    def _closed(self, reached: dict[int, int]) -> frozenset:
        """Letters of a term that the token leaves out cost one edit each; the tail of a stem costs nothing."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            tail = self.tails.get(node)
            if tail is not None and e <= self.budget[tail] and e < reached.get(tail, 9):
                reached[tail] = e
            for child in self.children[node].values():
                if e < self.budget[child] and e + 1 < reached.get(child, 9):
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(reached.items())

    def step(self, state: frozenset, c: str) -> frozenset:
        key = (state, c)
        if key not in self.steps:
            out: dict[int, int] = {}
            for node, e in state:
                end = self.ends[node]
                moves = [(node, e)] if end and end[1] else []  # in a tail
                moves += [(n, e + (x != c)) for x, n in self.children[node].items()]  # the letter, or another one for it
                moves.append((node, e + 1))  # one letter too many
                for n, cost in moves:
                    if cost <= self.budget[n] and cost < out.get(n, 9):
                        out[n] = cost
            self.steps[key] = self._closed(out)
        return self.steps[key]

    def match(self, token: str) -> tuple[str, int, bool] | None:
        """(term, edits, is stem) of the nearest term, a word before a stem, or None.

        A token with digits or signs is tried as letters too.
        """
        if token in self.clean:
            return None
        if token not in self.found:
            hit = self._nearest(token)
            if hit is None and not token.isalpha():
                plain = token.translate(LOOKALIKES)
                hit = self._nearest(plain) if plain != token else None
                hit = (hit[0], hit[1] + 1, hit[2]) if hit else None
            if hit is None:
                if len(self.clean) > 400_000:  # a cache only: a token that went is worked out again
                    self.clean.clear()
                self.clean.add(token)
                return None
            self.found[token] = hit
        return self.found[token]

    def _nearest(self, token: str) -> tuple[str, int, bool] | None:
        state = self.start
        for c in token:
            state = self.step(state, c)
            if not state:
                return None
        best = min(((e, *self.ends[n][::-1]) for n, e in state if self.ends[n] and e <= edits(*self.ends[n])), default=None)
        return (best[2], best[0], best[1]) if best else None


FEATURES = ("terms", "misspelled", "quoted", "share", "weight")


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches between quotation marks of one line, of any length."""
    out = []
    for a, b in QUOTES.items():
        if a in text:
            out += [m.span() for m in re.finditer(f"{re.escape(a)}[^{re.escape(a + b)}\n]+{re.escape(b)}", text)]
    return sorted(out)


def findings(text: str, automaton: Automaton) -> Iterator[tuple[int, int, str, int, bool, bool]]:
    """(start, stop, term, edits, quoted, is stem) of every term, misspelled ones included, in the whole text."""
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    fresh = set(TOKEN.findall(lowered)) - automaton.clean
    hits = {t: hit for t in fresh if (hit := automaton.match(t))}
    if not hits:
        return
    quotes, at = quoted_spans(lowered), 0
    for m in TOKEN.finditer(lowered):
        hit = hits.get(m.group())
        if hit is None:
            continue
        while at < len(quotes) and quotes[at][1] < m.end():
            at += 1
        inside = at < len(quotes) and quotes[at][0] < m.start()
        told = not REPORTING.isdisjoint(TOKEN.findall(lowered, max(0, m.start() - CONTEXT), m.start()))
        yield m.start(), m.end(), hit[0], hit[1], inside or told, hit[2]


def features(text: str, automaton: Automaton) -> list[float]:
    plain = wrong = quoted = 0
    weight = 0.0
    odds = automaton.lexicon
    for _, _, term, e, told, stem in findings(text, automaton):
        if told:
            quoted += 1
        elif e:
            wrong += 1
        else:
            plain += 1
            weight = max(weight, (odds.stems if stem else odds.words)[term])
    share = 100 * (plain + wrong) / (1 + len(text) / 6)
    return [np.log1p(plain), np.log1p(wrong), np.log1p(quoted), np.log1p(share), weight / 4]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    coef: np.ndarray  # of FEATURES, then the intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coef[:-1] + self.coef[-1], -30, 30)))


def learn_lexicon(sample: DataFrame, min_docs: int = 5, odds: float = 3.0, size: int = 5000) -> Lexicon:
    """Words and stems much likelier in toxic documents, from (doc_id, text, toxic).

    A word qualifies by its smoothed log odds over documents. A prefix of 4 to 10 letters with at least four words, none
    of them a qualified word, is a stem; it is taken as long as it holds nearly all of what its shorter form holds. Words
    stay beside their stems. At most ``size`` of each, the most telling first.
    """
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+", -1))
    words = stored(
        sample.select("toxic", F.explode(tokens).alias("w")).where(F.length("w").between(3, 40)).groupBy("w").agg(
            F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxic-words")
    n = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, clean = (n[0] or 0), (n[1] or 0)
    if not toxic or not clean:
        return Lexicon({}, {})
    score = F.log((F.col("t") + 0.1) / toxic) - F.log((F.col("c") + 0.1) / clean)
    telling = (F.col("t") >= min_docs) & (score >= odds) & (F.col("t") > 4 * F.col("c"))
    found = words.where(telling).select("w", "t", score.alias("s")).orderBy(F.desc(F.col("t") * F.col("s")), "w").limit(size).collect()
    cut = F.explode(F.transform(F.sequence(F.lit(4), F.least(F.length("w"), F.lit(10))), lambda k: F.left(F.col("w"), k)))
    stems = words.where(F.length("w") >= 4).select("t", "c", cut.alias("w")).groupBy("w").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("forms"))
    some = stems.where(telling & (F.col("forms") >= 4)).select("w", "t", score.alias("s")).orderBy(
        F.desc(F.col("t") * F.col("s")), "w").limit(size).collect()
    held = {r["w"]: (r["t"], r["s"]) for r in some}
    chosen: dict[str, float] = {}
    for stem in sorted(held, key=lambda w: (len(w), w)):
        if any(stem[:k] in held for k in range(4, len(stem))):
            continue  # a longer form of one that is looked at already
        best = stem
        while True:
            longer = [w for w in held if len(w) == len(best) + 1 and w.startswith(best) and held[w][0] >= 0.9 * held[best][0]]
            if not longer:
                break
            best = max(longer, key=lambda w: held[w][0])
        chosen[best] = float(held[best][1])
    return Lexicon({r["w"]: float(r["s"]) for r in found}, chosen)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, seed_weight: float = 1.0) -> ToxicityModel:
    """Learn from about ``rows`` labelled documents outside the held-out fold, chosen by hash.

    Labels of one doc_id that disagree count as toxic if any does. The weights start from a prior (a term in the open
    counts, a quoted one a little) and are fitted by ridge-penalised logistic regression towards it.
    """
    known = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).where((fold(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1))
    chosen = known.where(training_share(known.count(), rows))
    texts = pick(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    sample = stored(texts.join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"), "toxic-sample")
    lexicon = learn_lexicon(sample)
    prior = np.array([2.5, 1.5, 0.3, 1.0, 1.5, -4.0])
    model = ToxicityModel(lexicon, prior.copy())

    def start():
        automaton = Automaton(lexicon)
        return lambda text: tuple(round(float(v), 3) for v in features(text, automaton))

    counted = add_columns(sample.select("toxic", "text"), ", ".join(f"{f} double" for f in FEATURES), start)
    grouped = counted.groupBy(*FEATURES, "toxic").agg(F.count(F.lit(1)).alias("n"))
    table = np.array([[float(v) for v in r] for r in grouped.collect()]).reshape(-1, len(FEATURES) + 2)
    table = table[np.lexsort(table.T)]
    if len(table) and 0 < (table[:, -2] * table[:, -1]).sum() < table[:, -1].sum():
        x = np.hstack([table[:, :len(FEATURES)], np.ones((len(table), 1))])
        y, n, w = table[:, -2], table[:, -1], prior.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (p - y)) + seed_weight * (w - prior)
            h = (x * (n * p * (1 - p))[:, None]).T @ x + seed_weight * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-8:
                break
        model.coef = w
    return model


def toxicity(docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, score, terms, misspelled, quoted): every row of ``docs``, scored from its text alone.

    Null and empty texts get the score of a text without findings. Counts are of findings in the whole text.
    """
    def start():
        automaton = Automaton(model.lexicon)

        def one(text: str) -> tuple:
            x = np.array(features(text, automaton))
            return float(model.score(x)), *(int(v) for v in np.rint(np.expm1(x[:3])))

        return one

    rows = pick(docs, "doc_id", "text", *[c for c in carry if c != "text"])
    return add_columns(rows, "score double, terms long, misspelled long, quoted long", start, keep_text="text" in carry)
