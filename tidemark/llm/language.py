"""Language ID by words first, backing off to shorter and shorter character n-grams for words never seen."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns, fold, pick, training_share
from tidemark.sources.tables import stored

TOKEN = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
NOTHING = "und"


@dataclass
class LanguageModel:
    """Log frequencies per language, as rows less their mean over languages; the prior is left out on purpose."""

    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def _centred(counts: np.ndarray, totals: np.ndarray, kinds: int) -> np.ndarray:
    logs = np.log(counts + 0.5) - np.log(totals + 0.5 * kinds)
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def _table(counted: DataFrame, key: str, langs: list[str], size: int) -> tuple[dict[str, int], np.ndarray]:
    """The ``size`` most frequent keys with their scores; ties by key."""
    totals = {r["lang"]: float(r["n"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    per_key = counted.groupBy(key).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = per_key.orderBy(F.desc("n"), key).limit(size).collect()
    counts = np.array([[float(r["by"].get(g, 0)) for g in langs] for r in top]).reshape(-1, len(langs))
    return {r[key]: i for i, r in enumerate(top)}, _centred(counts, np.array([totals.get(g, 0.0) for g in langs]), max(1, len(top)))


def fit(docs: DataFrame, rows: int = 20_000, words: int = 60_000, grams: int = 40_000) -> LanguageModel:
    """Learn from about ``rows`` documents with a language outside the held-out fold, chosen by hash.

    The tables keep the most frequent ``words`` and n-``grams``, so the model's size has a bound. A word seen once is not a
    known word; it only adds to the n-grams. Null ids train too: they are in no held-out fold.
    """
    known = pick(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = known.where(training_share(known.count(), rows))
    token = F.explode(F.split(F.lower("text"), r"[^\p{L}]+", -1)).alias("word")
    counted = stored(chosen.select("lang", token).where((F.col("word") != "") & (F.length("word") <= 40)).groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n")), "language-words")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    seen = counted.groupBy("word").agg(F.sum("n").alias("all")).where("all > 1").select("word")
    word_index, word_scores = _table(counted.join(seen, "word"), "word", langs, words)
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("padded") - (k - 1), F.lit(1))),
                                   lambda i: F.substring(F.col("padded"), i, F.lit(k)))
    pieces = counted.withColumn("padded", padded).select("lang", F.explode(F.concat(*[starts(k) for k in ORDERS])).alias("gram"), "n")
    gram_counts = stored(pieces.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    gram_index, gram_scores = _table(gram_counts, "gram", langs, grams)
    return LanguageModel(langs, word_index, word_scores, gram_index, gram_scores)


class Scorer:
    """Scores texts; keeps the vectors of unseen words it has met, up to a number."""

    def __init__(self, model: LanguageModel, memory: int = 200_000) -> None:
        self.model, self.memory = model, memory
        self.unseen: dict[str, np.ndarray] = {}

    def back_off(self, word: str) -> np.ndarray:
        """The mean score of the longest n-grams that any of are known; zeros if not even a letter is."""
        if word not in self.unseen:
            padded, grams = f"^{word}$", self.model.grams
            vector = np.zeros(len(self.model.langs), np.float32)
            for k in ORDERS:
                rows = [r for i in range(len(padded) - k + 1) if (r := grams.get(padded[i:i + k])) is not None]
                if rows:
                    vector = self.model.gram_scores[rows].mean(axis=0)
                    break
            if len(self.unseen) >= self.memory:  # a cache only
                self.unseen.clear()
            self.unseen[word] = vector
        return self.unseen[word]

    def __call__(self, text: str) -> tuple[str, float]:
        counts = Counter(TOKEN.findall(text.lower()))
        if not self.model.langs or not any(w.isalpha() for w in counts) and not any(c.isalpha() for c in text):
            return NOTHING, 0.0
        known, n, total = [], [], np.zeros(len(self.model.langs))
        index = self.model.words
        for word, c in counts.items():
            row = index.get(word)
            if row is None:
                total += c * self.back_off(word if len(word) <= 200 else word[:100] + word[-100:])
            else:
                known.append(row)
                n.append(c)
        if known:
            total += np.array(n, np.float64) @ self.model.word_scores[known]
        words = max(1, sum(counts.values()))
        evidence = total * (min(words, 30) / words)  # thirty words are as sure as any number
        p = np.exp(evidence - evidence.max())
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best] / p.sum())


def detect(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, lang_pred, score): every row of ``docs``, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned. Equal
    scores go to the language first in order. Score is the share of the best language, 0 to 1.
    """
    rows = pick(docs, "doc_id", "text", *[c for c in carry if c != "text"])
    return add_columns(rows, "lang_pred string, score double", lambda: Scorer(model), keep_text="text" in carry)
