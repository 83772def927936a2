"""Secret scans: fixed patterns, and a small character convolution that judges every other candidate in its context."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import ALL_ROWS, pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "learned")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
EDGE = ".-"  # punctuation that may stand around a candidate

LEFT, RIGHT = 28, 6  # characters of context
SYMBOLS = 98  # 0: anything else, 1 to 95: printable ASCII, 96 and 97: where the candidate begins and ends
BEGIN, END = 96, 97
WIDTH, FILTERS, PIECE = 5, 16, 4096
BATCH, CELLS = 1024, 2 ** 16  # candidates and symbols judged together
PLAIN, FORMS, RATE = 512, 64, 0.01  # a training step: ordinary candidates, forms of secrets, length
TASK, BLOCK, FEW = 10_000_000, 1_000_000, 50_000_000  # characters: of a learning task, looked at together, gone through once
BINS, LIMIT = 128, 64  # logits are counted in steps of 1 / BINS up to LIMIT
SHAPES = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789",
          "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
CODES = np.array([i - 31 if 32 <= i < 127 else 0 for i in range(128)], np.uint8)
IN_STRING = np.array([CANDIDATE.fullmatch(chr(i + 31) * 8) is not None for i in range(SYMBOLS)], np.int8)
INSIDE = np.array([bool(x) and chr(i + 31) not in EDGE for i, x in enumerate(IN_STRING)])
ANNOUNCED = ("password", "passwd", "secret", "token", "apikey", "api_key")
LETTERS = tuple(np.frombuffer(x.encode(), np.uint8) - 31 for x in SHAPES)

Span = tuple[int, str, int]


def base_spans(text: str, long_strings: bool = True) -> list[Span]:
    """(start, kind, stop), leftmost and not overlapping within a kind; matches that fail are dropped, not retried.

    ``long_strings`` may be false where it is known that no 32 characters of candidates stand together.
    """
    lower, out = text.lower(), []
    if any(word in lower for word in ANNOUNCED):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if long_strings:
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def body_of(text: str, span: Span) -> tuple[int, int]:
    """The secret itself: of an assignment what stands behind the sign, else the whole span."""
    start, kind, stop = span
    return ASSIGN.match(text, start).span(2) if kind == "assign" else (start, stop)


def _strings(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all strings of 8 and more characters in symbols, punctuation at their ends left off, and their
    lengths with it."""
    bounds = np.flatnonzero(np.diff(IN_STRING[codes])) + 1 - LEFT
    starts, stops = bounds[::2], bounds[1::2]
    some = stops - starts >= 8
    starts, stops = starts[some], stops[some]
    whole = stops - starts
    inner = np.append(np.flatnonzero(INSIDE[codes]) - LEFT, len(codes))
    first, last = np.searchsorted(inner, starts), np.searchsorted(inner, stops)
    starts, stops = inner[first], inner[last - 1] + 1
    some = (first < last) & (stops - starts >= 8)
    return starts[some], stops[some], whole[some]


def _apart(starts: np.ndarray, stops: np.ndarray, base: list[Span]) -> np.ndarray:
    """Which of them touch no base span."""
    before = np.searchsorted([b[0] for b in base], stops)
    reach = np.maximum.accumulate([0] + [b[2] for b in base])
    return reach[before] <= starts


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Strings of 8 and more characters, of whatever kind, that touch no base span. Punctuation at their ends is left off."""
    starts, stops, _ = _strings(symbols(text))
    some = _apart(starts, stops, base)
    return list(zip(starts[some].tolist(), stops[some].tolist()))


def symbols(text: str) -> np.ndarray:
    """One code per code point, with empty context on both sides."""
    if text.isascii():
        points = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)
    out = np.zeros(LEFT + len(points) + RIGHT, np.uint8)
    out[LEFT:LEFT + len(points)] = CODES[points]
    return out


@dataclass
class _Texts:
    """Some texts: their joined symbols, where each begins in them, its base spans, and all candidates with their text.

    Places of candidates count from the first symbol; those of base spans from their text.
    """

    codes: np.ndarray
    begins: np.ndarray
    base: list[list[Span]]
    starts: np.ndarray
    stops: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> _Texts:
        parts = [symbols(t) for t in texts]
        begins = np.cumsum([0] + [len(x) for x in parts])[:-1]
        codes = np.concatenate(parts)
        starts, stops, whole = _strings(codes)
        owner = np.searchsorted(begins, starts, "right") - 1
        long = set(owner[whole >= 32].tolist())
        base = [base_spans(t, i in long) for i, t in enumerate(texts)]
        keep = np.ones(len(starts), bool)
        for i, b in enumerate(base):
            if b:
                mine = slice(*np.searchsorted(owner, [i, i + 1]))
                keep[mine] = _apart(starts[mine] - begins[i], stops[mine] - begins[i], b)
        return cls(codes, begins, base, starts[keep], stops[keep], owner[keep])


def encode(codes: np.ndarray, start: int, stop: int, context: bool = True) -> np.ndarray:
    """The whole candidate between marks and its context; without context only the marks remain around it.

    ``codes`` are a text's symbols, ``start`` and ``stop`` its own offsets.
    """
    left, body, right = codes[start:start + LEFT], codes[start + LEFT:stop + LEFT], codes[stop + LEFT:stop + LEFT + RIGHT]
    if not context:
        left, right = np.zeros_like(left), np.zeros_like(right)
    return np.concatenate([left, [BEGIN], body, [END], right]).astype(np.uint8)


@dataclass
class SecretModel:
    """One convolution over one-hot characters, the maximum over all places, one dense layer, and a calibration."""

    kernel: np.ndarray  # WIDTH x SYMBOLS x FILTERS
    bias: np.ndarray
    dense: np.ndarray  # FILTERS, then the intercept
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1  # nothing passes until trained

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What two neighbouring symbols add to a window, so that a window takes three look-ups."""
        k = self.kernel
        return ((k[0][:, None] + k[1] + self.bias).reshape(-1, FILTERS), (k[2][:, None] + k[3]).reshape(-1, FILTERS), k[4])

    def peaks(self, codes: np.ndarray, lengths: np.ndarray, tables: tuple, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Highest activation of each filter and, if asked for, its place. A column a sample; long ones go piece by piece."""
        width, n = codes.shape
        best, where = np.full((n, FILTERS), -np.inf, np.float32), np.zeros((n, FILTERS), np.int64)
        for a in range(0, width - WIDTH + 1, PIECE):
            part = codes[a:a + PIECE + WIDTH - 1].astype(np.intp)
            w = len(part) - WIDTH + 1
            pairs = part[:-1] * SYMBOLS + part[1:]
            x = tables[0].take(pairs[:w], axis=0)
            x += tables[1].take(pairs[2:w + 2], axis=0)
            x += tables[2].take(part[4:], axis=0)
            over = np.arange(a, a + w)[:, None] > lengths - WIDTH  # windows that hang over the end
            if over.any():
                x[over] = -np.inf
            if places:
                top = x.argmax(axis=0)
                v = np.take_along_axis(x, top[None], axis=0)[0]
                where = np.where(v > best, top + a, where)
            else:
                v = x.max(axis=0)
            best = np.maximum(best, v)
        return best, where

    def pooled(self, samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Highest activation of each filter and its place, for samples of any lengths."""
        return self.peaks(*_side_by_side(samples), self.tables(), places=True)

    def logits(self, samples: list[np.ndarray]) -> np.ndarray:
        """One number per sample; neighbours in length are worked on together."""
        out, tables = np.empty(len(samples)), self.tables()
        for some in _alike(np.array([len(x) for x in samples])):
            out[some] = self.score(*_side_by_side([samples[i] for i in some]), tables)
        return out

    def logits_at(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The same for candidates that stand in ``codes``."""
        out, tables = np.empty(len(starts)), self.tables()
        for some in _alike(stops - starts + LEFT + RIGHT + 2):
            out[some] = self.score(*_cut_out(codes, starts[some], stops[some], context[some]), tables)
        return out

    def score(self, codes: np.ndarray, lengths: np.ndarray, tables: tuple) -> np.ndarray:
        return np.maximum(self.peaks(codes, lengths, tables)[0], 0) @ self.dense[:-1] + self.dense[-1]

    def probabilities(self, samples: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(samples) + self.shift) if samples else np.empty(0)


def _alike(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Samples by falling length, as many at a time as fit a block of ``CELLS`` symbols."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, min(BATCH, CELLS // int(lengths[order[at]])))
        yield order[at:at + rows]
        at += rows


def _side_by_side(samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with a column a sample, lengths)."""
    lengths = np.array([len(x) for x in samples])
    codes = np.zeros((int(lengths.max()), len(samples)), np.uint8)
    for i, x in enumerate(samples):
        codes[:len(x), i] = x
    return codes, lengths


def _cut_out(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``encode`` makes of many candidates, side by side."""
    size = stops - starts
    lengths = size + LEFT + RIGHT + 2
    j = np.arange(int(lengths.max()))[:, None]
    behind = j > LEFT + 1 + size
    out = codes[np.minimum(starts + j - (j > LEFT) - behind, len(codes) - 1)]
    out[LEFT] = BEGIN
    out[LEFT + 1 + size, np.arange(len(size))] = END
    out[:LEFT, ~context] = 0
    out[(behind & ~context) | (j >= lengths)] = 0
    return out, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Adam:
    """Steps of one task. Both labels weigh the same in a step; the gradient reaches only the window that won each filter."""

    def __init__(self, model: SecretModel, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.params = [model.kernel, model.bias, model.dense]
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def step(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """``parts`` are symbols side by side, lengths, labels and weights."""
        model, tables = self.model, self.model.tables()
        grads = [np.zeros((WIDTH, SYMBOLS * FILTERS)), np.zeros(FILTERS), np.zeros(FILTERS + 1)]
        for codes, lengths, truth, weight in parts:
            best, where = model.peaks(codes, lengths, tables, places=True)
            hidden = np.maximum(best, 0)
            g = (_sigmoid(hidden @ model.dense[:-1] + model.dense[-1]) - truth) * weight
            back = np.where(best > 0, g[:, None] * model.dense[:-1], 0)
            grads[1] += back.sum(axis=0)
            grads[2] += np.append(g @ hidden, g.sum())
            for k in range(WIDTH):
                seen = codes[where + k, np.arange(len(g))[:, None]].astype(np.intp) * FILTERS + np.arange(FILTERS)
                grads[0][k] += np.bincount(seen.ravel(), back.ravel(), SYMBOLS * FILTERS)
        grads[0] = grads[0].reshape(model.kernel.shape)
        self.t += 1
        for p, g_, m, v in zip(self.params, grads, self.first, self.second):
            g_ = (g_ + 1e-4 * p).astype(np.float32)
            m += 0.1 * (g_ - m)
            v += 0.001 * (g_ * g_ - v)
            p -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def _untrained(seed: int) -> SecretModel:
    rng = np.random.default_rng(seed)
    start = [rng.normal(0, 0.15, (WIDTH, SYMBOLS, FILTERS)), np.zeros(FILTERS), np.append(rng.normal(0, 0.2, FILTERS), 0.0)]
    return SecretModel(*[p.astype(np.float32) for p in start])


def _train(samples: list[np.ndarray], truth: np.ndarray, epochs: int, seed: int) -> SecretModel:
    """Mini-batches of given samples."""
    rng, model = np.random.default_rng(seed), _untrained(seed)
    adam = _Adam(model, RATE)
    weight = np.where(truth == 1, len(truth) / (2 * truth.sum()), len(truth) / (2 * (1 - truth).sum()))
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), 64):
            some = order[at:at + 64]
            adam.step([(*_side_by_side([samples[i] for i in some]), truth[some], weight[some] / len(some))])
    return model


def _binned(logits: np.ndarray) -> np.ndarray:
    return np.round(np.clip(logits, -LIMIT, LIMIT) * BINS).astype(np.int64)


def _calibrate(model: SecretModel, samples: list[np.ndarray], truth: np.ndarray, recall: float) -> None:
    bins, at = np.unique(_binned(model.logits(samples)), return_inverse=True)
    _settle(model, bins, np.bincount(at, truth, len(bins)), np.bincount(at, 1 - truth, len(bins)), recall)


def _settle(model: SecretModel, bins: np.ndarray, secrets: np.ndarray, others: np.ndarray, recall: float) -> None:
    """Platt scaling on rows not trained on, then the most precise threshold that keeps ``recall`` of their secrets.

    The rows come as how many secrets and others have which logit, in steps of 1 / BINS.
    """
    logits = bins / BINS
    w, n = np.array([1.0, 0.0]), secrets + others
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (n * p - secrets) + 0.1 * (w - [1.0, 0.0]))
        w -= step / max(1.0, np.abs(step).max())
    model.scale, model.shift = float(w[0]), float(w[1])
    p = _sigmoid(x @ w)
    order = np.argsort(-p, kind="stable")
    caught, seen = np.cumsum(secrets[order]), np.cumsum(n[order])
    allowed = np.flatnonzero(caught >= recall * secrets.sum())
    best = max(allowed, key=lambda i: (caught[i] / seen[i], caught[i]))  # most precise, then most complete
    below = p[order[best + 1]] if best + 1 < len(p) else 0.0
    model.threshold = float(p[order[best]] + below) / 2


def _varied(body: int, rng: np.random.Generator) -> np.ndarray:
    """A secret in another alphabet and of another length than ``body``, as keys of other makers are."""
    letters = LETTERS[rng.integers(len(LETTERS))]
    return letters[rng.integers(len(letters), size=int(rng.integers(8, max(body, 24) + 1)))]


@dataclass
class _Findings:
    """What stands in some texts: offsets in their joined symbols, and which of three parts each falls into."""

    codes: np.ndarray
    spans: tuple[np.ndarray, np.ndarray]  # of others and of secrets: start, stop, part, a number to choose by

    def form(self, i: int, varied: bool, rng: np.random.Generator) -> np.ndarray:
        """Secret ``i``, or one like it, in its own context, in none, or where another candidate stands."""
        start, stop = at = self.spans[1][i, :2]
        place = rng.integers(3)
        if place == 2 and len(self.spans[0]):
            at = self.spans[0][rng.integers(len(self.spans[0])), :2]
        body = _varied(stop - start, rng) if varied else self.codes[start + LEFT:stop + LEFT]
        left, right = self.codes[at[0]:at[0] + LEFT], self.codes[at[1] + LEFT:at[1] + LEFT + RIGHT]
        if place == 1:
            left, right = np.zeros_like(left), np.zeros_like(right)
        return np.concatenate([left, [BEGIN], body, [END], right]).astype(np.uint8)


def _findings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Findings]:
    """Findings of the texts, with about ``most`` characters of texts at a time.

    The fixed patterns label them: what their spans hold are secrets, all other candidates are not. The findings of a text
    go to the three parts in turn, beginning at one that its checksum names.
    """
    codes, spans, size = [], ([], []), 0

    def ready() -> _Findings:
        return _Findings(np.concatenate(codes), tuple(np.concatenate([np.empty((0, 4), np.int64), *s]) for s in spans))

    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            texts = whole.slice(at, 64).column("text").to_pylist()
            some = _Texts.of(texts)
            turns = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            rank = np.arange(len(some.owner)) - np.searchsorted(some.owner, some.owner)
            n = turns[some.owner] + rank
            spans[0].append(np.column_stack([some.starts + size, some.stops + size, n % 3, n // 3]))
            for text, base, turn, begin in zip(texts, some.base, turns, some.begins + size):
                if base:  # a body that two patterns find is one finding
                    bodies = np.array(sorted({body_of(text, b) for b in base}), np.int64) + begin
                    n = turn + np.arange(len(bodies))
                    spans[1].append(np.column_stack([bodies, n % 3, n // 3]))
            codes.append(some.codes)
            size += len(some.codes)
            if size >= most:
                yield ready()
                codes, spans, size = [], ([], []), 0
    if codes:
        yield ready()


def _learn(model: SecretModel, found: _Findings, use: tuple[np.ndarray, np.ndarray], rate: float, rng: np.random.Generator) -> None:
    """One pass over the ordinary candidates in random order; every step also takes its share of forms of the secrets."""
    plain, secret = found.spans[0][use[0]], np.flatnonzero(use[1])
    adam, queue = _Adam(model, rate), []
    order = rng.permutation(len(plain))
    for at in range(0, max(len(order), len(secret) and 1), PLAIN):
        parts = []
        some = plain[order[at:at + PLAIN]]
        context = rng.integers(2, size=len(some)) == 0
        for part in _alike(some[:, 1] - some[:, 0] + LEFT + RIGHT + 2) if len(some) else ():
            one = some[part]
            parts.append((*_cut_out(found.codes, one[:, 0], one[:, 1], context[part]), 0.0, 0.5 / len(some)))
        if len(secret):
            forms = []
            while len(forms) < FORMS:
                queue = queue or list(rng.permutation(secret))
                forms.append(found.form(queue.pop(), rng.random() < 2 / 3, rng))
            parts += [(*_side_by_side([forms[i] for i in part]), 1.0, 0.5 / FORMS) for part in _alike(np.array([len(x) for x in forms]))]
        adam.step(parts)


def _averaged(rows: DataFrame, model: SecretModel, both: tuple[bool, bool], totals: tuple[int, int], rate: float, seed: int) -> tuple[SecretModel, int]:
    """Each task goes on from ``model`` with its own rows; the mean of what they reach, and how many secrets they saw.

    A task weighs by its shares of the secrets and of the others, which weigh the same in all. Sums are of whole numbers, so that their
    order does not matter.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        mine = SecretModel(model.kernel.copy(), model.bias.copy(), model.dense.copy())
        seen = [0, 0]
        for found in _findings(batches, TASK):
            use = tuple((s[:, 2] > 0) | b for s, b in zip(found.spans, both))
            _learn(mine, found, use, rate, rng)
            seen = [n + int(u.sum()) for n, u in zip(seen, use)]
        if any(seen):
            weight = seen[0] / totals[0] + seen[1] / totals[1]
            values = np.concatenate([mine.kernel.ravel(), mine.bias, mine.dense, [1.0]]).astype(np.float64) * weight
            whole = np.append(np.round(values * 2.0 ** 40).astype(np.int64), seen[1])
            yield pa.RecordBatch.from_arrays([pa.array([whole.tolist()], pa.list_(pa.int64()))], names=["reached"])

    sums = rows.mapInArrow(work, "reached array<long>").select(F.posexplode("reached").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    got = np.array([r["v"] for r in sums.orderBy("i").collect()], np.float64)
    if not len(got):
        return model, 0
    mean = (got[:-2] / got[-2]).astype(np.float32)
    k = WIDTH * SYMBOLS * FILTERS
    return SecretModel(mean[:k].reshape(WIDTH, SYMBOLS, FILTERS), mean[k:k + FILTERS], mean[k + FILTERS:]), int(got[-1])


def fit(docs: DataFrame, recall: float = 0.98, epochs: int = 6, seed: int = 7) -> SecretModel:
    """Train on every candidate of every document; the fixed patterns label them.

    Each secret is also shown in other alphabets and lengths, without context, and where another candidate stands, so that
    the net learns what secrets look like and not only which words announce them. A third of either label is kept for the
    calibration and the threshold, shown the same way; a label too rare to have both parts serves for both whole. Only where
    there is no secret at all, or nothing else, is there nothing to learn, and only the fixed patterns count.

    Rows spread by hash over tasks of about ``TASK`` characters. A first task learns alone; then each round takes as many new
    rows as all before it, its tasks go on from the mean of the last round, and every row is learned from once. Few texts are gone
    through up to ``epochs`` times.
    """
    texts = pick(docs, "doc_id", "text").where(F.col("text").isNotNull())
    texts = texts.select("text", F.xxhash64(F.lit("fit"), "doc_id", "text").alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2), np.int64)
        chars = 0
        for found in _findings(batches, BLOCK):
            chars += len(found.codes)
            for y, s in enumerate(found.spans):
                n[y] += [(s[:, 2] > 0).sum(), (s[:, 2] == 0).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (chars, *n.ravel())], names=list("cpqst"))

    row = texts.mapInArrow(count, "c long, p long, q long, s long, t long").agg(*[F.sum(c).alias(c) for c in "cpqst"]).first()
    chars, *n = [x or 0 for x in row]
    parts = ((n[0], n[1]), (n[2], n[3]))
    if not all(sum(p) for p in parts):
        return SecretModel(np.zeros((WIDTH, SYMBOLS, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS + 1, np.float32))
    both = tuple(not all(p) for p in parts)
    totals = tuple(sum(p) if b else p[0] for p, b in zip(parts, both))

    model, turn = _untrained(seed), 0
    for _ in range(max(1, min(epochs, -(-FEW // chars)))):
        low, high = 0.0, min(1.0, TASK / chars)
        while low < 1:
            place = F.col("h").bitwiseAND(F.lit(ALL_ROWS))
            mine = texts.where(place >= F.lit(int(ALL_ROWS * low)))
            mine = mine.where(place < F.lit(int(ALL_ROWS * high))) if high < 1 else mine
            spread = mine.repartition(max(1, round((high - low) * chars / TASK)), "h").sortWithinPartitions("h", "text")
            reached, secrets = _averaged(spread, model, both, totals, RATE * max(0.7 ** turn, 0.1), seed + turn)
            turn += 1
            if secrets or high == 1:  # without secrets the round is taken again with more rows
                model, low = reached, high
            high = min(1.0, 2 * high)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2 * LIMIT * BINS + 1), np.int64)
        for found in _findings(batches, BLOCK):
            use = [(s[:, 2] == 0) | b for s, b in zip(found.spans, both)]
            plain = found.spans[0][use[0]]
            if len(plain):
                logits = model.logits_at(found.codes, plain[:, 0], plain[:, 1], plain[:, 3] % 2 == 0)
                n[0] += np.bincount(_binned(logits) + LIMIT * BINS, minlength=n.shape[1])
            forms = []
            for i in np.flatnonzero(use[1]):
                rng = np.random.default_rng([seed, *found.spans[1][i, 3:].tolist()])
                forms += [found.form(i, k > 2, rng) for k in range(9)]
            if forms:
                n[1] += np.bincount(_binned(model.logits(forms)) + LIMIT * BINS, minlength=n.shape[1])
        y, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (y, at - LIMIT * BINS, n[y, at])], names=["y", "bin", "n"])

    counted = texts.mapInArrow(judge, "y long, bin long, n long").groupBy("bin").agg(
        *[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(name) for y, name in ((1, "secrets"), (0, "others"))])
    got = np.array([tuple(r) for r in counted.orderBy("bin").collect()], np.float64)
    _settle(model, got[:, 0], got[:, 1], got[:, 2], recall)
    return model


def scan(docs: DataFrame, model: SecretModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, spans): every row with its spans (start, kind, stop, score), by start, then kind.

    Every string of 8 and more characters is judged by the network, with its context: ``score`` is the probability that it
    is a secret. Spans of the fixed patterns always stay, whatever their score; ``learned`` spans are candidates outside
    them that reach the model's threshold. Null text is empty; a row without secrets has an empty list; repeated rows are
    scanned each. Texts and candidates of any length are judged whole, long candidates piece by piece. Places are code
    points.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                some = _Texts.of([t or "" for t in b.column("text").to_pylist()])
                found: list[list[dict]] = [[] for _ in range(b.num_rows)]

                def judged(starts: np.ndarray, stops: np.ndarray, codes: np.ndarray = some.codes) -> np.ndarray:
                    return _sigmoid(model.scale * model.logits_at(codes, starts, stops, np.ones(len(starts), bool)) + model.shift)

                spans = [(i, s) for i, base in enumerate(some.base) for s in base]
                if spans:
                    texts = b.column("text")
                    bodies = np.array([body_of(texts[i].as_py(), s) for i, s in spans]) + some.begins[[i for i, _ in spans], None]
                    for (i, (a, kind, stop)), p in zip(spans, judged(*bodies.T).tolist()):
                        found[i].append({"start": a, "kind": kind, "stop": stop, "score": p})
                if model.threshold <= 1:
                    scores = judged(some.starts, some.stops)
                    for n in np.flatnonzero(scores >= model.threshold):
                        i = some.owner[n]
                        a, stop = int(some.starts[n] - some.begins[i]), int(some.stops[n] - some.begins[i])
                        found[i].append({"start": a, "kind": "learned", "stop": stop, "score": float(scores[n])})
                for f in found:
                    f.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(found, kind_of)], names=[*kept, "spans"])

    names = ["doc_id", *[c for c in carry if c not in ("doc_id", "text")]]
    kept = [*names, "text"] if "text" in carry else names
    rows = pick(docs, *names, "text")
    added = StructType.fromDDL("spans array<struct<start long, kind string, stop long, score double>>")
    kind_of = to_arrow_schema(added).types[0]
    return rows.mapInArrow(work, StructType([*[rows.schema[n] for n in kept], *added]))
