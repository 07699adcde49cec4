"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its features are shares of character classes, length and repetition, of the line itself and of
its neighbours. Marginals by forward and backward recursion, weighted by line length, give the quality of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fold
from orrery.llm.learning import filtered, pieces, sample_texts, scored


@dataclass(frozen=True)
class Setting:
    """sample: labelled rows to fit on; chars: of each at most, else a stretch. folds, held_out: crc32 remainder never learned from."""

    sample: int = 5000
    chars: int = 40_000
    folds: int = 4
    held_out: int = 2
    steps: int = 150
    rate: float = 0.08
    decay: float = 1e-4
    threshold: float = 0.7


#: Byte classes: upper, digit, space, stop, symbol, beyond ASCII; the rest is lower case.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91] = 0
_CLASS[48:58] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>!@^_=+~{}/[]\\`"]] = 4
_CLASS[128:] = 5
#: log length, no words, class shares (6), repeated words, repeated neighbours, mean word length, seen before
N_OWN = 12
N_FEATURES = 3 * N_OWN + 3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte length of every line, and the number of lines of each text."""
    split = [t.split("\n") for t in texts]
    lines = [x for ls in split for x in ls]
    counts = np.array([len(ls) for ls in split])
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = (ends - starts).astype(float)
    kind = _CLASS[raw]
    shares = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) - (k == 2) for k in range(6)], 1) / np.maximum(n, 1)[:, None]
    own = np.zeros((len(lines), N_OWN), np.float32)
    own[:, 0] = np.log1p(n) / 5
    own[:, 2:8] = shares * 4
    own[:, 2] = np.minimum(own[:, 2], 4)
    word = np.zeros((len(lines), 4), np.float32)
    i = 0
    for ls in split:
        seen: set[str] = set()
        for x in ls:
            w = x.split()
            if w:
                word[i] = 1 - len(set(w)) / len(w), sum(map(str.__eq__, w, w[1:])) / len(w), len(w), x in seen
                seen.add(x)
            i += 1
    own[:, 1] = word[:, 2] == 0
    own[:, 8:10] = word[:, :2] * 2
    own[:, 10] = np.minimum(n / np.maximum(word[:, 2], 1), 20) / 10
    own[:, 11] = word[:, 3]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    last = np.cumsum(counts) - 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    edge = np.zeros((len(lines), 3), np.float32)
    edge[first, 0] = edge[last, 1] = edge[:, 2] = 1
    return np.concatenate((own, before, after, edge), 1), n + 1, counts


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines; where each begins; how many texts have a line at each step."""
    order = np.argsort(-counts, kind="stable")
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))[order]
    at = counts[order]
    active = np.searchsorted(-at, -np.arange(at[0] if len(at) else 0), side="left")
    return order, first, active


def marginals(emit: np.ndarray, move: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected moves, and the log of all texts' partition functions.

    emit: score of good against bad for each line; move: 2 x 2 scores of neighbouring labels. All texts advance together.
    """
    _, first, active = _steps(counts)
    e = np.stack((np.zeros_like(emit), emit), 1).astype(float)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    for t, n in enumerate(active):
        i = first[:n] + t
        alpha[i] = e[i] if t == 0 else e[i] + np.logaddexp(alpha[i - 1, :1] + move[0], alpha[i - 1, 1:] + move[1])
    for t in range(len(active) - 2, -1, -1):
        i = first[: active[t + 1]] + t
        x = e[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(x[:, :1] + move[:, 0], x[:, 1:] + move[:, 1])
    whole = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
    good = np.exp(alpha[:, 1] + beta[:, 1] - whole)
    inner = np.ones(len(emit), bool)
    inner[np.cumsum(counts) - 1] = False
    i = np.flatnonzero(inner)
    pair = alpha[i, :, None] + move[None] + (e[i + 1] + beta[i + 1])[:, None, :] - whole[i, None, None]
    return good, np.exp(pair).sum(0), float(whole[np.cumsum(counts) - 1].sum())


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def share(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of P(good) over the lines of each text, as log odds."""
        out = np.zeros(len(texts))
        for part in pieces(texts):
            x, n, counts = line_features(texts[part])
            good, _, _ = marginals(((x - self.mean) / self.spread) @ self.weights, self.move, counts)
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            out[part] = np.add.reduceat(good * n, starts) / np.add.reduceat(n, starts)
        out = np.clip(out, 1e-4, 1 - 1e-4)
        return np.log(out / (1 - out))

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.share(texts) + self.shift, -30, 30)))


def fit(texts: list[str], quality: np.ndarray, s: Setting = Setting()) -> Model:
    """Maximum likelihood with every line labelled as its text, by Adam; then two numbers map shares to odds of quality 1.

    Without texts, or with one label only, the model gives that label's share for everything.
    """
    y = np.asarray(quality, float)
    none = Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    if not len(y) or y.min() == y.max():
        none.slope, none.shift = 0.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return none
    parts = [line_features(texts[p]) for p in pieces(texts)]
    x, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    mean, spread = x.mean(0), x.std(0)
    mean[-1], spread[spread < 1e-6] = 0.0, 1.0
    x = (x - mean) / spread
    label = np.repeat(y, counts)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - 1] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner].astype(int), label[inner].astype(int)), 1)
    theta, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for t in range(1, s.steps + 1):
        w, move = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        good, moves, _ = marginals(x @ w, move, counts)
        grad = np.concatenate((x.T @ (good - label), (moves - seen).ravel())) / len(x) + s.decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model = Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2), mean, spread)
    z = model.share(texts)
    a = np.array([1.0, 0.0])
    f = np.stack((z, np.ones_like(z)), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ a, -30, 30)))
        h = (f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, f.T @ (p - y) + 1e-3 * (a - [1.0, 0.0])), -2, 2)
    model.slope, model.shift = float(max(a[0], 1e-3)), float(a[1])
    return model


def learned(docs: DataFrame, labels: DataFrame, s: Setting = Setting()) -> Model:
    """A model from a bounded sample of labelled rows of docs outside the held-out fold; null labels teach nothing."""
    known = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id"), s.folds) != s.held_out)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # labels without a text to learn from would use up the sample
    known = known.join(docs.filter(F.length("text") > 0).select("doc_id"), "doc_id", "left_semi")
    got = sample_texts(docs, known, s.sample, s.chars, ["quality"])
    return fit(got.text.tolist(), got.quality.to_numpy(), s)


def classified(docs: DataFrame, labels: DataFrame, s: Setting = Setting(), model: Model | None = None) -> DataFrame:
    """docs without text, with held_out, score and predicted.

    A null or empty text is one empty line. Rows are scored each on its own, so ties and repeated rows score alike.
    An empty table gives an empty table; extra columns are kept, but for those that are named like an added one.
    """
    model = model or learned(docs, labels, s)

    def start():
        return lambda texts: [model.score(texts)]

    out = scored(docs, start, "text", [("score", "double")])
    return out.drop("held_out", "predicted").withColumn("held_out", fold(F.col("doc_id"), s.folds) == s.held_out).withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))


def good_only(docs: DataFrame, labels: DataFrame, s: Setting = Setting(), texts: DataFrame | None = None) -> DataFrame:
    """Rows of docs predicted good, with their columns as they are. texts: the documents to learn from, else docs.

    A null or empty text is one empty line and is judged as such; texts are read as a whole, repeated rows go or stay
    together, and an empty table gives an empty table.
    """
    model = learned(docs if texts is None else texts, labels, s)

    def start():
        return lambda texts: model.score(texts) >= s.threshold

    return filtered(docs, start, "text")
