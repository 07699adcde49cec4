"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, any texts are the unlabelled. Features are words and word beginnings that positives
hold more often than the rest; a linear model is trained on the class-prior-corrected risk, whose negative part is kept from
going below zero.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fold
from orrery.llm.learning import sample_texts, scored

_WORD = re.compile(r"[^\W\d_]+")
_ROOT, _PREFIXES, _TIMES = 4, (4, 5, 6), ("2", "4")


@dataclass(frozen=True)
class Setting:
    """positives, unlabelled: rows to fit on; chars: of each at most, else a stretch. Fold held_out of folds gives no label."""

    positives: int = 3000
    unlabelled: int = 5000
    chars: int = 40_000
    folds: int = 5
    held_out: int = 0
    features: int = 2048
    least: int = 4
    #: A feature is used if its share among positives is this many deviations, and this many times, above the rest.
    gain: float = 4.0
    lift: float = 4.0
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    margin: float = 0.5


def features_of(word: str) -> list[str]:
    """A word, and its first 4, 5 and 6 letters if it has more."""
    return [word, *[f"{word[:n]}-" for n in _PREFIXES if len(word) > n]]


def all_features(found: list[str]) -> set[str]:
    """Features of words that stand in a text, and for those that come at least 2 or 4 times one more each."""
    counts: Counter = Counter()
    for w, n in Counter(found).items():
        for f in features_of(w):
            counts[f] += n
    return {f"{f}{k}" for f, n in counts.items() for k in ("", *_TIMES) if not k or n >= int(k)}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.roots = {f.rstrip("-24")[:_ROOT] for f in self.weights}

    def score(self, texts: list[str]) -> np.ndarray:
        """Estimated chance of being toxic. Each feature counts once a text, wherever in the text it stands."""
        out, roots, weights = np.full(len(texts), self.bias), self.roots, self.weights
        for i, t in enumerate(texts):
            if found := [w for w in _WORD.findall(t.lower()) if w[:_ROOT] in roots]:
                out[i] += sum(weights[f] for f in sorted(all_features(found)) if f in weights)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def thinned(texts: list[str], seeds: int = 6) -> list[str]:
    """Texts without near copies of earlier ones, which would make chance words of a copied text look telling.

    A text goes if for one of the seeds its two smallest word hashes are those of an earlier text.
    """
    seen: set[tuple] = set()
    out = []
    for t in texts:
        hashes = np.array([zlib.crc32(w.encode()) for w in set(_WORD.findall(t.lower()))], np.uint64)
        keys = [(k, *np.sort(hashes * np.uint64(2 * k + 0x9E3779B1) % np.uint64(1 << 32))[:2].tolist()) for k in range(seeds)] if len(hashes) > 1 else [(-1, t)]
        if seen.isdisjoint(keys):
            out.append(t)
        seen.update(keys)
    return out


def _chosen(positive: list[set], unlabelled: list[set], prior: float, s: Setting) -> list[str]:
    """Features whose share among positives exceeds what the prior lets the unlabelled explain, by a normal score."""
    counts: dict[str, list[int]] = {}
    for side, texts in enumerate((positive, unlabelled)):
        for features in texts:
            for f in features:
                counts.setdefault(f, [0, 0])[side] += 1
    names = [f for f, (p, _) in counts.items() if p >= s.least]
    p = np.array([counts[f][0] for f in names]) / len(positive)
    u = np.array([counts[f][1] for f in names]) / max(1, len(unlabelled))
    rest = np.clip(u - prior * p, 0, None) / (1 - prior)  # the share among negatives that the prior implies
    noise = np.sqrt((u + 1 / max(1, len(unlabelled))) / max(1, len(unlabelled)) + prior**2 * p / len(positive)) / (1 - prior)
    gain = (p - rest) / np.sqrt(p / len(positive) + noise**2 + 1e-12)
    order = sorted(range(len(names)), key=lambda i: (-gain[i], names[i]))
    return [names[i] for i in order[: s.features] if gain[i] > s.gain and p[i] > s.lift * rest[i] + 3 * noise[i]]


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Positive part and negative part of the corrected risk (logistic loss), and the slope of what to descend.

    Where the negative part is below zero, the step ascends it instead, as the non-negative estimator does.
    """
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    sig = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    as_positive, as_negative = np.logaddexp(0, -z), np.logaddexp(0, z)
    first = prior * as_positive[positive].sum() / n_p
    second = as_negative[~positive].sum() / n_u - prior * as_negative[positive].sum() / n_p
    slope = np.where(positive, -prior * sig / n_p, sig / n_u)
    if second >= 0:
        slope = slope + np.where(positive, prior * (sig - 1) / n_p, 0)
        return first, second, slope
    return first, second, -slope


def fit(positive: list[str], unlabelled: list[str], prior: float, s: Setting = Setting()) -> Model:
    """A model from texts; without positives nothing is toxic, and without features all texts get the prior."""
    if not positive:
        return Model({}, -4.0)
    prior = min(max(prior, 1e-4), 0.9)
    positive, unlabelled = thinned(positive), thinned(unlabelled)
    sides = [[all_features(_WORD.findall(t.lower())) for t in side] for side in (positive, unlabelled)]
    names = _chosen(*sides, prior, s)
    if not names:
        return Model({}, float(np.log(prior / (1 - prior))))
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(positive) + len(unlabelled), len(names) + 1), np.float32)
    x[:, -1] = 1
    for row, features in enumerate([*sides[0], *sides[1]]):
        x[row, [place[f] for f in features if f in place]] = 1
    is_positive = np.arange(len(x)) < len(positive)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, s.steps + 1):
        _, _, slope = risk((x @ w).astype(float), is_positive, prior)
        grad = x.T @ slope.astype(np.float32) + s.decay * np.where(np.arange(len(w)) < len(w) - 1, w, 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-4}, float(w[-1]))


def learned(docs: DataFrame, labels: DataFrame, s: Setting = Setting()) -> Model:
    """A model from bounded samples: confirmed positives outside the held-out fold, and texts whose labels are not looked at.

    The class prior is the share of toxic rows among all labelled rows outside the held-out fold.
    """
    open_ = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), s.folds) != s.held_out))
    n = open_.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    if not n["p"]:
        return fit([], [], 0.0, s)
    positive = sample_texts(docs, open_.filter("toxic = 1").select("doc_id", F.lit(1).alias("one")), s.positives, s.chars, ["one"])
    any_ = sample_texts(docs, docs.select("doc_id", F.lit(1).alias("one")), s.unlabelled, s.chars, ["one"])
    return fit(positive.text.tolist(), any_.text.tolist(), n["p"] / n["n"], s)


def classified(docs: DataFrame, labels: DataFrame, s: Setting = Setting(), model: Model | None = None) -> DataFrame:
    """docs without text, with held_out, score and predicted.

    A null or empty text has no feature and scores the bias. Rows are scored each on its own, so ties and repeated rows
    score alike. An empty table gives an empty table; extra columns are kept, but for those named like an added one.
    """
    model = model or learned(docs, labels, s)

    def start():
        return lambda texts: [model.score(texts)]

    out = scored(docs, start, "text", [("score", "double")])
    return out.drop("held_out", "predicted").withColumn("held_out", fold(F.col("doc_id"), s.folds) == s.held_out).withColumn("predicted", (F.col("score") >= s.margin).cast("int"))
