"""Language identification by cross-parsing.

A suffix automaton of labelled text for each language tells how far a text can be followed; a text is cut into longest
matches, and the language that needs the fewest phrases wins. Phrases count as the logarithm of the automaton's text, which is
what naming a place in it costs, so languages with less text are not worse off.

Automata are tables of moves, and stretches of text advance through them together, each as if a phrase began with it. Where
the stretch before ends inside a phrase, that phrase is followed on until both ways begin a phrase at one place, from which
on they are the same: the counts are those of one parse of the whole text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import fold, small
from orrery.llm.learning import sample_texts, scored

UNKNOWN = "und"
_BUCKETS = 16


@dataclass(frozen=True)
class Setting:
    """chars: of labelled text in all automata together, an equal share for each language.

    rows: of each language in the sample; row_chars: of each row's text, from a place that goes by its id. letters: codes of
    a language: a gap, its commonest letters, and 16 that the other letters share by number. lane: characters of a stretch.
    """

    chars: int = 200_000
    rows: int = 500
    row_chars: int = 4000
    folds: int = 4
    held_out: int = 2
    letters: int = 64
    lane: int = 128


def automaton(codes: list[int], letters: int) -> np.ndarray:
    """Moves of the suffix automaton of codes: row state, column letter, -1 where no substring goes on."""
    move: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                split = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = split
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = split
                    p = link[p]
        last = new
    table = np.full((len(move), letters), -1, np.int32)
    for state, row in enumerate(move):
        for c, to in row.items():
            table[state, c] = to
    return table


def steps_of(table: np.ndarray) -> np.ndarray:
    """The table as one move for each state and letter: twice the place of the next state's row, plus 1 where a phrase begins.

    A letter that does not go on begins the next phrase; a letter that occurs nowhere is a phrase of its own.
    """
    letters = table.shape[1]
    start = np.maximum(table[0], 0)
    out = np.where(table >= 0, table, start) * letters * 2
    begins = (table < 0) | (np.arange(len(table)) == 0)[:, None]
    return (out + begins).astype(np.int32).ravel()


class Letters:
    """Codes of a language's letters: 0 between words, then the commonest, then what is left by number."""

    def __init__(self, common: str, letters: int):
        self.table = (letters - _BUCKETS + np.arange(0x10000) % _BUCKETS).astype(np.int32)
        self.table[[i for i in range(0x10000) if not chr(i).isalpha()]] = 0
        for i, ch in enumerate(common):
            self.table[ord(ch)] = i + 1
        self.first = letters - _BUCKETS

    def codes(self, raw: np.ndarray) -> np.ndarray:
        """Codes of characters by number; gaps that follow one another are one."""
        out = self.table[np.minimum(raw, 0xFFFF)]
        if len(far := np.flatnonzero(raw > 0xFFFF)):
            out[far] = self.first + raw[far] % _BUCKETS
        return out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))] if len(out) else out


def numbers(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


class Model:
    """known: for each language its name, its commonest letters and the codes that its automaton is built of, on first use."""

    def __init__(self, known: list[tuple[str, str, np.ndarray]], s: Setting):
        self.known, self.s = known, s
        self.languages = [name for name, _, _ in known]
        self.weight = np.array([math.log2(max(2, len(codes))) for _, _, codes in known])
        self.built: list[tuple[Letters, np.ndarray]] = []

    def automata(self) -> list[tuple[Letters, np.ndarray]]:
        if len(self.built) < len(self.known):
            self.built = [(Letters(common, self.s.letters), steps_of(automaton(codes.tolist(), self.s.letters))) for _, common, codes in self.known]
        return self.built

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text needs in each language."""
        raw = [numbers(t) for t in texts]
        out = np.zeros((len(texts), len(self.known)), np.int64)
        for k, (letters, steps) in enumerate(self.automata()):
            out[:, k] = parsed([letters.codes(r) for r in raw], steps, self.s.lane)
        return out

    def score(self, texts: list[str]) -> list:
        """Language and, as its score, its share of the odds that weighted phrase counts give."""
        if not self.languages:
            return [pa.array([UNKNOWN] * len(texts), pa.string()), np.zeros(len(texts))]
        counts = self.phrases(texts) * self.weight
        size = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        rate = counts / np.maximum(counts.min(1, keepdims=True), 1e-9)
        odds = np.exp(-12 * (rate - 1))
        odds /= odds.sum(1, keepdims=True)
        win = counts.argmin(1)
        names = [self.languages[w] if s else UNKNOWN for w, s in zip(win, size)]
        return [pa.array(names, pa.string()), np.where(size, odds[np.arange(len(win)), win], 0.0)]


def parsed(coded: list[np.ndarray], steps: np.ndarray, lane: int) -> np.ndarray:
    """Phrases of each text, parsed from its beginning to its end by longest matches."""
    n = np.array([len(c) for c in coded])
    lanes = -(-n // lane)
    if not lanes.sum():
        return np.zeros(len(coded), np.int64)
    at = np.concatenate(([0], np.cumsum(lanes)))
    grid = np.full((int(at[-1]), lane), -1, np.int32)
    flat = grid.ravel()
    for i, c in enumerate(coded):
        flat[at[i] * lane : at[i] * lane + len(c)] = c
    long = (grid >= 0).sum(1)
    order = np.argsort(-long, kind="stable")
    columns = np.ascontiguousarray(grid[order].T)
    active = np.searchsorted(-long[order], -np.arange(lane), side="left")
    begins = np.zeros((int(long[order[0]]), len(order)), np.uint8)
    state, count = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
    for t in range(len(begins)):
        m = active[t]
        v = steps.take(state[:m] + columns[t, :m])
        begins[t, :m] = v & 1
        state[:m] = v >> 1
    count += begins.sum(0, dtype=np.int64)
    # from here on by lane and not by order
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    spoken, count = state[place], count[place]
    truth = spoken.copy()
    first = np.zeros(len(order), bool)
    first[at[:-1][n > 0]] = True
    extra = np.zeros(len(order), np.int64)
    dirty = np.flatnonzero(~first)
    while len(dirty):
        # what the lane before really ends in goes on into each of these, until both ways begin a phrase at one place
        lane_of, now = dirty, truth[dirty - 1]
        more = np.zeros(len(dirty), np.int64)
        end = spoken[dirty].copy()
        open_ = np.arange(len(dirty))
        for t in range(len(begins)):
            open_ = open_[long[lane_of[open_]] > t]
            if not len(open_):
                break
            i = place[lane_of[open_]]
            v = steps.take(now[open_] + columns[t, i])
            own, other = v & 1, begins[t, i]
            now[open_] = v >> 1
            more[open_] += own.astype(np.int64) - other
            end[open_] = v >> 1
            met = (own & other).astype(bool)
            end[open_[met]] = spoken[lane_of[open_[met]]]
            open_ = open_[~met]
        extra[dirty] = more
        changed = dirty[truth[dirty] != end]
        truth[dirty] = end
        # a lane whose end is another now sends the next one in differently
        after = changed + 1
        after = after[after < len(order)]
        dirty = after[~first[after]]
    owner = np.repeat(np.arange(len(coded)), lanes)
    return np.bincount(owner, count + extra, len(coded)).astype(np.int64)


def fit(texts: list[str], langs: list[str], s: Setting = Setting()) -> Model:
    """Equal shares of text for each language; ties between languages go to the first in order."""
    names = sorted(set(langs))
    known = []
    for name in names:
        own = [t.lower() for t, x in zip(texts, langs) if x == name]
        counts: dict[str, int] = {}
        for t in own:
            for ch in t:
                if ch.isalpha() and ord(ch) < 0x10000:
                    counts[ch] = counts.get(ch, 0) + 1
        common = "".join(sorted(counts, key=lambda ch: (-counts[ch], ch))[: s.letters - _BUCKETS - 1])
        letters = Letters(common, s.letters)
        codes = np.concatenate([np.append(letters.codes(numbers(t)), 0) for t in own])[: max(1, s.chars // len(names))]
        known.append((name, common, codes.astype(np.uint8)))
    return Model(known, s)


def learned(docs: DataFrame, s: Setting = Setting()) -> Model:
    """A model from a bounded sample of each language's rows outside the held-out fold, in hash order.

    A text longer than row_chars gives a stretch from a place that goes by its id, so long texts teach too. Rows without
    doc_id, lang or text teach nothing; of rows of one doc_id one text teaches; without any row the model knows no language.
    """
    open_ = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & (fold(F.col("doc_id"), s.folds) != s.held_out))
    # a hash threshold by each language's own number of rows, well above what is needed: the ranking gets few rows of any
    per = open_.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    per = F.broadcast(per) if small(per, 10_000) else per
    share = F.least(F.lit(1.0), 8.0 * s.rows / F.col("n"))
    below = (F.lit(-(2.0**63)) + share * (2.0**64)).cast("double")
    chosen = open_.select("doc_id", "lang").join(per, "lang").filter(F.xxhash64("doc_id").cast("double") <= below)
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.col("doc_id")))
    chosen = chosen.withColumn("r", first).filter(F.col("r") <= s.rows)
    chosen = chosen.select("doc_id", F.col("lang").alias("known_lang"))
    got = sample_texts(docs, chosen, None, s.row_chars, ["known_lang"])
    got = got.assign(h=[hash_of(i) for i in got.doc_id]).sort_values(["h", "doc_id"])
    return fit(got.text.tolist(), got.known_lang.tolist(), s)


def hash_of(doc_id: int) -> int:
    return int(doc_id) * 0x9E3779B97F4A7C15 % (1 << 64)


def identified(docs: DataFrame, s: Setting = Setting(), model: Model | None = None) -> DataFrame:
    """docs without text, with held_out, lang_pred and score.

    A null or empty text, or one without letters, is `und` with score 0. Texts of any length are parsed as a whole. Rows are
    scored each on its own, so repeated rows score alike; a tie goes to the first language in order. An empty table gives an
    empty table; columns named like an added one are replaced, others are kept.
    """
    model = model or learned(docs, s)
    # the sampled text goes to executors, at most s.chars codes; each worker builds its automata from it once
    held = docs.sparkSession.sparkContext.broadcast(Model(model.known, model.s))

    def start():
        return held.value.score

    out = scored(docs, start, "text", [("lang_pred", "string"), ("score", "double")])
    return out.drop("held_out").withColumn("held_out", fold(F.col("doc_id"), s.folds) == s.held_out)
