"""Models and codecs on plain Python values, against brute force or public libraries."""

import itertools
import random

import numpy as np
import pytest

from orrery.llm import chat_repair as C
from orrery.llm import language_id as L
from orrery.llm import near_dedup as N
from orrery.llm import quality_classifier as Q
from orrery.llm import sentencepiece_codec as S
from orrery.llm import toxicity as T
from orrery.llm import topk_search as K

ODD = ["", " ", "  a", "a  b   c ", "\n", "a\n\nb", "\ta\t", "naïve 😀 日本語", "<s> </s> <0x41>", "1234 56", "   \n  x", "é" * 60, "a" * 50, " " * 40 + "x", "Ünder space"]


def test_sentencepiece_equals_the_library():
    sp = pytest.importorskip("sentencepiece")
    codec = S.Codec(S.Vocabulary.read())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab thein\n .,é▁1") for _ in range(rng.randrange(80))) for _ in range(200)]
    ids, ends = codec.encode(texts)
    want = sp.SentencePieceProcessor(model_file=S.DEFAULT_MODEL).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    assert all(codec.decode(w) == t for t, w in zip(texts, want) if "▁" not in t)


def test_long_chunks_equal_short_ones_and_the_library():
    import time

    import sentencepiece

    rng = random.Random(4)
    v = S.Vocabulary.read()
    words = [p for p in v.pieces if p.isalpha() and len(p) > 2]
    texts = ["".join(rng.choice(words) for _ in range(60)) for _ in range(30)] + ["ab" * 300, "a" * 777, "的一是不了人我在" * 90, "".join(map(chr, range(0x4E00, 0x4F00)))]
    library = sentencepiece.SentencePieceProcessor(model_file=S.DEFAULT_MODEL)
    for short in (0, 48, 10_000):
        ids, ends = S.Codec(v, short=short).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t) for t in texts]
    long = "".join(rng.choice(words) for _ in range(200_000))[:1_000_000]
    began = time.process_time()
    codec = S.Codec(v)
    ids, _ = codec.encode([long])
    assert time.process_time() - began < 120 and codec.decode(ids.tolist()) == long
    assert ids.tolist() == library.encode(long)


def test_sentencepiece_forgets_and_stays_right():
    v = S.Vocabulary.read()
    small, big = S.Codec(v, remember=3), S.Codec(v)
    for text in ["one two three", "four five six seven eight", "one two three"]:
        assert small.encode([text])[0].tolist() == big.encode([text])[0].tolist()


def test_unigram_takes_the_best_path():
    pieces = ("<unk>", "a", "b", "ab", "ba", "aba", " ")
    scores = (0.0, -2.0, -2.5, -3.0, -3.2, -6.0, -1.0)
    v = S.Vocabulary(pieces, scores, (2, 1, 1, 1, 1, 1, 1), True, False, 0)
    for text, short in itertools.product(["a", "ab", "aba", "abab", "babab", "abcab"], (0, 48)):
        ids, _ = S.Codec(v, short=short).encode([text])
        best = max(
            (sum(scores[pieces.index(p)] if p in pieces else min(scores[1:]) - 10 for p in cut), cut)
            for cut in ([text[a:b] for a, b in zip((0, *at), (*at, len(text)))] for k in range(len(text)) for at in itertools.combinations(range(1, len(text)), k))
            if all(p in pieces or len(p) == 1 for p in cut)
        )
        got = sum(scores[i] if i else min(scores[1:]) - 10 for i in ids)
        assert got == pytest.approx(best[0])


def test_suffix_array_sorts_suffixes():
    codes = np.array([2, 1, 2, 1, 2, 3, 1], np.int64)
    assert S.suffix_array(codes, 8).tolist() == sorted(range(7), key=lambda i: codes[i:].tolist())


def test_automaton_knows_every_substring():
    rng = random.Random(2)
    codes = [rng.randrange(3) for _ in range(40)]
    table = L.automaton(codes, 4)
    subs = {tuple(codes[a:b]) for a in range(40) for b in range(a + 1, 41)}
    for n in range(1, 6):
        for word in itertools.product(range(4), repeat=n):
            state = 0
            for c in word:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (word in subs)


def phrases_by_hand(text, ref):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in ref:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("lane", [1, 7, 128])
def test_phrases_by_brute_force(lane):
    rng = random.Random(5)
    refs = ["the cat sat on the mat and the dog sat on the cat", "der hund und die katze und der andere hund"]
    m = L.fit(refs, ["en", "de"], L.Setting(chars=200, lane=lane))
    texts = ["the hat", "die mat und der", "xyz", "the the the", ""]
    texts += ["".join(rng.choice(["the", "und", " ", "a", "katze", "on the mat", "q"]) for _ in range(n)) for n in (5, 50, 400)]
    texts += [(refs[0] + " ") * 20, "x".join([refs[1]] * 9)]
    texts = [" ".join(t.split()) for t in texts]
    counts = m.phrases(texts)
    for k, ref in enumerate([refs[1] + " ", refs[0] + " "]):
        assert counts[:, k].tolist() == [phrases_by_hand(t, ref) for t in texts]


def test_rare_and_distant_languages():
    rng = random.Random(6)
    make = lambda low, n: " ".join("".join(chr(low + rng.randrange(24)) for _ in range(5)) for _ in range(n))
    words = {k: [make(low, 1) for _ in range(60)] for k, low in (("aa", 97), ("ru", 0x430), ("zh", 0x4E00), ("far", 0x20000))}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    m = L.fit([text("aa", 4000), text("ru", 4000), text("zh", 4000), text("far", 60)], ["aa", "ru", "zh", "far"])
    for k in words:
        assert m.score([text(k, 30)])[0].to_pylist() == [k]


def test_language_of_texts_without_letters():
    m = L.fit(["the cat", "die katze"], ["en", "de"])
    assert m.score(["", " 12 ", "😀"])[0].to_pylist() == ["und"] * 3
    assert L.fit([], []).score(["a"])[0].to_pylist() == ["und"]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 2])
    emit, move = rng.normal(size=6), rng.normal(size=(2, 2))
    good, moves, total = Q.marginals(emit, move, counts)
    at, log_z, expected, pairs = 0, 0.0, [], np.zeros((2, 2))
    for n in counts:
        ways = list(itertools.product((0, 1), repeat=n))
        w = np.exp([sum(emit[at + i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1)) for y in ways])
        log_z += np.log(w.sum())
        expected += [sum(p for p, y in zip(w, ways) if y[i]) / w.sum() for i in range(n)]
        for p, y in zip(w, ways):
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += p / w.sum()
        at += n
    assert np.allclose(good, expected) and np.allclose(moves, pairs) and total == pytest.approx(log_z)


def test_quality_model_learns_and_bears_odd_texts():
    good = [f"the cat number {i} sat on the mat.\nit was a fine day for a walk." for i in range(60)]
    bad = [f"$$$ {i} ### %%%\nBUY!! NOW!! {i} !!" for i in range(60)]
    m = Q.fit(good + bad, np.array([1] * 60 + [0] * 60))
    s = m.score([good[0], bad[0], "", "\n\n", "x" * 100_000])
    assert s[0] > 0.7 > s[1] and ((0 <= s) & (s <= 1)).all()
    assert len(m.score([])) == 0
    assert (Q.fit([], np.array([])).score(["a"]) == 0.5).all()
    assert (Q.fit(["a"], np.array([1])).score(["a", "b"]) > 0.7).all()


def test_nonnegative_risk():
    rng = np.random.default_rng(4)
    z, positive = rng.normal(size=20), np.arange(20) < 8
    first, second, slope = T.risk(z, positive, 0.3)
    assert second == pytest.approx(np.logaddexp(0, z)[8:].mean() - 0.3 * np.logaddexp(0, z)[:8].mean())
    if second >= 0:
        for i in range(20):
            d = np.zeros(20)
            d[i] = 1e-6
            a, b = T.risk(z + d, positive, 0.3), T.risk(z - d, positive, 0.3)
            assert slope[i] == pytest.approx((a[0] + a[1] - b[0] - b[1]) / 2e-6, abs=1e-5)
    assert T.risk(np.where(positive, 5.0, -5.0), positive, 0.3)[1] < 0


def test_toxicity_learns_from_positives_only():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    plain = [" ".join(rng.choices(words, k=40)) for _ in range(400)]
    toxic = [" ".join(rng.choices(words, k=30) + ["scumbag", rng.choice(["vile", "filth"])]) for _ in range(120)]
    m = T.fit(toxic[:60], plain[:300] + toxic[60:90], 0.1)
    assert (m.score(toxic[90:]) >= 0.5).mean() > 0.9 and (m.score(plain[300:]) < 0.5).mean() > 0.95
    assert 0 <= m.score([""])[0] < 0.5
    assert T.fit([], [], 0.0).score(["a"])[0] < 0.5


@pytest.mark.parametrize("seed", range(6))
def test_role_repair_is_cheapest(seed):
    rng = random.Random(seed)
    c = C.Costs()
    roles = [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randrange(1, 6))]

    def cheapest(i, state):
        if i == len(roles):
            return C.ending(state, c)
        return min(price + cheapest(i + 1, to) for a, to, price, _ in C.moves(roles[i], c) if a == state)

    whole = C.table(roles, c)
    best = min(int(whole[C.START, s]) + C.ending(s, c) for s in range(4))
    assert best == cheapest(0, C.START)
    rest = [C.ending(s, c) for s in range(4)]
    way = C.solve(roles, C.START, rest, c)
    end = way[-1][0]
    # any cut gives the same way
    for k in range(len(roles) + 1):
        after = C.costs_left(roles[k:], rest, c)[0].tolist()
        middle = C.ends_of(roles[:k], after, c)[C.START]
        assert C.solve(roles[:k], C.START, after, c) + C.solve(roles[k:], middle, rest, c) == way
    assert sum(c.relabel * how[0] + c.merge * how[1] + c.insert * len(how[2]) for _, how in way) + C.ending(end, c) == best


def test_registers_and_estimate():
    s = N.Near()
    rng = np.random.default_rng(6)
    union = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for shared in (2700, 1500, 300):
        rest = (3000 - shared) // 2
        a, b = np.concatenate((union[:shared], union[shared : shared + rest])), np.concatenate((union[:shared], union[shared + rest :]))
        got, deviation = N.estimate(N.registers(a, s)[None], N.registers(b, s)[None], s)
        assert abs(got[0] - shared / 3000) < 6 * max(deviation[0], 0.03)
    hops = N._hops(250)
    assert not len(N.band_keys(np.zeros(250, np.uint16), s, hops))
    for shared, n in ((4, 5), (8, 10), (40, 50), (400, 500)):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            a, b = N.registers(x, s), N.registers(x[:shared], s)
            agree.append((N.filled(a, hops) == N.filled(b, hops)).mean())
            assert len(set(N.band_keys(a, s, hops)) & set(N.band_keys(b, s, hops))) >= 2
        assert abs(np.mean(agree) - shared / n) < 0.06
    one = N.filled(N.registers(x[:1], s), hops)
    assert len(set(one)) == 1 and one[0] > 0
    known = N._Words()
    assert len(N.shingles("", 2, known)) == 0 and len(N.shingles("one", 2, known)) == 1
    assert N.shingles("A B a b", 2, known).tolist() == N.shingles("a b A b", 2, known).tolist()
    assert N.shingles("É b", 2, known).tolist() != N.shingles("é b", 2, known).tolist()


def test_best_k_with_ties():
    rng = np.random.default_rng(7)
    for k in (1, 3, 7):
        scores = rng.integers(0, 4, (20, 9)).astype(np.int64)
        keep = K.best(scores, k)
        for row, flags in zip(scores, keep):
            assert np.flatnonzero(flags).tolist() == sorted(sorted(range(9), key=lambda i: (-row[i], i))[:k])


def test_toxicity_scores_by_hand():
    rng = random.Random(12)
    # a wide vocabulary: texts that share their rarest hashes count as copies of one another
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    clean = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(300)]
    toxic = [t + " you awful idiots idiots" for t in clean[:40]]
    model = T.fit(toxic, clean[40:] + toxic[:10], 0.1)
    assert model.weights
    texts = [*clean[:5], *toxic[:5], "", "IDIOTS idiots awful", "idiotic"]
    for text, got in zip(texts, model.score(texts)):
        words, total = [], model.bias
        word = ""
        for ch in text.lower() + " ":
            if ch.isalpha():
                word += ch
            elif word:
                words.append(word)
                word = ""
        held = [f for w in words for f in {w, *(f"{w[:n]}-" for n in (4, 5, 6) if len(w) > n)}]
        for f in set(held):
            total += sum(model.weights.get(f + k, 0.0) for k, n in (("", 1), ("2", 2), ("4", 4)) if held.count(f) >= n)
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert model.score(toxic[:5]).min() > model.score(clean[:5]).max()


def test_quality_score_by_hand():
    rng = random.Random(13)
    good = ["\n".join(" ".join(rng.choice(["the", "quiet", "river", "ran", "home"]) for _ in range(8)) + "." for _ in range(3)) for _ in range(30)]
    bad = ["\n".join("$$ 99 ## buy" * rng.randrange(1, 3) for _ in range(3)) for _ in range(30)]
    model = Q.fit(good + bad, np.array([1] * 30 + [0] * 30))
    for text in [good[0], bad[0], good[1] + "\n" + bad[1], "", "one"]:
        x, n, counts = Q.line_features([text])
        emit = ((x - model.mean) / model.spread) @ model.weights
        weight = {}
        for labels in itertools.product((0, 1), repeat=len(emit)):
            s = sum(e for e, y in zip(emit, labels) if y) + sum(model.move[a, b] for a, b in zip(labels, labels[1:]))
            weight[labels] = np.exp(s)
        whole = sum(weight.values())
        good_line = [sum(w for ys, w in weight.items() if ys[i]) / whole for i in range(len(emit))]
        share = np.clip(sum(g * (len(line.encode()) + 1) for g, line in zip(good_line, text.split("\n"))) / sum(len(line.encode()) + 1 for line in text.split("\n")), 1e-4, 1 - 1e-4)
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.shift))), rel=1e-6)
