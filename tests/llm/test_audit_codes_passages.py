"""Filter audit, vector codes and repeated passages against plain Python, over odd rows too."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from orrery.llm import common, filter_audit, suffix_dedup, vector_codes

DOCS = "doc_id long, text string, lang string, removed int, part string, key binary"


def test_orders_come_by_swaps_of_neighbours():
    for n in range(1, 6):
        orders = []
        for order, at in filter_audit.swaps(n):
            if orders:
                want = list(orders[-1])
                want[at], want[at + 1] = want[at + 1], want[at]
                assert list(order) == want
            orders.append(tuple(order))
        assert sorted(orders) == sorted(itertools.permutations(range(n)))


def failed(rows):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = []
    for i, text, lang in rows:
        t = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        out.append((lang or "", {
            x for x, bad in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t),
                i is not None and i > least[t],
            )) if bad
        }, i))
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "Bb", "c#", "dé", "eE", "f", "g h", *[f"w{i}" for i in range(300)]]
    rows = [(i if i % 7 else None, " ".join(rng.choices(words, k=rng.choice([0, 3, 250, 400]))), rng.choice(["en", "de", "", None])) for i in range(80)]
    rows += rows[:10] + [(900 + i, rows[40][1], "en") for i in range(30)] + [(500, None, "xx"), (501, "", "xx"), (502, "Z" * 50_000 + " y" * 50_000, "en")]
    labels = [(i, i % 2, None if i % 3 else 1) for i in range(0, 80, 2)] + [(2, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "x", b"") for r in rows], DOCS)
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audited(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    marks = [{i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1)]
    all_rows = failed(rows)
    parts = {p for p, *_ in all_rows}
    assert len(got) == len(parts) * 600
    for part in parts:
        mine = [(bad, i) for p, bad, i in all_rows if p == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                shapley[x] += len(gone)
                r = got[part, "".join(order), step]
                assert (r.kept, r.removed, r.redundant) == (len(left), len(gone), sum(x in b for b, _ in mine) - len(gone))
                assert r.unique_fails == sum(b == {x} for b, _ in mine)
                assert (r.good_lost, r.toxic_lost) == tuple(sum(i in m for _, i in gone) for m in marks)
        assert all(got[part, "".join(o), o.index(x) + 1].shapley == shapley[x] for o in itertools.permutations("ABCDE") for x in o)
    assert filter_audit.audited(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def lloyd(vectors, s):
    rows = [(i, [math.floor(s.scale * x) for x in v], label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in rows) // s.parts)
    rows = [(i, v + [0] * (s.parts * width - len(v)), label) for i, v, label in rows]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(s.parts)]
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))[: s.entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(s.parts)]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(s.rounds):
        for p in range(s.parts):
            got = collections.defaultdict(list)
            for _, v, _ in rows:
                got[near(cut(v)[p], books[p])].append(cut(v)[p])
            for e, members in got.items():
                books[p][e] = tuple(sum(x) // len(members) for x in zip(*members))
    out = []
    for i, v, label in rows:
        at = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{e:02x}" for e in at), sum(dist(x, books[p][at[p]]) for p, x in enumerate(cut(v)))))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


SMALL = vector_codes.Codes(entries=5, rounds=4)


@pytest.mark.parametrize("seed", [2])
def test_codes_equal_plain_lloyd(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.integers(-3, 3, 8) / 16 + (i % 5)], None if i % 4 == 0 else int(i % 3)) for i in range(60)]
    vectors += [(3, [9.0] * 8, 1), (3, [8.0] * 8, 1), (None, [1.0] * 8, None), (70, None, 1), (71, [float("nan")] * 8, 1), (72, [None] + [1.0] * 7, 1), (73, [float("inf")] * 8, 1), (74, [0.5] * 7, 2), (75, [], 2)]
    vectors += [(100 + i, [2.0] * 8, 7) for i in range(40)]  # one value holds a third of all rows
    df = spark.createDataFrame([(*v, 0, "x") for v in vectors], "vec_id long, embedding array<float>, label int, row int, code string")
    coded, books = vector_codes.compressed(df, SMALL)
    want, digest = lloyd(vectors, SMALL)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r) for r in coded.collect()], key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
    assert vector_codes.books_digest(books) == digest
    per = collections.Counter()
    for _, label, _, error in want:
        per[label] += error
    assert all(r.label_error == per[r.label] for r in vector_codes.label_errors(coded).collect())


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.compressed(spark.createDataFrame([], schema))
    assert coded.count() == 0 and all(len(b) == 0 for b in books)
    coded, _ = vector_codes.compressed(spark.createDataFrame([(None, [1.0, 2.0], 1)], schema))
    assert [tuple(r) for r in coded.collect()] == [(None, 1, None, None)]
    large, _ = vector_codes.compressed(spark.createDataFrame([(1, [1e30, -1e30], 1), (2, [0.0, 1.0], 1)], schema))
    assert [r.error for r in large.orderBy("vec_id").collect()] == [0, 0]


def test_nearest_is_exact_beyond_doubles():
    rng = np.random.default_rng(0)
    rows, book = rng.integers(-(1 << 26), 1 << 26, (50, 16)), rng.integers(-(1 << 26), 1 << 26, (9, 16))
    at, error = vector_codes.nearest(rows, book)
    for x, e, d in zip(rows.tolist(), at.tolist(), error.tolist()):
        all_ = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book.tolist()]
        assert (d, e) == (min(all_), all_.index(min(all_)))


def spans_of(texts, length):
    count = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((suffix_dedup.runs(gone), bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return out


@pytest.mark.parametrize("length", [16, 17, 30, 63])
def test_windows_are_sorted_and_classed(length):
    rng, s = np.random.default_rng(length), suffix_dedup.Passages.of(length)
    for _ in range(40):
        base = bytes(rng.integers(0, rng.integers(1, 4), rng.integers(length, 300)).astype(np.uint8))
        text = (base + bytes(rng.integers(250, 256, 50).astype(np.uint8)) + base[5:]) * int(rng.integers(1, 3))
        places = np.arange(len(text) - length + 1)
        order, cls = suffix_dedup.sorted_windows(np.frombuffer(text, np.uint8), places, s)
        windows = [text[p : p + length] for p in order]
        assert windows == sorted(windows) and sorted(order.tolist()) == places.tolist()
        assert all((a == b) == (x == y) for a, b, x, y in zip(windows, windows[1:], cls, cls[1:]))


def test_equal_windows_are_dealt_alike():
    rng, hashes = np.random.default_rng(3), suffix_dedup._Hashes()
    text = bytes(rng.integers(0, 3, 3000).astype(np.uint8)) * 2
    for k in (1, 8, 15, 16):
        deal, first, end, _ = suffix_dedup.stretches(text, 16, k, 7, hashes)
        assert first[0] == 0 and end[-1] == len(text) - 15 and (first[1:] == end[:-1]).all() and (end - first).max() <= 7
        dealt = np.repeat(deal, end - first)
        seen = {}
        assert all(seen.setdefault(text[p : p + 16], dealt[p]) == dealt[p] for p in range(len(dealt)))


@pytest.mark.parametrize("block", [4])
def test_repeats_equal_brute_force(spark, block):
    rng = random.Random(block)
    word = lambda: "".join(rng.choices("abcdefghijé", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(20), prose(9)
    texts = [prose(rng.randint(1, 60)) for _ in range(40)]
    texts += [f"{prose(6)} {passage} {prose(6)}" for _ in range(30)]  # one passage in a third of all texts
    texts += [f"{prose(3)} {line} {prose(3)}" for _ in range(20)] + [passage[:30], passage[:40], "x" * 300, "ab" * 90, "ab" * 90 + "c", None, None, "", "x" * 39]
    base = prose(200)
    texts += [base, base, base[:500] + "!" + base[500:], base[100:] + base[:100]]
    rows = [(i if i % 11 else None, t, "en", 1, "p", b"k") for i, t in enumerate(texts)] + [(3, texts[3], "en", 1, "p", b"k"), (5, prose(40), None, None, None, None)]
    s = suffix_dedup.Passages.of(40, block=block, batch=500, stretch=50)
    got = suffix_dedup.removed(spark.createDataFrame(rows, DOCS), s).collect()
    raw = [(r[1] or "").encode() for r in rows]
    want = [(r[0], len(t), tuple(zip(*(x.tolist() for x in runs))), kept) for r, t, (runs, kept) in zip(rows, raw, spans_of(raw, 40))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2])
    assert sorted([(r.doc_id, r.n_bytes, tuple((x.begin, x.end) for x in r.spans), bytes(r.kept)) for r in got], key=key) == sorted(want, key=key)


def test_repeats_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a" * 1000, "en", 1, "p", b""), (None, None, None, None, None, None)], DOCS)
    assert [(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.removed(df).orderBy("n_bytes").collect()] == [(None, 0, 0, b""), (1, 1000, 1, b"")]
    assert suffix_dedup.removed(df.limit(0)).count() == 0


def test_long_texts_go_in_blocks():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, (1 << 20) + 5000).astype(np.uint8))
    deal, first, end, twice = suffix_dedup.stretches(text, 400, 200, 4096, suffix_dedup._Hashes())
    assert (first[1:] == end[:-1]).all() and end[-1] == len(text) - 399 and not twice.any()


def test_joins_with_hot_keys(spark):
    left = spark.createDataFrame([(1 if i < 3000 else i, i) for i in range(6000)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(k, str(k)) for k in [1, *range(4000, 6000)]], "k long, name string")
    plain = lambda df: sorted((r.v, r.name) for r in df.collect())
    for how in ("inner", "left"):
        assert plain(common.spread_join(left, right, "k", how, most=100).select("v", "name").fillna("")) == plain(left.join(right, "k", how).select("v", "name").fillna(""))


