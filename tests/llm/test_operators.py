"""Operators over small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import datetime
import math

import pytest
from pyspark.sql import functions as F

from orrery.llm import chat_repair, language_id, mixing, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, topk_search, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"
PROSE = "the cat and the dog sat on the mat in the sun and it was good to be there with all of them for a while as the day went by"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, PROSE + " one", "en", "a", 1, 0.5, True), (2, PROSE + " two", "en", "a", 2, None, None), (2, PROSE + " two", "en", "a", 2, None, None),
        (3, None, None, None, None, None, None), (4, "", "en", "b", 0, None, None), (None, PROSE, "de", "b", 5, None, None), (6, " \n\t ", "xx", None, 3, None, None),
        (7, "word", "en", "c", 4, None, None), (8, "$$$ ### " * 60, "en", "c", 4, None, None), (9, (PROSE + ".\n") * 300, "en", "c", 4, None, None), (10, PROSE + " one", "en", "c", 1, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 1), (9, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def counted(text):
    words = (text or "").split()
    windows = list(zip(words, words[1:], words[2:]))
    twice = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd):
    out = quality_rules.judged(odd)
    assert len(out.columns) == len(set(out.columns)) and "kept" in out.columns
    rows = out.collect()
    assert len(rows) == 11
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counted(r.text)
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and not (r.kept and r.base_failed)
    assert quality_rules.judged(odd.limit(0)).count() == 0
    kept = quality_rules.accepted(odd, quality_rules.Limits(min_words=5))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 10}


def test_repeated_windows_at_sizes_about_a_power_of_two(spark):
    texts = [" ".join(str(i * i % m) for i in range(n)) for n in (0, 1, 2, 3, 4, 5, 31, 32, 33, 34, 129, 130, 131, 3000) for m in (1, 2, 7, 101, 10007)]
    texts += ["x y z " + " ".join(map(str, range(n))) + " x y z" for n in (0, 1, 25, 26, 27, 250, 5000)]
    df = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality_rules.judged(df).collect():
        assert (r.n_words, r.n_repeat_words) == counted(r.text)[::4], r.text[:60]


def test_equal_first_bits_of_hashes_are_no_repeat(spark):
    df = spark.createDataFrame([([16, 17, 5, -1, -2],), ([16, 17, 16, -1, 5],), ([-1, 3, -1],), ([],)], "h array<long>")
    out = [[tuple(x) for x in r[0]] for r in df.select(quality_rules._repeated(F.col("h"))).collect()]
    assert out[0] == [(-2, 4), (-1, 3), (16, 0), (17, 1)]  # candidates: judged() compares the whole hashes
    assert {(16, 0), (16, 2)} <= set(out[1]) and set(out[2]) == {(-1, 0), (-1, 2)} and out[3] == []


def test_no_pattern_counts_over_whole_texts_and_no_struct_is_sorted_by_a_lambda(odd):
    plan = quality_rules.judged(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and "regexp_extract_all(qr_short" in plan and "regexp_extract_all(qr_text" not in plan


def test_quality_divergence_matches_plain_python(spark):
    texts = [PROSE + f" {i}" for i in range(4)] + ["@@@ %%% ^^^ " * 30]
    df = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    limits = quality_rules.Limits(min_words=5, char_guard=1, word_guard=1, noise=0.0)
    refs = quality_rules.references(df, limits)

    def jsd(p, q):
        return math.sqrt(sum(0.5 * a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a) + sum(0.5 * b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b))

    for r in quality_rules.judged(df, limits, refs=refs).collect():
        words = r.text.split()
        hist = [sum(w == v for w in words) for v in quality_rules.VOCABULARY]
        share = [x / len(words) for x in [len(words) - sum(hist), *hist]]
        assert r.word_distance == pytest.approx(jsd(share, refs["en"][1]), abs=1e-5)


def test_mixing_targets_and_copies(spark, odd):
    rows = [(i, "w " * (1 + i * 7919 % 97), "s%d" % (i % 5) if i % 7 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(df).collect()
    size = collections.Counter()
    for r in out:
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        total = left - sum(2 * size[s] for s in full)
        target = {s: 2.0 * size[s] if s in full else total * weight[s] / sum(weight[x] for x in size if x not in full) for s in size}
        over = {s for s in size if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.02 * size[s]
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mixed(df).collect()), key=str)
    again = mixing.repeated(df)
    assert again.columns == df.columns
    assert collections.Counter(r.doc_id for r in again.collect()) == {r.doc_id: r.copies for r in out if r.copies}
    assert mixing.mixed(odd).count() == 11 and mixing.repeated(odd).columns == odd.columns
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_url_filter_is_an_as_of_join(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    entries = spark.createDataFrame(
        [("Example.com", "block", day(5)), ("example.com", "allow", day(9)), ("a.example.com", "block", day(7)), ("example.com", "block", day(5)), (None, "block", day(1)), ("b.org", "noise", day(1)), ("c.org", "allow", day(3)), ("c.org", "block", day(3))],
        "host string, action string, listed_at timestamp",
    )
    cases = [
        ("http://example.com/", 4, True), ("http://example.com/", 5, False), ("http://example.com/", 9, True), ("https://x.EXAMPLE.com:80/p?q", 6, False), ("http://u@a.example.com", 10, False),
        ("http://a.example.com", 6, False), ("http://notexample.com", 6, True), ("", 6, True), (None, 6, True), ("http://b.org", 6, True), ("http://c.org", 3, False), ("http://example.com", None, True),
    ]
    df = spark.createDataFrame([(i, u, day(d) if d else None, "x") for i, (u, d, _) in enumerate(cases)], "id long, url string, fetched_at timestamp, url_host string")
    out = {r.id: r.url_kept for r in url_filter.evaluated(df, entries).collect()}
    assert out == {i: k for i, (_, _, k) in enumerate(cases)}
    assert url_filter.evaluated(df, entries.limit(0)).filter("not url_kept").count() == 0
    assert url_filter.evaluated(df.limit(0), entries).count() == 0


def test_chat_repair_is_the_same_for_any_cut(spark):
    import random

    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "tool"]
    rows = [(k, i, rng.choice(roles), f"t{i}") for k in range(25) for i in range(rng.randrange(1, 40))]
    rows += [(100, 0, "assistant", None), (None, 0, "user", "x"), (101, 0, "system", "s"), (101, 0, "system", "s"), (102, None, "user", "y" * 5000), (None, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit(1)).withColumn("part", F.lit(1))
    c = chat_repair.Costs()
    low = lambda x: (x is not None, x)
    want = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (low(r[1]), low(r[2]), r[3] or ""))
        way = chat_repair.solve([r[2] for r in own], chat_repair.START, [chat_repair.ending(x, c) for x in range(4)], c)
        text = "".join(chat_repair.rendered(to, how, r[3] or "", i == 0) for i, (r, (to, how)) in enumerate(zip(own, way))) + chat_repair.tail(way[-1][0])
        legal = [x.split("|>")[0] for x in text.split("<|") if x and not x.startswith("end")]
        legal = legal[1:] if legal[0] == "system" else legal
        assert legal == ["user", "assistant"] * (len(legal) // 2) and legal
        want.append((k, [(r[2], chat_repair.ROLES[to - 1], bool(how[0]), bool(how[1])) for r, (to, how) in zip(own, way)], text))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, s in ((1, chat_repair.Costs()), (4, chat_repair.Costs(stretch=3)), (7, chat_repair.Costs(stretch=1)), (4, chat_repair.Costs(stretch_chars=9))):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = chat_repair.repaired(df, s).collect()
            assert len(out) == len(rows)
            for k, steps, text in want:
                own = sorted((r for r in out if r.conv_id == k), key=lambda r: r.position)
                assert [r.position for r in own] == list(range(len(own)))
                assert [(r.role, r.new_role, r.relabelled, r.merged) for r in own] == steps and "".join(r.rendered for r in own) == text
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert chat_repair.repaired(df.limit(0)).count() == 0


def test_language_identification(spark, odd):
    out = language_id.identified(odd, model=language_id.learned(odd)).collect()
    assert len(out) == 11 and all(r.lang_pred == "und" for r in out if r.doc_id in (3, 4, 6)) and all(0 <= r.score <= 1 for r in out)
    assert language_id.identified(odd.limit(0), model=language_id.learned(odd.limit(0))).count() == 0


def test_classifiers_bear_odd_rows(odd, labels):
    for module in (toxicity, quality_classifier):
        out = module.classified(odd, labels).collect()
        assert len(out) == 11 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in out)
        assert module.classified(odd.limit(0), labels.limit(0)).count() == 0
        clash = odd.withColumnsRenamed({"score": "SCORE", "kept": "Held_Out"})
        assert module.classified(clash, labels).columns == ["doc_id", "lang", "source", "n_chars", "score", "held_out", "predicted"]
    assert quality_classifier.good_only(odd, labels).columns == odd.columns
    assert quality_classifier.good_only(odd.limit(0), labels).count() == 0


def test_added_columns_may_have_any_names(spark, odd):
    names = {"lang": "_host", "source": "_life", "n_chars": "uf_host", "score": "_active", "kept": "_found"}
    df = odd.withColumnsRenamed(names).withColumn("url", F.lit("http://a.org/")).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    entries = spark.createDataFrame([("a.org", "block", datetime.datetime(2023, 1, 1))], "host string, action string, listed_at timestamp")
    out = url_filter.evaluated(df, entries)
    assert out.columns == [*df.columns, "url_host", "listed_host", "listed_at", "url_kept"] and out.filter("url_kept").count() == 0
    assert quality_rules.accepted(odd.withColumn("qa_0", F.lit(1)).withColumn("qr_w", F.lit(1))).columns == [*odd.columns, "qa_0", "qr_w"]
    assert mixing.repeated(odd.withColumn("mix_tilt", F.lit(1))).columns == [*odd.columns, "mix_tilt"]
    assert near_dedup.deduplicated(odd.withColumn("_row", F.lit(1))).columns == [*odd.columns, "_row"]
    for f in (quality_rules.accepted, mixing.repeated):
        assert f(odd.limit(0)).count() == 0


def near_by_hand(rows, n):
    sets, parent = {}, {}
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets.setdefault(i, []).append(frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else []))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in sets}


def test_near_duplicates_by_brute_force(spark, odd):
    import random

    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(40)] = str(rng.randrange(100))
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "solo"), (903, "SOLO"), (904, rows[0][1].upper()), (5, rows[1][1])]
    # one document with two texts, each of which others have: it joins them
    rows += [(905, "p q r s"), (906, "t u v w"), (907, "p q r s"), (907, "t u v w")]
    # a chain of near texts, none near its second neighbour, and one text of some length
    chain = [f"c{i}" for i in range(60)]
    for i in range(8):
        chain[7 * i] = f"x{i}"
        rows.append((920 + i, " ".join(chain)))
    rows += [(940, " ".join(f"l{i}" for i in range(30_000))), (941, " ".join(f"l{i}" for i in range(29_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(0)).withColumn("nd_row", F.lit(1))
    for block, long in ((1024, 2048), (3, 20)):
        s = near_dedup.Near(shingle=2, block=block, long=long)
        out = near_dedup.classes(df, s).collect()
        want = near_by_hand(rows, 2)
        assert len(out) == len(rows) and {r.doc_id: r.component_id for r in out} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    again = near_dedup.deduplicated(df, near_dedup.Near(shingle=2))
    assert again.columns == df.columns and [r.doc_id for r in again.collect()].count(905) == 1
    assert near_dedup.deduplicated(odd.limit(0)).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) <= 1 and 10 not in ids and {3, 4, 6, 7, 8, 9} <= set(ids)
    assert near_dedup.classes(odd.limit(0)).count() == 0


def test_top_k_by_brute_force(spark):
    import random

    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.01, 1.5]) for _ in range(4)], i) for i in range(120)]
    rows += [(i % 7, [0.5] * 4, 0) for i in range(3)] + [(41, rows[41][1], 0)]
    v = [(i, [math.floor(64 * x) for x in e]) for i, e, _ in rows]
    rows += [(200, None, 0), (201, [0.1, None, 0.2, 0.3], 0), (202, [float("nan"), 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 0), (203, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    for shard in (8192, 16):
        out = topk_search.top_k(df, F.col("vec_id") % 20 == 0, topk_search.Tiling(shard=shard, block=2, fan_in=2)).collect()
        want = []
        for at, (q, x) in enumerate(v):
            if q % 20 == 0:
                best = sorted((-sum(a * b for a, b in zip(x, y)), c) for k, (c, y) in enumerate(v) if k != at)[:20]
                want += [(q, rank + 1, c, -score) for rank, (score, c) in enumerate(best)]
        assert sorted(tuple(r) for r in out) == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_encoding_gives_texts_back(odd):
    v = sentencepiece_codec.Vocabulary.read()
    out = sentencepiece_codec.encoded(odd, v, ("ids", "n_tokens", "ids_crc", "round_trip"))
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out.collect())
    texts = {(r.doc_id, r.text) for r in sentencepiece_codec.decoded(out, v).collect()}
    assert texts == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert sentencepiece_codec.encoded(odd.limit(0), v).count() == 0
