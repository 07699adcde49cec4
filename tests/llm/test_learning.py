"""What the classifier learns from."""

from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import chat_repair, common, language_id, learning, quality_classifier, sentencepiece_codec

GOOD = "The cat and the dog sat on the mat in the sun, and it was good to be there with all of them.\nThey went home as the day went by.\n"
BAD = "$$$ ### 1 1 1 1 $$$\nbuy buy buy buy ### $$$ 99\n### $$$ ###\n"
SCHEMA = "doc_id long, text string"


def text(i):
    return (GOOD if i % 2 else BAD) * (1 + i % 3) + str(i)


def test_stage_learns_from_texts_that_the_rules_removed(spark, tmp_path):
    docs = spark.createDataFrame([(i, text(i)) for i in range(40)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = spark.createDataFrame([(i, text(i)) for i in range(40) if i % 2] + [(100, text(100)), (101, text(101))], SCHEMA)
    out = {r.doc_id for r in corpus_pipeline.quality_classifier_stage(spark, left, str(tmp_path)).collect()}
    assert out == {i for i in range(40) if i % 2} | {101}


def test_labels_without_text_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(i, text(i)) for i in range(20)] + [(100, text(100)), (101, text(101))], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(i, 1) for i in range(1000, 3000)], "doc_id long, quality int")
    s = quality_classifier.Setting(sample=20)
    scores = {r.doc_id: r.predicted for r in quality_classifier.classified(docs, labels, s).collect()}
    assert scores[100] == 0 and scores[101] == 1


def test_tilts_solve_the_dual(spark):
    import math
    import random

    from orrery.llm import mixing

    rng = random.Random(14)
    rows = [(i, "abc"[i % 3], rng.randrange(1, 60)) for i in range(90)]
    per = mixing.tilts(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert {r.source for r in per} == set("abc")
    for r in per:
        sizes = [n for _, s, n in rows if s == r.source]
        assert r.source_size == sum(sizes)
        if not r.full:
            got = sum(min(2.0, math.exp(r.tilt * n / r["mean"])) * n for n in sizes)
            assert abs(got - r.target) <= 1e-6 * r.target


def test_long_texts_teach_too(spark):

    docs = spark.createDataFrame([(1, "a" * 50), (2, "b" * 5000), (2, "b" * 5000), (3, None), (None, "c")], "doc_id long, text string")
    chosen = docs.selectExpr("doc_id", "1 as one")
    got = learning.sample_texts(docs, chosen, 10, 100, ["one"])
    assert sorted(map(len, got.text)) == [50, 100]


def test_one_id_that_repeats_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (None, "x"), (3, None)], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    got = learning.sample_texts(docs, chosen, 10, 100, ["quality"])
    assert got.values.tolist() == [[1, "text 0", 0], [2, "other", 1]]


def test_each_language_teaches_by_its_first_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word {i}", "aa" if i % 20 else "bb") for i in range(400)], "doc_id long, text string, lang string")
    s = language_id.Setting(rows=5)
    monkeypatch.setattr(language_id, "fit", lambda texts, langs, s: sorted(zip(langs, texts)))
    rows = docs.filter(common.fold(F.col("doc_id"), s.folds) != s.held_out).withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
    assert language_id.learned(docs, s) == sorted((x, r.text) for x in ("aa", "bb") for r in [r for r in rows if r.lang == x][:5])


def test_no_text_is_a_range_key_of_turns(spark):
    turns = spark.createDataFrame([("c", i % 7, "user", f"some text {i}") for i in range(50)], "conv_id string, turn long, role string, text string")
    seen = []
    keep = type(turns).repartitionByRange
    try:
        type(turns).repartitionByRange = lambda self, *a: (seen.append([str(c) for c in a[1:]]), keep(self, *a))[1]
        chat_repair.repaired(turns).count()
    finally:
        type(turns).repartitionByRange = keep
    assert seen and not any("text" in c for cs in seen for c in cs)


def test_codec_forgets_by_characters():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.read(), room=500)
    plain = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.read())
    for i in range(30):
        text = f"line {i} " + "abcde" * 20 + str(i)
        a, b = codec.encode([text]), plain.encode([text])
        assert a[0].tolist() == b[0].tolist() and codec.held <= 700
