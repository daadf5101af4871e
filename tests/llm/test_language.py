import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language as L
from quillon.llm.common import held_out

RU, GR = "привет мир это русский текст о языке", "γεια σου κόσμε αυτό είναι κείμενο"
EN, DE = "the quick brown fox and the lazy dog with words", "der schnelle braune fuchs und der faule hund mit wörtern"


def training(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru"), (GR, "el")] * 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_spans_scripts_and_odd_texts(spark):
    long = " ".join([EN] * 3000 + [RU] * 10)
    texts = [EN, f"{EN} {EN} {RU} {EN}", RU.upper(), None, "", "123 !? 🙂", "½ ²", long, f"{DE}. {DE}", GR, "a"]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)] + [(0, EN, 1.0, "x")], "doc_id long, text string, score double, lang string")
    out = L.identify_language(docs, training(spark)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(texts) + 1
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["en", "en", "ru", "und", "und", "und", "und", "en", "de", "el"]
    assert [s.lang for s in got[1].spans] == ["en", "ru", "en"] and [s.words for s in got[1].spans] == [20, 7, 10]
    assert got[1].score < 1.0 == got[0].score and got[3].score == 0.0
    assert got[10].lang_pred in ("en", "de")
    assert L.identify_language(docs.limit(0), training(spark)).collect() == []
    assert {r.lang_pred for r in L.identify_language(docs, training(spark).limit(0)).collect()} == {"und"}


def test_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    model = L.LanguageModel(["a", "b", "c"], np.ones((L.BUCKETS, 3)), np.ones((L.SCRIPTS, 3)))
    counts = np.array([0, 5, 5, 6, 12])
    for _ in range(30):
        scores = r.normal(size=(12, 3)) * 3
        path = model.viterbi(scores, counts, switch=2.0)
        for a, b in zip(counts, counts[1:]):
            cost = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
            best = max(map(cost, itertools.product(range(3), repeat=b - a)))
            assert cost(path[a:b].tolist()) == pytest.approx(best)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify_language(docs, docs.filter(~held_out(F.col("doc_id")))).join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.filter(held_out(F.col("doc_id"))).select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert len(rows) > 250 and np.mean([r.ok for r in rows]) > 0.985


def test_scripts_are_ranges_of_code_points():
    import numpy as np

    from quillon.llm import language as L

    words = {"tiếng": "latin", "ἀρχή": "greek", "ქართული": "georgian", "ひらがな": "kana", "한국어": "hangul", "漢字": "han", "слово": "cyrillic", "שלום": "hebrew", "مرحبا": "arabic", "हिन्दी": "devanagari", "plain": "latin"}
    for word, name in words.items():
        raw = np.frombuffer(word.encode(), np.uint8)
        _, _, script = L.word_features(raw, np.array([0]), np.array([len(raw)]))
        assert L._NAMES[script[0]] == name, word
    assert [first for first, _ in L._RANGES] == sorted({first for first, _ in L._RANGES})


def test_rare_languages_are_learned(spark):
    from quillon.llm import language as L

    rows = [(i, "the men went to the town and came home", "en") for i in range(400)] + [(1000, "los hombres fueron al pueblo", "es"), (1001, "die frau ging nach hause", "de")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), examples=20)
    assert model.langs == ["de", "en", "es"]


def test_examples_are_the_least_hashes_of_each_language_in_turn(spark):
    from quillon.llm.language import _chosen

    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("often").alias("lang"))
    hashed = sorted((r.hash, r.doc_id, r.lang) for r in rows.withColumn("hash", F.xxhash64("doc_id")).collect())
    turns = {lang: [x[1] for x in hashed if x[2] == lang] for lang in ("rare", "often")}
    found = _chosen(rows, 300).collect()
    assert {r.doc_id for r in found} == set(turns["rare"]) | set(turns["often"][:260])
