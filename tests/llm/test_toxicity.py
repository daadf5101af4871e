import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity as T
from quillon.llm.common import held_out, letter_bytes


def index_of(spark, rows, **options):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    return T.fit(docs, labels, **options), docs, labels


def corpus(n=600, seed=2):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(400)]
    bad = ["grimble", "foulnix", "snarkle"]
    rows = []
    for i in range(n):
        words = list(r.choice(vocabulary, r.integers(20, 60)))
        toxic = int(i % 4 == 0)
        if toxic:
            words += list(r.choice(bad, 2))
        rows.append((i, " ".join(words).capitalize() + "!", toxic))
    return rows


def test_search_is_exact(spark):
    index, _, _ = index_of(spark, corpus())
    assert len(index.terms) and index.blocks > 1
    dense = np.zeros((len(index.doc_id), len(index.terms)))
    for t in range(len(index.terms)):
        at = slice(index.begin[t], index.begin[t + 1])
        dense[index.example[at], t] = index.weight[at]
    assert np.allclose((dense**2).sum(axis=1), 1)
    r = np.random.default_rng(1)
    for _ in range(200):
        at = np.sort(r.choice(len(index.terms), r.integers(1, min(6, len(index.terms)) + 1), replace=False))
        weight = r.random(len(at)) + 0.1
        weight /= np.sqrt((weight**2).sum())
        cosine = dense[:, at] @ weight
        want = np.lexsort((index.doc_id, -np.round(cosine, 9)))[: T.NEIGHBOURS]
        want = want[cosine[want] > 0]
        ids, found = index.search(at, weight, T.NEIGHBOURS)
        assert index.doc_id[ids].tolist() == index.doc_id[want].tolist() and np.allclose(found, cosine[want])


def test_separates_and_cites(spark):
    rows = corpus()
    _, docs, labels = index_of(spark, rows)
    learned = labels.filter(~held_out(F.col("doc_id")))
    extra = docs.union(spark.createDataFrame([(9000, None), (9001, ""), (9002, "123 !?"), (9003, "GRIMBLE### Foulnix!! snarkle")], docs.schema))
    out = {r.doc_id: r for r in T.score_toxicity(extra, learned).collect()}
    for i, _, y in rows:
        assert (out[i].score >= 0.7) == bool(y)
    assert out[9003].score >= 0.7 and len(out[9003].evidence) == 3 and all(e.toxic for e in out[9003].evidence)
    base = {out[i].score for i in (9000, 9001, 9002)}
    assert len(base) == 1 and 0.1 < base.pop() < 0.5
    kept = T.drop_toxic(extra.withColumn("score", F.lit(1)), learned)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i in out if out[i].score < 0.7}


def test_labels_never_leak_from_held_out_rows(spark):
    _, docs, labels = index_of(spark, corpus())
    learned = labels.filter(~held_out(F.col("doc_id")))
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).filter(~held_out(F.col("doc_id")))
    score = lambda x: sorted((r.doc_id, r.score) for r in T.score_toxicity(docs, x).collect())
    assert score(learned) == score(flipped)


def test_no_labels_one_label_null_and_repeated_rows(spark):
    index, docs, labels = index_of(spark, [(1, "a b c", None), (1, "a b c", None), (None, "x", None)])
    out = T.score_toxicity(docs, labels).collect()
    assert len(out) == 3 and all(r.score == 0.5 and r.evidence == [] for r in out)
    index, docs, labels = index_of(spark, [(i, f"word{i} and", 1) for i in range(20)])
    assert all(0 <= r.score <= 1 for r in T.score_toxicity(docs, labels).collect())
    assert T.score_toxicity(docs.limit(0), labels).collect() == []


def test_sample_bound(spark):
    index, _, _ = index_of(spark, corpus(), examples=100, terms=5)
    assert len(index.doc_id) <= 100 and len(index.terms) <= 5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    some = docs.join(labels, "doc_id", "left_semi")
    out = T.score_toxicity(some, labels.filter(~held_out(F.col("doc_id")))).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    rows = out.select("toxic", (F.col("score") >= 0.7).alias("p")).collect()
    toxic, clean = [r.p for r in rows if r.toxic], [r.p for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.01


def test_words_and_stems():
    terms, begin = T.word_terms(*letter_bytes(["Abcdefgh abcdefXX, abcdef", None, "ÉCOLE école"]))
    assert begin.tolist() == [0, 6, 6, 10]
    assert terms[1] == terms[3] != 0 and terms[5] == 0 and terms[0] != terms[2] and terms[6] == terms[8]


def test_any_base_rate(spark):
    rows = [(i, t if i % 4 else t.replace("grimble", "").replace("foulnix", "").replace("snarkle", ""), int(i % 4 > 0)) for i, t, _ in corpus()]
    r = np.random.default_rng(3)
    rows = [(i, t + (" " + " ".join(r.choice(["grimble", "foulnix", "snarkle"], 2)) if y else ""), y) for i, t, y in rows]
    _, docs, labels = index_of(spark, rows)
    out = {r.doc_id: r.score for r in T.score_toxicity(docs, labels).collect()}
    assert all((out[i] >= 0.7) == bool(y) for i, _, y in rows)
    assert {r.doc_id for r in T.drop_toxic(docs, labels).collect()} == {i for i, _, y in rows if not y}


def test_words_of_the_clean_are_terms(spark):
    rows = [(i, t + (" meadow" if i % 4 else ""), y) for i, t, y in corpus()]
    index, _, _ = index_of(spark, rows)
    assert np.isin(T.word_terms(*letter_bytes(["meadow"]))[0][0], index.terms)


def test_only_near_copies_count_once(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    line, rows = " ".join(word() for _ in range(40)), []
    for i in range(80):
        own = f"{line} {'grimble' if i % 4 == 0 else word()} " + " ".join(word() for _ in range(20))
        rows += [(3 * i + j, own, int(i % 4 == 0)) for j in range(2)] + [(3 * i + 2, own + " " + word(), int(i % 4 == 0))]
    index, _, _ = index_of(spark, rows)
    kept = set((index.doc_id // 3).tolist())
    assert {i for i in range(80) if i % 4 == 0} <= kept
    assert len(index.doc_id) < 240 and all((index.doc_id == 3 * i + 1).sum() == 0 for i in kept)
