"""Ranked search against scores of every pair, and what its bounds leave out."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import lexical
from quillon.llm.common import plain_words, text_bytes

DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string, doc_id string, rank int"


def _terms(text):
    low = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _brute(docs, items, k):
    own = [(d, _terms(t)) for d, t, *_ in docs]
    own = [(d, t) for d, t in own if t]
    n, total = len(own), sum(len(t) for _, t in own)
    asked: dict = {}
    for i, t, *_ in items:
        if i is not None:
            asked.setdefault(i, set()).update(_terms(t))
    out = []
    for i, terms in asked.items():
        df = {t: sum(t in x for _, x in own) for t in terms}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for d, x in own:
            m = 50 + 50 * len(x) * n // total
            score = sum(w[t] * (10**9 * x.count(t) // (1000 * x.count(t) + 20 * m)) for t in terms if t in x)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 30, 200, 900)))), "x", 1) for i in range(400)]
    docs += [(1000 + i, docs[3][1], None, None) for i in range(30)] + [(7, docs[7][1], None, None)]
    docs += [(2000, None, None, None), (2001, "", None, None), (2002, " .;", None, None), (None, docs[5][1], None, None), (None, docs[5][1], None, None)]
    docs += [(2003, "W1, w2! é w3_w3 Éa éA " * 5, None, None), (2004, "w1 w2 " * 60_000, None, None)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 40)))), "x", 2) for i in range(25)]
    items += [(25, docs[3][1], None, None), (26, "", None, None), (27, None, None, None), (None, "w1 w2", None, None), (28, "éa É W3", None, None)]
    items += [(3, "w9 w10 w11", None, None), (29, "nowhere", None, None), (30, docs[5][1], None, None)]
    return docs, items


def test_against_every_pair(spark, corpus):
    docs, items = corpus
    for k, parts in ((50, 3), (5, 1)):
        found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), k)
        assert sorted([tuple(r) for r in found.collect()], key=lambda x: x[:2]) == _brute(docs, items, k)


def test_items_in_several_passes(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "ITEMS", 7)
    found = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 10)
    assert sorted([tuple(r) for r in found.collect()], key=lambda x: x[:2]) == _brute(docs, items, 10)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    for d, i in ((none[0], spark.createDataFrame(items, ITEMS)), (spark.createDataFrame(docs, DOCS), none[1])):
        assert lexical.search(d, i).collect() == []


def _blocks(docs):
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.string())], ["doc_id", "text"])
    return [pa.Table.from_batches([b]) for b in lexical._index([batch])]


def test_bounds_hold_and_exclude(corpus):
    docs, items = corpus
    hashed = [np.unique(plain_words(*text_bytes(pa.array([t], pa.string())))[0]) for _, t, *_ in items if t]
    terms = np.unique(np.concatenate(hashed))
    weights = np.arange(1, len(terms) + 1)
    asked = lexical.Asked(list(range(len(hashed))), terms, weights, [np.searchsorted(terms, x) for x in hashed], len(docs), 100_000, 5)
    close = []
    for block in _blocks(docs):
        row = block.to_pylist()[0]
        lengths, starts = np.array(row["lengths"]), np.array(row["starts"])
        m = asked.normed(lengths)
        most = asked.bounds(row["width"], np.frombuffer(row["slices"], np.uint8), lengths, m)
        exact = asked.exact(np.arange(len(lengths)), starts, np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], "<u4"), m)
        assert (most >= exact).all()
        close.append((exact.sum(), most.sum()))
    exact, most = np.sum(close, axis=0)
    assert most < 1.5 * exact


def test_most_documents_are_not_scored(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=60)), None, None) for i in range(3000)]
    items = [(i, docs[i * 90][1], None, None) for i in range(5)]
    blocks = lexical.index(spark.createDataFrame(docs, DOCS).coalesce(1))
    own = lexical._terms_of(spark.createDataFrame(items, ITEMS), 1, 0)
    terms = np.unique(np.concatenate([x for _, x in own]))
    asked = lexical.Asked([i for i, _ in own], terms, np.full(len(terms), 3000), [np.searchsorted(terms, x) for _, x in own], 3000, 180_000, 3)
    found = blocks.coalesce(1).mapInArrow(lexical._search(spark.sparkContext.broadcast(asked)), lexical._FOUND).collect()
    assert {r.item for r in found if r.doc_id == r.item * 90} == {0, 1, 2, 3, 4}
    assert 0 < found[0].scored < 1000
