import hashlib
import random

import pytest

from quillon.llm.repeats import remove_repeats


def brute(rows, t):
    data = [(i, (x or "").encode()) for i, x in rows]
    least = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - t + 1):
                w = b[p : p + t]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - t + 1):
            if i is not None and least[b[p : p + t]] < i:
                gone[p : p + t] = b"\1" * t
        spans = sum(1 for p, x in enumerate(gone) if x and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, t=50):
    return sorted((tuple(r) for r in remove_repeats(df, t).collect()), key=str)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    want = brute(rows, 50)
    assert run(df) == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlapping_passages(spark, seed):
    r = random.Random(seed)
    pool = "".join(r.choice("abcdé \n") for _ in range(600))
    rows = []
    for i in range(60):
        cuts = []
        for _ in range(r.randrange(6)):
            a = r.randrange(550)
            cuts.append(pool[a : a + r.randrange(20, 200)])
            cuts.append("".join(r.choice("xyz") for _ in range(r.randrange(3))))
        rows.append((r.randrange(1000), "".join(cuts)))
    rows += [(5, "ab" * 300), (9, "ab" * 40), (11, "ab" * 24 + "a"), (7, "q" * 49), (8, "q" * 49), (2000, "q" * 50), (2001, "q" * 51)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute(rows, 50)


def test_a_common_passage_is_no_hot_task(spark, monkeypatch):
    """One passage in 20,000 documents: its digits take the path of aggregates and broadcasts."""
    import quillon.llm.repeats as m

    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(r.choice("jklmnop ") for _ in range(20)) + passage + f"{i:07d}" + "".join(r.choice("jklmnop ") for _ in range(40))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert run(df) == brute(rows, 50)
    ids = df.select("doc_id", "text")
    common = m._common_digits(ids, 50)
    assert 0 < len(common.value) < 300
    # What the ranked path sees of a digit, and all that the other sees.
    rows = ids.mapInArrow(m._anchors(50, common), m._ANCHORS)
    assert rows.filter("sides < 4294967296").groupBy("hi", "lo").count().agg({"count": "max"}).first()[0] < 200
    assert rows.filter("sides >= 4294967296").count() > 20_000


def test_one_number_tells_digits_apart(spark):
    import quillon.llm.repeats as m

    # Texts whose anchors share their first bytes: the first number must still differ.
    rows = [(i, "abcdefgh" * 3 + f"{i:08d}" + "abcdefgh" * 3) for i in range(500)]
    anchors = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(m._anchors(50), m._ANCHORS)
    assert anchors.select("hi").distinct().count() == anchors.select("hi", "lo").distinct().count() > 100


def test_the_common_path_alone(spark, monkeypatch):
    import quillon.llm.repeats as m

    monkeypatch.setattr(m, "COMMON", 1)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(df) == brute([tuple(r) for r in df.collect()], 50)


def test_nulls_ties_clashing_columns_empty(spark):
    long = " ".join(str(i) for i in range(400))
    rows = [(3, long), (3, long), (None, long), (1, None), (2, ""), (9, long[100:900] + "!" + long[:300]), (3, long + "tail")]
    df = spark.createDataFrame([(a, b, i, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, g int, c int")
    assert run(df) == brute(rows, 50)
    assert run(df.limit(0)) == []


def test_a_text_longer_than_a_step(spark, monkeypatch):
    import quillon.llm.repeats as m

    text = "".join(random.Random(4).choice("abcdef ") for _ in range(6000))
    rows = [(1, text), (2, text[700:5000] + "#" + text[:3000])]
    import numpy as np

    monkeypatch.setattr(m, "STEP", 1000)
    raw = np.frombuffer(text.encode(), np.uint8)
    blocks = m.Blocks(raw, np.array([0, len(raw)]), 50)
    assert [int(x) for a, b in zip(blocks.first, blocks.last) for x in range(a, b + 1)] == list(range(len(raw) - 49))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)
