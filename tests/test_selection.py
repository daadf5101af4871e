"""Quantiles by selection, weighted samples, scans of merged ranges, greedy parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import cells, metrics, ranking, sampling


def test_quantiles_of_skewed_constant_and_odd_groups(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANKED", 300)
    rng = random.Random(6)
    rows = [("skew", rng.paretovariate(0.3)) for _ in range(3000)] + [("same", 2.5)] * 2000 + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan"))]
    rows += [(None, float(i % 3)) for i in range(400)] + [("far", x) for x in (-math.inf, 1.0, math.inf, math.inf)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r.g: r["values"] for r in metrics.quantiles(df, "x", ["g"], shares).collect()}
    assert set(got) == {"skew", "same", "one", "two", None, "far"}
    for g in ("skew", "same", "one", "two", None):
        want = np.quantile([x for k, x in rows if k == g], shares)
        assert got[g] == pytest.approx(list(want), rel=1e-12)
    assert got["far"][0] == -math.inf and got["far"][-1] == math.inf
    whole = metrics.quantiles(df.filter("g <> 'far'"), "x", [], [0.5]).first()["values"]
    assert whole == pytest.approx([np.quantile([x for k, x in rows if k not in (None, "far") and x is not None and x == x], 0.5)])
    assert metrics.quantiles(df.limit(0), "x", ["g"], shares).collect() == []
    said = {r.g: r for r in metrics.latency(df.filter("g in ('two', 'none')"), "x", ["g"]).collect()}
    assert said["two"].tp50 == 1.5 and said["none"].tp50 is None and said["none"]["avg"] is None


def test_weighted_samples_by_frequency(spark):
    weights, runs, n = [1.0, 2.0, 4.0, 8.0, 0.0, None], 3000, 2
    df = spark.createDataFrame(list(enumerate(weights)), "k int, w double")
    # One sample a seed, all at once: the two least times of each.
    each = df.filter("w > 0").crossJoin(spark.range(runs)).withColumn("t", -F.ln(sampling.uniform(0, F.concat_ws("-", "id", "k"))) / F.col("w"))
    firsts = ranking.top_k_per_group(each, ["id"], ["t"], n).groupBy("k").count().collect()
    p, total = {}, 15.0
    for i in range(4):
        p[i] = weights[i] / total + sum(weights[j] / total * weights[i] / (total - weights[j]) for j in range(4) if j != i)
    for r in firsts:
        assert abs(r["count"] - runs * p[r.k]) < 3.5 * math.sqrt(runs * p[r.k] * (1 - p[r.k]))
    one = sampling.weighted_sample(df, "k", "w", 3, 5)
    assert one.count() == 3 and sorted(map(tuple, one.collect())) == sorted(map(tuple, sampling.weighted_sample(df.repartition(3), "k", "w", 3, 5).collect()))
    assert {r.k for r in sampling.weighted_sample(df, "k", "w", 10, 1).collect()} == {0, 1, 2, 3}


def test_feedback_and_appended_prompts(spark):
    weights = spark.createDataFrame([(i, 1.0) for i in range(4)], "k int, weight double")
    feedback = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 0.0), (9, 5.0)], "k int, signal double")
    moved = sampling.with_feedback(weights, feedback, "k", 1.0)
    assert dict(moved.collect()) == {0: 0.5, 1: 0.0, 2: 1.0, 3: 1.0}
    prompts = spark.createDataFrame([(i,) for i in range(6)], "k int")  # two came after the weights
    picked = sampling.curriculum(prompts, moved, "k", 10, 2).collect()
    assert {(r.k, r.weight, r.epoch) for r in picked} == {(0, 0.5, 2), (2, 1.0, 2), (3, 1.0, 2), (4, 1.0, 2), (5, 1.0, 2)}


def _scans(ranges):
    out = []
    for idx, r1, c1, r2, c2 in ranges:
        a = (r2 - r1 + 1) * (c2 - c1 + 1)
        if out:
            first, last, asked, box = out[-1]
            b = (min(box[0], r1), min(box[1], c1), max(box[2], r2), max(box[3], c2))
            size = (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
            if idx == last + 1 and size <= max(1024, 4 * (asked + a)) and size <= 100_000:
                out[-1] = (first, idx, asked + a, b)
                continue
        out.append((idx, idx, a, (r1, c1, r2, c2)))
    return [(i, f, last, *b) for i, (f, last, _, b) in enumerate(out)]


def test_scans_of_merged_ranges(spark):
    rng = random.Random(1)
    rows = []
    for task in "abcde":
        idx = 0
        for _ in range(30):
            idx += rng.choice((1, 1, 1, 2))
            r, c = rng.choice((rng.randrange(1, 60), rng.randrange(1, 5000))), rng.randrange(1, 30)
            rows.append((task, idx, r, c, r + rng.choice((0, 5, 400, 9000)), c + rng.randrange(12)))
    names = "task_id string, range_idx int, min_row int, min_col int, max_row int, max_col int"
    df = spark.createDataFrame(rows, names).withColumns({"file": F.lit("f"), "sheet": F.lit("s")})
    got = cells.scan_groups(df.repartition(3)).drop("file", "sheet").collect()
    for task in "abcde":
        assert sorted(tuple(r)[1:] for r in got if r.task_id == task) == _scans([r[1:] for r in rows if r[0] == task])
    assert cells.scan_groups(df.limit(0)).collect() == []


def test_greedy_parts(spark):
    sizes = [5, 4, 3, 3, 9, 1]
    df = spark.createDataFrame([("b", i, n) for i, n in enumerate(sizes)], "b string, i int, n long")
    part = lambda equal: [r.part for r in ranking.greedy_partition(df, "b", "i", "n", 2, equal).orderBy("i").collect()]
    assert part(False) == [0, 1, 1, 0, 1, 0] and part(True) == [0, 1, 1, 0, 1, 0]
    heavy = spark.createDataFrame([("b", 0, 100), ("b", 1, 1), ("b", 2, 1), ("b", 3, 1)], "b string, i int, n long")
    equal = ranking.greedy_partition(heavy, "b", "i", "n", 2, True).groupBy("part").count().collect()
    assert sorted(r["count"] for r in equal) == [2, 2]


def test_dense_search_by_blocks(spark, monkeypatch):
    from quillon.operators import retrieval

    monkeypatch.setattr(retrieval, "CELLS", 40)
    rng = random.Random(3)
    vectors = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(300)]
    odd = [(1000, None), (1001, [1.0]), (1002, [1.0, None, 2.0]), (1003, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1004, [])]
    queries = [(f"q{i}", v) for i, v in vectors[:12]] + [("short", [2.0]), ("none", None), ("null", [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").repartition(3)
    found = retrieval.dense(df, spark.createDataFrame(queries, "query_id string, q array<float>"), 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: sorted(((i, float(sum(a * b for a, b in zip(v, x)))) for i, x in vectors), key=lambda t: (-t[1], t[0]))[:5] for q, v in queries[:12]}
    assert got == want | {"short": [(1001, 2.0)]}


def test_batches_beyond_their_bound_are_errors():
    import pyarrow as pa

    table = pa.table({"k": [2, 1, 3]})
    assert ranking.in_order(table, "k").column("k").to_pylist() == [1, 2, 3]
    with pytest.raises(ValueError, match="a batch of 1000001 rows"):
        ranking.in_order(pa.table({"k": np.zeros(1_000_001)}), "k")
