import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import topk as T


def brute(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in good}.items():
        if i % 50 == 0:
            scored = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(df, k=5):
    return sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 50 == 0, k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("block,leaf", [(4096, 64), (60, 8)])
def test_embeddings(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "LEAF", leaf)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    assert len(want) == 50 and run(df) == want


def test_clusters_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 8)) * 3
    rows = [(i, [float(x) for x in base[i % 6] + r.normal(size=8) * 0.05]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert run(df) == brute(rows)


def test_bad_vectors_few_rows_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, nan]), (2, None), (3, [0.5, None]), (4, [inf, 1.0]), (50, [-1.0, 0.25]), (100, [1.0]), (7, []), (None, [1.0, 1.0]), (9, [0.1, 0.1])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, block string, dim int")
    assert run(df) == brute(rows)
    assert run(df.union(df)) == brute(rows + rows)
    assert run(df.limit(0)) == []
    empty = [(0, []), (1, []), (2, [1.0]), (50, [])]
    assert run(spark.createDataFrame(empty, "vec_id long, embedding array<double>")) == brute(empty)


def test_leaf_pairs_are_ruled_out_level_by_level(spark, monkeypatch):
    """Of clusters far apart, few pairs of leaves are left to compare."""
    monkeypatch.setattr(T, "BLOCK", 40)
    monkeypatch.setattr(T, "FAN", 4)
    r = np.random.default_rng(7)
    base = r.normal(size=(40, 6))
    base *= 60 / np.sqrt((base**2).sum(axis=1, keepdims=True))
    rows = [(i, [float(x) for x in base[i % 40] + r.normal(size=6) * 0.2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counted = {}
    saved = T.save
    monkeypatch.setattr(T, "save", lambda x, name: counted.setdefault(name, []).append(saved(x, name)) or counted[name][-1])
    assert run(df) == brute(rows)
    leaves = counted["topk-nodes"][0].filter("leaf").count()
    queries = counted["topk-q-nodes"][0].filter("q_leaf").count()
    levels = len(counted["topk-pairs"])
    assert leaves > 50 and levels > 2
    assert counted["topk-done"][0].count() < 0.3 * leaves * queries


def test_a_cover_tree_covers_separates_and_nests():
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 5)) * 40
    points = np.concatenate([b + r.normal(size=(150, 5)) for b in base])
    seen = []

    def walk(node):
        gaps = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        assert gaps.max() <= node.radius + 1e-9
        if not node.children:
            seen.extend(node.rows.tolist())
            return
        centres = np.array([c.centre for c in node.children])
        assert (centres[0] == node.centre).all()
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
        assert apart.min() > T.SHRINK * node.radius and all(c.radius <= T.SHRINK * node.radius + 1e-9 for c in node.children)
        for c in node.children:
            walk(c)

    tree = T.Node(points, np.arange(len(points)))
    walk(tree)
    assert tree.children and sorted(seen) == list(range(len(points)))


def test_trees_rule_pairs_out():
    r = np.random.default_rng(1)
    data = np.floor(np.concatenate([r.normal(size=(400, 4)) + 40 * c for c in np.concatenate((np.eye(4), -np.eye(4)))[:4] * [[1], [2], [3], [4]]]) * 16)
    calls = []

    class Counting(T.Search):
        def leaves(self, a, b):
            calls.append(len(a) * len(b))
            super().leaves(a, b)

    s = Counting(np.arange(10**6, 10**6 + 40), data[1200:1600:10], np.full(40, -np.inf), np.arange(1600), data, 5).run()
    score = (data[1200:1600:10] @ data.T).astype(int)
    want = [[j for _, j in sorted((-x, j) for j, x in enumerate(row))[:5]] for row in score.tolist()]
    assert s.ids.tolist() == want
    assert sum(calls) < 0.7 * 40 * 1600


def test_a_node_is_cut_before_its_rows_meet(spark):
    from quillon.llm.topk import _sampled

    rows = spark.range(5000).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("string").alias("node"), F.array("id").alias("v"), F.lit(5000).alias("n"))
    plan = _sampled(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
