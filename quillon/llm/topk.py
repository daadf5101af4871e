"""Exact top-k search by inner product with cover trees on both sides.

All vectors are dealt to the nodes of one tree, level by level: a node with too
many rows is covered by the net of a bounded sample of them, each row goes to
the nearest centre, until every leaf is a bounded group of one task.  Queries
and data share the tree.  Each query is first compared within its leaf; then
node pairs are ruled out level by level, by their covering radii against the
worst k-th score of the queries below.  Within a pair of leaves both sides are
cover trees (covering, separation, nesting), and node pairs are ruled out alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import attach, save

#: Rows of a leaf of the shared tree, and of a leaf of a tree in a task.
BLOCK = 4096
LEAF = 64
#: Each level of a tree in a task covers with this share of the radius above it.
SHRINK = 0.5
#: Children of a node of the shared tree at most, and the rows their net is drawn from: no more
#: than spark.sql.optimizer.windowGroupLimitThreshold, so that tasks cut a node's rows before the shuffle.
FAN = 32
SAMPLE = 1000


def net(points: np.ndarray, radius: float, most: int, first: int = 0) -> np.ndarray:
    """Places of a net of ``points``: every next one is the point farthest from those
    before, until all lie within ``radius``; so the chosen are farther apart than it."""
    chosen = [first]
    far = ((points - points[first]) ** 2).sum(axis=1)
    while len(chosen) < most and far.max(initial=0.0) > radius * radius:
        i = int(far.argmax())
        chosen.append(i)
        far = np.minimum(far, ((points - points[i]) ** 2).sum(axis=1))
    return np.array(chosen)


class Node:
    """A node of a cover tree over ``rows`` of ``points``.

    Its centre is a point and lies within ``radius`` of all rows (covering); the
    children's centres are farther apart than SHRINK of it (separation), the first
    of them is its own (nesting), and each row is below the nearest.  Rows that
    such a net does not group are a leaf, whatever their number.
    """

    __slots__ = ("centre", "radius", "norm", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, first: int = 0):
        own = points[rows]
        self.centre, self.rows, self.children = own[first], rows, []
        self.norm = float(np.sqrt((self.centre**2).sum()))
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(axis=1).max(initial=0.0)))
        if len(rows) <= LEAF or self.radius == 0:
            return
        most = 2 * len(rows) // LEAF + 1
        chosen = net(own, SHRINK * self.radius, most, first)
        if len(chosen) == most:
            return
        centres = own[chosen]
        gaps = (centres**2).sum(axis=1)[None, :] - 2 * own @ centres.T
        gaps[chosen, np.arange(len(chosen))] = -np.inf  # a centre is its own nearest
        nearest = gaps.argmin(axis=1)
        for i in range(len(chosen)):
            part = np.flatnonzero(nearest == i)
            self.children.append(Node(points, rows[part], int(np.searchsorted(part, chosen[i]))))


class Search:
    """The best ``k`` of the data for each query, kept while trees are compared."""

    def __init__(self, q_ids, queries, worst, d_ids, data, k):
        self.k, self.q_ids, self.d_ids = k, q_ids, d_ids
        order = np.argsort(d_ids, kind="stable")
        self.d_ids, data = d_ids[order], data[order]
        self.queries, self.data = queries, data
        self.exact = max(np.abs(queries).max(initial=0), 1) * max(np.abs(data).max(initial=0), 1) * max(data.shape[1], 1) < 2.0**53
        self.floor = worst
        self.scores = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def run(self):
        q = Node(self.queries, np.arange(len(self.queries)))
        d = Node(self.data, np.arange(len(self.data)))
        stack = [(q, d)]
        while stack:
            q, d = stack.pop()
            if bound(q.centre, q.norm, q.radius, d.centre, d.norm, d.radius) < self.worst(q.rows):
                continue
            if not q.children and not d.children:
                self.leaves(q.rows, d.rows)
            elif not q.children or (d.children and d.radius >= q.radius):
                pairs = [(q, c) for c in d.children]
                pairs.sort(key=lambda p: bound(p[0].centre, p[0].norm, p[0].radius, p[1].centre, p[1].norm, p[1].radius))
                stack += pairs
            else:
                stack += [(c, d) for c in q.children]
        return self

    def worst(self, rows) -> float:
        return float(np.maximum(self.scores[rows, -1].astype(np.float64), self.floor[rows]).min())

    def leaves(self, q_rows, d_rows):
        kind = np.float64 if self.exact else np.int64
        score = (self.queries[q_rows].astype(kind) @ self.data[d_rows].astype(kind).T).astype(np.int64)
        ids = np.broadcast_to(self.d_ids[d_rows], score.shape)
        score = np.concatenate((self.scores[q_rows], score), axis=1)
        ids = np.concatenate((self.ids[q_rows], ids), axis=1)
        own = ids == self.q_ids[q_rows][:, None]
        score = np.where(own, np.iinfo(np.int64).min, score)
        ids = np.where(own, np.iinfo(np.int64).max, ids)
        by_id = np.argsort(ids, axis=1, kind="stable")
        score, ids = np.take_along_axis(score, by_id, 1), np.take_along_axis(ids, by_id, 1)
        best = np.argsort(-score.astype(np.float64) if self.exact else ~score, axis=1, kind="stable")[:, : self.k]
        self.scores[q_rows], self.ids[q_rows] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)


def bound(qc, qn, qr, dc, dn, dr) -> float:
    """No inner product of the two groups is greater (a little is added for rounding)."""
    most = float(qc @ dc) + qn * dr + dn * qr + qr * dr
    return most + 1e-9 * (abs(most) + qn * dn + 1)


_FOUND = "query_id long, vec_id long, score long"


def _pair(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not len(left) or not len(right):
            return empty
        def matrix(t: pa.Table) -> np.ndarray:
            flat = np.array(t.column("v").combine_chunks().flatten(), dtype=np.int64)
            return flat.reshape(len(t), len(flat) // len(t)).astype(np.float64)

        s = Search(
            left.column("vec_id").to_numpy(), matrix(left), left.column("worst").to_numpy().astype(np.float64),
            right.column("vec_id").to_numpy(), matrix(right), k,
        ).run()
        found = s.ids != np.iinfo(np.int64).max
        q = np.broadcast_to(s.q_ids[:, None], s.ids.shape)
        return pa.table({"query_id": q[found], "vec_id": s.ids[found], "score": s.scores[found]})

    return run


def _cover(block: int, fan: int):
    """Centres of the children of one node, from its sampled rows."""

    def run(key, table):
        v = table.column("v").combine_chunks()
        points = np.array(v.flatten(), dtype=np.float64).reshape(len(table), -1) if len(v.flatten()) else np.zeros((len(table), 0))
        spread = float(np.sqrt(((points - points[0]) ** 2).sum(axis=1).max(initial=0.0)))
        chosen = net(points, SHRINK * spread, fan)
        if len(chosen) < 2:
            chosen = net(points, 0.0, fan)
        n = table.column("n")[0].as_py()
        # Copies cannot be told apart: they are split by hash around one centre.
        parts = n // block + 1 if len(chosen) == 1 else 1
        return pa.table({"node": [key[0].as_py()], "n": [n], "parts": [parts], "centres": pa.array([points[chosen].tolist()], pa.list_(pa.list_(pa.float64())))})

    return run


_ROW = "vec_id long, query boolean, v array<long>, node string, trail array<struct<node: string, d: double>>"


def _descend(batches):
    """Rows of covered nodes go to the child with the nearest centre."""
    kind = pa.list_(pa.struct([("node", pa.string()), ("d", pa.float64())]))
    for batch in batches:
        node, trail, ids = batch.column("node").to_pylist(), batch.column("trail").to_pylist(), batch.column("vec_id").to_numpy()
        rows: dict[str, list[int]] = {}
        valid = batch.column("centres").is_valid().to_pylist()
        for i, name in enumerate(node):
            if valid[i]:
                rows.setdefault(name, []).append(i)
        for name, own in rows.items():
            points = np.array(batch.column("v").take(pa.array(own)).flatten(), dtype=np.float64).reshape(len(own), -1) if len(batch.column("v")[own[0]]) else np.zeros((len(own), 0))
            centres = np.array(batch.column("centres")[own[0]].as_py(), dtype=np.float64).reshape(-1, points.shape[1])
            parts = batch.column("parts")[own[0]].as_py()
            at = ((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)
            gap = np.sqrt(((points - centres[at]) ** 2).sum(axis=1))
            if parts > 1:
                at = (ids[own] * 2654435761 >> 7) % parts
            for i, child, d in zip(own, at.tolist(), gap.tolist()):
                node[i] = f"{name}/={child}" if parts > 1 else f"{name}/{child}"
                trail[i] = [*trail[i], {"node": node[i], "d": d}]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("query"), batch.column("v"), pa.array(node, pa.string()), pa.array(trail, kind)], ["vec_id", "query", "v", "node", "trail"]
        )


def _sampled(rows: DataFrame) -> DataFrame:
    """SAMPLE rows of each node, by hash."""
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("vec_id"), "vec_id"))
    return rows.withColumn("i", first).filter(F.col("i") <= SAMPLE).select("node", "v", "n")


def _tree(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their leaves, and the nodes: ``node, parent, level, n, n_q, c, norm, r_d, r_q, leaf``."""
    leaves, found = rows, None
    while True:
        sizes = leaves.groupBy("node").agg(F.count("*").alias("n"))
        # A part of copies ("=") is bounded in the mean; it is not split again.
        big = save(sizes.filter((F.col("n") > BLOCK) & ~F.col("node").contains("=")), "topk-big")
        if big.isEmpty():
            break
        some = attach(leaves, big.withColumn("m", F.col("n")), ["node"], total).withColumnRenamed("m", "n")
        some = _sampled(some)
        covers = save(some.groupBy("node").applyInArrow(_cover(BLOCK, FAN), "node string, n long, parts long, centres array<array<double>>"), "topk-covers")
        whole = F.col("parts") > 1
        children = covers.select(
            "node", F.when(whole, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.size("centres").cast("long") - 1)).alias("i"), "centres", whole.alias("whole")
        ).select(F.col("node").alias("parent"), F.explode("i").alias("i"), "centres", "whole")
        children = save(
            children.select(
                F.concat("parent", F.when(F.col("whole"), F.lit("/=")).otherwise(F.lit("/")), F.col("i").cast("string")).alias("node"), "parent", F.when(F.col("whole"), F.col("centres")[0]).otherwise(F.get("centres", F.col("i").cast("int"))).alias("c")
            ),
            "topk-children",
        )
        found = children if found is None else found.unionByName(children)
        moved = attach(leaves, covers, ["node"], total, how="left").mapInArrow(_descend, _ROW)
        leaves = save(moved, "topk-leaves")
    root = rows.select("node").distinct().select("node", F.lit("").alias("parent"), F.lit(None).cast("array<double>").alias("c"))
    every = root if found is None else root.unionByName(found)
    below = leaves.select("query", F.explode("trail").alias("t"))
    said = below.groupBy("t.node").agg(
        F.count("*").alias("n"), F.count_if("query").alias("n_q"), F.max("t.d").alias("r_d"), F.coalesce(F.max(F.when(F.col("query"), F.col("t.d"))), F.lit(0.0)).alias("r_q")
    )
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    nodes = every.join(said, "node").withColumn("norm", norm)
    parents = every.select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    nodes = nodes.join(parents, "node", "left").withColumn("leaf", F.col("inner").isNull()).drop("inner")
    return leaves, save(nodes, "topk-nodes")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other rows.

    ``vectors(vec_id, embedding)`` become ``floor(scale * x)``; scores are
    integer inner products (exact in 64 bits).  ``is_query`` is a Column.  Ties
    go to the smaller vec_id; fewer candidates give fewer rows.  Vectors that
    are null or hold null or non-finite components take no part, nor do rows
    without vec_id; vectors of different lengths are never compared, those
    without components score 0 with each other.  Rows with the query's vec_id
    are its own.  Repeated rows of another vec_id are a candidate each; equal
    rows of a query are one query, rows of one vec_id that differ share its ranks.
    An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
        F.size("embedding").cast("string").alias("node"),
        # The root of each length of vectors; it rules nothing out.
        F.array(F.struct(F.size("embedding").cast("string").alias("node"), F.lit(0.0).alias("d"))).alias("trail"),
    )
    rows = save(rows, "topk-rows")
    leaves, nodes = _tree(rows, rows.count())
    queries = save(leaves.filter("query").drop("query").dropDuplicates(["vec_id", "v"]), "topk-queries")

    def compare(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
        left = left.select(*key, "vec_id", "v", "worst")
        right = right.select(*[F.col(c).alias(c) for c in (*key, "vec_id", "v")])
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_pair(k), _FOUND)

    # Within the query's own leaf; the leaves without queries are not read.
    asked = queries.select("node").distinct()
    found = save(compare(queries.withColumn("worst", F.lit(float("-inf"))), leaves.join(asked, "node", "left_semi"), "node"), "topk-first")
    worst = save(
        found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("worst")).filter("worst is not null"),
        "topk-worst",
    )
    known = save(queries.join(worst, "vec_id", "left").fillna(float("-inf"), ["worst"]), "topk-known")
    least = known.select("worst", F.explode("trail.node").alias("node")).groupBy("node").agg(F.min("worst").alias("least"))
    own = nodes.join(least, "node", "left")
    q = save(own.filter("n_q > 0").select(*[F.col(c).alias(f"q_{c}") for c in ("node", "parent", "leaf", "c", "norm")], "n_q", "r_q", "least"), "topk-q-nodes")
    d = save(own.select(*[F.col(c).alias(f"d_{c}") for c in ("node", "parent", "leaf", "c", "norm")], "r_d"), "topk-d-nodes")
    centre = F.aggregate(F.zip_with("q_c", "d_c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    most = centre + F.col("q_norm") * F.col("r_d") + F.col("d_norm") * F.col("r_q") + F.col("r_q") * F.col("r_d")
    reaches = F.col("q_c").isNull() | F.col("d_c").isNull() | (most + 1e-6 * (F.abs(most) + F.col("q_norm") * F.col("d_norm") + 1) >= F.coalesce("least", F.lit(float("-inf"))))
    columns = ["q_node", "d_node", "q_leaf", "d_leaf", "n_q"]
    # One root for each length of vectors; then the children of the pairs that are left.
    pairs = save(q.filter("q_parent = ''").join(d.filter("d_parent = ''"), F.col("q_node") == F.col("d_node")).select(*columns), "topk-pairs")
    done = pairs.filter("q_leaf and d_leaf")
    while not (open_ := pairs.filter("not (q_leaf and d_leaf)")).isEmpty():
        left = open_.select("d_node", "d_leaf", F.col("q_node").alias("at"), F.col("q_leaf").alias("stays")).join(
            q.unionByName(q.filter("q_leaf").withColumn("q_parent", F.col("q_node"))), F.col("at") == F.col("q_parent")
        )
        left = left.select(*q.columns, F.col("d_node").alias("on"))
        both = left.join(d.unionByName(d.filter("d_leaf").withColumn("d_parent", F.col("d_node"))), F.col("on") == F.col("d_parent"))
        pairs = save(both.filter(reaches).select(*columns), "topk-pairs")
        done = done.unionByName(pairs.filter("q_leaf and d_leaf"))
    # A data leaf meets its queries in bounded runs: its tree is built once a run.
    done = done.filter("q_node <> d_node")
    run = F.sum("n_q").over(Window.partitionBy("d_node").orderBy("q_node").rowsBetween(Window.unboundedPreceding, -1))
    done = save(done.withColumn("run", F.floor(F.coalesce(run, F.lit(0)) / BLOCK)), "topk-done")
    left = known.join(done.select(F.col("q_node").alias("node"), "d_node", "run"), "node")
    right = leaves.select(F.col("node").alias("d_node"), "vec_id", "v").join(done.select("d_node", "run").distinct(), "d_node")
    every = found.unionByName(compare(left, right, "d_node", "run"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        every.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
