"""Retrieval: BM25 over an inverted index and exact dense top-k for given queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import written

#: Queries that one pass over the vectors takes, and distinct terms of queries that are broadcast.
BATCH, TERMS = 10_000, 1_000_000


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Postings of a query's rarest terms, for each of its k, from which its first threshold comes, and the pairs completed for it.
FIRST, SEEDS = 50, 4
#: Classes of document lengths in an octave.
SIZES = 3


class Bm25:
    """BM25 of ``docs(doc_id, text)`` for ``queries(query_id, text)`` without scoring every pair that shares a word.

    One scan counts the words that queries have (their distinct terms are broadcast up to
    ``TERMS``) and what other words a document has.  A term's greatest weight in documents of about one
    length bounds what it adds to them.  The rarest terms of a query lead to some pairs whose completed scores
    give it a threshold; terms are then taken from rare to common only while they and all
    more common ones could together reach it.  The pairs found so look up the other terms,
    those that can add most first, and are left as soon as they cannot reach it any more.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4):
        self.k, self.k1, self.b = k, k1, b
        asked = queries.select("query_id", F.explode(_words("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        among = asked.select("term", F.col("term").alias("known")).distinct()
        few = among.limit(TERMS + 1).count() <= TERMS
        words = docs.select("doc_id", F.explode(_words("text")).alias("term")).join(F.broadcast(among) if few else among, "term", "left")
        counts = words.groupBy("doc_id", "known").agg(F.count("*").alias("tf"))
        known = F.collect_list(F.when(F.col("known").isNotNull(), F.struct("known", "tf")))
        index = counts.groupBy("doc_id").agg(F.sum("tf").alias("length"), F.map_from_entries(known).alias("tf"))
        self.index = written(index.withColumn("size", F.floor(F.log2("length") * SIZES).cast("int")), "bm25-index")
        held = self.index.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        self.n, self.mean = held.n, held.mean or 1.0
        self.postings = self.index.select("doc_id", "length", "size", F.explode("tf").alias("term", "tf"))
        idf = F.ln(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tops = written(self.postings.groupBy("term", "size").agg(F.count("*").alias("df"), F.max(self._saturated(F.col("tf"))).alias("top")), "bm25-tops")
        each = tops.groupBy("term").agg(F.sum("df").alias("df")).withColumn("idf", idf)
        asked = asked.join(each, "term").withColumn("weight", F.col("qtf") * F.col("idf"))
        before = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
        self.asked = written(asked.withColumn("before", F.coalesce(before, F.lit(0))), "bm25-asked")
        # What a document of a size can score of which this is the rarest term of the query.
        rare = Window.partitionBy("query_id", "size").orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        sized = self.asked.join(tops.drop("df"), "term")
        most = (F.col("weight") * F.col("top")).alias("most")
        self.reach = written(sized.select("query_id", "term", "size", "weight", most, F.sum(most).over(rare).alias("reach")), "bm25-reach")

    def _saturated(self, tf: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * F.col("length") / self.mean))

    def partial(self, asked: DataFrame) -> DataFrame:
        """``query_id, doc_id, part, size``: scores by the terms of ``asked`` alone, where it has a size in documents of that."""
        found = self.postings.join(asked, [c for c in ("term", "size") if c in asked.columns])
        return found.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * self._saturated(F.col("tf"))).alias("part"), F.first("size").alias("size"))

    def completed(self, pairs: DataFrame) -> DataFrame:
        """``query_id, doc_id, score`` of the given pairs, by all terms: one lookup in the document's counts each."""
        whole = self.asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
        adds = lambda x: F.coalesce(x["weight"] * self._saturated(F.try_element_at("tf", x["term"])), F.lit(0.0))
        score = F.aggregate("terms", F.lit(0.0), lambda s, x: s + adds(x))
        return pairs.select("query_id", "doc_id").join(self.index, "doc_id").join(whole, "query_id").select("query_id", "doc_id", score.alias("score"))

    def candidates(self) -> DataFrame:
        """The pairs that can be among the best ``k`` of a query, ties included."""
        k, best = self.k, Window.partitionBy("query_id")
        first = self.partial(self.asked.filter(F.col("before") < FIRST * k))
        seeds = first.withColumn("n", F.row_number().over(best.orderBy(F.col("part").desc(), "doc_id"))).filter(F.col("n") <= SEEDS * k)
        seeds = self.completed(seeds).withColumn("n", F.row_number().over(best.orderBy(F.col("score").desc(), "doc_id")))
        least = seeds.filter(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score") - 1e-6).alias("least"))
        reach = written(self.reach.join(least, "query_id", "left").fillna(0.0, ["least"]), "bm25-least")
        found = self.partial(reach.filter(F.col("reach") >= F.col("least")))
        # The terms that are not looked for: what those after one could add.
        worth = Window.partitionBy("query_id", "size").orderBy(F.col("most").desc(), "term")
        after = F.coalesce(F.sum("most").over(worth.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
        rest = reach.filter(F.col("reach") < F.col("least")).withColumn("after", after)
        rest = rest.groupBy("query_id", "size").agg(F.sum("most").alias("rest"), F.sort_array(F.collect_list(F.struct((-F.col("most")).alias("order"), "term", "weight", "after"))).alias("terms"))
        left = found.join(least, "query_id", "left").fillna(0.0, ["least"]).join(rest, ["query_id", "size"], "left")
        left = left.filter(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("least")).join(self.index.drop("size"), "doc_id")
        adds = lambda x: F.coalesce(x["weight"] * self._saturated(F.try_element_at("tf", x["term"])), F.lit(0.0))
        going = lambda s, x: F.when(s + adds(x) + x["after"] >= F.col("least"), s + adds(x))
        reached = F.aggregate(F.coalesce("terms", F.array().cast(rest.schema["terms"].dataType)), F.col("part"), lambda s, x: F.when(s.isNotNull(), going(s, x)))
        return left.filter(reached >= F.col("least")).select("query_id", "doc_id")

    def best(self) -> DataFrame:
        # Equal texts have equal scores up to the order of their sums.
        rank = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
        return self.completed(self.candidates()).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= self.k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """``query_id, doc_id, score, rank``: the best ``k`` of ``docs(doc_id, text)`` for ``queries(query_id, text)``."""
    return Bm25(docs, queries, k, k1, b).best().select("query_id", "doc_id", "score", "rank")


def fetch(corpus: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows of the corpus by position, in the order asked."""
    return positions.join(corpus, "doc_idx").orderBy("place")


class _Best:
    """The ``k`` best vectors of each query so far: score (to 12 digits) down, then vec_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def take(self, scores: np.ndarray, vec: np.ndarray) -> None:
        """``scores`` of queries (rows) with vectors (columns).

        Of a block only what reaches its own ``k``-th score of a query is looked at, so a
        first block brings no more pairs than the others.
        """
        if scores.shape[1] > self.k and len(scores):
            self.floor = np.maximum(self.floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, at = np.nonzero(scores >= (self.floor - 1e-9 * np.maximum(np.abs(self.floor), 1))[:, None])
        q, score, vec = np.concatenate((self.q, q)), np.concatenate((self.score, scores[q, at])), np.concatenate((self.vec, vec[at]))
        order = np.lexsort((vec, -np.round(score, 12), q))
        q, score, vec = q[order], score[order], vec[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.q, self.score, self.vec = q[kept], score[kept], vec[kept]
        last = rank == self.k - 1
        self.floor[q[last]] = score[last]


#: Products of vectors and queries that are held at once.
CELLS = 1 << 20


def _products(shared, k: int):
    """Blocks of vectors times the matrix of queries; a task hands on ``k`` vectors a query."""

    def run(batches):
        ids, matrix = shared.value
        best = _Best(len(matrix), k)
        rows = max(1, CELLS // max(1, len(matrix)))
        for batch in batches:
            v = batch.column("embedding")
            good = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(v), matrix.shape[1]), False), batch.column("vec_id").is_valid())
            batch = batch.filter(good)
            v = batch.column("embedding").flatten()
            data = v.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), matrix.shape[1])
            whole = ~np.isnan(data).any(axis=1)
            data, vec = data[whole], batch.column("vec_id").to_numpy()[whole]
            for a in range(0, len(data), rows):
                best.take(matrix @ data[a : a + rows].T, vec[a : a + rows])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.q)), pa.array(best.vec, pa.int64()), pa.array(best.score, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score, rank``: inner products of each query with all vectors.

    The queries (``query_id, q``) are a stated set: about ``BATCH`` of them are a matrix that
    goes to one pass over the vectors, more take more passes.  A task multiplies blocks and
    keeps the best ``k`` of a query.  Vectors and queries that are null, hold null or NaN, or
    have another length take no part with each other.
    """
    spark = vectors.sparkSession
    queries = queries.filter(F.col("query_id").isNotNull() & F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull() | F.isnan(x)))
    lengths = [r.n for r in queries.select(F.size("q").alias("n")).distinct().collect()]
    rank = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id")
    out = queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    for n in lengths:
        own = queries.filter(F.size("q") == n)
        blocks = max(1, -(-own.count() // BATCH))
        for block in range(blocks):
            part = own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else own
            table = part.select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow()
            matrix = table.column("q").combine_chunks().flatten().to_numpy().reshape(len(table), n) if len(table) else np.zeros((0, n))
            shared = spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), matrix))
            kind = queries.schema["query_id"].dataType.simpleString()
            out = out.unionByName(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_products(shared, k), f"query_id {kind}, vec_id long, score double"))
    return out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def passages_to_text(passages: str) -> Column:
    """``Doc i (Title: ...) text`` of an array of ``struct<title, text>``, joined by newlines."""
    return F.array_join(
        F.transform(passages, lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), p["title"], F.lit(") "), p["text"])), "\n"
    )
