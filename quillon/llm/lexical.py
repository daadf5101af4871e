"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks of documents.  A block holds a Bloom signature of
every document, cut into slices: slice i is a bitmap of the documents whose bit i
is set.  A signature has a term and, for terms that repeat, the steps that its
count reaches, so that the slices of a term bound its count from above.  Weighted
sums of these bounds over an item's terms bound the scores; documents whose bound
reaches what the best so far have are scored exactly from the block's forward lists.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LARGE_ROWS, mix64, plain_words, save, slices, text_bytes

#: Counts of a term that its document's signature tells apart.
REACHED = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 4096, 16384])
#: Bits set for each entry of a signature, and bits of a signature for each entry.
HASHES, WIDTH = 3, 8
#: Documents of a block, and bits and forward entries it may have (one document may have more).
BLOCK, BITS, ENTRIES = 1024, 1 << 23, 1 << 19
#: Items and bytes of items that one pass over the index takes; more take more passes.
ITEMS, ITEM_BYTES = 2_000, 1 << 20
#: Terms whose slices, and counters of terms and documents, that are held at once.
AT_ONCE, CELLS = 512, 1 << 22

_STEP = 0xD6E8FEB86659FD93


def positions(terms: np.ndarray, step: int, width: int) -> np.ndarray:
    """The slices of each term's entry for ``REACHED[step]``: a row for each of HASHES."""
    x = mix64(terms + np.uint64(step * _STEP % 2**64))
    y = mix64(x) | np.uint64(1)
    return np.stack([(x + np.uint64(h) * y) % np.uint64(width) for h in range(HASHES)]).astype(np.int64)


_BLOCK = pa.schema([
    ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("terms", pa.large_binary()), ("counts", pa.large_binary()), ("width", pa.int64()), ("slices", pa.large_binary()),
])
_BLOCK_DDL = "ids array<long>, lengths array<long>, starts array<long>, terms binary, counts binary, width long, slices binary"


def _signatures(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Slices by documents, eight documents a byte."""
    n = len(starts) - 1
    row = -(-n // 8)
    bits = np.zeros(width * row, dtype=np.uint8)
    doc = np.repeat(np.arange(n), np.diff(starts))
    for step, least in enumerate(REACHED):
        has = counts >= least
        if not has.any():
            break
        place, bit = doc[has] >> 3, (np.uint8(128) >> (doc[has] & 7).astype(np.uint8))
        for at in positions(terms[has], step, width):
            np.bitwise_or.at(bits, at * row + place, bit)
    return bits


class _Open:
    """Documents of one size class that wait for their block to fill."""

    def __init__(self, size: int):
        self.width = WIDTH << size
        self.most = max(8, min(BLOCK, BITS // self.width, ENTRIES >> size))
        self.docs: list = []

    def block(self) -> pa.RecordBatch:
        ids, lengths, terms, counts = zip(*self.docs)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in terms])))
        terms, counts = np.concatenate(terms), np.concatenate(counts)
        bits = _signatures(starts, terms, counts, self.width)
        self.docs = []
        row = [list(ids), list(lengths), starts.tolist(), terms.tobytes(), counts.astype("<u4").tobytes(), self.width, bits.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)


def _index(batches):
    """Blocks of documents of like size (so that no signature is much too wide), those that are left at the end."""
    waiting: dict[int, _Open] = {}
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in slices(sizes):
            raw, offsets = text_bytes(batch.column("text").slice(a, b - a))
            words, before, _, _ = plain_words(raw, offsets)
            ids = batch.column("doc_id").slice(a, b - a).to_pylist()
            for i, doc_id in enumerate(ids):
                own = words[before[i] : before[i + 1]]
                if not len(own):
                    continue
                terms, counts = np.unique(own, return_counts=True)
                entries = int(np.searchsorted(REACHED, counts, side="right").sum())
                size = max(6, (entries - 1).bit_length())
                open_ = waiting.setdefault(size, _Open(size))
                open_.docs.append((doc_id, len(own), terms, counts))
                if len(open_.docs) >= open_.most:
                    yield open_.block()
    for open_ in waiting.values():
        if open_.docs:
            yield open_.block()


def index(docs: DataFrame) -> DataFrame:
    """The blocks of ``docs(doc_id, text)``, written to the scratch folder.  Documents without a term are not in it."""
    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index, _BLOCK_DDL), "lexical-blocks", LARGE_ROWS)


def _frequencies(shared):
    """How many documents of a task have each of the terms asked for."""

    def run(batches):
        asked = shared.value
        found = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                own = np.frombuffer(terms.as_buffer(), dtype=np.uint64)
                at = np.searchsorted(asked, own)
                at[at == len(asked)] = 0
                found += np.bincount(at[asked[at] == own], minlength=len(asked))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["term", "df"])

    return run


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``10**9 tf div (1000 tf + 20 m)``: grows with tf, below 10**6."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Asked:
    """The items of one pass: sorted term hashes, weights, and each item's terms."""

    def __init__(self, items: list[int], terms: np.ndarray, weights: np.ndarray, of_items: list[np.ndarray], n: int, total: int, k: int):
        self.items, self.terms, self.weights, self.n, self.total, self.k = items, terms, weights, n, total, k
        self.flat = np.concatenate(of_items)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in of_items])[:-1]))

    def normed(self, lengths: np.ndarray) -> np.ndarray:
        """m of each document; Python integers, since 50 n N may pass 64 bits."""
        return np.array([50 + 50 * int(x) * self.n // self.total for x in lengths], dtype=np.int64)

    def bounds(self, width: int, bits: np.ndarray, lengths: np.ndarray, m: np.ndarray) -> np.ndarray:
        """No document (columns) scores more for an item (rows)."""
        table = bits.reshape(width, -(-len(lengths) // 8))
        run = max(8, CELLS // len(self.terms) // 8 * 8)
        parts = [self._bounds(table[:, a // 8 : (a + run) // 8], lengths[a : a + run], m[a : a + run]) for a in range(0, len(lengths), run)]
        return np.concatenate(parts, axis=1)

    def _bounds(self, table: np.ndarray, lengths: np.ndarray, m: np.ndarray) -> np.ndarray:
        width, row, n = *table.shape, len(lengths)
        # By steps reached: nothing, then the most a count can be below the next step.
        tops = np.minimum(np.append(REACHED[1:] - 1, np.iinfo(np.int32).max)[:, None], lengths[None, :])
        worth = np.concatenate((np.zeros((1, n), dtype=np.int64), saturated(np.maximum(tops, 1), m[None, :])))
        each = np.empty((len(self.terms), n), dtype=np.int64)
        for a in range(0, len(self.terms), AT_ONCE):
            terms = self.terms[a : a + AT_ONCE]
            reached = np.zeros((len(terms), n), dtype=np.int8)
            going, there = np.arange(len(terms)), np.full((len(terms), row), 255, dtype=np.uint8)
            for step in range(len(REACHED)):
                for at in positions(terms[going], step, width):
                    there &= table[at]
                some = there.any(axis=1)
                going, there = going[some], there[some]
                if not len(going):
                    break
                reached[going] += np.unpackbits(there, axis=1, count=n).view(np.int8)
            each[a : a + AT_ONCE] = np.take_along_axis(worth, reached.astype(np.int64), axis=0) * self.weights[a : a + AT_ONCE, None]
        return self._summed(each)

    def _summed(self, each: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.items), each.shape[1]), dtype=np.int64)
        run = max(1, CELLS // each.shape[1])
        i = 0
        while i < len(self.items):
            # Items whose terms make about one run are summed together.
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + run, side="right")) - 1)
            b = self.first[j] if j < len(self.items) else len(self.flat)
            out[i:j] = np.add.reduceat(each[self.flat[self.first[i] : b]], self.first[i:j] - self.first[i], axis=0)
            i = j
        return out

    def exact(self, docs: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The scores of some documents (columns) for all items (rows)."""
        each = np.zeros((len(self.terms), len(docs)), dtype=np.int64)
        for column, d in enumerate(docs):
            own = terms[starts[d] : starts[d + 1]]
            at = np.searchsorted(self.terms, own)
            at[at == len(self.terms)] = 0
            same = self.terms[at] == own
            tf = counts[starts[d] : starts[d + 1]][same].astype(np.int64)
            each[at[same], column] = self.weights[at[same]] * saturated(tf, m[d])
        return self._summed(each)


class Best:
    """The ``k`` best documents of each item so far: score down, then doc_id (null last)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = np.zeros((items, k), dtype=np.int64)
        self.ids = np.full((items, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """What a document must score to be among them: above 0, or as much as the last."""
        return np.maximum(self.scores[:, -1], 1)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for i in np.flatnonzero((scores >= self.least()[:, None]).any(axis=1)):
            s, d = np.concatenate((self.scores[i], scores[i])), np.concatenate((self.ids[i], ids))
            order = np.lexsort((d, -s))[: self.k]
            self.scores[i], self.ids[i] = s[order], d[order]


_FOUND = "item long, doc_id long, score long, scored long"
_NO_ID = np.iinfo(np.int64).max
#: Documents of a block that are scored before the bounds are held against the new least score.
TURN = 64


def _search(shared):
    def run(batches):
        asked = shared.value
        best, scored = Best(len(asked.items), asked.k), 0
        some = max(1, min(TURN, CELLS // len(asked.terms)))
        for batch in batches:
            for r in range(len(batch)):
                get = lambda c: batch.column(c)[r]
                ids = np.array(get("ids").values.fill_null(_NO_ID), dtype=np.int64)
                lengths, starts = (np.array(get(c).values, dtype=np.int64) for c in ("lengths", "starts"))
                m = asked.normed(lengths)
                width = get("width").as_py()
                most = asked.bounds(width, np.frombuffer(get("slices").as_buffer(), dtype=np.uint8), lengths, m)
                terms, counts = np.frombuffer(get("terms").as_buffer(), dtype=np.uint64), np.frombuffer(get("counts").as_buffer(), dtype="<u4")
                # Documents in the order of how far some bound of theirs may carry them.
                left = np.flatnonzero((most >= best.least()[:, None]).any(axis=0))
                left = left[np.argsort(-most[:, left].max(axis=0, initial=0), kind="stable")]
                for a in range(0, len(left), some):
                    turn = left[a : a + some]
                    turn = turn[(most[:, turn] >= best.least()[:, None]).any(axis=0)]
                    if len(turn):
                        best.take(asked.exact(turn, starts, terms, counts, m), ids[turn])
                        scored += len(turn)
        at, rank = np.nonzero(best.scores > 0)
        ids = best.ids[at, rank]
        yield pa.RecordBatch.from_arrays(
            [pa.array([asked.items[i] for i in at], pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(best.scores[at, rank], pa.int64()), pa.array([scored] * len(at), pa.int64())],
            ["item", "doc_id", "score", "scored"],
        )

    return run


def _terms_of(items: DataFrame, passes: int, turn: int) -> list[tuple[int, np.ndarray]]:
    """The distinct term hashes of each item of one pass."""
    part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn) if passes > 1 else items
    found: dict[int, list] = {}
    for r in part.collect():
        raw, offsets = text_bytes(pa.array([r.text], pa.string()))
        found.setdefault(r.item_id, []).append(plain_words(raw, offsets)[0])
    return [(item, terms) for item, parts in sorted(found.items()) if len(terms := np.unique(np.concatenate(parts)))]


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms are runs of letters, digits and characters beyond ASCII, only A-Z
    lower-cased.  With N documents that have a term, L terms in all, n of a
    document, a term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, m is
    ``50 + (50 n N) div L``, and a score sums ``weight * (10**9 tf div (1000 tf + 20 m))``
    over the item's distinct terms.  Scores above 0 are ranked, ties by doc_id.

    Every row of ``docs`` is a document, repeated rows and doc_ids too; a row
    without doc_id counts and comes last among equals.  Null and empty texts
    have no terms.  Rows of one item_id are one item with the terms of all;
    items without id or term give no rows, nor do empty tables.  Other columns,
    whatever their names, are ignored.  Terms are told apart by 64 bits.
    """
    spark = docs.sparkSession
    blocks = index(docs)
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.countDistinct("item_id").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    held = blocks.select(F.explode("lengths").alias("n")).agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    passes = max(1, -(-size.items // ITEMS), -(-size.bytes // ITEM_BYTES))
    parts = []
    for turn in range(passes if held.n else 0):
        own = _terms_of(items, passes, turn)
        if not own:
            continue
        terms = np.unique(np.concatenate([x for _, x in own]))
        df = np.zeros(len(terms), dtype=np.int64)
        counted = blocks.select("terms").mapInArrow(_frequencies(spark.sparkContext.broadcast(terms)), "term long, df long")
        for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * held.n + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        asked = Asked([i for i, _ in own], terms, weights, [np.searchsorted(terms, x) for _, x in own], held.n, held.total, k)
        parts.append(blocks.mapInArrow(_search(spark.sparkContext.broadcast(asked)), _FOUND))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
