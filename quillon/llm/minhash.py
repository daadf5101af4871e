"""Near-duplicate groups by min-max hashing.

Under each permutation both the least and the greatest value of a document's
shingle set are kept, so half as many hash evaluations give as many signature
values.  Bands of values propose candidates, the full sets confirm links.

Equal sets are one class with one representative.  Within a band's bucket the
least representative is the hub: members are compared with it first.  Members
that are still apart are then known by what they lack of the hub and have
beyond it; two of them can only be alike if these differences share enough,
so those with a rare difference in common are compared (prefix filtering).
No bucket is cut, no link is lost, and a group of copies costs a few pairs per
copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import mix64, random_words, save, slices, text_bytes, word_hashes
from quillon.llm.graph import components

#: Signature values are twice as many.
PERMUTATIONS = 64
#: Values a band; 32 bands of 4 miss a pair at 0.80 once in 2e7, at 0.85 once in 2e10.
ROWS = 4

_A = random_words(PERMUTATIONS, 101) | np.uint64(1)
_B = random_words(PERMUTATIONS, 202)


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles of several texts, and where each text's begin.

    A text of fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    words, counts, _, _ = word_hashes(raw, offsets)
    per = np.diff(counts)
    multipliers = random_words(k, 303) | np.uint64(1)
    n = np.where(per >= k, per - k + 1, (per > 0).astype(per.dtype))
    begin = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(per)), n)
    at = counts[owner] + np.arange(begin[-1]) - begin[owner]
    last = counts[1:][owner]
    total = np.full(begin[-1], 0, dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(1, np.uint64)))
    for j in range(k):
        here = at + j
        inside = here < last
        total += np.where(inside, padded[np.minimum(here, len(words))] * multipliers[j], np.uint64(j))
    return mix64(total), begin


def shingle_sets(batch: pa.RecordBatch, k: int):
    """Sorted distinct shingle hashes of each row, by slices of rows."""
    raw, offsets = text_bytes(batch.column("text"))
    for a, b in slices(np.diff(offsets)):
        part = offsets[a : b + 1]
        hashes, begin = shingles(raw[part[0] : part[-1]], part - part[0], k)
        yield a, [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(b - a)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Least and greatest value of each non-empty set under each permutation."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        values = flat * _A[p] + _B[p]
        out[:, 2 * p] = np.minimum.reduceat(values, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(values, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row; bands never share a key."""
    n_bands = signature.shape[1] // ROWS
    multipliers = random_words(ROWS, 404) | np.uint64(1)
    salt = random_words(n_bands, 505)
    grouped = signature[:, : n_bands * ROWS].reshape(len(signature), n_bands, ROWS)
    return mix64((mix64(grouped) * multipliers).sum(axis=2, dtype=np.uint64) + salt)


_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"


def _sign(k: int):
    def run(batches):
        for batch in batches:
            for a, sets in shingle_sets(batch, k):
                full = [s for s in sets if len(s)]
                keys = band_keys(signatures(full)).view(np.int64) if full else np.zeros((0, 0), np.int64)
                rows, bands = iter(keys), []
                for s in sets:
                    bands.append(next(rows) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for a, sets in shingle_sets(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "shingles"],
                )

    return run


def _overlap(batches):
    for batch in batches:
        shared, either = [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            both = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
            both.sort()
            shared.append(int((both[1:] == both[:-1]).sum()))
            either.append(len(both) - shared[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(either, pa.int64())],
            ["a", "b", "shared", "either"],
        )


def _difference(batches):
    """What only one of the two sets has."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            out.append(np.setxor1d(x, y, assume_unique=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(out, pa.list_(pa.int64()))], ["a", "b", "apart"]
        )


def _alike(differences: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of members of one hub, in different groups, that may be linked.

    With x the difference of a set from the hub, two sets differ by x + y less
    twice what x and y share.  A link allows ``limit`` of difference, so x and
    y share ``(|x| + |y| - limit) / 2`` elements at least.  That is one or more:
    if it were none, one of the two would be linked to the hub and the other
    too.  Hence they share one among the first ``|x| - that + 1`` elements of
    x, and so for y, in any common order; rare ones come first here.
    """
    ratio = (100 - percent) / (100 + percent)
    own = differences.select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.size("apart").alias("size"), "apart")
    own = own.join(members, ["hub", "rep"])
    elements = own.select("hub", "rep", "n", "c", "size", F.explode("apart").alias("element"))
    often = elements.groupBy("hub", "element").agg(F.count("*").alias("often")).filter("often > 1")
    # Elements that no other member has come first of all and are only counted.
    shared = elements.join(often, ["hub", "element"])
    w = Window.partitionBy("hub", "rep")
    shared = shared.withColumn(
        "at", F.col("size") - F.count("*").over(w) + F.row_number().over(w.orderBy("often", "element")) - 1
    )
    # No partner allows more than this; a set's partner is at most 100 / percent as large.
    most = ratio * F.col("n") * (1 + 100 / percent)
    prefix = save(shared.filter(F.col("at") <= most).drop("often"), "minmax-prefixes")
    left, right = (
        prefix.select("hub", "element", *[F.col(x).alias(f"{x}_{side}") for x in ("rep", "n", "c", "size", "at")]) for side in ("a", "b")
    )
    needed = (F.col("size_a") + F.col("size_b") - ratio * (F.col("n_a") + F.col("n_b")) - 1e-6) / 2
    return (
        left.join(right, ["hub", "element"])
        .filter("rep_a < rep_b and c_a <> c_b")
        .filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .filter((F.col("at_a") <= F.col("size_a") - needed) & (F.col("at_b") <= F.col("size_b") - needed))
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Group ``docs(doc_id, text)`` whose ``k``-word shingle sets are alike.

    Two documents are linked where ``100 * shared >= percent * either``.
    Returns per row ``doc_id, n_shingles, component_id, kept``: the component
    is the least doc_id reachable, and its row is kept.  A null or wordless
    text has no shingles and no links.  Rows that share a doc_id are taken as
    one document: each keeps a row, and links of any count.  An empty table
    gives no rows; other columns are ignored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = save(ids.mapInArrow(_sign(k), _SIGNED), "minmax-signatures")
    classes = save(
        signed.filter("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("least"))
        .select("digest", F.col("least.doc_id").alias("rep"), F.col("least.n_shingles").alias("n"), F.col("least.bands").alias("bands")),
        "minmax-classes",
    )
    banded = classes.select(F.explode("bands").alias("key"), "rep", "n")
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("key", "hub")
    members = save(banded.join(hubs, "key").filter("rep <> hub"), "minmax-members")

    wanted = members.select(F.col("rep").alias("doc_id")).union(members.select(F.col("hub").alias("doc_id"))).distinct()
    sets = save(ids.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, shingles binary"), "minmax-sets")

    def with_sets(pairs: DataFrame) -> DataFrame:
        first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
        second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
        return pairs.select("a", "b").distinct().join(first, "a").join(second, "b")

    def confirm(pairs: DataFrame) -> DataFrame:
        """``a, b, shared, either`` of the distinct pairs ``(a, b)``, on full sets."""
        checked = with_sets(pairs).mapInArrow(_overlap, "a long, b long, shared long, either long")
        return save(checked, "minmax-pairs")

    linked = f"100 * shared >= {percent} * either"
    joins = members.groupBy("rep").agg(F.min("hub").alias("a")).select("a", F.col("rep").alias("b"))
    first = confirm(joins)
    links = first.filter(linked).select("a", "b")
    labels = components(links)

    # Hubs not yet in the same group.
    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        found = labels.select(F.col("id").alias(column), F.col("component").alias(name))
        return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))

    pairs = members.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    apart = labelled(labelled(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    second = confirm(apart.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    measured = first.unionByName(second)
    links = links.unionByName(second.filter(linked).select("a", "b"))
    labels = components(links)

    # Members of a bucket, neither its hub, that are still in different groups.
    open_ = labelled(members, "rep", "c")
    split = open_.groupBy("key").agg(F.min("c").alias("c_min"), F.max("c").alias("c_max")).filter("c_min < c_max").select("key")
    open_ = save(open_.join(split, "key", "left_semi").select("hub", "rep", "n", "c").distinct(), "minmax-open")
    third = confirm(
        _alike(save(with_sets(open_.select(F.col("hub").alias("a"), F.col("rep").alias("b"))).mapInArrow(_difference, "a long, b long, apart array<long>"), "minmax-apart"), open_, percent)
        .join(measured.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = third.filter(linked).select("a", "b")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = classes.select("digest", "rep").join(
        labels.select(F.col("id").alias("rep"), "component"), "rep", "left"
    ).select("digest", F.coalesce("component", "rep").alias("component"))
    return signed.join(named, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(False)).alias("kept"),
    )
