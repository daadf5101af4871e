"""How text filters interact: what each removes in every order of them.

Every document has a mask of the filters that it fails.  A mask stands for one
wide integer: a counter field for each outcome of each step of each order.
Tasks add these integers, so one sum per part holds all counts, and no field
runs into the next.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import attach, save

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Bytes of a field: a count of rows is below 2**63, so a sum never carries into its neighbour.
FIELD_BYTES = 8
#: Outcomes counted for each step, in the order of their fields.
OUTCOMES = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
#: Parts that a task sums before it hands their sums on.
PARTS = 1000
#: Sums of a part are added in so many lanes before they meet.
LANES = 256


def _fields(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """What a document with this mask and these labels adds to every field."""
    fails = [bool(mask >> i & 1) for i in range(STEPS)]
    out = np.zeros((len(ORDERS), STEPS, len(OUTCOMES)), dtype="<u8")
    for o, order in enumerate(ORDERS):
        there = True
        for s, letter in enumerate(order):
            fail = fails[FILTERS.index(letter)]
            removed = there and fail
            out[o, s] = [there and not fail, removed, fail and not there, removed and good, removed and toxic]
            there = there and not fail
    alone = np.array([mask == 1 << i for i in range(STEPS)], dtype="<u8")
    return np.concatenate((out.ravel(), alone))


def packed_masks() -> list[int]:
    """The wide integer of each mask + 32 * good + 64 * toxic."""
    return [int.from_bytes(_fields(x & 31, bool(x & 32), bool(x & 64)).tobytes(), "little") for x in range(128)]


def unpacked(total: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by order, step and outcome, and of the documents that fail one filter only."""
    size = len(ORDERS) * STEPS * len(OUTCOMES) + STEPS
    flat = np.frombuffer(total.to_bytes(size * FIELD_BYTES, "little"), dtype="<u8").astype(np.int64)
    return flat[:-STEPS].reshape(len(ORDERS), STEPS, len(OUTCOMES)), flat[-STEPS:]


def _bytes(total: int) -> bytes:
    return total.to_bytes((total.bit_length() + 7) // 8, "little")


def _pack(batches):
    packed = packed_masks()
    sums: dict[str, int] = {}

    def handed_on():
        out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([_bytes(x) for x in sums.values()], pa.binary())], ["part", "packed"])
        sums.clear()
        return out

    for batch in batches:
        part = batch.column("part").dictionary_encode()
        at = part.indices.to_numpy() * 128 + batch.column("mask").to_numpy()
        counts = np.bincount(at, minlength=128 * len(part.dictionary)).reshape(-1, 128)
        for name, row in zip(part.dictionary.to_pylist(), counts):
            sums[name] = sums.get(name, 0) + sum(int(row[x]) * packed[x] for x in np.flatnonzero(row))
        if len(sums) > PARTS:
            yield handed_on()
    yield handed_on()


def _sum(table: pa.Table) -> int:
    return sum(int.from_bytes(x, "little") for x in table.column("packed").to_pylist())


def _add(key, table):
    return pa.table({"part": pa.array([key[0].as_py()], pa.string()), "packed": pa.array([_bytes(_sum(table))], pa.binary())})


_COUNTED = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _unpack(key, table):
    counts, alone = unpacked(_sum(table))
    letter = np.array([[FILTERS.index(x) for x in order] for order in ORDERS]).ravel()
    counts = counts.reshape(-1, len(OUTCOMES))
    removed = counts[:, OUTCOMES.index("removed")]
    shapley = np.array([removed[letter == i].sum() for i in range(STEPS)])
    found = dict(zip(OUTCOMES, counts.T))
    n = len(letter)
    return pa.table(
        {
            "part": pa.array([key[0].as_py()] * n, pa.string()),
            "filter_order": pa.array(np.repeat(ORDERS, STEPS), pa.string()),
            "step": pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32()),
            "kept": found["kept"], "removed": removed, "redundant": found["redundant"], "unique_fails": alone[letter],
            "good_lost": found["good_lost"], "toxic_lost": found["toxic_lost"], "shapley": shapley[letter],
        }
    )


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of every row of ``docs(doc_id, text, lang)``: bit i of the mask is filter i of FILTERS.

    A: under 100 words; B: distinct words under 80 % of the words; C: A-Z over 10 %
    of the characters; D: any of ``#$%&*|``; E: the text of a row with a smaller
    doc_id.  Texts are equal where their SHA-256 is.  A null text is empty; a row
    without doc_id is nobody's smaller and has no smaller.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "").alias("words"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    own = [
        F.size("words") < 100,
        100 * F.size(F.array_distinct("words")).cast("long") < 80 * F.size("words").cast("long"),
        100 * capitals.cast("long") > 10 * F.length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((x.cast("int") * (1 << i) for i, x in enumerate(own)), F.lit(0))
    rows = save(rows.select("doc_id", "part", mask.alias("mask"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "audit-masks")
    shared = save(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "audit-copies")
    judged = attach(rows, shared, ["digest"], rows.count(), how="left")
    return judged.select("doc_id", "part", (F.col("mask") + F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters of ``failures`` do to ``docs(doc_id, text, lang)``, in all 120 orders.

    Returns for each part (a value of lang, empty for null), order and step
    (its filter is that letter of the order) the documents kept after it, removed
    by it, failing it but removed before (``redundant``), failing it alone
    (``unique_fails``), removed here with quality 1 or toxic 1 in ``labels(doc_id,
    quality, toxic)``, and ``shapley``, what its filter removes summed over all
    orders.  Every row of ``docs`` counts, repeated ones too; a doc_id has a label
    if one of its rows there says so; other columns, whatever their names, are
    ignored.  Without documents there are no rows.
    """
    rows = save(failures(docs), "audit-failures")
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    said = save(said.filter("doc_id is not null and good + toxic > 0").join(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id"), "audit-labels")
    known = attach(rows, said, ["doc_id"], rows.count(), how="left")
    marked = known.select("part", (F.col("mask") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("toxic", F.lit(0))).cast("int").alias("mask"))
    packed = marked.mapInArrow(_pack, "part string, packed binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    added = packed.groupBy("part", "lane").applyInArrow(_add, "part string, packed binary")
    return added.groupBy("part").applyInArrow(_unpack, _COUNTED)
