"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; longer texts are one step.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; on one machine a temporary one if unset."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes of one Arrow batch, so that a Python worker holds a few MB of texts (or
#: of pairs of sets) at a time, however long they are.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Settings that the operators rely on, given to a session once: Arrow batches
    bounded by bytes, and shuffle files dropped when the query that made them ends."""
    if not spark.conf.get("quillon.ready", ""):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        spark.conf.set("quillon.ready", "true")


#: For tables whose rows are MB each.  Parquet looks at the size of a page and of a row group
#: only after 100 rows otherwise, and a task holds, and later reads, all of those at once.
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
}


def save(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet (with a writer's ``options``) in the shared scratch folder and read it back.

    This cuts the lineage: what was computed is not computed again, and losing
    an executor loses nothing.  The table goes when the driver ends, or by
    ``discard``.
    """
    spark = df.sparkSession
    ready(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    atexit.register(_remove, spark, path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.scratch_path = path
    return saved


def discard(*saved: DataFrame) -> None:
    """Remove saved tables from which nothing more is read."""
    for df in saved:
        _remove(df.sparkSession, df.scratch_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is already gone; the folder is scratch
        return


#: Keys that may hold more than one in so many rows; there are no more of them than this.
HOT_KEYS = 10_000


def attach(rows: DataFrame, keyed: DataFrame, key: list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row for each key and in ``n`` how many rows have it.

    Keys with more than one in HOT_KEYS of ``total`` rows are broadcast: there
    cannot be more than HOT_KEYS of them.  The others are joined by a shuffle
    in which no key is large; rows with a hot or null key stay out of it or,
    where they must come through a left join, are dealt by their content.  Both
    tables are read twice: give saved ones.
    """
    values = [c for c in keyed.columns if c not in (*key, n)]
    often = F.col(n) > max(1, total // HOT_KEYS)
    if how == "inner":
        hot, rest = (keyed.filter(x).select(*key, *values) for x in (often, ~often))
        found = rows.join(F.broadcast(hot), key)
        return found.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key)).select(*rows.columns, *values)
    hot, rest = (x.select(*key, *[F.col(c).alias(f"{c}_{side}") for c in values], F.lit(True).alias(f"is_{side}")) for x, side in ((keyed.filter(often), "hot"), (keyed.filter(~often), "rest")))
    apart = F.col("is_hot").isNotNull()
    for c in key:
        apart = apart | F.col(c).isNull()
    salt = F.when(apart, F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long"))
    joined = rows.join(F.broadcast(hot), key, "left").withColumn("salt_", salt).join(rest.withColumn("salt_", F.lit(0).cast("long")), [*key, "salt_"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"{c}_hot", f"{c}_rest").alias(c) for c in values])


def crc_mod(doc_id, modulus: int):
    """crc32 of the decimal text of ``doc_id``, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id):
    """True for the rows no model may learn labels from (remainder 1 of 3)."""
    return F.coalesce(crc_mod(doc_id, 3) == 1, F.lit(False))


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``limit`` bytes; every run has a row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + int(n) > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: One random 64-bit word per byte value, and the odd base of the polynomial.
BYTE_WORDS = random_words(256, 17)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes of letter words: a-z, A-Z and all of every character beyond ASCII.
_LETTER_GAP = np.ones(256, dtype=bool)
_LETTER_GAP[128:] = False
_LETTER_GAP[97:123] = False
_LETTER_GAP[65:91] = False


#: The same with digits.
_WORD_GAP = _LETTER_GAP.copy()
_WORD_GAP[48:58] = False


def letter_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts and their offsets; null counts as empty."""
    parts = [(x or "").lower().encode("utf-8", "replace") for x in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offsets


def letter_words(raw: np.ndarray, offsets: np.ndarray):
    """``word_hashes`` for runs of letters: digits and punctuation end a word."""
    return word_hashes(raw, offsets, _LETTER_GAP)


def plain_words(raw: np.ndarray, offsets: np.ndarray):
    """``word_hashes`` for runs of letters and digits: only punctuation ends a word."""
    return word_hashes(raw, offsets, _WORD_GAP)


def word_hashes(
    raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, in order.

    A word is a run of bytes not in ``gap`` (ASCII white space unless given),
    A-Z lower-cased.  Returns the hashes, for each text the number of words
    before it (one more than texts), and the first and last-plus-one byte of
    each word.
    """
    n = len(raw)
    ends_at = np.zeros(n + 1, dtype=bool)
    ends_at[offsets] = True
    low = _LOWER[raw]
    inside = ~gap[low]
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[ends_at[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        after[np.flatnonzero(ends_at[1:])] = False
    stops = np.flatnonzero(inside & ~after) + 1
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts, starts, stops
    lengths = stops - starts
    powers = np.empty(int(lengths.max()), dtype=np.uint64)
    powers[0] = 1
    powers[1:] = BASE
    np.multiply.accumulate(powers, out=powers)
    flat = low[inside]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(flat)) - np.repeat(first, lengths)
    terms = BYTE_WORDS[flat] * powers[place]
    return mix64(np.add.reduceat(terms, first)), counts, starts, stops
