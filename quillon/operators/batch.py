"""Batch algebra over tables with an explicit ordinal ``row_id`` from 0.

Order is a column, never the placement of rows, so nothing here sorts the data
to gather, slice, repeat, chunk or pad it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

ROW = "row_id"


#: Sampled rows for each range from which the bounds of an order are drawn.
SAMPLED = 64


def with_range(df: DataFrame, order: Sequence[str | Column], ranges: int) -> DataFrame:
    """Add ``_range``: in which of about ``ranges`` equal runs of an order (ascending, null first) a row is.

    The bounds are rows of the order, all columns of it, so a frequent first
    value is cut by the next column; only rows equal in the whole order stay
    together.  They are drawn from a sample of at most some ``SAMPLED`` rows a
    range, and read first: a task that runs again sees the same.  A row finds its
    range among the square root of them twice.
    """
    spark = df.sparkSession
    fields = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    dealt = df.withColumn("_key", fields)
    n = df.count()
    share = min(1.0, SAMPLED * ranges / max(n, 1))
    drawn = dealt.select("_key").filter(F.pmod(F.xxhash64("_key", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = sorted_keys(drawn)
    bounds = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []
    wide = max(1, math.isqrt(len(bounds)))
    runs = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    kind = dealt.schema["_key"].dataType
    shape = StructType([StructField("_heads", ArrayType(kind)), StructField("_runs", ArrayType(ArrayType(kind)))])
    both = F.broadcast(spark.createDataFrame([([run[0] for run in runs], runs)], shape))
    run = F.size(F.filter("_heads", lambda x: x < F.col("_key")))
    inside = F.size(F.filter(F.get("_runs", F.col("_run") - 1), lambda x: x < F.col("_key")))
    placed = dealt.crossJoin(both).withColumn("_run", run)  # one row of bounds
    placed = placed.withColumn("_range", F.when(F.col("_run") == 0, F.lit(0)).otherwise((F.col("_run") - 1) * wide + inside))
    return placed.drop("_key", "_heads", "_runs", "_run")


def sorted_keys(drawn: DataFrame) -> list:
    """The sampled keys in order: Spark sorts them, since it says how values compare."""
    return [r[0] for r in drawn.orderBy("_key").collect()]


def with_ordinal(df: DataFrame, *order: str | Column) -> DataFrame:
    """Add ``row_id`` from 0 in a total order, ascending with null first, of any columns that compare.

    Rows are ranked within ranges of the order and offset by the rows of lower
    ranges, so no single task ranks everything.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = with_range(df, order, ranges)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(before), "_range").withColumn(ROW, F.col("_rank") + F.col("_before")).drop("_range", "_rank", "_before")


def select(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the ordinal and ``columns``; None keeps all."""
    return df if columns is None else df.select(ROW, *columns)


def pop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The popped columns and the rest; a missing column is an error."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise KeyError(f"no such columns: {sorted(missing)}")
    return df.select(ROW, *columns), df.drop(*columns)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def gather(df: DataFrame, indices: Sequence[int] | Sequence[bool]) -> DataFrame:
    """Rows by index, with order and repeats, or by mask; a new ordinal."""
    spark = df.sparkSession
    if indices and isinstance(indices[0], bool):
        indices = [i for i, keep in enumerate(indices) if keep]
    index = spark.createDataFrame([(int(i), n) for n, i in enumerate(indices)], f"{ROW} long, _new long")
    return df.join(F.broadcast(index), ROW).drop(ROW).withColumnRenamed("_new", ROW)


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """``permutation(row_id, new_id)``: an equi join gives every row its new place."""
    return df.join(permutation, ROW).drop(ROW).withColumnRenamed("new_id", ROW)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Python's slice; the row count is read only for negative bounds."""
    step = 1 if step is None else step
    if step < 1:
        raise ValueError("step must be positive")
    if (start or 0) < 0 or (stop or 0) < 0:
        start, stop, step = slice(start, stop, step).indices(df.count())
    start = start or 0
    kept = df.filter((F.col(ROW) >= start) & ((F.col(ROW) - start) % step == 0))
    kept = kept if stop is None else kept.filter(F.col(ROW) < stop)
    return kept.withColumn(ROW, ((F.col(ROW) - start) / step).cast("long"))


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both by ordinal; shared ones must be equal, nulls and NaN included."""
    shared = [c for c in right.columns if c in left.columns and c != ROW]
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in shared})
    joined = left.join(renamed, ROW)
    for c in shared:
        joined = joined.withColumn(
            c, F.when(F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(left.schema[c].dataType))
        )
    return joined.drop(*[f"_{c}" for c in shared])


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts one after the other; ordinals go on."""
    out, at = None, 0
    for part in parts:
        moved = part.withColumn(ROW, F.col(ROW) + at)
        out = moved if out is None else out.unionByName(moved)
        at += part.count()
    return out


def chunk(df: DataFrame, n: int, allow_uneven: bool = False) -> DataFrame:
    """Add ``chunk``: n equal runs; a count that n does not divide is an error."""
    total = df.count()
    if total % n and not allow_uneven:
        raise ValueError(f"{total} rows do not divide into {n} chunks")
    return df.withColumn("chunk", F.floor(F.col(ROW) / -(-total // n)))


def split(df: DataFrame, size: int) -> DataFrame:
    """Add ``chunk``: runs of ``size`` rows, the last may be short."""
    return df.withColumn("chunk", F.floor(F.col(ROW) / size))


def split_equal(df: DataFrame, n: int) -> DataFrame:
    """n runs of equal size; what is left over is dropped."""
    size = df.count() // n
    return df.filter(F.col(ROW) < size * n).withColumn("chunk", F.floor(F.col(ROW) / max(size, 1)))


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Every row ``times`` times: r0 r0 r1 r1, or r0 r1 r0 r1."""
    copies = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("_i", F.lit(0))
    place = F.col(ROW) * times + F.col("_i") if interleave else F.col("_i") * F.lit(df.count()) + F.col(ROW)
    return copies.withColumn(ROW, place.cast("long")).drop("_i")


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """Row i as often as its column ``times`` says; ``copy`` counts from 0."""
    return df.filter(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))


def unfold(df: DataFrame, column: str, n: int) -> DataFrame:
    """Cut an array column into n rows of equal length; the other columns repeat."""
    size = (F.size(column) / n).cast("int")
    cut = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))
    return cut.withColumn(column, F.slice(column, F.col("_i") * size + 1, size)).withColumn(ROW, F.col(ROW) * n + F.col("_i")).drop("_i")


def fold(df: DataFrame, size: int) -> DataFrame:
    """Runs of ``size`` rows as one row of arrays."""
    own = [c for c in df.columns if c != ROW]
    runs = df.groupBy(F.floor(F.col(ROW) / size).alias("_run")).agg(F.sort_array(F.collect_list(F.struct(ROW, *own))).alias("_x"))
    return runs.select(F.col("_run").alias(ROW), *[F.col(f"_x.{c}").alias(c) for c in own])


def unfold_batch(df: DataFrame) -> DataFrame:
    """The inverse of ``fold``: arrays of equal length back to rows."""
    own = [c for c in df.columns if c != ROW]
    rows = df.select(ROW, F.size(own[0]).alias("_n"), F.posexplode(F.arrays_zip(*own)).alias("_i", "_x"))
    return rows.select((F.col(ROW) * F.col("_n") + F.col("_i")).alias(ROW), *[F.col(f"_x.{c}").alias(c) for c in own])


def pad_to_divisor(df: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """Rows cycled from the start until the count divides; ``is_pad`` marks them."""
    n = df.count()
    pad = -n % divisor
    own = df.withColumn("is_pad", F.lit(False))
    if not pad or not n:
        return own, 0
    rounds = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(-(-pad // n)))))
    cycled = rounds.withColumn(ROW, F.col("_i") * n + F.col(ROW)).filter(F.col(ROW) < n + pad).drop("_i").withColumn("is_pad", F.lit(True))
    return own.unionByName(cycled), pad


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def pad_with(df: DataFrame, n: int, last: bool = False) -> DataFrame:
    """``n`` copies of the first or last row after the others."""
    total = df.count()
    row = df.filter(F.col(ROW) == (total - 1 if last else 0)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df.unionByName(row.withColumn(ROW, F.lit(total) + F.col("_i")).drop("_i"))


def mini_batches(df: DataFrame, size: int, epochs: int, seed: int) -> DataFrame:
    """``epoch, batch``: every epoch a shuffle by hash, in equal mini-batches.

    An epoch is ranked in 4096 ranges of the hash, each offset by the rows of
    lower ones, so no task sorts an epoch.
    """
    if df.count() % size:
        raise ValueError("the mini-batch size must divide the rows")
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    each = each.withColumn("_hash", F.xxhash64(F.lit(seed), "epoch", ROW)).withColumn("_range", F.shiftright("_hash", 52))
    lower = Window.partitionBy("epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.groupBy("epoch", "_range").agg(F.count("*").alias("_n")).select("epoch", "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("epoch", "_range").orderBy("_hash", ROW)) - 1
    placed = each.withColumn("_rank", rank).join(before, ["epoch", "_range"])
    return placed.withColumn("batch", F.floor((F.col("_rank") + F.col("_before")) / size)).select(*df.columns, "epoch", "batch")


def response_mask(mask: str, length: int) -> Column:
    """The last ``length`` entries of an attention mask."""
    return F.slice(mask, F.greatest(F.size(mask) - length + 1, F.lit(1)), length)


def sample(df: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """The first ``n`` by key, or ``n`` by the hash of seed and key (the same every time)."""
    return df.orderBy(key).limit(n) if seed is None else df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def hold_out(df: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """Add ``split``: test for a share of the keys by hash, else train."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000), "test").otherwise("train"))


def head_split(df: DataFrame, share: float) -> DataFrame:
    """Add ``split``: the first share of the rows by ordinal is train, the rest test."""
    return df.withColumn("split", F.when(F.col(ROW) < int(df.count() * share), "train").otherwise("test"))


def save_batch(df: DataFrame, path: str) -> None:
    """Write a batch with its ordinal; the folder must be new."""
    if ROW not in df.columns:
        raise KeyError(f"a batch has a column {ROW}")
    df.write.parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    """A saved batch; ordinals that repeat or leave gaps are an error."""
    df = spark.read.parquet(path)
    seen = df.agg(F.count("*").alias("n"), F.min(ROW).alias("first"), F.max(ROW).alias("last"), F.sum(F.col(ROW).cast("decimal(38,0)")).alias("sum")).first()
    if seen.n and (seen.first != 0 or seen.last != seen.n - 1 or int(seen.sum) != seen.n * (seen.n - 1) // 2):
        raise ValueError(f"{path}: the ordinals of {seen.n} rows do not count from 0")
    return df


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two batches have the same columns and, by ordinal, equal values (null and NaN equal themselves)."""
    if {f.name: f.dataType for f in left.schema} != {f.name: f.dataType for f in right.schema}:
        return False
    own = [c for c in left.columns if c != ROW]
    a = left.select(ROW, F.struct(*own).alias("_a")) if own else left.select(ROW, F.lit(1).alias("_a"))
    b = right.select(ROW, F.struct(*own).alias("_b")) if own else right.select(ROW, F.lit(1).alias("_b"))
    both = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), ROW, "full")
    return both.filter(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).isEmpty()
