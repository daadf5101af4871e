"""Queries and edits over a table of cells."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import cells as C

KEY = ["file", "sheet", "row", "col"]


def value(cells: DataFrame) -> DataFrame:
    """Add ``value``: the normal value of each cell."""
    return cells.withColumn("value", C.normal(F.col("vtype"), F.col("num"), F.col("str"), F.col("bool"), F.col("ts")))


def resolve_sheets(wanted: DataFrame, sheets: DataFrame) -> DataFrame:
    """``wanted(file, name)`` to ``sheets(file, sheet)``: exact, then by case, then trimmed.

    The first tier with a match counts; several matches in it leave the sheet
    null and ``matches`` says how many.
    """
    a, b = F.col("name"), F.col("sheet")
    tier = (
        F.when(a == b, 1).when(F.lower(a) == F.lower(b), 2).when(F.trim(a) == F.trim(b), 3).when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 4)
    )
    # An equi-join on the loosest form of the name; tiers are told apart after it.
    pairs = wanted.withColumn("_k", F.lower(F.trim("name"))).join(sheets.withColumn("_k", F.lower(F.trim("sheet"))), ["file", "_k"], "left")
    w = Window.partitionBy("file", "name")
    best = pairs.withColumn("tier", tier).withColumn("_best", F.min("tier").over(w)).filter(F.col("tier").eqNullSafe(F.col("_best")))
    out = best.groupBy("file", "name").agg(F.count("sheet").alias("matches"), F.min("sheet").alias("sheet"), F.first("_best").alias("tier"))
    return out.withColumn("sheet", F.when(F.col("matches") == 1, F.col("sheet")))


def catalog(cells: DataFrame) -> DataFrame:
    """One row a sheet: extent and number of cells."""
    return cells.groupBy("file", "sheet", "sheet_idx").agg(
        F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.count("vtype").alias("cells")
    )


def in_range(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells joined to ``targets(task_id, file, sheet, min_row, ...)`` that hold them.

    Targets are a list that someone wrote: they go to the cells.  Nothing is known of their size
    where they come from Python, and Spark would send the cells to the driver, or a sheet to one task.
    """
    inside = F.col("row").between(F.col("min_row"), F.col("max_row")) & F.col("col").between(F.col("min_col"), F.col("max_col"))
    return cells.join(F.broadcast(targets), ["file", "sheet"]).filter(inside)


def compare(truth: DataFrame, actual: DataFrame, targets: DataFrame) -> DataFrame:
    """``task_id, ok, cells, mismatches, first`` of the cells in each task's ranges.

    Both sides are cut to the ranges first; a cell that one side lacks is
    empty.  ``first`` is the address of the first mismatch by range, row and
    column.
    """
    key = ["task_id", "range_idx", "file", "sheet", "row", "col"]
    left = in_range(value(truth), targets).select(*key, F.col("value").alias("want"))
    right = in_range(value(actual), targets).select(*key, F.col("value").alias("got"))
    joined = left.join(right, key, "full_outer").withColumn("same", C.same(F.col("want"), F.col("got")))
    place = F.struct("range_idx", "row", "col", C.address(F.col("sheet"), F.col("row"), F.col("col")).alias("address"))
    found = joined.groupBy("task_id").agg(F.count("*").alias("cells"), F.count_if(~F.col("same")).alias("mismatches"), F.min(F.when(~F.col("same"), place)).alias("_first"))
    tasks = targets.select("task_id").distinct()
    return tasks.join(found, "task_id", "left").fillna(0, ["cells", "mismatches"]).select(
        "task_id", (F.col("mismatches") == 0).alias("ok"), F.when(F.col("mismatches") == 0, 1.0).otherwise(0.0).alias("reward"), "cells", "mismatches", F.col("_first.address").alias("first")
    )


def matcher(column: Column, query: str, mode: str = "contains", case_sensitive: bool = False, most: int = 2000) -> Column:
    """``contains``, ``equals``, ``prefix`` or ``regex`` (checked, over the first ``most`` characters)."""
    if mode == "regex":
        check_pattern(query)
        return F.regexp_like(F.substring(column, 1, most), F.lit(query if case_sensitive else f"(?i){query}"))
    a, b = (column, F.lit(query)) if case_sensitive else (F.lower(column), F.lit(query.lower()))
    return {"contains": F.contains(a, b), "equals": a == b, "prefix": F.startswith(a, b)}[mode]


def check_pattern(pattern: str, most: int = 200) -> None:
    """Refuses patterns that may take exponential time: groups, repeats other than ``*``, alternation."""
    outside = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", pattern)
    if len(pattern) > most or re.search(r"[(){}?+|]", outside):
        raise ValueError("groups, braces, ?, + and alternation are not allowed")
    re.compile(pattern)


def find(cells: DataFrame, query: str, mode: str = "contains", search_in: str = "values", per_sheet: int | None = None, **options) -> DataFrame:
    """Cells whose shown value or formula matches, by sheet in row-major order, with their address."""
    text = F.coalesce("str", F.col("num").cast("string"), F.col("bool").cast("string"))
    columns = {"values": [text], "formulas": [F.col("formula")], "both": [text, F.col("formula")]}[search_in]
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(matcher(c, query, mode, **options), F.lit(False))
    out = cells.filter(hit).withColumn("address", C.address(F.col("sheet"), F.col("row"), F.col("col")))
    if per_sheet is None:
        return out
    place = F.row_number().over(Window.partitionBy("file", "sheet").orderBy("row", "col"))
    return out.withColumn("_n", place).filter(F.col("_n") <= per_sheet).drop("_n")


def summary(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts of a range: filled, empty, formula and error cells; an error counts once."""
    inside = in_range(cells, targets)
    size = ((F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1)).cast("long")
    counts = inside.groupBy("task_id", "range_idx").agg(F.count_if(F.col("vtype").isNotNull() | F.col("formula").isNotNull()).alias("filled"), F.count("formula").alias("formulas"), F.count_if(F.col("vtype") == "e").alias("errors"))
    out = targets.withColumn("size", size).join(counts, ["task_id", "range_idx"], "left").fillna(0, ["filled", "formulas", "errors"])
    return out.select("task_id", "range_idx", "size", "filled", (F.col("size") - F.col("filled")).alias("empty"), "formulas", "errors", (F.col("filled") / F.col("size")).alias("share"))


def range_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ranges ``(id, file, sheet, min_row, ...)`` that meet, by sheet.

    Ranges are dealt to tiles, so only those near each other are compared.  A range's
    level is the least power of two of rows and of columns that holds its extent; two
    meet in the tiles of the greater level, of which each has four at most, and count in
    the tile of the first cell they share.
    """
    box, level = ["min_col", "min_row", "max_col", "max_row"], ["_rows", "_cols"]
    bits = lambda low, high: F.ceil(F.log2(F.greatest(F.col(high) - F.col(low) + 1, F.lit(1)))).cast("int")

    def levelled(df: DataFrame, side: str) -> DataFrame:
        out = df.select("file", "sheet", F.col("id").alias(side), F.struct(*[F.col(x).cast("long").alias(x) for x in box]).alias(f"_{side}"), bits("min_row", "max_row").alias("_rows"), bits("min_col", "max_col").alias("_cols"))
        return out.withColumn("_own", F.struct(*level))

    def tiled(df: DataFrame, other: DataFrame, side: str) -> DataFrame:
        met = other.groupBy("file", "sheet").agg(F.collect_set("_own").alias("_levels"))
        out = df.join(met, ["file", "sheet"]).withColumn("_other", F.explode("_levels"))
        at = lambda x, n: F.expr(f"shiftright(_{side}.{x}, greatest(_own.{n}, _other.{n}))")
        out = out.withColumn("_tile_row", F.explode(F.sequence(at("min_row", "_rows"), at("max_row", "_rows"))))
        out = out.withColumn("_tile_col", F.explode(F.sequence(at("min_col", "_cols"), at("max_col", "_cols"))))
        own, theirs = ("_own", "_other") if side == "a" else ("_other", "_own")
        return out.select("file", "sheet", side, f"_{side}", F.col(own).alias("_la"), F.col(theirs).alias("_lb"), "_tile_row", "_tile_col")

    left, right = levelled(a, "a"), levelled(b, "b")
    near = tiled(left, right, "a").join(tiled(right, left, "b"), ["file", "sheet", "_la", "_lb", "_tile_row", "_tile_col"])
    first = lambda x, n: F.expr(f"shiftright(greatest(_a.{x}, _b.{x}), greatest(_la.{n}, _lb.{n}))")
    here = (F.col("_tile_row") == first("min_row", "_rows")) & (F.col("_tile_col") == first("min_col", "_cols"))
    return near.filter(here & C.overlaps(F.col("_a"), F.col("_b"))).select("file", "sheet", "a", "b")


# A scan of merged ranges may always hold LEAST cells, never more than MOST, and between them TIMES what is asked for.
LEAST, TIMES, MOST = 1024, 4, 100_000


def _scans(key: list[str], types):
    """A pass over ranges in order of key and index: their scans; it holds one."""
    import pyarrow as pa

    kinds = [*types, pa.int32(), *[pa.int64()] * 6]
    names = [*key, "scan", "first", "last", "min_row", "min_col", "max_row", "max_col"]

    def area(r1, c1, r2, c2):
        return None if r1 is None or c1 is None or r2 is None or c2 is None else (r2 - r1 + 1) * (c2 - c1 + 1)

    def wider(pick, x, y):  # what is null does not count
        return y if x is None else x if y is None else pick(x, y)

    def run(batches):
        now, number, first, last, asked, box, begun = None, 0, None, None, None, None, False
        for batch in batches:
            out = []
            for *own, idx, r1, c1, r2, c2 in zip(*[c.to_pylist() for c in batch.columns]):
                size, same = area(r1, c1, r2, c2), begun and own == now
                if same and idx is not None and last is not None and idx == last + 1:
                    both = (wider(min, box[0], r1), wider(min, box[1], c1), wider(max, box[2], r2), wider(max, box[3], c2))
                    together, scanned = None if asked is None or size is None else asked + size, area(*both)
                    if scanned is not None and scanned <= MOST and scanned <= max(LEAST, TIMES * (together or 0)):
                        last, asked, box = idx, together, both
                        continue
                if begun:
                    out.append((*now, number, first, last, *box))
                number = number + 1 if same else 0
                now, first, last, asked, box, begun = own, idx, idx, size, (r1, c1, r2, c2), True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, number, first, last, *box), kinds)], names)

    return run


def scan_groups(targets: DataFrame) -> DataFrame:
    """``task_id, file, sheet, scan, first, last, min_row, min_col, max_row, max_col``: what is scanned for
    the ranges of ``targets(task_id, range_idx, file, sheet, min_row, ...)``.

    Within a task and sheet each range, by index, joins the scan before it if it follows
    the range before without a gap and the box of both is small enough; else it begins
    a scan.  Ranges of one index go by their corners.  Ranges go by in order, in one pass
    that holds one scan, so a list may be of any length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    key, names = ["task_id", "file", "sheet"], ["range_idx", "min_row", "min_col", "max_row", "max_col"]
    rows = targets.select(*key, *[F.col(x).cast("long").alias(x) for x in names])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    ordered = rows.repartition(*key).sortWithinPartitions(*key, *names)
    kind = f"{fields}, scan int, first long, last long, min_row long, min_col long, max_row long, max_col long"
    return ordered.mapInArrow(_scans(key, to_arrow_schema(rows.select(*key).schema).types), kind)


def delete_lines(cells: DataFrame, deleted: DataFrame, axis: str = "row") -> DataFrame:
    """Remove rows (or columns) of ``deleted(file, sheet, first, last)`` and close the gaps.

    The ranges are merged, so a line is counted once; formulas stay as they are.
    """
    from quillon.operators.ranking import merge_intervals

    merged = merge_intervals(deleted, ["file", "sheet"], "first", "last")
    spans = merged.groupBy("file", "sheet").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    joined = cells.join(spans, ["file", "sheet"], "left")
    at = F.col(axis)
    gone = F.coalesce(F.exists("_spans", lambda s: at.between(s["first"], s["last"])), F.lit(False))
    before = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda t, s: t + F.when(s["last"] < at, s["last"] - s["first"] + 1).otherwise(0)), F.lit(0))
    return joined.filter(~gone).withColumn(axis, (at - before).cast(dict(cells.dtypes)[axis])).drop("_spans")


def clear(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells outside all target ranges."""
    return cells.join(in_range(cells, targets).select(*KEY).distinct(), KEY, "left_anti")


def write(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Upsert: ``grid`` has cells of the same columns and replaces those in its places."""
    return cells.join(grid.select(*KEY).distinct(), KEY, "left_anti").unionByName(grid, allowMissingColumns=True)


def broadcast_grid(grid: Sequence[Sequence], rows: int, cols: int) -> list[list]:
    """A scalar, one row or one column stretched to a range; other shapes must fit."""
    h, w = len(grid), len(grid[0])
    if (h, w) == (rows, cols):
        return [list(r) for r in grid]
    if h in (1, rows) and w in (1, cols):
        return [[grid[i if h > 1 else 0][j if w > 1 else 0] for j in range(cols)] for i in range(rows)]
    raise ValueError(f"a {h} x {w} grid does not fit {rows} x {cols}")


def restore_cached(new: DataFrame, old: DataFrame) -> DataFrame:
    """Cached values of formula cells whose formula is unchanged, where a save lost them."""
    kept = old.filter("formula is not null and vtype is not null").select(*KEY, F.col("formula").alias("_f"), *[F.col(c).alias(f"_{c}") for c in ("vtype", "num", "str", "bool", "ts")])
    joined = new.join(kept, KEY, "left")
    lost = F.col("vtype").isNull() & (F.col("formula") == F.col("_f"))
    return joined.select(*[F.when(lost, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("vtype", "num", "str", "bool", "ts") else F.col(c) for c in new.columns])


def sample_ends(df: DataFrame, order: list[str], head: int, tail: int) -> DataFrame:
    """The first and last rows of an order, each found by a bounded top-k."""
    first = df.orderBy(*order).limit(head)
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(tail)
    return first.union(last).distinct()


def within_budget(df: DataFrame, group: list[str], order: list[str], text: str, most: int) -> DataFrame:
    """The longest prefix of each group whose texts, with separators, fit ``most`` characters."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(F.length(text) + 1).over(w)).filter(F.col("_used") <= most + 1).drop("_used")


def fill(start: DataFrame, rows: int, cols: int) -> DataFrame:
    """Formula cells ``(file, sheet, row, col, formula)`` filled down and right, references moved."""
    each = start.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return each.select(
        "file", "sheet", (F.col("row") + F.col("_r")).alias("row"), (F.col("col") + F.col("_c")).alias("col"), C.shifted(F.col("formula"), F.col("_r"), F.col("_c")).alias("formula")
    )


def rename_sheet(cells: DataFrame, file: str, old: str, new: str) -> DataFrame:
    """A name that another sheet of the file has, whatever its case, is an error."""
    taken = cells.filter((F.col("file") == file) & (F.lower("sheet") == new.lower()) & (F.col("sheet") != old))
    if not taken.isEmpty():
        raise ValueError(f"there is a sheet {new!r}")
    return cells.withColumn("sheet", F.when((F.col("file") == file) & (F.col("sheet") == old), F.lit(new)).otherwise(F.col("sheet")))


def delete_sheet(cells: DataFrame, file: str, name: str) -> DataFrame:
    """The sheets after it move up; a file's last sheet cannot go."""
    own = cells.filter(F.col("file") == file)
    if own.filter(F.col("sheet") != name).isEmpty():
        raise ValueError("the last sheet cannot be deleted")
    place = own.filter(F.col("sheet") == name).select("sheet_idx").first()
    if place is None:
        raise ValueError(f"no sheet {name!r}")
    moved = F.when((F.col("file") == file) & (F.col("sheet_idx") > place[0]), F.col("sheet_idx") - 1).otherwise(F.col("sheet_idx"))
    return cells.filter(~((F.col("file") == file) & (F.col("sheet") == name))).withColumn("sheet_idx", moved.cast("int"))


def copy_sheet(cells: DataFrame, file: str, name: str, new: str) -> DataFrame:
    """A copy after the last sheet."""
    own = cells.filter(F.col("file") == file)
    last = own.agg(F.max("sheet_idx")).first()[0]
    copied = own.filter(F.col("sheet") == name).withColumns({"sheet": F.lit(new), "sheet_idx": F.lit(int(last) + 1).cast("int")})
    return cells.unionByName(copied)


def move_sheet(cells: DataFrame, file: str, name: str, place: int) -> DataFrame:
    """To another index; the sheets between shift by one."""
    at = cells.filter((F.col("file") == file) & (F.col("sheet") == name)).select("sheet_idx").first()[0]
    i = F.col("sheet_idx")
    new = F.when(F.col("sheet") == name, place).when((i > at) & (i <= place), i - 1).when((i < at) & (i >= place), i + 1).otherwise(i)
    return cells.withColumn("sheet_idx", F.when(F.col("file") == file, new).otherwise(i).cast("int"))
