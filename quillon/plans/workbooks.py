"""Queries over workbooks that Spark writes from ``part``: cells and what lies over ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import cells as O
from quillon.sources import workbook_source as S
from quillon.streaming.run import shared_folder

c = F.col


def _books(spark, sf_dir):
    """A workbook a brand, three sheets each; every part is a row and brings one object."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.translate("p_brand", "#", "-").alias("file"), (c("p_size") % 3).alias("sheet_idx"), "p_name", c("p_retailprice").cast("double").alias("price"))
    p = p.withColumn("sheet", F.concat(F.lit("Sheet "), c("sheet_idx").cast("string"))).withColumn("row", c("p_partkey").cast("int") + 1)
    k = c("row").cast("string")
    cell = lambda col, num, text, formula: F.struct(F.lit(col).alias("col"), num.cast("double").alias("num"), text.cast("string").alias("str"), formula.cast("string").alias("formula"))
    none = F.lit(None)
    cells = p.withColumn("x", F.explode(F.array(cell(1, c("price"), none, none), cell(2, none, c("p_name"), none), cell(3, none, none, F.concat(F.lit("=A"), k, F.lit("*2"))))))
    at = lambda first, last, more: F.concat(F.lit(first), k, F.lit(f":{last}"), (c("row") + more).cast("string"))
    kind = c("p_partkey") % 4
    objects = p.select(
        "file", "sheet", F.when(kind == 0, "merged").when(kind == 1, "validation").when(kind == 2, "name").otherwise("table").alias("kind"),
        F.when(kind > 0, F.concat(F.lit("T"), k)).alias("name"), F.when(kind == 0, at("A", "B", 2)).when(kind == 1, at("C", "D", 9)).when(kind == 2, at("$B$", "$B$", 0)).otherwise(at("A", "C", 20)).alias("ref"),
    )
    folder = shared_folder(spark)
    S.write_workbooks(cells.select("file", "sheet", "sheet_idx", "row", "x.*"), objects, folder).count()
    S.register(spark)
    return p, lambda part: spark.read.format("workbook").option("part", part).load(folder)


def _file():
    return F.regexp_extract("file", r"([^/]+)\.xlsx$", 1).alias("file")


def q_workbook_cells(spark, sf_dir):
    """Counts of one sheet of every workbook; the other sheets are not read."""
    _, read = _books(spark, sf_dir)
    one = read("cells").filter((c("sheet") == "Sheet 1") & (c("row") >= 3))
    return one.groupBy(_file()).agg(F.count("*").alias("cells"), F.count("formula").alias("formulas"), F.count("str").alias("texts"), F.sum(F.round(c("num") * 100).cast("long")).alias("cents"))


def q_workbook_objects(spark, sf_dir):
    """Merged ranges, validations, names and tables that meet the ranges asked for: a part's row, columns B and C."""
    p, read = _books(spark, sf_dir)
    found = read("objects").select(F.concat_ws(" ", "kind", "ref").alias("id"), _file(), "sheet", "min_row", "min_col", "max_row", "max_col")
    asked = p.select(c("p_partkey").alias("id"), "file", "sheet", c("row").alias("min_row"), F.lit(2).alias("min_col"), c("row").alias("max_row"), F.lit(3).alias("max_col"))
    return O.range_overlaps(asked, found).select(c("a").alias("p_partkey"), c("b").alias("object"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_P = "p AS (SELECT p_partkey, replace(p_brand, '#', '-') AS file, p_size % 3 AS sheet, p_partkey + 1 AS r, CAST(p_retailprice AS DOUBLE) AS price FROM part)"
ORACLE = {
    "q_workbook_cells": f"WITH {_P} SELECT file, 3 * count(*) AS cells, count(*) AS formulas, count(*) AS texts, CAST(sum(round(price * 100)) AS BIGINT) AS cents FROM p WHERE sheet = 1 AND r >= 3 GROUP BY file",
    "q_workbook_objects": f"""WITH {_P}, o AS (SELECT file, sheet, r AS r1, r + ([2, 9, 0, 20])[p_partkey % 4 + 1] AS r2, p_partkey % 4 AS k FROM p)
SELECT p_partkey, (['merged A' || r1 || ':B' || r2, 'validation C' || r1 || ':D' || r2, 'name $B$' || r1 || ':$B$' || r2, 'table A' || r1 || ':C' || r2])[k + 1] AS object
FROM p JOIN o ON p.file = o.file AND p.sheet = o.sheet AND r BETWEEN r1 AND r2""",
}
