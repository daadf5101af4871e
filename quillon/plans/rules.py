"""Queries of formulas and of tool calls made from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import formulas as X
from quillon.functions import text as T

c = F.col


def _formulas(spark, sf_dir):
    """A formula of each order, of twelve shapes right and wrong."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (c("o_custkey") % 5000).cast("string").alias("k"), c("o_orderpriority").alias("text"), (c("o_orderkey") % 12).alias("shape"))
    parts = [
        ["=SUM(A", "k", ":B", "k", ")"], ["=A", "k", "+"], ["=SUM(A", "k"], ["=A", "k", " ", "k"], ['="', "text", '"&A', "k"], ["=COUNTIFS(A", "k", ",1,B", "k", ")"],
        ['=("', "text", '"}'], ["='", "text", "'!A", "k", "*-2%"], ["=INDEX(A", "k", ":B9,1):C3"], ["=SUM(A", "k", "):C3"], ["  sort(A", "k", ")&'", "text", "'"], ["{1,", "k", ";3,4}"],
    ]
    shape = F.lit(None).cast("string")
    for i, part in enumerate(parts):
        shape = F.when(c("shape") == i, F.concat(*[c(x) if x in ("k", "text") else F.lit(x) for x in part])).otherwise(shape)
    return o.select("o_orderkey", shape.alias("formula"))


def q_formula_error(spark, sf_dir):
    return _formulas(spark, sf_dir).select("o_orderkey", X.formula_error(c("formula")).alias("error"))


def q_formula_normal(spark, sf_dir):
    return _formulas(spark, sf_dir).select("o_orderkey", X.normal_formula(c("formula")).alias("formula"))


def q_tool_call_score(spark, sf_dir):
    """The lines of an order as calls, against the same by part with other numbers, flags and names."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", c("l_linenumber").alias("n"), c("l_partkey").alias("p"), F.concat("l_linestatus", (c("l_suppkey") % 3).cast("string")).alias("mode"), c("l_quantity").cast("int").alias("qty"), c("l_returnflag").alias("flag"))
    call = lambda name, *pairs: F.struct(name.alias("name"), F.map_concat(*pairs).alias("parameters"))
    none = F.create_map().cast("map<string, string>")
    pairs = lambda qty, flag: F.create_map(F.lit("qty"), qty.cast("string"), F.lit("flag"), flag)
    want = lambda x: call(x["mode"], pairs(x["qty"], x["flag"]), F.when(x["n"] % 2 == 0, F.create_map(F.lit("line"), x["n"].cast("string"))).otherwise(none))
    made = lambda x: call(F.when(x["n"] == 3, "O1").otherwise(x["mode"]), pairs(x["qty"] + x["n"] % 2, x["flag"]), F.when(x["n"] % 3 == 0, F.create_map(F.lit("more"), F.lit("x"))).otherwise(none))
    # Only the lines travel, once; both orders of them are the order of their fields.
    by_line = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", "p", "qty", "flag", "mode"))).alias("lines"))
    by_part = F.sort_array(F.transform("lines", lambda x: F.struct(*[x[k].alias(k) for k in ("p", "n", "qty", "flag", "mode")])))
    return by_line.select("l_orderkey", F.round(T.tool_call_score(F.transform("lines", want), F.transform(by_part, made)), 6).alias("score"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_O = "o AS (SELECT o_orderkey, CAST(o_custkey % 5000 AS VARCHAR) AS k, o_orderpriority AS t, o_orderkey % 12 AS shape FROM orders)"
ORACLE = {
    "q_formula_error": f"""WITH {_O} SELECT o_orderkey, CASE shape WHEN 1 THEN 'position ' || (4 + length(k)) || ': missing right operand' WHEN 2 THEN 'position ' || (7 + length(k)) || ': unclosed parenthesis, call or brace'
WHEN 3 THEN 'position ' || (4 + length(k)) || ': missing operator' WHEN 5 THEN 'position ' || (16 + 2 * length(k)) || ': arguments of COUNTIFS come in pairs' WHEN 6 THEN 'position ' || (5 + length(t)) || ': unexpected }}'
WHEN 9 THEN 'position ' || (8 + length(k)) || ': a range needs references' END AS error FROM o""",
    "q_formula_normal": f"""WITH {_O} SELECT o_orderkey, CASE shape WHEN 0 THEN '=SUM(A' || k || ':B' || k || ')' WHEN 1 THEN '=A' || k || '+' WHEN 2 THEN '=SUM(A' || k WHEN 3 THEN '=A' || k || ' ' || k WHEN 4 THEN '="' || t || '"&A' || k
WHEN 5 THEN '=COUNTIFS(A' || k || ',1,B' || k || ')' WHEN 6 THEN '=("' || t || '"}}' WHEN 7 THEN '=''' || t || '''!A' || k || '*-2%' WHEN 8 THEN '=INDEX(A' || k || ':B9,1):C3' WHEN 9 THEN '=SUM(A' || k || '):C3'
WHEN 10 THEN '=_xlfn.SORT(A' || k || ')&"' || t || '"' ELSE '={{1,' || k || ';3,4}}' END AS formula FROM o""",
    "q_tool_call_score": """WITH RECURSIVE l AS (
  SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS INTEGER) AS qty, l_returnflag AS flag, l_linestatus || (l_suppkey % 3) AS want, CASE WHEN l_linenumber = 3 THEN 'O1' ELSE l_linestatus || (l_suppkey % 3) END AS made,
    ['qty=' || CAST(l_quantity AS INTEGER), 'flag=' || l_returnflag] || CASE WHEN l_linenumber % 2 = 0 THEN ['line=' || l_linenumber] ELSE [] END AS w,
    ['qty=' || (CAST(l_quantity AS INTEGER) + l_linenumber % 2), 'flag=' || l_returnflag] || CASE WHEN l_linenumber % 3 = 0 THEN ['more=x'] ELSE [] END AS m FROM lineitem
), c AS (
  SELECT k, list({'name': want, 'kv': w, 'keys': list_transform(w, lambda x: split_part(x, '=', 1))} ORDER BY n, p, qty, flag, want) AS want,
    list({'name': made, 'kv': m, 'keys': list_transform(m, lambda x: split_part(x, '=', 1))} ORDER BY p, n, qty, flag, want) AS made FROM l GROUP BY k
), x AS (
  SELECT k, want AS name, 1 AS a, 0 AS b FROM l UNION ALL SELECT k, made, 0, 1 FROM l
), j AS (
  SELECT k, sum(least(a, b)) / (sum(a) + sum(b) - sum(least(a, b))) AS names FROM (SELECT k, name, sum(a) AS a, sum(b) AS b FROM x GROUP BY ALL) GROUP BY k
), f(k, i, score, used) AS (
  SELECT k, 1, names, CAST([] AS BIGINT[]) FROM j
  UNION ALL
  SELECT k, i + 1, score + coalesce(best.points, 0), CASE WHEN best IS NULL THEN used ELSE list_append(used, -best.place) END FROM (
    SELECT f.k, i, score, used, list_sort(list_filter(list_transform(made, lambda m, q: {
      'points': CASE WHEN m.name = want[i].name AND NOT list_contains(used, q)
        THEN len(list_intersect(m.keys, want[i].keys)) / (len(m.keys) + len(want[i].keys) - len(list_intersect(m.keys, want[i].keys))) + len(list_intersect(m.kv, want[i].kv)) ELSE 0 END,
      'place': -q}), lambda z: z.points > 0), 'DESC')[1] AS best FROM f JOIN c ON f.k = c.k WHERE i <= len(want))
)
SELECT f.k AS l_orderkey, round(score / (1 + len(want) + list_sum(list_transform(want, lambda z: len(z.kv)))) * 6 - 3, 6) AS score FROM f JOIN c ON f.k = c.k WHERE i = len(want) + 1""",
}
