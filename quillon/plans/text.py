"""Text queries over documents, conversations, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import answers as A
from quillon.functions import text as T

c = F.col


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def solutions(spark, sf_dir):
    """Orders as solutions: some with a marked answer, some with a bare number, some with none."""
    k = c("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("so\n#### 1\nthen #### -"), (k % 90).cast("string"), F.lit(",000")))
        .when(k % 4 == 1, F.concat(F.lit("about "), k.cast("string"), F.lit(" . yes")))
        .when(k % 4 == 2, F.concat(F.lit("<answer>no</answer> Answer: 7\n<answer> The "), F.lower("o_orderpriority"), F.lit("! </answer> answer : x"), k.cast("string")))
        .otherwise("none at all")
    )
    return _read(spark, sf_dir, "orders").select(k, "o_orderpriority", text.alias("text"))


SOL = """s AS (SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN 'so' || chr(10) || '#### 1' || chr(10) || 'then #### -' || o_orderkey % 90 || ',000' WHEN 1 THEN 'about ' || o_orderkey || ' . yes'
  WHEN 2 THEN '<answer>no</answer> Answer: 7' || chr(10) || '<answer> The ' || lower(o_orderpriority) || '! </answer> answer : x' || o_orderkey ELSE 'none at all' END AS text FROM orders)"""


def q_answer_strict(spark, sf_dir):
    a = T.hash_answer("text")
    return solutions(spark, sf_dir).select("o_orderkey", a.alias("answer"), T.match_score(a, F.lit("-12000"), 1.0, 0.1).alias("score"))


def q_answer_last_number(spark, sf_dir):
    return solutions(spark, sf_dir).select("o_orderkey", T.hash_answer("text", strict=False).alias("answer"))


def q_qa_answer(spark, sf_dir):
    return solutions(spark, sf_dir).select("o_orderkey", T.tagged_answer("text").alias("answer"), T.last_answer_line("text").alias("line"))


def q_qa_em(spark, sf_dir):
    golden = F.array(F.lit("a 2-HIGH"), F.lit("5 low!"), F.lit("low"))
    s = solutions(spark, sf_dir)
    return s.select("o_orderkey", T.answer_score("text", golden, 1.0, 0.1).alias("score"))


def q_qa_subem(spark, sf_dir):
    return solutions(spark, sf_dir).select("o_orderkey", T.substring_match(c("text"), F.array(F.lit("the LOW"), F.lit("urgent"))).alias("hit"))


def q_qa_normalise(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", T.normal_answer(F.concat(F.lit("The, A "), "p_name", F.lit("  an-"), "p_type")).alias("text"))


def fenced(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    tag = F.element_at(F.array(F.lit("py"), F.lit("SQL"), F.lit(" c++ "), F.lit("what")), (c("p_partkey") % 4 + 1).cast("int"))
    closed = F.concat(F.lit("Text\n```"), tag, F.lit("\nselect "), "p_name", F.lit("\n```\nmore ```go\nx := "), c("p_size").cast("string"), F.when(c("p_partkey") % 3 > 0, "\n  ```").otherwise(""))
    return p.select("p_partkey", closed.alias("text"))


FEN = """f AS (SELECT p_partkey, (['py', 'SQL', ' c++ ', 'what'])[p_partkey % 4 + 1] AS tag, (['python', 'sql', 'cpp', ''])[p_partkey % 4 + 1] AS language, 'select ' || p_name AS first, 'x := ' || p_size AS second, p_partkey % 3 > 0 AS closed FROM part)"""


def q_fences(spark, sf_dir):
    return fenced(spark, sf_dir).select("p_partkey", F.explode(T.fenced_blocks("text")).alias("b")).select("p_partkey", "b.language", "b.code")


def q_best_block(spark, sf_dir):
    return fenced(spark, sf_dir).select("p_partkey", T.best_block("text", "go").alias("code"))


def q_sql_blocks(spark, sf_dir):
    text = F.concat(F.lit("see\n\n  SELECT "), "p_name", F.lit("\n\nfrom t; and\nwith a as (\nselect 1) x"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(T.sql_blocks(text)).alias("sql"))


def q_strip_entry(spark, sf_dir):
    text = F.concat(F.lit("def f(): pass\nif __name__ == '__main__':\n  f("), "p_name", F.lit(")"))
    return _read(spark, sf_dir, "part").select("p_partkey", T.strip_entry_point(text, "python").alias("code"), T.trim_at_stops(text, ["re:\\n\\s+f", "pass"]).alias("trimmed"))


def q_mid_truncate(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.middle_truncated("text", 50).alias("text"))


def q_output_match(spark, sf_dir):
    s = _read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" Ok\n"), c("o_totalprice").cast("string"), F.lit("\n\n")).alias("a"),
        F.concat(F.lit("OK\n"), (c("o_totalprice") * F.when(c("o_orderkey") % 2 == 0, 1.000001).otherwise(1.001)).cast("string"), F.when(c("o_orderkey") % 5 == 0, "\nmore").otherwise("")).alias("b"))
    return s.select("o_orderkey", T.output_matches("a", "b").alias("same"))


def q_wiki_clean(spark, sf_dir):
    text = F.concat(F.lit("  [header] How to [title] "), "p_name", F.lit("  [step] now   "))
    return _read(spark, sf_dir, "part").select("p_partkey", T.wiki_clean(text).alias("text"))


def q_mask_pattern(spark, sf_dir):
    return T.masked(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "[0-9]+|A")


def q_metric_key(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", T.metric_key(F.concat(F.lit("val//core/"), "p_brand", F.lit("@8(x)%"))).alias("key"))


def q_flatten(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").select(F.struct(c("n_nationkey").alias("k"), F.struct(c("n_name").alias("name")).alias("b")).alias("a"))
    return T.flat(n)


def q_tool_calls(spark, sf_dir):
    text = F.concat(F.lit("go <tool_call>{\"name\": \""), "p_brand", F.lit("\", \"arguments\": \""), c("p_size").cast("string"), F.lit("\"}</tool_call> <tool_call>{bad</tool_call>"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(T.tool_calls(text)).alias("t")).select("p_partkey", "t.name", "t.arguments")


def q_run_status(spark, sf_dir):
    x = lambda m: F.element_at(F.array(F.lit("success"), F.lit("failed"), F.lit("timeout")), (c("o_orderkey") / m % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "orders").select(T.run_status(x(1), x(3)).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def q_scorer(spark, sf_dir):
    s = solutions(spark, sf_dir)
    score = T.scorer("o_orderpriority", {"1-URGENT": F.lit(1.0), "2-HIGH": T.match_score(T.hash_answer("text", False), F.lit("7"))}, F.lit(-1.0))
    return s.select("o_orderkey", score.alias("score"))


def q_prompt_record(spark, sf_dir):
    p = _read(spark, sf_dir, "benchmark").select(*T.prompt_record("bench", c("text"), c("item_id").cast("string"), "train", c("item_id")))
    return p.select("data_source", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.index")


def q_nonempty_label(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").filter(F.length(F.regexp_replace("text", "[^,]", "")) > 0).select("conv_id", "turn")


def q_python_blocks(spark, sf_dir):
    text = F.concat(F.lit("Here:\nimport re\n\ndef f():\n    return "), "p_name", F.lit("\nprint(1)\nclass A:\n  x = 1"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(T.python_blocks(text)).alias("code"))


def q_final_answer(spark, sf_dir):
    k = c("p_partkey")
    text = F.concat(F.lit("so\nAnswer: x = $"), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(",000"))).when(k % 3 == 1, F.concat(F.lit("\\frac12 \\text{ km}"), k.cast("string"))).otherwise("\\sqrt3"), F.lit("$"))
    v = A.line_verdict(text, F.lit("\\sqrt{3}"))
    return _read(spark, sf_dir, "part").select("p_partkey", v["pred"].alias("pred"), v["score"].alias("score"))


def q_boxed(spark, sf_dir):
    k = c("p_partkey").cast("string")
    text = F.concat(F.lit("\\boxed{1} and \\boxed{a{"), k, F.lit("}b"), F.when(c("p_partkey") % 2 == 0, "} end").otherwise(""))
    v = A.box_verdict(text, F.lit("a{4}b"))
    return _read(spark, sf_dir, "part").select("p_partkey", v["pred"].alias("pred"), v["acc"].alias("acc"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLE = {
    "q_answer_strict": f"""WITH {SOL}, a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '-' || o_orderkey % 90 || '000' END AS answer FROM s)
SELECT o_orderkey, answer, CAST(CASE WHEN answer IS NULL THEN 0 WHEN answer = '-12000' THEN 1 ELSE 0.1 END AS DOUBLE) AS score FROM a""",
    "q_answer_last_number": f"""WITH {SOL} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '-' || o_orderkey % 90 || ',000' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN CAST(o_orderkey AS VARCHAR) END AS answer FROM s""",
    "q_qa_answer": f"""WITH {SOL} SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 'The ' || lower(o_orderpriority) || '!' END AS answer, CASE WHEN o_orderkey % 4 = 2 THEN 'x' || o_orderkey ELSE '[INVALID]' END AS line FROM s""",
    "q_qa_em": f"""WITH {SOL} SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 <> 2 THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0.1 END AS DOUBLE) AS score FROM s""",
    "q_qa_subem": f"""WITH {SOL} SELECT o_orderkey, o_orderkey % 4 = 2 AND (contains(lower(o_orderpriority), 'low') OR contains(lower(o_orderpriority), 'urgent')) AS hit FROM s""",
    "q_qa_normalise": r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('The, A ' || p_name || '  an-' || p_type), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM part""",
    "q_fences": f"WITH {FEN} SELECT p_partkey, language, first AS code FROM f UNION ALL SELECT p_partkey, 'go', second FROM f WHERE closed",
    "q_best_block": f"WITH {FEN} SELECT p_partkey, CASE WHEN closed THEN second ELSE first END AS code FROM f",
    "q_sql_blocks": "SELECT p_partkey, '  SELECT ' || p_name || chr(10) || 'from t' AS sql FROM part UNION ALL SELECT p_partkey, 'with a as (' || chr(10) || 'select 1) x' FROM part",
    "q_strip_entry": "SELECT p_partkey, 'def f(): pass' || chr(10) AS code, 'def f(): ' AS trimmed FROM part",
    "q_mid_truncate": "SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substring(text, 1, 23) || '...' || right(text, 23) END AS text FROM documents",
    "q_output_match": "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS same FROM orders",
    "q_wiki_clean": "SELECT p_partkey, replace(regexp_replace(replace(trim('  [header] How to [title] ' || p_name || '  [step] now   '), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS text FROM part".replace("\\\\", "\\"),
    "q_mask_pattern": "SELECT c_custkey, regexp_replace(c_name, '[0-9]+|A', '*', 'g') AS c_name, regexp_replace(c_mktsegment, '[0-9]+|A', '*', 'g') AS c_mktsegment FROM customer",
    "q_metric_key": "SELECT p_partkey, 'val/core/' || regexp_replace(p_brand, '[^A-Za-z0-9_.: /-]', '_', 'g') || '_at_8_x__' AS key FROM part",
    "q_flatten": 'SELECT n_nationkey AS "a/k", n_name AS "a/b/name" FROM nation',
    "q_tool_calls": "SELECT p_partkey, p_brand AS name, CAST(p_size AS VARCHAR) AS arguments FROM part",
    "q_run_status": """WITH x AS (SELECT (['success', 'failed', 'timeout'])[o_orderkey % 3 + 1] AS c, (['success', 'failed', 'timeout'])[o_orderkey // 3 % 3 + 1] AS r FROM orders)
SELECT CASE WHEN c = 'timeout' THEN 'CompileTimeout' WHEN c = 'failed' THEN 'CompileFailed' WHEN r = 'timeout' THEN 'RunTimeout' WHEN r = 'success' THEN 'Success' ELSE 'Failed' END AS status, count(*) AS n FROM x GROUP BY 1""",
    "q_scorer": f"WITH {SOL} SELECT o_orderkey, CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '2-HIGH' THEN CASE WHEN o_orderkey % 4 = 1 AND o_orderkey = 7 THEN 1 ELSE 0 END ELSE -1 END AS DOUBLE) AS score FROM s",
    "q_prompt_record": "SELECT 'bench' AS data_source, text AS content, CAST(item_id AS VARCHAR) AS ground_truth, item_id AS index FROM benchmark",
    "q_nonempty_label": "SELECT conv_id, turn FROM conversations WHERE contains(text, chr(44))",
    "q_final_answer": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || '000' WHEN 1 THEN '\\frac{1}{2}' || p_partkey ELSE '\\sqrt{3}' END AS pred, CASE WHEN p_partkey % 3 = 2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM part""",
    "q_boxed": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a{' || p_partkey || '}b' END AS pred, p_partkey = 4 AS acc FROM part",
    "q_python_blocks": "SELECT p_partkey, 'import re' || chr(10) || 'def f():' || chr(10) || '    return ' || p_name || chr(10) AS code FROM part UNION ALL SELECT p_partkey, 'class A:' || chr(10) || '  x = 1' || chr(10) FROM part",
}
