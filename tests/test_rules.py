"""Formulas against vectors of right and wrong ones; tool calls against a plain greedy match."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quillon.functions import formulas as X
from quillon.functions import text as T

GOOD = ["=A1+B2", "=SUM(A1:B2)", "=SUM(A1:B2, 3)*-2%", "=IF(A1=\"x,(\",1,0)", "='My Sheet'!A1", "='It''s'!$A$1:$B$2", "=Table1[[#All],[x]]+1", "={1,2;3,4}", "=INDEX(A:A,1):B2", "=(A1):B2", "=A1:A5 B1:B9", "=SUM((A1,B2))", "=COUNTIFS(A:A,1,B:B,2)", "=SUMIFS(A:A,B:B,1)", "=LAMBDA(x,x+1)(2)", "=F()", "=IF(A1,,1)", "=--A1", "=1E+5+1", "=A1#", "=#REF!+1", "A1", "=NOT(TRUE)", "=_xlfn.SUMIF(A,B)", "=A1 & \" \"\"q\"\" \"", "=my.COUNTIF(1)", "=+1", "=@A1"]
BAD = ["=A1+", "=*A1", "=SUM(A1", "=SUM)A1(", "=(A1}", "={1,2", "=\"abc", "='abc", "=[abc", "=A1 1", "=1 2", "=A1B2 \"x\"", "=SUM(1)2", "=COUNTIF(A:A)", "=COUNTIFS(A,1,B)", "=SUMIFS(A,B,1,C)", "=SUM(A1,*2)", "=SUM(1+)", "=SUM(1+,2)", "=", "", "=QUOTIENT()", "=1:2", "=SUM(A1):B1", "=A$", "=...", "=A1:", "=%", "=A1!!+", "=-", "=(1+2", "=)"]


def test_formulas_that_can_and_cannot_be(spark):
    df = spark.createDataFrame([(x,) for x in GOOD + BAD] + [(None,)], "f string")
    said = dict(df.select("f", X.formula_error(F.col("f"))).collect())
    assert {f: said[f] for f in GOOD} == dict.fromkeys(GOOD)
    assert [f for f in BAD if said[f] is None] == [] and said[None] is None
    assert said["=SUM(A1,*2)"] == "position 9: missing left operand"
    assert said["=COUNTIFS(A,1,B)"] == "position 16: arguments of COUNTIFS come in pairs"
    assert said["=SUM(A1):B1"] == "position 9: a range needs references"
    assert said["=(A1}"] == "position 5: unexpected }"
    deep = spark.createDataFrame([("=" + "(" * 60 + "1" + ")" * n,) for n in (60, 59, 61)], "f string")
    assert [r[0] for r in deep.select(X.formula_error(F.col("f"))).collect()] == [None, "position 122: unclosed parenthesis, call or brace", "position 123: unexpected )"]


def test_formulas_of_many_tokens(spark):
    n = 20000
    rows = [("=" + "SUM(" * n + "1" + ")" * n,), ("=" + "(" * n + "1" + ")" * (n - 1),), ("=A1" + "+A1" * n + "+",), ('="' + "x" * n + '"&A1',)]
    got = [r[0] for r in spark.createDataFrame(rows, "f string").select(X.formula_error(F.col("f"))).collect()]
    assert got == [None, f"position {2 * n + 2}: unclosed parenthesis, call or brace", f"position {3 * n + 5}: missing right operand", None]


def test_formulas_in_their_normal_form(spark):
    vectors = {
        " A1 ": "=A1", "=sort(A:A)": "=_xlfn.SORT(A:A)", "=Filter(A1,B1)": "=_xlfn._xlws.FILTER(A1,B1)", "=_xlfn.SORT(A1)": "=_xlfn.SORT(A1)", "=SORTED(1)": "=SORTED(1)",
        "='it''s'&\"sort(\"": "=\"it's\"&\"sort(\"", "='say \"x\"'": "=\"say \"\"x\"\"\"", "='My Sheet'!A1": "='My Sheet'!A1", "": None, "  ": None, "=[sort(]": "=[sort(]",
    }
    df = spark.createDataFrame([(x,) for x in vectors], "f string")
    assert dict(df.select("f", X.normal_formula(F.col("f"))).collect()) == vectors


def _jaccard(a, b):
    common = sum((Counter(a) & Counter(b)).values())
    return common / (len(a) + len(b) - common) if a or b else 1.0


def _plain(want, made, most, least):
    score, best_of_all, used = _jaccard([n for n, _ in want], [n for n, _ in made]), 1.0, set()
    for name, own in want:
        best_of_all += 1 + len(own)
        points = [(_jaccard(list(own), list(p)) + sum(k in p and p[k] == v for k, v in own.items()), -i) for i, (n, p) in enumerate(made) if n == name and i not in used]
        points = [x for x in points if x[0] > 0]
        if points:
            score += max(points)[0]
            used.add(-max(points)[1])
    return (most - least) * score / best_of_all + least


def test_tool_calls_as_a_greedy_match(spark):
    rng = random.Random(8)
    calls = lambda: [(rng.choice("abc"), {k: rng.choice("xy") for k in rng.sample("klmn", rng.randrange(4))}) for _ in range(rng.randrange(6))]
    rows = [(i, calls(), calls()) for i in range(200)] + [(200, [], []), (201, [("a", {})], [("a", {})])]
    kind = "array<struct<name: string, parameters: map<string, string>>>"
    df = spark.createDataFrame([*rows, (202, None, [("a", None)])], f"i int, w {kind}, m {kind}")
    got = {r[0]: r[1] for r in df.select("i", T.tool_call_score("w", "m", 2.0, -1.0)).collect()}
    assert got.pop(202) == -1.0
    assert all(abs(got[i] - _plain(w, m, 2.0, -1.0)) < 1e-12 for i, w, m in rows)
    assert got[200] == got[201] == 2.0


def test_lines_of_tool_calls_travel_once(spark, sf_dir):
    from quillon.plans import rules

    plan = rules.q_tool_call_score(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list(" in line]
    assert len(gathered) == 1 and gathered[0].count("collect_list(") == 1 and "map" not in gathered[0]


def test_first_code_line_of_pointers_and_strings(spark):
    rows = [("// a\n/* b\n c */\n*p = 3;\n", "cpp", "*p = 3;"), ('s = "/* no */";\n', "java", 's = "/* no */";'), ("/* x */ int a;", "cpp", " int a;"), ("char c = '\"'; /* y */", "cpp", "char c = '\"'; "), ("# c\n\nx = 1", "python", "x = 1")]
    for code, language, want in rows:
        assert spark.createDataFrame([(code,)], "c string").select(T.first_code_line("c", language)).first()[0] == want


def test_ranges_as_people_write_them(spark):
    from quillon.functions import cells as C

    vectors = {
        "'My, sheet'!A1:B2, C3": [("My, sheet", "A1:B2", (1, 1, 2, 2)), (None, "C3", (3, 3, 3, 3))], "Sheet1'!bd2:308": [("Sheet1", "BD2:BD308", (56, 2, 56, 308))], '"A:C"': [(None, "A:C", (1, 1, 3, 50))],
        "x!B$2:$a1,'it''s'!Z9": [("x", "B$2:$A1", (1, 1, 2, 2)), ("it's", "Z9", (26, 9, 26, 9))], "A0": [(None, "A0", None)], "XFE1": [(None, "XFE1", None)], "nothing": [(None, "NOTHING", None)],
    }
    df = spark.createDataFrame([(t,) for t in vectors], "t string").select("t", F.posexplode(C.ranges(F.col("t"))).alias("i", "r"))
    rows = df.select("t", "i", "r.sheet", "r.range", C.bounds(F.col("r.range"), F.lit(50)).alias("b")).orderBy("i").collect()
    assert {t: [(r.sheet, r.range, r.b and tuple(r.b)) for r in rows if r.t == t] for t in vectors} == vectors


def test_sheets_by_the_first_tier_that_has_one(spark):
    from quillon.operators import cells

    wanted = spark.createDataFrame([("f", x) for x in ("Data", "data ", "SUM", "none")], "file string, name string")
    sheets = spark.createDataFrame([("f", "Data"), ("f", "DATA"), ("f", " sum")], "file string, sheet string")
    got = cells.resolve_sheets(wanted, sheets).select("name", "matches", "sheet", "tier").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("Data", 1, "Data", 1), ("data ", 2, None, 4), ("SUM", 1, " sum", 4), ("none", 0, None, None)], key=str)


def test_rows_and_columns_as_people_write_them(spark):
    from quillon.functions import cells as C

    one = lambda text, axis: [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(C.lines(F.col("t"), axis)).first()[0]]
    assert one("3, 9:$5,'My, data'!2:2,0,A,1048577,1:1048576", "row") == [(None, 3, 3), (None, 5, 9), ("My, data", 2, 2), (None, None, None), (None, None, None), (None, None, None), (None, 1, 1048576)]
    assert one("b,$E:c,S!XFD,XFE,3", "column") == [(None, 2, 2), (None, 3, 5), ("S", 16384, 16384), (None, None, None), (None, None, None)]


def test_batches_saved_loaded_and_compared(spark, tmp_path):
    import pytest

    from quillon.operators import batch

    df = spark.createDataFrame([(i, None if i == 2 else float("nan") if i == 3 else i / 2, [i]) for i in range(6)], "row_id long, x double, a array<int>")
    batch.save_batch(df, f"{tmp_path}/a")
    again = batch.load_batch(spark, f"{tmp_path}/a")
    assert batch.same_rows(df, again.repartition(3))
    for other in (df.filter("row_id < 5"), df.withColumn("x", F.coalesce("x", F.lit(9.0))), df.drop("a"), df.unionByName(df.filter("row_id = 1").withColumn("row_id", F.lit(6).cast("long")))):
        assert not batch.same_rows(df, other)
    for i, bad in enumerate((df.filter("row_id <> 3"), df.withColumn("row_id", F.greatest("row_id", F.lit(1).cast("long"))))):
        batch.save_batch(bad, f"{tmp_path}/bad{i}")
        with pytest.raises(ValueError):
            batch.load_batch(spark, f"{tmp_path}/bad{i}")
    with pytest.raises(KeyError):
        batch.save_batch(df.drop("row_id"), f"{tmp_path}/c")


def test_sessions_and_pending_tasks(spark):
    import statistics

    from quillon.operators import grouped, ranking

    rows = [("a_b_s1_0", 9.0), ("a_b_s1_1", 1.0), ("a_b_s2_0", 3.0), ("a_b_s3_10", 8.0), ("a_b_s3_9", 0.0), ("c_s_0", 4.0)]
    got = {r.key: r.adv for r in grouped.session_advantage(spark.createDataFrame(rows, "key string, score double"), "key", "score").collect()}
    mean, std = statistics.mean([1, 3, 8]), statistics.stdev([1, 3, 8])
    for key, final in (("a_b_s1_0", 1), ("a_b_s1_1", 1), ("a_b_s2_0", 3), ("a_b_s3_9", 8), ("a_b_s3_10", 8)):
        assert abs(got[key] - (final - mean) / (std + 1e-6)) < 1e-9
    assert abs(got["c_s_0"] - 4 / (1 + 1e-6)) < 1e-9
    tasks = spark.createDataFrame([(1, "x", 3), (2, "x", 1), (3, "x", 2), (4, "y", 1)], "task int, who string, at int")
    done = spark.createDataFrame([(2,), (2,), (4,)], "task int")
    assert [tuple(r) for r in ranking.next_pending(tasks, done, "task", ["who"], ["at", "task"]).collect()] == [("x", 3, 2)]
