"""Operators that SQL does not express, edge cases and errors."""

import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import cells as C
from quillon.functions import text as T
from quillon.functions import tokens as K
from quillon.operators import audit, batch, cells, grouped, metrics, ranking
from quillon.operators import tokens as tokens_
from quillon.sources import records, workbook
from quillon.streaming import events, run, state


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- batch ------------------------------------------------------------------


def table(spark, n=6):
    return spark.createDataFrame([(i, i * 10, f"x{i}") for i in range(n)], "row_id long, v long, s string")


def values(df, column="v"):
    return [r[column] for r in df.orderBy("row_id").collect()]


def test_chunk_and_concat_round_trip(spark):
    df = table(spark)
    with pytest.raises(ValueError):
        batch.chunk(df, 5)
    parts = batch.chunk(df, 2)
    again = batch.concat([parts.filter(f"chunk = {i}").drop("chunk").withColumn("row_id", F.col("row_id") - 3 * i) for i in range(2)])
    assert values(again) == values(df)


@pytest.mark.parametrize("n,d", [(6, 4), (6, 3), (5, 12), (0, 4)])
def test_pad_and_unpad(spark, n, d):
    padded, pad = batch.pad_to_divisor(table(spark, n), d)
    assert padded.count() == n + pad and (n + pad) % d == 0
    assert values(padded) == [(i % n) * 10 for i in range(n + pad)] if n else True
    assert values(batch.unpad(padded)) == [i * 10 for i in range(n)]


@pytest.mark.parametrize("s", [slice(None), slice(1, 5, 2), slice(-3, None), slice(None, -2, 3), slice(4, 2)])
def test_slices_as_python(spark, s):
    assert values(batch.slice_rows(table(spark), s.start, s.stop, s.step)) == list(range(0, 60, 10))[s]


def test_gather_repeat_fold(spark):
    df = table(spark)
    assert values(batch.gather(df, [5, 0, 0])) == [50, 0, 0]
    assert values(batch.gather(df, [True, False, False, True, False, False])) == [0, 30]
    assert values(batch.repeat(df.limit(2), 2)) == [0, 0, 10, 10]
    assert values(batch.repeat(df.limit(2), 2, interleave=False)) == [0, 10, 0, 10]
    assert batch.repeat(df, 0).count() == 0
    assert values(batch.unfold_batch(batch.fold(df, 3))) == values(df)


def test_union_columns_checks_equality(spark):
    a = spark.createDataFrame([(0, float("nan"), None), (1, 2.0, "b")], "row_id long, x double, y string")
    assert batch.union_columns(a, a.withColumn("z", F.lit(1))).count() == 2
    with pytest.raises(Exception, match="differs"):
        batch.union_columns(a, a.withColumn("x", F.lit(2.0))).collect()
    with pytest.raises(KeyError):
        batch.pop(a, ["none"])
    with pytest.raises(ValueError):
        batch.rename(a, ["x"], ["a", "b"])


# --- estimators ---------------------------------------------------------------


def test_estimators_against_numpy(spark):
    r = random.Random(3)
    rows = [(i, f"g{r.randrange(12)}", r.gauss(0, 1), float(r.randrange(1, 9))) for i in range(80)] + [(99, "alone", 2.5, 3.0)]
    df = spark.createDataFrame(rows, "i long, g string, s double, n double")
    groups = {}
    for i, g, s, n in rows:
        groups.setdefault(g, []).append((i, s, n))

    def check(out, f):
        got = {r.i: r.adv for r in out.collect()}
        for members in groups.values():
            s, n = np.array([x[1] for x in members]), np.array([x[2] for x in members])
            for (i, *_), want in zip(members, f(s, n)):
                assert got[i] == pytest.approx(want, abs=1e-9)

    check(grouped.group_norm(df, "s", "g"), lambda s, n: (s - s.mean()) / (s.std(ddof=1) + 1e-6) if len(s) > 1 else s / (1 + 1e-6))
    check(grouped.leave_one_out(df, "s", "g"), lambda s, n: [x - (s.sum() - x) / (len(s) - 1) for x in s] if len(s) > 1 else s)
    check(grouped.leave_one_out_vectorised(df, "s", "g"), lambda s, n: [x - (s.sum() - x) / (len(s) - 1) for x in s] if len(s) > 1 else s * 0)
    check(grouped.weighted_baseline(df, "s", "g", "n"), lambda s, n: s - (s * n).sum() / n.sum() if len(s) > 1 else s)
    check(grouped.best_over_second(df, "s", "g", "i", by_std=False), lambda s, n: np.where(s == s.max(), s.max() - (np.sort(s)[-2] if len(s) > 1 else s.max()), 0))


def test_gae_ignores_masked_values(spark):
    mask = [int(x) for x in "00111001100"]
    r = random.Random(1)
    rewards = [r.gauss(0, 1) * m for m in mask]
    v1 = [r.gauss(0, 1) for _ in mask]
    v2 = [v if m else r.gauss(0, 9) for v, m in zip(v1, mask)]
    arr = lambda x: F.array(*[F.lit(y) for y in x])
    row = one(spark, grouped.gae(arr(rewards), arr(v1), arr(mask), 0.9, 0.8).alias("a"), grouped.gae(arr(rewards), arr(v2), arr(mask), 0.9, 0.8).alias("b"))
    assert row.a == pytest.approx(row.b)
    last, nxt, want = 0.0, 0.0, []
    for reward, value, m in reversed(list(zip(rewards, v1, mask))):
        if m:
            last = reward + 0.9 * nxt - value + 0.9 * 0.8 * last
            nxt = value
        want.append(last)
    assert row.a == pytest.approx(want[::-1])


def test_labels_registry_controller(spark):
    labels = ["1", "01", "1.0", " 2 ", "a", "A", None, "1e2", "100"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "x string").select(grouped.canonical_label("x")).collect()]
    assert got == ["1", "1", "1", "2", "a", "A", None, "100", "100"]
    with pytest.raises(ValueError):
        grouped.register_estimator("group_norm")(lambda df: df)
    with pytest.raises(ValueError):
        grouped.advantage(spark.range(1), "none")
    assert grouped.adapt_beta(0.1, 6.0, 3.0, 10, 100) == pytest.approx(0.1 * 1.02)


def test_resample_is_in_proportion(spark):
    df = spark.createDataFrame([(i, 0.0 if i % 2 else float(i)) for i in range(1000)], "i long, s double")
    drawn = [r.i for r in grouped.resample_by_score(df, "s", "i", seed=5).collect()]
    assert len(drawn) == 1000 and all(i % 2 == 0 and i for i in drawn)
    assert 620 < np.mean(drawn) < 710  # the mean under weights i is two thirds of the range


def test_sessions_take_the_last_row(spark):
    rows = [("q_1_s_0", 1.0), ("q_1_s_2", 3.0), ("q_1_s_1", 2.0), ("q_1_t_0", 9.0)]
    out = grouped.session_broadcast(spark.createDataFrame(rows, "key string, score double"), "key", "score").collect()
    assert {r.key: r.final_score for r in out} == {"q_1_s_0": 3.0, "q_1_s_1": 3.0, "q_1_s_2": 3.0, "q_1_t_0": 9.0}


# --- tokens -------------------------------------------------------------------


def test_masked_nan_is_harmless_and_bad_names_fail(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, float("nan"), 0), (1, 2, 3.0, 1)], "row_id long, t int, x double, mask int")
    row = tokens_.masked_stats(df, "x").first()
    assert (row["sum"], row.n, row["var"]) == (4.0, 2, 2.0)
    for bad in (lambda: tokens_.aggregate_loss(df, F.col("x"), "none"), lambda: tokens_.reject(df, "x", {"none": 1}), lambda: K.kl(F.lit(1), F.lit(1), "none")):
        with pytest.raises(ValueError):
            bad()
    assert tokens_.threshold("token_k1", "0.5_2") == (math.log(0.5), math.log(2))
    assert tokens_.threshold("seq_sum_k1", 2) == (math.log(0.5), math.log(2))


def test_kl_forms_are_bounded(spark):
    row = one(spark, K.kl(F.lit(-100.0), F.lit(0.0), "k3").alias("a"), K.ratio(F.lit(0.0), F.lit(-100.0)).alias("b"), K.kl(F.lit(-1.0), F.lit(-2.0), "k2+").alias("c"))
    assert row.a == 10.0 and row.b == pytest.approx(math.exp(20)) and row.c == 0.5


# --- metrics ------------------------------------------------------------------


def test_bootstrap_matches_numpy_and_closed_form(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=8)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, i int, v double")
    row = metrics.bootstrap(df, ["g"], "v", "i", 4, 1000, 42).first()
    state_ = np.random.RandomState(42)
    drawn = np.array([x[state_.choice(8, size=4, replace=True)] for _ in range(1000)])
    assert row.max_mean == pytest.approx(drawn.max(axis=1).mean()) and row.min_std == pytest.approx(drawn.min(axis=1).std())
    assert metrics.best_of_n(df, ["g"], "v", 4).first()["best_at_4"] == pytest.approx(row.max_mean, abs=0.1)


def test_majority_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([("p", i, v, float(i)) for i, v in enumerate("baab")], "g string, i int, vote string, score double")
    row = metrics.majority(df, ["g"], "vote", "score", "i").first()
    assert (row.vote, row.score, row.n) == ("b", 0.0, 2)


def test_pass_at_k_is_the_unbiased_estimator(spark):
    from math import comb

    df = spark.createDataFrame([(p, i < c) for p, (n, c) in enumerate([(10, 3), (10, 0), (10, 10), (4, 1)]) for i in range(n)], "p int, ok boolean")
    got = {r.k: r.pass_at_k for r in metrics.pass_at_k(df, "p", F.col("ok"), [1, 5]).collect()}
    want = lambda k: np.mean([1 - comb(n - c, k) / comb(n, k) for n, c in [(10, 3), (10, 0), (10, 10), (4, 1)] if n >= k])
    assert got == pytest.approx({1: want(1), 5: want(5)})


# --- ranking ------------------------------------------------------------------


def test_balance_covers_and_is_near_even(spark):
    r = random.Random(2)
    rows = [(b, i, r.randrange(1, 500), i // 4) for b in range(3) for i in range(64)]
    df = spark.createDataFrame(rows, "b int, i int, n int, g int")
    for out, key in ((ranking.balance(df, "b", "i", "n", 4), "i"), (ranking.balance_groups(df, "b", "g", "n", 4), "g")):
        got = out.collect()
        assert len(got) == len(rows)
        for b in range(3):
            sums, members = {}, {}
            for x in got:
                if x.b == b:
                    sums[x.part] = sums.get(x.part, 0) + x.n
                    members.setdefault(x[key], set()).add(x.part)
            assert len(sums) == 4 and all(len(m) == 1 for m in members.values())
            assert max(sums.values()) - min(sums.values()) < 0.15 * max(sums.values())
    micro = ranking.micro_batches(df, "b", "i", "n", 2500).collect()
    sums = {}
    for x in micro:
        sums[(x.b, x.micro)] = sums.get((x.b, x.micro), 0) + x.n
    assert max(sums.values()) < 2900 and all(sums[(b, 0)] <= sums[(b, 1)] for b in range(3))


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 7, 9), ("a", 2, 2), ("b", 7, 7)], "g string, f int, l int")
    assert sorted(tuple(r) for r in ranking.merge_intervals(df, ["g"], "f", "l").collect()) == [("a", 1, 5), ("a", 7, 9), ("b", 7, 7)]


def test_audit_rules(spark):
    rows = [("domain", "yes", 1, ""), ("domain", "yes", None, ""), ("training", "no", None, "abc"), ("training", "no", None, "abcde"), ("training", "maybe", None, ""), ("domain", "yes", 0, ""), ("training", "yes", 1, ""), ("training", "yes", None, "x" * 4001)]
    df = spark.createDataFrame(rows, "s string, a string, r int, d string")
    got = [r[0] for r in df.select(audit.audit_error(F.col("s"), F.col("a"), F.col("r"), F.col("d"))).collect()]
    assert got == [None, "reasonable missing", "description too short", None, "assessment", "description too short", "reasonable not asked", "description too long"]


# --- text ---------------------------------------------------------------------


def test_answers(spark):
    lit = F.lit
    row = one(
        spark,
        T.hash_answer(lit("x" * 400 + "#### 5 #### -1,234.5")).alias("a"), T.hash_answer(lit("#### 5" + "x" * 300)).alias("b"), T.hash_answer(lit("is 7 .")
, strict=False).alias("c"), T.hash_answer(lit("none"), strict=False).alias("d"),
        T.normal_answer(lit("The  Theatre, an Apple!")).alias("e"), T.answer_score(lit("<answer>x</answer>" * 11 + "<answer> The X. </answer>"), F.array(lit("x"))).alias("f"),
        T.answer_score(lit("no tags"), F.array(lit("x"))).alias("g"), T.last_answer_line(lit("ANSWER : 1\nanswer: 2 ")).alias("h"),
    )
    assert (row.a, row.b, row.c, row.d) == ("-1234.5", None, "7", None)
    assert (row.e, row.f, row.g, row.h) == ("theatre apple", 0.25, 0.0, "2 ")


def test_output_comparison(spark):
    cases = [("1.0\n", "1.00000001", True), ("A b", "a B\n", True), ("1\n2", "1", False), ("12d", "12", False), ("nan", "NaN", True), ("x\n\n", "x", True), ("1e3", "1000", True), ("", "", True)]
    got = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(T.output_matches("a", "b").alias("s")).collect()
    assert [r.s for r in got] == [w for *_, w in cases]


def test_code_blocks(spark):
    text = "a\n```py\nx=1\n```\nb\n```\ny\n```\nopen ```go\nz"
    row = one(spark, T.fenced_blocks(F.lit(text)).alias("a"), T.best_block(F.lit(text), "go").alias("b"), T.best_block(F.lit("t ```go\nz"), "go").alias("c"), T.best_block(F.lit("plain"), "go").alias("d"))
    assert [(b.language, b.code) for b in row.a] == [("python", "x=1"), ("", "y")]
    assert (row.b, row.c, row.d) == ("x=1", "z", "")


# --- cells --------------------------------------------------------------------


def test_cell_equality_vectors(spark):
    def cell(v):
        if v is None:
            return (None, None, None, None)
        if isinstance(v, bool):
            return ("b", None, None, v)
        return ("n", float(v), None, None) if isinstance(v, (int, float)) else ("s", None, v, None)

    cases = [
        (True, 1, False), (False, 0, False), (True, True, True), ("nan", "nan", True), ("nan", "NaN", False), ("inf", "Infinity", False), ("1e309", "inf", False), (None, "", True),
        ("1.004", 1, True), ("1_000", 1000, True), ("12d", 12, False), (" 5 ", 5, True), (-0.001, 0, True), ("a", "A", False), (0.5, "0.50", True),
    ]
    rows = [(*cell(a), *cell(b)) for a, b, _ in cases]
    df = spark.createDataFrame(rows, "t1 string, n1 double, s1 string, b1 boolean, t2 string, n2 double, s2 string, b2 boolean")
    ts = F.lit(None).cast("timestamp_ntz")
    side = lambda i: C.normal(*[F.col(f"{c}{i}") for c in "tnsb"], ts)
    assert [r[0] for r in df.select(C.same(side(1), side(2))).collect()] == [w for *_, w in cases]


def test_columns_and_ranges(spark):
    names = spark.range(1, 16385).select("id", C.column_name(F.col("id")).alias("n"), C.column_number(C.column_name(F.col("id"))).alias("b")).collect()
    assert all(r.id == r.b for r in names)
    by_id = {r.id: r.n for r in names}
    assert [by_id[i] for i in (1, 26, 27, 52, 702, 703, 16384)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]
    row = one(spark, C.ranges(F.lit("'My, sheet'!bd2:308, ‘x''y’!C3,Sheet1'!A:B")).alias("r"))
    assert [(x.sheet, x.range) for x in row.r] == [("My, sheet", "BD2:BD308"), ("x'y", "C3"), ("Sheet1", "A:B")]
    b = lambda s, h=None: one(spark, C.bounds(F.lit(s), None if h is None else F.lit(h)).alias("b")).b
    assert tuple(b("$B$3:A1")) == (1, 1, 2, 3) and tuple(b("B:A", 9)) == (1, 1, 2, 9)
    assert b("A:B") is None and b("XFE1") is None and b("A0") is None and b("A1048577") is None and b("1A") is None


def test_pattern_check():
    for bad in ("(a)", "a+", "a|b", "a{2}", "a?", "x" * 300):
        with pytest.raises(ValueError):
            cells.check_pattern(bad)
    for good in ("a.*b", "[a+|(]x*", r"\(a\)"):
        cells.check_pattern(good)
    assert cells.broadcast_grid([[1, 2]], 2, 2) == [[1, 2], [1, 2]]
    with pytest.raises(ValueError):
        cells.broadcast_grid([[1, 2]], 2, 3)


def book(path, sheets):
    """A minimal workbook: sheets of {ref: (attributes, inner XML)}."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="20"/></cellXfs></styleSheet>')
        for i, cells_ in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData><row>" + "".join(f'<c r="{ref}" {a}>{x}</c>' for ref, (a, x) in cells_.items()) + "</row></sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    book(
        f"{tmp_path}/a.xlsx",
        {
            "One": {"A1": ('t="s"', "<v>0</v>"), "B1": ('t="s"', "<v>1</v>"), "C2": ("", "<f>A1*2</f><v>4.5</v>"), "AA3": ('s="1"', "<v>45000.25</v>"), "D4": ('s="2"', "<v>0.5</v>")},
            "Two": {"A1": ('t="b"', "<v>1</v>"), "A2": ('t="e"', "<v>#N/A</v>"), "A3": ('t="inlineStr"', "<is><t>in</t></is>"), "A4": ("", "<f>B1</f>")},
        },
    )
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    rows = workbook.read_workbooks(spark, str(tmp_path)).collect()
    got = {(r.sheet, r.row, r.col): r for r in rows if r.error is None}
    assert got["One", 1, 1].str == "hello" and got["One", 1, 2].str == "rich"
    assert got["One", 2, 3].num == 4.5 and got["One", 2, 3].formula == "=A1*2"
    assert str(got["One", 3, 27].ts) == "2023-03-15 06:00:00" and (got["One", 4, 4].vtype, got["One", 4, 4].num) == ("t", 0.5)
    assert got["Two", 1, 1].bool is True and got["Two", 2, 1].vtype == "e" and got["Two", 3, 1].str == "in" and got["Two", 4, 1].vtype is None
    assert [r.error.split(":")[0] for r in rows if r.error] == ["BadZipFile"] and len(got) == 9


# --- state and streams ----------------------------------------------------------


def test_token_bucket(spark):
    rows = [("k", 0.0, 5.0), ("k", 0.0, 5.0), ("k", 1.0, 5.0), ("k", 100.0, 30.0), ("k", 100.0, 1.0), ("z", 0.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, at double, n double")
    got = {r.i: r.wait for r in state.token_bucket(df, "k", "at", "n", 1.0, 10.0).collect()}
    # The third waits for 4 tokens; the large one runs 20 into debt, which the next waits out.
    assert got == pytest.approx({0: 0.0, 1: 0.0, 2: 4.0, 3: 20.0, 4: 21.0, 5: 0.0})


def test_quarantine_and_ring(spark):
    jobs = [("1", "done", 1.0, 1.0, 2.0, 1.0, "w"), ("", "done", 1.0, 1.0, 2.0, 1.0, "w"), ("3", "running", 1.0, None, None, None, " "), ("4", "gone", float("inf"), None, None, None, None)]
    df = spark.createDataFrame(jobs, "job_id string, status string, created_at double, started_at double, finished_at double, reward double, worker_id string")
    good, bad = state.quarantine(df)
    assert [r.job_id for r in good.collect()] == ["1"]
    assert {r.job_id: r.reasons for r in bad.collect()} == {"": ["job_id"], "3": ["running without start", "running without worker"], "4": ["status", "created_at"]}
    assert {r.slot: r.id for r in state.ring(spark.range(10), "id", 4).collect()} == {0: 8, 1: 9, 2: 6, 3: 7}


def test_mixed_sample_fills_deficits(spark):
    df = spark.range(20).withColumn("ok", F.col("id") < 3)
    for size, share, want in ((10, 0.5, (3, 7)), (10, 0.1, (1, 9)), (20, 0.0, (3, 17)), (30, 0.5, (3, 17))):
        got = state.mixed_sample(df, F.col("ok"), size, share, "id").collect()
        assert (sum(r.ok for r in got), sum(not r.ok for r in got)) == want


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 250).parquet(f"{tmp_path}/e")
    batch_ = events.tumbling(spark.read.parquet(f"{tmp_path}/e"), "1 day", ["event_type"], "value")
    stream = run.available_now(events.tumbling(run.source(spark, f"{tmp_path}/e"), "1 day", ["event_type"], "value"), "complete")
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(stream) == key(batch_)
    once = run.available_now(events.deduplicated(run.source(spark, f"{tmp_path}/e").select("ts", "event_id"), ["event_id"]))
    assert once.count() == 1000
    seen, both = [], ([], [])
    run.micro_batches(run.source(spark, f"{tmp_path}/e"), 100, "event_id", lambda b, n: seen.append(b.count()))
    assert seen == [100] * 10  # 50 of each file's 250 rows wait for the next one
    run.fan_out(run.source(spark, f"{tmp_path}/e"), [lambda b, n: both[0].append(b.count()), lambda b, n: both[1].append(b.count())])
    assert sum(both[0]) == sum(both[1]) == 1000


def test_record_files(spark, tmp_path):
    with pytest.raises(ValueError):
        records.scan(spark, ["x.txt"])
    df = records.table_of(spark, "judged", [{"id": 1, "labels": {"a": [1]}, "name": None}, {"id": 2, "labels": "x"}])
    assert [tuple(r) for r in df.collect()] == [(1, '{"a": [1]}', None), (2, "x", None)]
    records.write_csv(spark.createDataFrame([(1, 'a"b', None)], "x int, y string, z string"), f"{tmp_path}/c")
    text = next((tmp_path / "c").glob("part*")).read_bytes()
    assert text.startswith(b"x,y,z\r\n") and text.endswith(b"\r\n")
    (tmp_path / "j").mkdir()
    (tmp_path / "j/one.jsonl").write_text('{"id": 1, "tags": [1, 2]}\n')
    assert records.jsonl_views(spark, f"{tmp_path}/j", {"one": "id int, tags array<int>"}) == ["one"]
    assert spark.table("one").first().tags == "[1,2]"


def test_range_overlaps_by_tiles(spark):
    r = random.Random(6)
    rows = []
    for i in range(150):
        top, left = r.randint(1, 400), r.randint(1, 60)
        rows.append((i, "f", r.choice("xy"), left, top, left + r.choice([0, 0, 2, 30]), top + r.choice([0, 1, 5, 90, 1048575])))
    box = spark.createDataFrame(rows, "id int, file string, sheet string, min_col int, min_row int, max_col int, max_row int")
    pairs = cells.range_overlaps(box, box)
    meet = lambda p, q: p[2] == q[2] and p[3] <= q[5] and q[3] <= p[5] and p[4] <= q[6] and q[4] <= p[6]
    assert sorted((x.a, x.b) for x in pairs.collect()) == [(p[0], q[0]) for p in rows for q in rows if meet(p, q)]
    # No pair is formed by the sheet alone.
    assert "_tile_row" in next(x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)


def test_mini_batches_are_the_shuffle_by_hash(spark):
    from pyspark.sql import Window

    df = spark.range(600).withColumnRenamed("id", "row_id").withColumn("x", F.col("row_id") * 2)
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(2))))
    place = F.row_number().over(Window.partitionBy("epoch").orderBy(F.xxhash64(F.lit(7), "epoch", "row_id"), "row_id")) - 1
    want = each.withColumn("batch", F.floor(place / 50))
    got = batch.mini_batches(df, 50, 3, 7)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ordinals_of_one_frequent_value_and_none(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else 5 if i % 3 else i, i) for i in range(500)], "a long, b long")
    rows = batch.with_ordinal(df.repartition(5), "a", "b").orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(500))
    assert [r.b for r in rows] == [r.b for r in df.orderBy("a", "b").collect()]
    assert batch.with_ordinal(df.limit(0), "a", "b").collect() == []


def test_admission_of_null_queues_and_short_ones(spark):
    rows = [("a", i, None if i == 3 else i) for i in range(10)] + [(None, i, i) for i in range(4)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "queue string, job_id long, at long")
    for capacity in (0, 2, 100):
        want = set()
        for q in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
            want |= set(own[:capacity])
        got = state.admitted(df.repartition(4), ["queue"], ["at", "job_id"], capacity)
        assert {tuple(r)[:3] for r in got.filter("accepted").collect()} == want
        assert got.count() == len(rows)


def test_dense_search_in_several_passes(spark, monkeypatch):
    from quillon.operators import retrieval

    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = sorted(map(tuple, retrieval.dense(vectors, queries, 4).collect()))
    monkeypatch.setattr(retrieval, "BATCH", 2)
    assert sorted(map(tuple, retrieval.dense(vectors, queries, 4).collect())) == want
    assert len(want) == 36
    assert retrieval.dense(vectors, queries.limit(0), 4).collect() == []


def test_bm25_with_many_and_few_query_terms(spark, monkeypatch):
    from quillon.operators import retrieval

    docs = spark.createDataFrame([(1, "red fox, red hen"), (2, "blue fox"), (3, None), (4, ""), (5, "hen"), (5, "red")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "hen hen"), (3, "none"), (4, None)], "query_id long, text string")
    want = sorted(map(tuple, retrieval.bm25(docs, queries, 3).collect()))
    assert [(r[0], r[1]) for r in want] == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 5)]
    monkeypatch.setattr(retrieval, "TERMS", 1)
    assert sorted(map(tuple, retrieval.bm25(docs, queries, 3).collect())) == want


def test_bm25_completes_few_pairs_and_loses_none(spark):
    import math
    import random

    from quillon.operators import retrieval

    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice((20, 60, 200))))) for i in range(500)]
    queries = [(i, " ".join(rng.choices(docs[i * 40][1].split(), k=15))) for i in range(10)]
    k1, b, k = 0.9, 0.4, 4
    own = {d: t.split() for d, t in docs}
    mean = sum(map(len, own.values())) / len(own)
    df = {w: sum(w in x for x in map(set, own.values())) for w in {w for _, t in queries for w in t.split()}}
    want, pairs = [], 0
    for q, text in queries:
        scores = []
        for d, x in own.items():
            score = 0.0
            for w in text.split():
                tf = x.count(w)
                score += math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(x) / mean))
            if score > 0:
                scores.append((-round(score, 9), d))
        pairs += len(scores)
        want += [(q, d, r) for r, (_, d) in enumerate(sorted(scores)[:k], 1)]
    search = retrieval.Bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), k)
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in search.best().collect()) == sorted(want)
    assert len(want) <= search.candidates().count() <= pairs / 10


@pytest.mark.parametrize("kind", ["string", "date", "struct<x: long, y: string>"])
def test_ordinals_of_any_order(spark, kind):
    df = spark.range(400).withColumn("s", F.when(F.col("id") % 9 > 0, F.hash("id") % 50))
    x = {"string": F.col("s").cast("string"), "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("s").cast("int"))}.get(kind, F.struct(F.col("s").alias("x"), F.col("s").cast("string").alias("y")))
    df = df.select(x.alias("a"), "id")
    rows = batch.with_ordinal(df.repartition(5), "a", "id").orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(400))
    assert [r.id for r in rows] == [r.id for r in df.orderBy("a", "id").collect()]


def test_one_first_value_is_spread_over_ranges(spark):
    df = spark.range(100_000).withColumn("a", F.lit("same"))
    sizes = [r["count"] for r in batch.with_range(df, ["a", "id"], 16).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 100_000 / 16
