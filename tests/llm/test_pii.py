import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import pii as P

# The contract's own patterns, in Python.
RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    spans = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(RAW.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return tuple(sum(s[2] == k for s in spans) for k in RAW), hashlib.sha256(joined.encode()).hexdigest(), {f"{k}:{a}:{b}" for a, _, k, b in spans}


def check(spark, rows):
    from quillon.llm.queries import op6_pii  # noqa: F401 - the same derivation, over our own rows

    df = spark.createDataFrame([(i, t, 0, "r") for i, t in rows], "doc_id long, text string, base int, row string")
    out = P.find_pii(df)
    base = P.joined(P.in_order(F.concat(*P.KINDS)))
    got = out.select("doc_id", "text", *[F.size(k).alias(k) for k in P.KINDS], F.sha2(base.cast("binary"), 256).alias("h"), P.joined(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        counts, digest, spans = brute(r.text)
        assert ((r.email, r.ip, r.card, r.phone), r.h) == (counts, digest), r.text[:200]
        assert spans <= set(r.s.split(","))
    return got


ODD = [
    None, "", "a@b.c_d@e.f g@h", "x@y.z..w@v.u", "é🙂 a.b+c@d-e.fr, 1.2.3.4.5.6.7.8.9", "256.1.1.1 0001.002.3.255 1.2.3 999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+1 (017) 555-7713. +1 +44 20 7946 0958x +0123456789012345678 ++1.2.3.4.5.6.7.8.9.0",
    "4111111111111111+14155550123 a@1.2.3.4", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "a" * 50_000, "1" * 20_000, "1 " * 20_000, "a@" + "b." * 4_000 + "c",
    "." * 20_000 + "@", "+" * 20_000, "+1" + " " * 20_000, "0.0.0.0-+00000000000", "x@y @z.w a@-.- %@1.1",
]


def test_odd_texts(spark):
    check(spark, [(i, t) for i, t in enumerate(ODD)] + [(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    r = random.Random(seed)
    check(spark, [(i, "".join(r.choice("0123456789.@+- ()a_é\n4111") for _ in range(r.randrange(200)))) for i in range(600)])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sum(r.email + r.ip + r.card + r.phone for r in check(spark, [tuple(r) for r in docs.collect()])) > 30


def test_redaction(spark):
    rows = [(1, "mail a@b.co or +1 (017) 555-7713!", 9, "k"), (2, None, 0, "k"), (3, "clean é", 7, "k"), (4, "a@1.2.3.4 b", 3, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string")
    out = {r.doc_id: r for r in P.redact(df, P.BoostedTrees(0.0, [], float("inf"))).collect()}
    assert out[1].text == "mail <EMAIL> or <PHONE>!" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean é" and out[4].text == "<EMAIL> b"
    assert P.redact(df).columns == df.columns
    assert P.redact(df.limit(0)).collect() == []


def test_trees_learn_and_calibrate():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.integers(0, 20, (4000, len(P.FEATURES))).astype(float)
    y = ((x[:, 1] > 8) & (x[:, 2] < 12)).astype(float)
    m = P.BoostedTrees.fit(x, y)
    assert np.isfinite(m.threshold)
    assert P.BoostedTrees.fit(x[:0], y[:0]).threshold == float("inf")
    chosen = m.scores(x) >= m.threshold
    assert y[chosen].mean() > 0.93 and chosen.sum() > 0.8 * y.sum()


def test_added_spans_have_independent_truth(spark):
    """Precision and recall over pairs of format and context that the trees have not seen."""
    m = P.fit(spark)
    assert m.precision > 0.85 and m.recall > 0.4, (m.precision, m.recall)
    # The column and the trees agree, candidate by candidate.
    rows = [
        (1, 'as token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" says', True), (2, "Tel: (017) 555-7713 or", True), (3, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixes", False),
        (4, "on 2024-01-15 the men went", False), (5, "about 1 000 000 people", False), (6, "", False),
    ]
    got = {r.doc_id: len(r.spans) > 0 for r in P.find_pii(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: y for i, _, y in rows}


def test_clean_documents_are_left_alone(spark):
    """What the trees add in the test documents are the planted tokens and no prose."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    added = P.find_pii(docs).select("text", F.explode(F.filter("spans", lambda x: ~x["kind"].isin(P.KINDS))).alias("x"))
    values = [r.v for r in added.select(F.substring("text", F.col("x.first") + 1, F.col("x.last") - F.col("x.first")).alias("v")).collect()]
    assert len(values) > 5 and all(re.fullmatch("[0-9a-fA-F]{40}", v) for v in values), values[:10]
    assert P.find_pii(docs.limit(0)).collect() == []
