import re

import pytest

from quillon.llm.graph import components
from quillon.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows, k, percent):
    """Every pair that shares a shingle is compared."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    seen = set()
    for ids in by_shingle.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def run(spark, rows, k=3, percent=85, schema="doc_id long, text string"):
    out = near_duplicates(spark.createDataFrame(rows, schema), k, percent).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


def chain():
    """Each text differs from the next in one word, so the ends are linked only through the middle."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(12):
        words = list(words)
        words[8 * i] = f"x{i}"
        rows.append((50 - i, " ".join(words)))
    return rows


def test_small_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "one"), (8, "ONE\x0bone"),
        (9, "é É"), (10, "é é"), (11, "a b c d e f g h"), (12, "a b c d e f g h"), (13, "x " * 5000),
    ]
    assert run(spark, rows) == brute(rows, 3, 85)


def test_chain_and_copies(spark):
    rows = chain() + [(100 + i, chain()[0][1]) for i in range(40)]
    assert run(spark, rows) == brute(rows, 3, 85)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_documents(spark, k, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)
    assert sum(not kept for _, _, kept in got.values()) > 20


def test_repeated_rows_clashing_columns_empty(spark):
    rows = [(1, "a b c d", 5, "k"), (1, "a b c d", 5, "k"), (None, "a b c d", 1, None), (2, "zz", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, digest string")
    out = sorted((tuple(r) for r in near_duplicates(df, 3, 85).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 1, 2, True)], key=str)
    assert near_duplicates(df.limit(0), 3, 85).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 7), (200, 201), (202, 201), (300, 300)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 31)}, 100: 1, 200: 200, 201: 200, 202: 200}


def test_crowd_of_loose_copies(spark):
    """Copies too far from the original to be linked to it, some of them linked to one another."""
    import random

    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in r.sample(range(200), r.choice([4, 8, 10, 12, 14, 18])):
            words[j] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            words = list(words)
            for j in r.sample(range(200), 3):
                words[j] = f"y{r.randrange(10**6)}"
            rows.append((1000 - i, " ".join(words)))
    want = brute(rows, 3, 85)
    assert run(spark, rows) == want
    groups = {}
    for i, (_, c, _) in want.items():
        groups.setdefault(c, []).append(i)
    assert sum(len(g) > 1 for g in groups.values()) > 3 and len(groups) > 20
