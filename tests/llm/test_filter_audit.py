"""Filter interactions against a plain simulation of every order."""

import random
import re
from itertools import permutations

from quillon.llm.filter_audit import ORDERS, audit_filters, packed_masks, unpacked

DOCS = "doc_id long, text string, lang string, mask string, n int"
LABELS = "doc_id long, quality int, toxic int, part string"


def _fails(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller,
    }
    return {k for k, x in tests.items() if x}


def _simulated(docs, labels):
    good = {r[0] for r in labels if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    parts: dict = {}
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        smaller = any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, *_ in docs)
        parts.setdefault(lang or "", []).append((doc_id, _fails(text, smaller)))
    out = {}
    for part, rows in parts.items():
        taken = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                out[part, order, step] = [
                    len(left) - len(gone), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                ]
                left = [r for r in left if f not in r[1]]
                taken[f] += len(gone)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(taken[order[step - 1]])
    return out


def _found(rows):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_against_a_simulation(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(words[: rng.choice((40, 300))]) for _ in range(rng.choice((3, 99, 100, 140))))
        text = text.upper() if i % 7 == 0 else text + rng.choice(("", " #", "\t|", " é"))
        docs.append((i, text, rng.choice(("en", "de", None)), "x", i))
    docs += [(100 + i, docs[i][1], "en", None, None) for i in range(10)]
    docs += [(200, None, "fr", None, None), (201, "", "fr", None, None), (None, None, "fr", None, None), (5, docs[5][1], docs[5][2], None, None)]
    docs += [(300, "word " * 50_000, "", None, None)]
    labels = [(i, i % 2, int(i % 5 == 0), "clash") for i in range(0, 110, 3)] + [(3, None, 1, None), (None, 1, 1, None), (999, 1, 1, None)]
    found = audit_filters(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == 4 * 600
    assert _found(found) == _simulated(docs, labels)


def test_empty_table(spark):
    assert audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_wide_sums_do_not_carry():
    packed = packed_masks()
    n = 2**60
    counts, alone = unpacked(n * packed[31] + (n - 1) * packed[1 + 32 + 64])
    o = ORDERS.index("EDCBA")
    assert counts[o, 0].tolist() == [n - 1, n, 0, 0, 0]
    assert counts[o, 4].tolist() == [0, n - 1, n, n - 1, n - 1]
    assert alone.tolist() == [n - 1, 0, 0, 0, 0]
