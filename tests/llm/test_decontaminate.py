import numpy as np
import pytest

from quillon.llm import decontaminate as D
from quillon.llm.common import letter_bytes, plain_words


def brute(rows, items):
    """Every passage against every item, scored in full."""
    index = D.ItemIndex([(i, t, "") for i, t in items])
    out = []
    for doc_id, text in rows:
        texts = D.Texts([text])
        words = texts.words
        found = {}
        for start in range(0, max(1, len(words) - index.stride), index.stride):
            terms = set(words[start : start + index.width].tolist())
            for i, (at, weight) in enumerate(index.postings):
                score = sum(w for a, w in zip(at.tolist(), weight.tolist()) if int(index.terms[a]) in terms)
                if score >= D.THRESHOLD - 1e-9 and (share := index.verify(texts, 0, start, i)) >= D.OVERLAP - 1e-9:
                    found[index.item_id[i]] = max(share, found.get(index.item_id[i], 0))
        out.append((doc_id, bool(found), sorted(found), round(max(found.values(), default=0.0), 9)))
    return sorted(out, key=str)


def run(docs, items):
    return sorted(((r.doc_id, r.contaminated, r.item_ids, round(r.overlap, 9)) for r in D.find_contamination(docs, items).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert run(docs, items) == want
    assert sum(r[1] for r in want) > 3


#: Items of a few words count as whole lines only.
ITEMS = [(1, "Who wrote the long book about the white whale at sea? Herman Melville did."), (2, "alpha beta gamma"), (3, None), (4, "12 !"), (2, "alpha beta gamma")]


@pytest.mark.parametrize("passes", [20_000, 2])
def test_cases(spark, monkeypatch, passes):
    monkeypatch.setattr(D, "ITEMS", passes)
    filler = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(700))
    whole = ITEMS[0][1]
    rows = [
        (1, filler + " " + whole), (2, whole.upper().replace(" ", "### ")), (3, whole.split("?")[0]), (4, None), (5, ""), (6, "ALPHA, beta; gamma!"), (10, "so alpha beta gamma"), (11, filler + "\nalpha beta gamma\nand on"), (12, "take\n12\nof it"), (13, "12 alpha"),
        (7, filler), (8, filler[:900] + " " + whole + " " + filler[:300]), (9, "alpha gamma"), (None, whole), (1, filler + " " + whole),
    ]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r[0], r[2]) for r in run(docs, items)]
    want = {1: [1], 2: [1], 3: [], 4: [], 5: [], 6: [2], 7: [], 8: [1], 9: [], 10: [], 11: [2], 12: [4], 13: [], None: [1]}
    assert sorted(got, key=str) == sorted([(i, want[i]) for i, _ in rows], key=str)


def test_question_and_answer_columns_and_empty(spark):
    items = spark.createDataFrame([(1, "what is the capital city of france today", "paris of course")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "what is the capital city of france today paris of course"), (2, "what is the capital city of france today")], "doc_id long, text string")
    assert [r[:3] for r in run(docs, items)] == [(1, True, [1]), (2, False, [])]
    assert run(docs.limit(0), items) == []
    assert [r[1] for r in run(docs, items.limit(0))] == [False, False]


def test_numbers_and_every_answer_count(spark):
    items = spark.createDataFrame(
        [(1, "What is 17 plus 25 when both are written in base ten?", "42"), (2, "12 + 30 = ?", "42"), (3, "Paris", ""), (4, "Which sign stands for no more than in most languages?", "<="), (5, "", "what is seven times six: 42"), (6, "??", "!")],
        "item_id long, question string, answer string",
    )
    rows = {
        1: ("What is 91 plus 33 when both are written in base ten? 124", []), 2: ("What is 17 plus 25 when both are written in base ten? It is 42.", [1]),
        3: ("What is 17 plus 25 when both are written in base ten?", []), 4: ("12 + 30 = ? 42", [2]), 5: ("12 + 30 = ?\n42", [2]), 6: ("12 + 31 = ? 42", []),
        7: ("I love paris in spring", []), 8: ("cities:\nParis\nRome", [3]), 9: ("Which sign stands for no more than in most languages? <= does", [4]), 10: ("Which sign stands for no more than in most languages? >= does", []),
        11: ("What is seven times six: 42", [5]), 12: ("what is seven times six: 43", []), 13: ("?? !", []),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.find_contamination(docs, items).collect()}
    assert got == {i: x for i, (_, x) in rows.items()}
    assert {r.doc_id for r in D.drop_contaminated(docs, items).collect()} == {i for i, (_, x) in rows.items() if not x}


def test_a_long_item_leaves_the_others_alone(spark):
    long = " ".join(f"w{i}" for i in range(900))
    items = spark.createDataFrame([(1, long), (2, "one short item of only seven words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + long), (2, "y " * 400 + "one short item of only seven words"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.item_ids for r in D.find_contamination(docs, items).collect()} == {1: [1], 2: [2], 3: []}


def test_block_bounds_never_drop_an_item():
    r = np.random.default_rng(5)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(150)]
    items = [(i, " ".join(r.choice(vocabulary, r.integers(1, 25)))) for i in range(70)]
    rows = [(i, " ".join(r.choice(vocabulary, 300)) + " " + items[i % 70][1]) for i in range(40)]
    index = D.ItemIndex([(i, t, "") for i, t in items])
    for _, text in rows:
        words, counts, _, _ = plain_words(*letter_bytes([text]))
        got = {(start, item) for _, start, item in index.retrieve(words, counts)}
        want = set()
        for start in range(0, max(1, len(words) - index.stride), index.stride):
            terms = set(words[start : start + index.width].tolist())
            for i, (at, weight) in enumerate(index.postings):
                if sum(w for a, w in zip(at.tolist(), weight.tolist()) if int(index.terms[a]) in terms) >= D.THRESHOLD - 1e-9:
                    want.add((start, i))
        assert got == want


def test_near_copies_of_single_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()
    texts = []
    for r in rows[:20]:
        words = r.text.split()
        shares = lambda v: np.isin(w := D._shingles(D._words(r.text), 5), D._shingles(D._words(" ".join(v)), 5)).sum() / max(len(w), 1)  # noqa: E731, B023
        edits = [[*words[:j], "zzz", *words[j + 1 :]] for j in range(len(words))] + [words[: -j - 1] for j in range(len(words))]
        texts += [(r.item_id, " ".join(v)) for v in edits if shares(v) >= D.OVERLAP]
    assert len(texts) > 100
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.item_ids for r in D.find_contamination(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert [n for n, (i, _) in enumerate(texts) if i not in found[n]] == []
