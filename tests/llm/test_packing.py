import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm.packing import minimum_bin_slack, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, window=4096):
    """Exact round trip: every id lies in one piece, sequences are gapless and bounded."""
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    model = Tokenizer.from_file(PATH)
    ids = Counter()
    for doc_id, text in rows:
        ids[(doc_id, tuple(model.encode(text or "", add_special_tokens=False).ids + [2]))] += 1
    out = pack(df, PATH, window=window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, pieces in by_doc.items():
        want = Counter()
        for (i, own), n in ids.items():
            if i == doc_id:
                for a in range(0, len(own), window):
                    part = own[a : a + window]
                    want[(a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(own))] += n
        assert Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    assert set(by_doc) == {i for i, _ in rows}
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += window - at
    return padding, len(by_sequence)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    padding, n = check(df)
    assert padding < 4096 * 2 + 0.001 * 4096 * n


def test_odd_texts(spark):
    odd = [
        "", None, " ", "\n\n", "it's we'll DON'T a.'s b,'ll 'sword,", "x<|endoftext|>y <|startoftext|> z", "<|ENDOFTEXT|> a<|StartOfText|>b", "É é é É, ß.", "ΣΑΣ. Σ",
        "a b c\tD\r\n", "日本語 テスト. 123,456 7.5%", "a..b ?! ...", "İstanbul KK.", "́abc ́", "word " * 3000 + "end.", "🙂!🙂 x", "a\x00b\x0bc",
    ]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, "twice"), (3, "twice"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, bucket int")
    check(df, window=64)
    assert pack(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_minimum_bin_slack(seed):
    r = random.Random(seed)
    window = r.choice([16, 100, 4096])
    lengths = Counter(r.randrange(1, window + 1) for _ in range(r.randrange(1, 800)))
    used, windows, total = Counter(), 0, 0
    for times, n in minimum_bin_slack(lengths, window):
        assert n > 0 and sum(length * k for length, k in times) <= window
        for length, k in times:
            used[length] += k * n
        windows += n
    assert used == lengths
    total = sum(length * k for length, k in lengths.items())
    assert windows <= -(-total // window) * 1.25 + 1


def test_first_pattern_is_closest():
    import itertools

    for lengths in ({7: 1, 5: 2, 4: 1, 3: 1}, {9: 1, 8: 3, 3: 1}, {10: 1, 6: 1, 5: 1}):
        times, _ = minimum_bin_slack(lengths, 20)[0]
        items = [x for x, k in lengths.items() for _ in range(k)]
        seed = max(items)
        items.remove(seed)
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := seed + sum(c)) <= 20)
        assert sum(length * k for length, k in times) == best
