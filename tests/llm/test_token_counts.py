import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.token_count import _Library, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a", " a", "a b  c", "a\nb\n\nc", "a \n b", "tab\there", "end ", "end\n", "<|endoftext|>", "x <|endoftext|> y\n<|endoftext|>", "it's we'll", "é 日本語 🙂",
    "a\u00a0b", "a b\u2003c", "\x1c a b", "word " * 5000 + "end", "A.\nB c!\n D", "\ufeffx y",
]


def library(texts):
    model = Tokenizer.from_file(PATH)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_as_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_000, "twice"), (10_000, "twice"), (None, "no id"), (None, "no id"), (5, "no id")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, digest int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(rows, library([t for _, t in rows]))), key=str)
    assert count_tokens(df.limit(0), PATH).collect() == []


def test_cache_encodes_only_misses(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a b"), (5, "new one")], "doc_id long, text string")
    count_tokens(first, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    # A stored count is trusted, so a changed one shows that nothing was encoded again.
    kept = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 100).collect()
    spark.createDataFrame(kept).write.mode("overwrite").parquet(f"file://{tmp_path}/cache2")
    got = {r.doc_id: r.n_tokens for r in count_tokens(second, PATH, f"file://{tmp_path}/cache2").collect()}
    assert got == {4: 102, 5: 2}
    assert spark.read.parquet(f"file://{tmp_path}/cache2").count() == 3
    # Another vocabulary has counts of its own.
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in count_tokens(second, model, f"file://{tmp_path}/cache2").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert got == {4: len(sp.encode("a b")), 5: len(sp.encode("new one"))}


def test_second_run_of_the_query_encodes_nothing(spark, sf_dir, tmp_path, monkeypatch):
    import quillon.llm.queries as q
    import quillon.llm.token_count as m
    from quillon.llm.queries import op9_token_counts

    monkeypatch.setattr(q, "scratch_root", lambda _: f"file://{tmp_path}")
    first = sorted(map(tuple, op9_token_counts(spark, sf_dir).collect()))
    cache = f"file://{tmp_path}/token-count-cache"
    size = spark.read.parquet(cache).count()

    def refuse(path):
        def run(batches):
            for batch in batches:
                if len(batch):
                    raise ValueError("encoded again")
                yield batch
        return run

    monkeypatch.setattr(m, "_counts", refuse)
    assert sorted(map(tuple, op9_token_counts(spark, sf_dir).collect())) == first
    assert spark.read.parquet(cache).count() == size == len({r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})


@pytest.mark.parametrize("memo", [1, 400_000])
def test_memo_does_not_change_counts(monkeypatch, memo):
    import quillon.llm.token_count as m

    monkeypatch.setattr(m, "MEMO", memo)
    own = _Library(PATH)
    texts = [t or "" for t in ODD]
    assert own.chunked
    for _ in range(2):
        assert own.count(texts) == library(texts)


def test_stored_texts_stay_where_they_are_and_damage_is_an_error(spark, tmp_path, monkeypatch):
    from quillon.llm import token_count

    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)] + [(None, "x y"), (40, None)], "doc_id long, text string")
    want = sorted(map(str, count_tokens(docs, PATH).collect()))
    cache = f"file://{tmp_path}/cache"
    assert sorted(map(str, count_tokens(docs, PATH, cache).collect())) == want

    # With all counts stored the tokenizer is not asked.
    def refuse(path):
        def run(batches):
            for batch in batches:
                raise AssertionError
            return iter(())

        return run

    monkeypatch.setattr(token_count, "_counts", refuse)
    assert sorted(map(str, count_tokens(docs, PATH, cache).collect())) == want
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|file"):
        count_tokens(docs, PATH, f"file://{broken}").collect()
