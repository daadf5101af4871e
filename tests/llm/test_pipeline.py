import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from quillon.llm.common import save, table
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_duplicates import brute as duplicates
from tests.llm.test_pii import brute as personal

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = save(stage(spark, docs, SF), "test-stage")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r for r in docs.collect()}
            assert docs.count() == len(kept[name])
        after = kept.get(name)
        if name == "toxicity":
            from quillon.llm.queries import op3_toxicity

            scores = {r.doc_id: r.score for r in op3_toxicity(spark, SF).collect()}
            assert after == {i: r for i, r in before.items() if scores[i] < 0.7} and len(after) < len(before)
            labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
            clean = [i for i in before if labels.get(i) == 0]
            assert sum(i in after for i in clean) >= 0.98 * len(clean)
            toxic = [i for i in before if labels.get(i) == 1]
            assert sum(i in after for i in toxic) <= 0.5 * len(toxic)
        elif name == "near_duplicate":
            judged = duplicates([(i, r.text) for i, r in before.items()], 5, 80)
            assert after == {i: r for i, r in before.items() if judged[i][2]}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            found = {i for i, hit, _, _ in contaminated([(i, r.text) for i, r in before.items()], items) if hit}
            assert found and after == {i: r for i, r in before.items() if i not in found}
        elif name == "personal_data":
            assert after.keys() == before.keys()
            for i, r in after.items():
                assert r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source)
                assert sum(personal(r.text)[0]) == 0
                if not personal(before[i].text)[0] != (0, 0, 0, 0):
                    assert abs(len(r.text) - len(before[i].text)) < 200
        else:
            pieces = docs.collect()
            model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = {i: len(model.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in before.items()}
            got = {}
            for p in pieces:
                got[p.doc_id] = got.get(p.doc_id, 0) + p.length
            assert got == want


def test_odd_rows_pass(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x y z", None, None, None), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, None} and sum(r.doc_id == 2 for r in out) == 1
    assert zlib.crc32((2).to_bytes(4, "little")) in {r.ids_crc32 for r in out}
