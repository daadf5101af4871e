"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import held_out, scratch_root, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), threshold=50)


#: Score from which op3 predicts toxic.
TOXIC = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.toxicity import score_toxicity

    learned = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(table(spark, sf_dir, "documents"), learned)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), window=4096, end_id=2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.language import identify_language

    docs = table(spark, sf_dir, "documents")
    labelled = identify_language(docs, docs.filter(~held_out(F.col("doc_id"))))
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.pii import KINDS, find_pii, in_order, joined

    found = find_pii(table(spark, sf_dir, "documents"))
    base = joined(in_order(F.concat(*KINDS)))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


#: The block and allow lists that op7 is asked to apply.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.url_filter import url_filter

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), "overlap")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.token_count import count_tokens

    cache = f"{scratch_root(spark)}/token-count-cache"
    counts = count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", counts.n_tokens > 512)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict:
    return {
        "op1_minhash": op1_minhash,
        "op2_suffix_array": op2_suffix_array,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_language_id": op5_language_id,
        "op6_pii": op6_pii,
        "op7_url_filters": op7_url_filters,
        "op8_decontamination": op8_decontamination,
        "op9_token_counts": op9_token_counts,
        "op10_top_k": op10_top_k,
        "op11_warc": op11_warc,
        "op12_filter_audit": op12_filter_audit,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op2_suffix_array": OP2_SQL, "op7_url_filters": OP7_SQL, "op8_decontamination": OP8_SQL, "op10_top_k": OP10_SQL, "op11_warc": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_lexical_search": OP13_SQL}


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM reach JOIN both_ways ON reach.doc_id = a
)
SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id, min(c) = r.doc_id AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP2_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), m AS (
  SELECT doc_id, i, CASE WHEN min(doc_id) OVER (PARTITION BY s) < doc_id THEN 1 ELSE 0 END AS seen FROM w
), b AS (
  SELECT doc_id, p, substring(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, n)) AS p FROM d)
), g AS (
  SELECT b.doc_id, p, x,
         coalesce(max(seen) OVER (PARTITION BY b.doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM b LEFT JOIN m ON b.doc_id = m.doc_id AND b.p = m.i
), l AS (
  SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) AS before FROM g
), r AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans,
         string_agg(x, '' ORDER BY p) FILTER (gone = 0) AS kept FROM l GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP7_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), url AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM cut
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
  SELECT page_id, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS n
  FROM url JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT url.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM url LEFT JOIN (SELECT * FROM fitting WHERE n = 1) f ON url.page_id = f.page_id
"""


OP8_SQL = r"""
WITH i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
), m AS (
  SELECT greatest(64, max(len(w))) AS stride FROM i
), si AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i
), ni AS (
  SELECT item_id, count(*) AS n FROM si GROUP BY item_id
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents
), a AS (
  SELECT doc_id, w, k, greatest(1, CAST(ceil((len(w) - stride) / stride) AS BIGINT)) AS passages, stride
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS k FROM d), m
), sd AS (
  SELECT doc_id, k // stride AS p, array_to_string(w[k + 1:k + 5], ' ') AS s FROM a WHERE k // stride < passages
  UNION ALL
  SELECT doc_id, k // stride - 1, array_to_string(w[k + 1:k + 5], ' ') FROM a WHERE k >= stride AND k % stride + 5 <= stride
), c AS (
  SELECT doc_id, p, item_id, count(DISTINCT s) AS k FROM sd JOIN si USING (s) GROUP BY ALL
), f AS (
  SELECT doc_id, item_id, max(k / n) AS share FROM c JOIN ni USING (item_id) WHERE k / n >= 0.8 - 1e-9 GROUP BY ALL
)
SELECT documents.doc_id, count(item_id) > 0 AS contaminated, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS item_ids,
       coalesce(max(share), 0.0) AS overlap
FROM documents LEFT JOIN f USING (doc_id) GROUP BY documents.doc_id
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), m AS (
  SELECT part, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN d.doc_id > first THEN 'E' ELSE '' END) AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n
  FROM d LEFT JOIN labels ON labels.doc_id = d.doc_id GROUP BY ALL
), f(x) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS x, substring(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, x, fails = x AS alone, contains(fails, x) AS fail, length(translate(fails, before, '')) = length(fails) AS there, good, toxic, n FROM s, m
), g AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, x,
         coalesce(sum(n) FILTER (there AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (there AND fail), 0) AS removed, coalesce(sum(n) FILTER (fail AND NOT there), 0) AS redundant,
         coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(n) FILTER (there AND fail AND good), 0) AS good_lost, coalesce(sum(n) FILTER (there AND fail AND toxic), 0) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM g
"""


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM documents
), t AS (
  SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), n AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id
), g AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM benchmark
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, g WHERE term IN (SELECT term FROM q) GROUP BY term, nn
), m AS (
  SELECT doc_id, 50 + (50 * n * nn) // ll AS m FROM n, g
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 50
"""


OP11_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
