"""Token counts through a digest cache.

Content digests are joined to stored counts; only one row per digest that the
cache lacks is encoded, and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import attach, save, slices

#: Word chunks whose counts a Python worker remembers before it starts afresh.
MEMO = 400_000

_COUNTERS: dict = {}


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file and of its library's version: others never reuse counts."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.encode()).hexdigest()[:32]


class _Library:
    """Counts as the library gives them for a whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.chunked = False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
            kind = str(model.pre_tokenizer)
            self.chunked = (
                model.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
            )

    def count(self, texts: list[str]) -> list[int]:
        """Byte-level BPE never merges across ' x' or '\\nx' where x is no white
        space, so such chunks are counted once and remembered; any text with
        other white space is encoded whole."""
        out = [0] * len(texts)
        whole, cut, new = [], [], set()
        memo = self.memo
        for i, text in enumerate(texts):
            pieces = text.replace("\n", " \n").split(" ") if self.chunked else ()
            # Equal lengths: single blanks and newlines between words, nothing else.
            if pieces and len(text.split()) == len(pieces) and not text[0].isspace():
                pieces = [" " + pieces[0], *pieces[1:]]
                cut.append((i, pieces))
                new.update(pieces)
            elif text:
                whole.append(i)
        new = [x for x in new if x not in memo]
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            # A piece stands for its word with a blank before it, a first word for itself.
            memo.update(zip(part, self.encode([x[1:] if x[0] == " " else x if x[0] == "\n" else " " + x for x in part])))
        for i, pieces in cut:
            out[i] = sum(map(memo.__getitem__, pieces))
        for i in whole:
            out[i] = self.encode([texts[i]])[0]
        if len(memo) > MEMO:
            memo.clear()
        return out


def _counts(path: str):
    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = _Library(path)
        library = _COUNTERS[path]
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), part.column("n_bytes"), pa.array(library.count(texts), pa.int64())],
                    ["digest", "n_bytes", "n_tokens"],
                )

    return run


def count_tokens(docs: DataFrame, path: str, cache_path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row of ``docs(doc_id, text)``.

    ``path`` names a vocabulary file readable on every node (``.json`` for
    tokenizers, ``.model`` for sentencepiece).  ``cache_path`` names a Parquet
    table of ``version, digest, n_bytes, n_tokens`` in a shared store;
    it is made if missing, read, and appended to.  Without
    it nothing is kept between calls, but equal texts are still encoded once.

    Null text counts as empty (0 tokens).  Repeated rows and doc_ids keep a
    row each.  An empty table gives no rows; other columns, whatever their
    names, are ignored.  The text is not normalised further: for these
    tokenizers bytes that differ may count differently.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = save(
        docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")),
        "token-digests",
    )
    contents = save(digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "token-contents")
    stored = _stored(spark, cache_path, version)
    wanted = contents.drop("n")
    if stored is not None:
        stored = save(contents.select("digest").join(stored, "digest"), "token-stored")
        wanted = wanted.join(stored.select("digest"), "digest", "left_anti")
    wanted = save(wanted, "token-misses")
    missing = wanted.count()
    # One text a missing digest is encoded; a null doc_id still counts (null-safe).
    keyed = docs.select(F.col("doc_id").alias("rep"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    keys = wanted.withColumnsRenamed({"digest": "d2", "rep": "r2"})
    same = (F.col("digest") == F.col("d2")) & F.col("rep").eqNullSafe(F.col("r2"))
    misses = keyed.join(keys, same, "left_semi")
    misses = misses.select("digest", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    # Where all is stored, no text is read again.
    fresh = (misses if missing else misses.limit(0)).mapInArrow(_counts(path), "digest string, n_bytes long, n_tokens long").groupBy("digest").agg(
        F.first("n_bytes").alias("n_bytes"), F.first("n_tokens").alias("n_tokens")
    )
    fresh = save(fresh, "token-counts")
    if cache_path is not None and not fresh.isEmpty():
        fresh.select(F.lit(version).alias("version"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(cache_path)
    counts = fresh.select("digest", "n_tokens")
    if stored is not None:
        counts = counts.unionByName(stored.select("digest", "n_tokens"))
    counted = save(counts.join(contents.select("digest", "n"), "digest"), "token-counted")
    return attach(digests, counted, ["digest"], digests.count()).select("doc_id", "n_bytes", "n_tokens")


def _stored(spark: SparkSession, cache_path: str | None, version: str) -> DataFrame | None:
    """What the cache holds of this version, or None where there is no cache yet."""
    if cache_path is None:
        return None
    try:
        found = spark.read.parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise  # a cache that cannot be read is not an empty one
        return None
    # Two runs may have appended the same digest at once.
    return found.filter(F.col("version") == version).dropDuplicates(["digest"]).select("digest", "n_tokens")
