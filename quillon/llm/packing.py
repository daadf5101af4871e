"""Sequence packing by minimum bin slack.

Every document's ids are cut into full windows and one remainder.  Only the
histogram of piece lengths (at most ``window`` entries, whatever the corpus)
reaches the driver, where a bitset subset-sum picks the multiset of lengths
that fills a window closest to capacity; backtracking gives the count of each
length, and the pattern is repeated while the counts last.  Pieces find their
place by their rank among pieces of equal length.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillon.llm.common import save, slices, text_bytes

#: Words of one generation of a Python worker's memory; it holds two, and words
#: that are met again move to the new one, so frequent words stay.
MEMO = 220_000

#: A-Z lower-cased, and newlines as blanks.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[10] = 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
#: ASCII marks that may follow a letter; the apostrophe starts contractions and stays.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(x) for x in "!#$%&*,.:;?|"]] = True

_ENCODERS: dict = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _WordIds:
    """Ids of a tokenizer that drops white space, word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # Words may be fed one by one if pre-tokens are runs without white space
        # and an added token, itself never normalised, can stand between them.
        added = [
            (i, t.content)
            for i, t in self.model.get_added_tokens_decoder().items()
            if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)
        ]
        kind = str(self.model.pre_tokenizer)
        self.by_word = bool(added) and "invert=True" in kind and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in kind
        self.by_word &= "Lowercase" in str(self.model.normalizer)
        if self.by_word:
            self.between_id, self.between = added[0]
            self.special = [t.content.lower().encode() for t in self.model.get_added_tokens_decoder().values()]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 500):
            part = words[a : a + 500]
            ids = self._encode(b"\n".join(part).decode().replace("\n", self.between))
            cuts = np.concatenate(([-1], np.flatnonzero(ids == self.between_id), [len(ids)])).tolist()
            raw = ids.tobytes()
            self.memo.update((w, raw[4 * i + 4 : 4 * j]) for w, i, j in zip(part, cuts, cuts[1:]))

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        if not self.by_word:
            return [self._encode(raw[a:b].tobytes().decode()).tobytes() for a, b in zip(offsets, offsets[1:])]
        # ASCII only: the library's own lower-casing and white space do the rest.
        low = _LOWER[raw]
        # Strings of added tokens, in any case, are left to the library with their text.
        whole, joined = set(), low.tobytes()
        for special in self.special:
            at = joined.find(special)
            while at >= 0:
                whole.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = joined.find(special, at + 1)
        # A word's letters and what follows them are separate pre-tokens.
        split = _LETTER[low[:-1]] & _MARK[low[1:]]
        split[offsets[1:-1][offsets[1:-1] < len(raw)] - 1] = False
        at = np.flatnonzero(split) + 1
        text = np.insert(low, at, 32).tobytes()
        bounds = (offsets + np.searchsorted(at, offsets, side="left")).tolist()
        words, counts = [], [0]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            words += () if i in whole else text[a:b].split(b" ")
            counts.append(len(words))
        memo = self.memo
        out = list(map(memo.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            unknown = {words[i] for i in missing}
            known = unknown & self.old.keys()
            memo.update((w, self.old[w]) for w in known)
            self._learn(list(unknown - known))
            for i in missing:
                out[i] = memo[words[i]]
        if len(memo) > MEMO:
            self.memo, self.old = {}, memo
        ids = [b"".join(out[i:j]) for i, j in zip(counts, counts[1:])]
        for i in whole:
            ids[i] = self._encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode()).tobytes()
        return ids


def _pieces(path: str, window: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * window

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = _WordIds(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in slices(np.diff(offsets)):
                part = offsets[a : b + 1]
                rows = [[], [], [], [], []]
                for doc_id, ids in zip(
                    batch.column("doc_id").slice(a, b - a).to_pylist(), encoder.ids(raw[part[0] : part[-1]], part - part[0])
                ):
                    ids += end
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        for column, x in zip(rows, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return run


def minimum_bin_slack(histogram: dict[int, int], window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """``[([(length, times in one window), ...], windows), ...]`` using up ``histogram``.

    Each pattern starts from the longest length left and adds the multiset
    whose sum is closest to what is free: bit s of ``reach[i]`` says that the
    first i groups can sum to s.  Groups are a length taken 1, 2, 4, ... times,
    so counts are bounded with few groups, and the search stops at an exact fit.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    patterns = []
    while left:
        seed = max(left)
        free = window - seed
        groups: list[tuple[int, int]] = []
        reach = [1]
        mask = (1 << (free + 1)) - 1
        for length in sorted(left, reverse=True):
            if length > free:
                continue
            usable = min(left[length] - (length == seed), free // length)
            k = 1
            while usable > 0:
                k = min(k, usable)
                groups.append((length, k))
                reach.append((reach[-1] | reach[-1] << (length * k)) & mask)
                usable -= k
                k *= 2
            if reach[-1] >> free & 1:
                break
        total = reach[-1].bit_length() - 1
        times = {seed: 1}
        for i in range(len(groups), 0, -1):
            if not reach[i - 1] >> total & 1:
                length, k = groups[i - 1]
                times[length] = times.get(length, 0) + k
                total -= length * k
        windows = min(left[length] // k for length, k in times.items())
        for length, k in times.items():
            left[length] -= k * windows
            if not left[length]:
                del left[length]
        patterns.append((sorted(times.items(), reverse=True), windows))
    return patterns


def _plan(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, per window, offset, first sequence) rows."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, windows in patterns:
        offset = 0
        for length, k in times:
            first = taken.get(length, 0)
            rows.append((length, first, first + k * windows, k, offset, sequence))
            taken[length] = first + k * windows
            offset += k * length
        sequence += windows
    return rows


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``window`` tokens.

    ``path`` names a tokenizers file readable on every node.  Returns a row per
    piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``.  A document is its ids and ``end_id``; null text counts as empty
    (the end id alone); repeated rows are packed one by one.  Offsets within a
    sequence are gapless from 0.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, window, end_id), PIECES),
        "pack-pieces",
    )
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        _plan(minimum_bin_slack(histogram, window)),
        "p_length long, first long, past long, per long, at long, sequence long",
    )
    # Rank among equal lengths: within a bucket, plus what lower buckets hold,
    # so that a length shared by very many documents is ranked by many tasks.
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    by_length = W.Window.partitionBy("length").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    below = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("below"))
    )
    ranked = dealt.withColumn(
        "place", F.row_number().over(W.Window.partitionBy("length", "bucket").orderBy("doc_id", "start")) - 1
    ).join(below, ["length", "bucket"]).withColumn("place", F.col("place") + F.col("below"))
    # The plan has at most window patterns of at most sqrt(2 * window) lengths.
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("past")),
    )
    nth = F.col("place") - F.col("first")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )
