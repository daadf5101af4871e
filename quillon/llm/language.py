"""Language of whole texts and of spans of mixed-language text.

Each word's script narrows the languages it may be in; a naive Bayes score of
its byte trigrams, and a Viterbi path with a penalty for each switch, label
the words.  A text's language is the one that labels most of its letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import letter_bytes, letter_words, save, slices

#: Rows the model is fitted on at most, those with the least hash of doc_id.
EXAMPLES = 8192
#: Hash buckets of byte trigrams.
BUCKETS = 1 << 16
#: Log odds that a change of language between neighbouring words costs.
SWITCH = 12.0
#: Bytes of text that one vectorised step looks at.
STEP_BYTES = 8 << 20

# Scripts by ranges of Unicode: the first code point of each, to the next one's.
# Latin has its additions (1E00, 2C60, A720, AB30), Greek and Cyrillic theirs.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "latin"), (0x2E80, "han"), (0x3000, "latin"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "latin"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "latin"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
]
_NAMES = ["latin", *sorted({name for _, name in _RANGES} - {"latin"})]
SCRIPTS = len(_NAMES)
_STARTS = np.array([first for first, _ in _RANGES])
_OF_RANGE = np.array([_NAMES.index(name) for _, name in _RANGES], dtype=np.int8)


def scripts(raw: np.ndarray) -> np.ndarray:
    """The script of the character that begins at each byte; 0 at bytes within one."""
    n = len(raw)
    out = np.zeros(n, dtype=np.int8)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        first = raw[lead].astype(np.int32)
        tail = [raw[np.minimum(lead + k, n - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        two, three = (first & 0x1F) << 6 | tail[0], (first & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        point = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
        out[lead] = _OF_RANGE[np.searchsorted(_STARTS, point, side="right") - 1]
    return out


def word_features(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words, where each word's begin, and each word's script.

    A word of n bytes has n trigrams, with one blank before and after it.
    """
    lengths = stops - starts
    begin = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], lengths)
    here = raw[at].astype(np.uint32)
    first = np.zeros(len(at), dtype=bool)
    first[begin[:-1]] = True
    last = np.zeros(len(at), dtype=bool)
    last[begin[1:] - 1] = True
    before = np.where(first, np.uint32(32), np.concatenate((here[:1], here[:-1])))
    after = np.where(last, np.uint32(32), np.concatenate((here[1:], here[-1:])))
    gram = (before << np.uint32(16) | here << np.uint32(8) | after) * np.uint32(2654435761)
    script = np.maximum.reduceat(scripts(raw)[at], begin[:-1]) if len(lengths) else np.zeros(0, np.int8)
    return (gram >> np.uint32(16)).astype(np.int32), begin, script


def _statistics(batches):
    """Counts of (kind, bucket) by language: kind 0 trigrams, kind 1 scripts of words."""
    for batch in batches:
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            by_lang.setdefault(lang, []).append(i)
        for lang, rows in by_lang.items():
            raw, offsets = letter_bytes(batch.column("text").take(pa.array(rows)).to_pylist())
            _, _, starts, stops = letter_words(raw, offsets)
            grams, _, script = word_features(raw, starts, stops)
            for kind, values, size in ((0, grams, BUCKETS), (1, script, SCRIPTS)):
                counts = np.bincount(values, minlength=size)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))],
                    ["lang", "kind", "bucket", "n"],
                )


class LanguageModel:
    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        """``grams``: counts by bucket and language; ``scripts``: by script and language."""
        self.langs = langs
        self.table = np.log(grams + 0.1) - np.log(grams.sum(axis=0) + 0.1 * BUCKETS)
        self.table = self.table.astype(np.float32)
        # A script is a language's if one in a hundred of its words is written in it.
        allowed = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
        self.barred = np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0.0, -1e6).astype(np.float32)

    def word_scores(self, raw, starts, stops) -> np.ndarray:
        grams, begin, script = word_features(raw, starts, stops)
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32)
        return np.add.reduceat(self.table[grams], begin[:-1], axis=0) + self.barred[script]

    def viterbi(self, scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """The best language of each word; ``counts`` are the texts' first words.

        All texts advance together, the longest first, so a step is one vector
        operation over the texts that still have words.
        """
        lengths = np.diff(counts)
        order = np.argsort(-lengths, kind="stable")
        begin, longest = counts[:-1][order], int(lengths.max(initial=0))
        active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
        came = np.empty(scores.shape, dtype=np.int16)
        path = np.empty(len(scores), dtype=np.int16)
        n_langs = scores.shape[1]
        own = np.arange(n_langs, dtype=np.int16)
        best = np.zeros((len(order), n_langs), dtype=np.float64)
        for t in range(longest):
            n = active[t]
            at = begin[:n] + t
            now = best[:n]
            if t:
                top = now.argmax(axis=1)
                floor = now[np.arange(n), top][:, None] - switch
                stays = now >= floor
                came[at] = np.where(stays, own, top[:, None].astype(np.int16))
                now = np.where(stays, now, floor)
            now = now + scores[at]
            best[:n] = now - now.max(axis=1, keepdims=True)
        state = best.argmax(axis=1).astype(np.int16)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            path[at] = state[:n]
            if t:
                state[:n] = came[at, state[:n]]
        return path


def _chosen(rows: DataFrame, examples: int) -> DataFrame:
    """``examples`` rows of ``rows(doc_id, lang)`` at most, those of each language by hash, in turn.

    A language's rows are first cut to a share that holds its ``examples`` least hashes (some
    twice as many on average; short of them in less than one case of 1e100), so that no
    task ranks a whole language.
    """
    rows = rows.withColumn("hash", F.xxhash64("doc_id"))
    share = rows.groupBy("lang").agg((F.lit(2.0 * examples + 1000) / F.count("*")).alias("share"))
    least = F.col("hash").cast("double") < (2 * F.least("share", F.lit(1.0)) - 1) * 2.0**63
    near = rows.join(F.broadcast(share), "lang").filter(least | (F.col("share") >= 1))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    ranked = near.withColumn("turn", turn).filter(F.col("turn") <= examples)
    return ranked.orderBy("turn", "lang").limit(examples).select("doc_id", "lang")


def fit(docs: DataFrame, examples: int = EXAMPLES) -> LanguageModel:
    """Fit on ``examples`` rows of ``docs(doc_id, text, lang)`` at most: of each language in
    turn the one with the next least hash of doc_id, so that rare languages are learned too."""
    known = docs.filter("doc_id is not null and lang is not null and text is not null")
    chosen = _chosen(known.select("doc_id", "lang").distinct(), examples)
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "lang")
    counts = save(
        rows.mapInArrow(_statistics, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")),
        "language-counts",
    ).collect()
    langs = sorted({r.lang for r in counts})
    at = {x: i for i, x in enumerate(langs)}
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((SCRIPTS, len(langs)))
    for r in counts:
        (scripts if r.kind else grams)[r.bucket, at[r.lang]] += r.n
    return LanguageModel(langs, grams, scripts)


_LABELLED = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, words: int>>"


def _label(shared):
    def run(batches):
        model = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, STEP_BYTES):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                raw, offsets = letter_bytes(texts)
                _, counts, starts, stops = letter_words(raw, offsets)
                langs, scores, spans = [], [], []
                if model.langs:
                    path = model.viterbi(model.word_scores(raw, starts, stops), counts)
                    for text, i, j in zip(texts, counts[:-1].tolist(), counts[1:].tolist()):
                        if j == i or not any(map(str.isalpha, text)):
                            langs.append("und"), scores.append(0.0), spans.append([])
                            continue
                        own = path[i:j]
                        share = np.bincount(own, weights=stops[i:j] - starts[i:j], minlength=len(model.langs))
                        top = int(share.argmax())
                        heads = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
                        langs.append(model.langs[top])
                        scores.append(float(share[top] / share.sum()))
                        spans.append([{"lang": model.langs[own[x]], "words": int(y - x)} for x, y in zip(heads[:-1], heads[1:])])
                else:
                    langs, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    return run


def identify_language(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """Label every text of ``docs(doc_id, text)``; learn from ``examples(doc_id, text, lang)``.

    Returns ``doc_id, lang_pred, score, spans``: the language of most letters,
    their share, and the labelled spans in words.  ``und`` with score 0 where
    the text is null, has no letter, or nothing was learned.  Ties go to the
    language first by name.  Repeated rows are labelled alike.  An empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(examples))
    return save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_label(shared), _LABELLED), "languages"
    )
