"""Benchmark decontamination: BM25 of every passage against the test items.

The items are the index, the passages of the training texts the queries.  A
passage retrieves an item when its BM25 score reaches ``threshold`` of the
item's score against itself.  As in WAND, an item can only be reached through
its essential terms (without them the rest stays below the threshold), and a
block of items is only scored where the sum of the block's greatest weights
reaches it; so every item above the threshold is found.  What is retrieved is
verified by the overlap of word shingles with the item's text, or with both its
question and its answer where the benchmark has these as columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import letter_bytes, mix64, plain_words, save, slices

#: Share of an item's self-score that retrieves it, and of its shingles that confirms it.
THRESHOLD = 0.6
OVERLAP = 0.8
#: Words of a shingle; shorter items are only found where they are whole lines.
SHINGLE = 5
K1, B = 1.2, 0.75
#: Items of one block, and of one index; more items are more passes over the texts.
BLOCK = 16
ITEMS = 20_000
#: Items up to so many words share an index, so a long one does not widen the passages of short ones.
LENGTHS = (64, 512, 4096)


def _words(text: str) -> np.ndarray:
    return plain_words(*letter_bytes([text]))[0]


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles in order."""
    n = len(words) - k + 1
    if k < 1 or n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix64(out)


class Texts:
    """The words of several texts, and where lines begin and end among them."""

    def __init__(self, texts: list[str | None]):
        self.raw, offsets = letter_bytes(texts)
        self.words, self.counts, self.starts, self.stops = plain_words(self.raw, offsets)
        line = np.searchsorted(np.flatnonzero((self.raw == 10) | (self.raw == 13)), self.starts)
        text = np.repeat(np.arange(len(texts)), np.diff(self.counts))
        new = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        edge = np.ones(min(1, len(line)), dtype=bool)
        self.begins, self.ends = np.concatenate((edge, new)), np.concatenate((new, edge))
        self.offsets = offsets

    def passage(self, text: int, start: int, width: int) -> slice:
        """The words of a passage, as places in ``words``."""
        first = int(self.counts[text]) + start
        return slice(first, int(min(first + width, self.counts[text + 1])))

    def between(self, text: int, part: slice) -> bytes:
        """The bytes of a passage, with what stands before its first and after its last word."""
        low = self.stops[part.start - 1] if part.start > self.counts[text] else self.offsets[text]
        high = self.starts[part.stop] if part.stop < self.counts[text + 1] else self.offsets[text + 1]
        return self.raw[low:high].tobytes()


class ItemIndex:
    """Normalised BM25 weights of items by block: an item's sum to 1."""

    def __init__(self, items: list[tuple[int, str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        parsed = []
        for item_id, question, answer in items:
            q, a = _words(question), _words(answer)
            if len(q) + len(a):
                # An answer of marks alone is looked up as it stands.
                mark = b"" if len(a) else answer.strip().lower().encode("utf-8", "replace")
                parsed.append((item_id, q, a, mark))
        # Items with a common start share a block, so copies do not loosen bounds.
        parsed.sort(key=lambda x: (np.concatenate(x[1:3])[:1].tolist(), x[0]))
        self.item_id = [x[0] for x in parsed]
        self.parts = [x[1:] for x in parsed]
        n, lengths = len(parsed), np.array([len(q) + len(a) for _, q, a, _ in parsed], dtype=np.float64)
        self.longest = int(lengths.max(initial=0))
        counts = [np.unique(np.concatenate((q, a)), return_counts=True) for _, q, a, _ in parsed]
        every = np.concatenate([w for w, _ in counts]) if n else np.zeros(0, np.uint64)
        self.terms, df = np.unique(every, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.blocks = (n + BLOCK - 1) // BLOCK
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        essential: list[tuple[int, int]] = []
        for i, (w, tf) in enumerate(counts):
            at = np.searchsorted(self.terms, w)
            own = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / lengths.mean()))
            own = own / own.sum()
            self.postings.append((at, own))
            # The rarest terms, until what is left cannot reach the threshold.
            order = np.lexsort((self.terms[at], df[at]))
            left = 1 - np.cumsum(own[order])
            for j in order[: int(np.argmax(left < threshold - 1e-6)) + 1]:
                essential.append((int(at[j]), i // BLOCK))
        pairs = np.unique(np.array(essential, dtype=np.int64).reshape(-1, 2), axis=0)
        self.essential_begin = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))
        self.essential_block = pairs[:, 1]
        # Blocks are small: their terms are few, so they are kept sparse by block.
        self.block_terms, self.block_weights = [], []
        for b in range(self.blocks):
            own = self.postings[b * BLOCK : (b + 1) * BLOCK]
            terms = np.unique(np.concatenate([at for at, _ in own]))
            weights = np.zeros((len(terms) + 1, BLOCK))
            for j, (at, w) in enumerate(own):
                weights[np.searchsorted(terms, at), j] = w
            self.block_terms.append(terms)
            self.block_weights.append(weights)
        self.filter = np.zeros(1 << 18, dtype=bool)
        self.filter[(self.terms & np.uint64(0x3FFFF)).astype(np.int64)] = True
        self.width = max(128, 2 * self.longest)
        self.stride = self.width // 2

    def retrieve(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word of the passage within the text, item) above the threshold.

        Passages are ``width`` words, one every ``stride``; no item is longer
        than their overlap, so one passage holds any whole item.
        """
        if not len(self.terms) or not len(words):
            return []
        known = np.flatnonzero(self.filter[(words & np.uint64(0x3FFFF)).astype(np.int64)])
        term = np.searchsorted(self.terms, words[known])
        term[term == len(self.terms)] = 0
        hit = self.terms[term] == words[known]
        known, term = known[hit], term[hit]
        lengths = np.diff(counts)
        n_passages = np.maximum(1, -(-(lengths - self.stride) // self.stride))
        base = np.concatenate(([0], np.cumsum(n_passages)))
        text = np.searchsorted(counts, known, side="right") - 1
        slot = (known - counts[text]) // self.stride
        # A word lies in the passage that starts in its stride and in the one before.
        later = slot < n_passages[text]
        earlier = slot > 0
        passage = np.concatenate(((base[text] + slot)[later], (base[text] + slot - 1)[earlier]))
        size = len(self.terms)
        pair = np.unique(passage * size + np.concatenate((term[later], term[earlier])))
        passage, term = pair // size, pair % size
        begin = np.searchsorted(passage, np.arange(base[-1] + 1))
        # Blocks reached through an essential term, by block and passage.
        n = self.essential_begin[term + 1] - self.essential_begin[term]
        at = np.repeat(self.essential_begin[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        reached = np.unique(self.essential_block[at] * base[-1] + np.repeat(passage, n))
        cuts = np.searchsorted(reached, np.arange(self.blocks + 1) * base[-1])
        out = []
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = reached[cuts[b] : cuts[b + 1]] % base[-1]
            terms, weights = self.block_terms[b], self.block_weights[b]
            most = weights.max(axis=1)
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                n = begin[part + 1] - begin[part]
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                row = np.repeat(begin[part] - first, n) + np.arange(n.sum())
                place = np.searchsorted(terms, term[row])
                place[(place == len(terms)) | (terms[np.minimum(place, len(terms) - 1)] != term[row])] = len(terms)
                bound = np.add.reduceat(most[place], first)
                for i in np.flatnonzero(bound >= self.threshold - 1e-9).tolist():
                    score = weights[place[first[i] : first[i] + n[i]]].sum(axis=0)
                    for j in np.flatnonzero(score >= self.threshold - 1e-9).tolist():
                        t = int(np.searchsorted(base, part[i], side="right")) - 1
                        out.append((t, int(part[i] - base[t]) * self.stride, b * BLOCK + j))
        return out

    def verify(self, texts: Texts, text: int, start: int, item: int) -> float:
        """The lesser share of the shingles of question and answer in the passage.

        An item of fewer than SHINGLE words counts where its words are whole
        lines, an answer without words where its marks are in the passage.
        """
        part = texts.passage(text, start, self.width)
        passage = texts.words[part]
        question, answer, mark = self.parts[item]
        whole = np.concatenate((question, answer))
        n = len(whole)
        if n < SHINGLE:
            hits = np.flatnonzero(_shingles(passage, n) == _shingles(whole, n)) + part.start
            share = float((texts.begins[hits] & texts.ends[hits + n - 1]).any())
        else:
            shares = []
            for words in (question, answer):
                if len(words):
                    k = min(SHINGLE, len(words))
                    wanted = np.unique(_shingles(words, k))
                    shares.append(float(np.isin(wanted, _shingles(passage, k)).mean()))
            share = min(shares)
        return share if not mark or mark in texts.between(text, part) else 0.0


_FOUND = "doc_id long, contaminated boolean, item_ids array<long>, overlap double"


def _matches(indexes: list[ItemIndex], texts) -> list[dict[int, float]]:
    """Confirmed items of each text, with the share of their shingles."""
    out: list[dict[int, float]] = []
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes):
        part = Texts(texts.slice(a, b - a).to_pylist())
        found: list[dict[int, float]] = [{} for _ in range(b - a)]
        for index in indexes:
            for text, start, item in index.retrieve(part.words, part.counts):
                share = index.verify(part, text, start, item)
                if share >= OVERLAP - 1e-9:
                    item_id = index.item_id[item]
                    found[text][item_id] = max(share, found[text].get(item_id, 0.0))
        out += found
    return out


def _find(shared):
    def run(batches):
        for batch in batches:
            found = _matches(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([bool(x) for x in found], pa.bool_()),
                    pa.array([sorted(x) for x in found], pa.list_(pa.int64())),
                    pa.array([max(x.values(), default=0.0) for x in found], pa.float64()),
                ],
                ["doc_id", "contaminated", "item_ids", "overlap"],
            )

    return run


def _clean(shared):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not x for x in _matches(shared.value, batch.column("text"))], pa.bool_()))

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, q, a``; an item that is one text is a question without answer."""
    own = set(benchmark.columns)
    question, answer = ("question", "answer") if {"question", "answer"} <= own else ("text", None)
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(question, F.lit("")).alias("q"),
        F.coalesce(answer, F.lit("")).alias("a") if answer else F.lit("").alias("a"),
    )
    return items.filter("item_id is not null").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every text of ``docs(doc_id, text)`` against ``benchmark``.

    ``benchmark`` has ``item_id`` and ``text``, or ``question`` and ``answer``.
    Returns per row ``doc_id, contaminated, item_ids, overlap``: the items
    of which OVERLAP of the shingles lie in one passage of the text (of both the
    question and the answer, where these are columns), and the greatest such
    share.  Only passages are looked at whose BM25 reaches ``threshold`` of what the
    item scores against itself: where nearly all of an item's weight lies in a few rare
    words and just these are changed, it is not found, though 0.8 of its shingles are
    left.  Words are runs of letters and digits in lower case.  An answer that
    is not empty is always demanded: one of fewer than SHINGLE words as a whole,
    one without words by its marks.  An item of fewer than SHINGLE words in all
    is only found where these are all the words of a line, or of lines that
    follow each other; one without words is never found.

    Null or wordless texts match nothing.  Repeated rows keep a row each, the
    items of a repeated item_id are one, and what no item_id names is left out.
    An empty ``docs`` gives no rows, an empty benchmark finds nothing; other
    columns, whatever their names, are ignored.

    The indexes of ``ITEMS`` items at most are broadcast; a larger benchmark is
    read in parts, each a pass over the texts, and the parts are merged.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for shared in _indexes(benchmark, threshold):
        parts.append(save(rows.mapInArrow(_find(shared), _FOUND), "contamination"))
        shared.unpersist()
    if len(parts) == 1:
        return parts[0]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    # Rows with one doc_id are merged; each keeps its row through its multiplicity.
    return merged.groupBy("doc_id").agg(
        (F.count("*") / len(parts)).cast("int").alias("n"),
        F.bool_or("contaminated").alias("contaminated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.max("overlap").alias("overlap"),
    ).select("doc_id", "contaminated", "item_ids", "overlap", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find_contamination`` finds no item.

    The rows pass without a shuffle, once for each part of the benchmark.  Null
    and empty texts and repeated rows stay; an empty table stays empty; columns
    of any name stay as they are.
    """
    for n, shared in enumerate(_indexes(benchmark, threshold)):
        if n:
            docs = save(docs, "clean")
        docs = docs.mapInArrow(_clean(shared), docs.schema)
    return docs


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator:
    """Broadcast indexes, one after the other: each a list by length of items, with
    ``ITEMS`` items at most (in the mean; parts are by hash)."""
    spark = benchmark.sparkSession
    items = save(_items(benchmark), "benchmark-items")
    passes = max(1, -(-items.count() // ITEMS))
    for p in range(passes):
        own = items.filter(F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(passes)) == p).collect()
        by_length: dict[int, list] = {}
        for r in own:
            n = len(r.q.split()) + len(r.a.split())
            by_length.setdefault(next((i for i, most in enumerate(LENGTHS) if n <= most), len(LENGTHS)), []).append((r.item_id, r.q, r.a))
        yield spark.sparkContext.broadcast([ItemIndex(x, threshold) for _, x in sorted(by_length.items())])
