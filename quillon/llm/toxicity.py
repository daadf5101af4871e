"""Toxicity by the nearest labelled examples under TF-IDF cosine.

The index is fitted on a bounded sample of labelled rows: terms are the words
that tell the labels apart (chi-square), those of either label, so a text is
compared by what matters for the label.  Texts with words but no term are alike
to the index; their score is the toxic share of the examples without a term.
Search is exact: a term's postings are held by blocks of examples with the
block's greatest weight; the blocks with the greatest bounds are scored first,
then those that can still reach the k-th best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BASE, BYTE_WORDS, letter_bytes, letter_words, mix64, save, slices

#: Labelled rows the index is fitted on, those with the least hash of doc_id.
EXAMPLES = 8192
#: Terms of the index at most, by chi-square, which must reach CHI_SQUARE.
TERMS = 4096
CHI_SQUARE = 15.0
#: Share of common terms from which examples with one least shingle and label are near copies.
NEAR = 0.8
#: Examples that vote at most; of these numbers one is chosen with the prior.
NEIGHBOURS = 31
VOTERS = (7, 15, 31)
#: Examples of one block of the index.
BLOCK = 64
#: Blocks that are scored before the others are ruled out by the k-th best of these.
FIRST = 4
#: Weights of the base rate against the votes; one is chosen by leave-one-out log loss.
PRIORS = (1.0, 2.0, 3.0, 4.0)

#: Bytes of a stem: longer words count as themselves and as their stem.
STEM = 6
_STEM_POWERS = np.multiply.accumulate(np.array([1] + [BASE] * (STEM - 1), dtype=np.uint64))


def word_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash and its stem's (0 if it is no longer than a stem), by turns,
    and where each text's begin."""
    hashes, counts, starts, stops = letter_words(raw, offsets)
    terms = np.zeros(2 * len(hashes), dtype=np.uint64)
    terms[0::2] = hashes
    long = np.flatnonzero(stops - starts > STEM)
    stem = np.zeros(len(long), dtype=np.uint64)
    for j in range(STEM):
        stem += BYTE_WORDS[raw[starts[long] + j]] * _STEM_POWERS[j]
    terms[2 * long + 1] = mix64(stem ^ np.uint64(0x5354454D))
    return terms, 2 * counts


#: Turns a term into the one that says it occurs twice or more.
_AGAIN = np.uint64(0x5457494345544552)


def counted(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and their counts; one that occurs again is a further term."""
    terms, n = np.unique(terms, return_counts=True)
    terms, n = terms[terms != 0], n[terms != 0]
    return np.concatenate((terms, terms[n > 1] ^ _AGAIN)), np.concatenate((n, n[n > 1]))


_WORDS = "doc_id long, toxic int, near long, words array<long>, times array<int>"


def _example_words(batches):
    for batch in batches:
        raw, offsets = letter_bytes(batch.column("text").to_pylist())
        hashes, counts = word_terms(raw, offsets)
        words, times, near = [], [], []
        for a, b in zip(counts[:-1], counts[1:]):
            w, n = counted(hashes[a:b])
            own = hashes[a:b:2]
            words.append(w.view(np.int64))
            times.append(n.astype(np.int32))
            # Near copies mostly share the least hash of three words.
            near.append(int(mix64(own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)).min().view(np.int64)) if len(own) > 2 else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("toxic"),
                pa.array(near, pa.int64()),
                pa.array(words, pa.list_(pa.int64())),
                pa.array(times, pa.list_(pa.int32())),
            ],
            ["doc_id", "toxic", "near", "words", "times"],
        )


class BlockMaxIndex:
    """Unit TF-IDF vectors of labelled examples, searched exactly."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]], base: float):
        """``terms``: sorted word hashes; ``examples``: doc_id, label, count by term index."""
        order = np.argsort(idf, kind="stable")
        self.terms, self.idf, self.base = terms, idf, base
        vectors = []
        for doc_id, label, counts in examples:
            if counts:
                at = np.array(sorted(counts), dtype=np.int64)
                weight = (1 + np.log([counts[i] for i in at.tolist()])) * idf[at]
                vectors.append((doc_id, label, at, weight / np.sqrt((weight**2).sum())))
        # Examples with like leading terms share blocks, which makes the bounds sharp.
        lead = np.argsort(order)
        vectors.sort(key=lambda v: (int(lead[v[2][np.argmax(v[3])]]), v[0]))
        self.doc_id = np.array([v[0] for v in vectors], dtype=np.int64)
        self.label = np.array([v[1] for v in vectors], dtype=np.float64)
        n, blocks = len(vectors), (len(vectors) + BLOCK - 1) // BLOCK
        self.blocks = blocks
        example = np.repeat(np.arange(n), [len(v[2]) for v in vectors]) if n else np.zeros(0, np.int64)
        term = np.concatenate([v[2] for v in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([v[3] for v in vectors]) if n else np.zeros(0)
        by_term = np.lexsort((example, term))
        self.example, self.weight = example[by_term], weight[by_term]
        self.begin = np.searchsorted(term[by_term], np.arange(len(terms) + 1))
        self.most = np.zeros((len(terms), blocks))
        np.maximum.at(self.most, (term, example // BLOCK), weight)
        self.filter = np.zeros(1 << 16, dtype=bool)
        for x in (terms, terms ^ _AGAIN):
            self.filter[(x & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.voters, self.prior = 15, 2.0
        #: Score of a text with words of which none is a term.
        self.plain = base

    def vector(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term indices and unit weights of a text's word hashes."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0)
        hashes, counts = counted(hashes)
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[at] == hashes)
        hit = hit[np.argsort(at[hit])]
        at, counts = at[hit], counts[hit]
        weight = (1 + np.log(counts)) * self.idf[at]
        return at, weight / np.sqrt((weight**2).sum()) if len(at) else weight

    def search(self, at: np.ndarray, weight: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of greatest cosine above 0 and the cosines, ties to the
        smaller doc_id; ``but`` is an example left out."""
        bound = weight @ self.most[at]
        visit = np.argsort(-bound, kind="stable")
        visit = visit[bound[visit] > 0]
        slots = [slice(self.begin[i], self.begin[i + 1]) for i in at.tolist()]
        example = np.concatenate([self.example[x] for x in slots]) if slots else np.zeros(0, np.int64)
        own = np.concatenate([self.weight[x] * w for x, w in zip(slots, weight.tolist())]) if slots else np.zeros(0)
        block = example // BLOCK
        found, cosines, worst = [], [], 0.0
        for part in (visit[:FIRST], visit[FIRST:]):
            chosen = part[bound[part] >= worst - 1e-12]
            if not len(chosen):
                break
            row = np.full(self.blocks, -1)
            row[chosen] = np.arange(len(chosen))
            inside = row[block] >= 0
            cosine = np.bincount(row[block[inside]] * BLOCK + example[inside] % BLOCK, own[inside], len(chosen) * BLOCK)
            i = np.flatnonzero(cosine)
            ids = chosen[i // BLOCK] * BLOCK + i % BLOCK
            if but is not None:
                i, ids = i[ids != but], ids[ids != but]
            found.append(ids)
            cosines.append(cosine[i])
            if len(ids) >= k:
                worst = np.partition(cosine[i], -k)[-k]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        ids, cosine = np.concatenate(found), np.concatenate(cosines)
        best = np.lexsort((self.doc_id[ids], -np.round(cosine, 9)))[:k]
        return ids[best], cosine[best]

    def score(self, ids: np.ndarray, cosine: np.ndarray, prior: float | None = None, voters: int | None = None) -> float:
        """Votes weighted by cosine, with the base rate as ``prior`` votes more."""
        prior, voters = self.prior if prior is None else prior, self.voters if voters is None else voters
        ids, cosine = ids[:voters], cosine[:voters]
        return float(((cosine * self.label[ids]).sum() + prior * self.base) / (cosine.sum() + prior))

    def calibrate(self) -> None:
        """Choose prior and voters by the log loss of each example against the others."""
        loss = {(v, p): 0.0 for v in VOTERS for p in PRIORS}
        vectors: dict[int, list] = {}
        for t in range(len(self.terms)):
            for e, w in zip(self.example[self.begin[t] : self.begin[t + 1]].tolist(), self.weight[self.begin[t] : self.begin[t + 1]].tolist()):
                vectors.setdefault(e, []).append((t, w))
        for e, vector in vectors.items():
            at, weight = (np.array(x) for x in zip(*vector))
            ids, cosine = self.search(at, weight, NEIGHBOURS, but=e)
            for v, p in loss:
                s = min(max(self.score(ids, cosine, p, v), 1e-6), 1 - 1e-6)
                loss[v, p] -= np.log(s if self.label[e] else 1 - s)
        self.voters, self.prior = min(loss, key=lambda x: (loss[x], x))


def _once(words: DataFrame) -> DataFrame:
    """The examples without copies and near copies: of rows with one least shingle and
    label, equal ones count once, and those at NEAR of the first of them not again."""
    key = F.coalesce("near", "doc_id").alias("key")
    rows = words.groupBy(key, "toxic", "words", "times").agg(F.min("doc_id").alias("doc_id"))
    first = rows.groupBy("key", "toxic").agg(F.min(F.struct("doc_id", "words")).alias("first"))
    both = F.size(F.array_intersect("words", "first.words"))
    near = both >= NEAR * (F.size("words") + F.size("first.words") - both)
    kept = rows.join(F.broadcast(first), ["key", "toxic"]).filter((F.col("doc_id") == F.col("first.doc_id")) | ~near)
    return kept.select("doc_id", "toxic", "words", "times")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> BlockMaxIndex:
    """Index of the labelled rows of ``labels(doc_id, toxic)`` with the least hash."""
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(examples)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    words = rows.select("doc_id", "toxic", "text").mapInArrow(_example_words, _WORDS)
    once = save(_once(save(words, "toxicity-words")), "toxicity-examples")
    worded = F.when(F.size("words") > 0, F.col("doc_id"))
    n, positive, n_worded, positive_worded = once.agg(
        F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.countDistinct(worded), F.countDistinct(F.when(F.col("toxic") > 0, worded))
    ).first()
    pos, all_ = F.sum("toxic"), F.count("*")
    table = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(pos.alias("p"), all_.alias("df"))
    # Chi-square of the 2 x 2 table of presence and label.
    p, df = F.col("p").cast("double"), F.col("df").cast("double")
    cross = p * (n - df - positive + p) - (df - p) * (positive - p)
    under = df * (n - df) * float(positive) * float(n - positive)
    best = (
        table.filter("df >= 3")
        .withColumn("chi2", F.try_divide(cross * cross * float(n), under))
        .filter(F.col("chi2") >= CHI_SQUARE)
        .orderBy(F.col("chi2").desc(), "word")
        .limit(terms)
        .select("word", "df")
        .collect()
    )
    best = sorted((np.int64(r.word).view(np.uint64), r.df) for r in best)
    hashes = np.array([x for x, _ in best], dtype=np.uint64)
    idf = np.log((1 + n) / (1 + np.array([d for _, d in best], dtype=np.float64))) + 1
    index = {int(x): i for i, x in enumerate(hashes.view(np.int64))}
    spark = docs.sparkSession
    vocabulary = F.broadcast(spark.createDataFrame([(k,) for k in index], "word long"))
    pairs = once.select("doc_id", "toxic", F.explode(F.arrays_zip("words", "times")).alias("x"))
    pairs = pairs.select("doc_id", "toxic", F.col("x.words").alias("word"), F.col("x.times").alias("n")).join(vocabulary, "word")
    by_example: dict[int, tuple[int, dict[int, int]]] = {}
    for r in pairs.collect():
        by_example.setdefault(r.doc_id, (r.toxic, {}))[1][index[r.word]] = r.n
    out = BlockMaxIndex(hashes, idf, [(i, y, c) for i, (y, c) in sorted(by_example.items())], (positive + 0.5) / (n + 1))
    out.calibrate()
    left = n_worded - len(by_example)
    out.plain = float((positive_worded - sum(y for y, _ in by_example.values()) + out.prior * out.base) / (left + out.prior))
    return out


_SCORED = "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"


def _scores(index: BlockMaxIndex, texts) -> tuple[list[float], list[list[dict]]]:
    """Score and evidence of each text."""
    scores, why = [], []
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes):
        raw, offsets = letter_bytes(texts.slice(a, b - a).to_pylist())
        hashes, counts = word_terms(raw, offsets)
        worded = np.diff(counts) > 0
        # Few words are terms; only those are looked up text by text.
        known = np.flatnonzero(index.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        hashes, counts = hashes[known], np.searchsorted(known, counts)
        for i, j, some in zip(counts[:-1], counts[1:], worded.tolist()):
            at, weight = index.vector(hashes[i:j]) if j > i else ((), ())
            if not len(at):
                scores.append(index.plain if some else index.base)
                why.append([])
                continue
            ids, cosine = index.search(at, weight, NEIGHBOURS)
            scores.append(index.score(ids, cosine))
            why.append([{"doc_id": int(index.doc_id[x]), "cosine": float(c), "toxic": int(index.label[x])} for x, c in zip(ids[:3], cosine[:3])])
    return scores, why


def _score(shared):
    def run(batches):
        evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            scores, why = _scores(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(why, evidence)], ["doc_id", "score", "evidence"]
            )

    return run


def _below(shared, threshold: float):
    def run(batches):
        for batch in batches:
            scores, _ = _scores(shared.value, batch.column("text"))
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, model_docs: DataFrame | None = None) -> DataFrame:
    """Score every text of ``docs(doc_id, text)`` by ``labels(doc_id, toxic)``.

    The caller passes only labels that may be learned from; ``model_docs`` has
    the labelled texts (``docs`` unless given).  Returns ``doc_id, score,
    evidence``: the probability that the text is toxic and the three nearest
    examples.  A text without a known term gets the rate of the examples
    without one, a text without words (null, empty) the base rate; neither has
    evidence.  Without labels the base rate is 0.5; labels of one kind only tell
    nothing apart, and every text gets about their rate.  Repeated rows are
    scored alike; ties between examples go to the smaller doc_id.
    """
    index = fit(docs if model_docs is None else model_docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), _SCORED), "toxicity")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``.

    Scores are those of ``score_toxicity``; the rows pass without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInArrow(_below(shared, threshold), docs.schema)
