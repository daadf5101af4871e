"""Removal of byte strings that repeat across documents, by depth-limited radix sort.

Suffixes are sorted from the most significant digit, only through the bytes of
``threshold``, and only groups that span two documents go on.  Sorting the
suffix of every byte would move many times the text, so the suffixes are those
at anchors: in every window of ``threshold`` bytes the 16-byte string with the
least hash, so equal windows share their anchor and its place.

The first digit is the anchor's 16 bytes, as two numbers that are one to one with them.  The second are the bytes beside it:
of what a window has beside its anchor, half at least lies on one side, so only
anchors go on that share the bytes of one side with another document (told by
16 bits, which never part equal ones).  Then whole blocks are told apart, a
block being the bytes of the windows that one anchor stands for, and, where an
anchor has several, the windows, both by 64 bits.  Groups equal at the last
digit are the repeated windows.

Digits that very many documents have (found in a sample; any choice gives the
same result) are not ranked in one task: their groups are aggregated before the
shuffle, and what an aggregate says is joined back with ``attach``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BASE, BYTE_WORDS, attach, discard, mix64, random_words, save, text_bytes

#: Bytes of an anchor; anchors of 16 in windows of 50 are a byte in 18.
ANCHOR = 16
#: Documents (with the least hash of doc_id) in which common digits are looked for,
#: and in how many of them a digit is common.
SAMPLE, COMMON = 20_000, 8
#: Window starts that one vectorised step looks at.
STEP = 1 << 20
_POSITION = np.uint64((1 << 31) - 1)
_DOUBLING = random_words(4, 606) | np.uint64(1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        tables = []
        for base in (BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers.clear()
        _powers[size] = tuple(tables)
    return _powers[size]


def half_window(threshold: int) -> int:
    """Of what a window has beside its anchor, so much at least lies on one side."""
    return (threshold - ANCHOR + 1) // 2


class Blocks:
    """The anchored blocks of several texts.

    ``row``: the text; ``first``, ``last``: its least and greatest window start
    (bytes within the text); ``hi``, ``lo``: the anchor's 16 bytes; ``c``: the block's hash;
    ``sides``: two 16-bit hashes, of the anchor with the half window to its left
    (upper bits) and right, 0 where no window of the block reaches as far;
    ``middle``: the least window start right of which windows reach so far
    right, and up to which they reach so far left.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, threshold: int, digits: bool = True):
        """Without ``digits`` the anchors' bytes and sides are left out (0)."""
        self.threshold, self.digits = threshold, digits
        self.offsets = offsets
        self.raw = raw
        parts = []
        for rows, bases, begins, ends in self._steps():
            parts.append(self._step(rows, bases, begins, ends))
        self.row, self.first, self.last, self.hi, self.lo, self.c, self.sides, self.middle = (
            (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in ("i8", "i8", "i8", "i8", "i8", "i8", "i4", "i8"))
        )
        self.half = half_window(threshold)

    def _steps(self):
        """Runs of segments; a segment is a text or, of a long one, STEP window starts."""
        rows, bases, begins, ends, total = [], [], [], [], 0
        over = self.threshold - 1
        for row in range(len(self.offsets) - 1):
            start, end = int(self.offsets[row]), int(self.offsets[row + 1])
            for at in range(start, end - over, STEP):
                stop = min(end, at + STEP + over)
                if rows and total + stop - at > STEP:
                    yield rows, bases, begins, ends
                    rows, bases, begins, ends, total = [], [], [], [], 0
                rows.append(row)
                bases.append(at - start)
                begins.append(at)
                ends.append(stop)
                total += stop - at
        if rows:
            yield rows, bases, begins, ends

    def _step(self, rows, bases, begins, ends):
        t, w = self.threshold, self.threshold - ANCHOR + 1
        rows, bases, begins, ends = (np.array(x, dtype=np.int64) for x in (rows, bases, begins, ends))
        low, high = int(begins[0]), int(ends[-1])
        raw = self.raw[low:high]
        begins, ends = begins - low, ends - low
        hashes = BYTE_WORDS[raw]
        powers, inverses = _power_tables(len(raw))
        prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers[: len(raw)], out=prefix[1:])
        for j in range(4):  # strings of 2, 4, 8, 16 bytes
            hashes = hashes[: -(1 << j)] * _DOUBLING[j] + hashes[1 << j :]
        least = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        anchor = (least & _POSITION).astype(np.int64)
        # Window starts of each segment, in order, and the runs with the same anchor.
        n = ends - begins - t + 1
        begin_at = np.concatenate(([0], np.cumsum(n)))
        start = np.arange(begin_at[-1]) - np.repeat(begin_at[:-1] - begins, n)
        at = anchor[start]
        head = np.ones(len(start), dtype=bool)
        head[1:] = at[1:] != at[:-1]
        head[begin_at[:-1]] = True
        heads = np.flatnonzero(head)
        tails = np.concatenate((heads[1:], [len(start)])) - 1
        first, last, segment = start[heads], start[tails], np.searchsorted(begin_at, heads, side="right") - 1
        c = mix64((prefix[last + t] - prefix[first]) * inverses[first] + (last - first).astype(np.uint64))
        half, a, back = half_window(t), at[heads], bases[segment] - begins[segment]
        middle = a - half + back
        if not self.digits:
            none = np.zeros(len(c), np.int64)
            return rows[segment], first + back, last + back, none, none, c.view(np.int64), none, middle
        digit = np.lib.stride_tricks.sliding_window_view(raw, ANCHOR)[at[heads]].view(">u8").astype(np.uint64).view(np.int64)
        # Half of what a window has beside the anchor, and where that reaches.
        sides = []
        for low_, high_, reaches in ((a - half, a + ANCHOR, first <= a - half), (a, a + ANCHOR + half, last >= a + ANCHOR + half - t)):
            low_, high_ = np.where(reaches, low_, 0), np.where(reaches, high_, 0)
            side = (mix64((prefix[high_] - prefix[low_]) * inverses[low_]) >> np.uint64(48)).astype(np.uint32) | np.uint32(1)
            sides.append(np.where(reaches, side, np.uint32(0)))
        both = (sides[0] << np.uint32(16) | sides[1]).view(np.int32)
        return rows[segment], first + back, last + back, digit[:, 0], digit[:, 1], c.view(np.int64), both, middle

    def keys(self) -> np.ndarray:
        """One 64-bit key for each (text, block)."""
        return block_keys(self.row, self.c)

    def window_hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of the blocks ``chosen``, by block and start, and their numbers."""
        t = self.threshold
        n = self.last[chosen] - self.first[chosen] + 1
        size = n + t - 1
        begin = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.offsets[self.row[chosen]] + self.first[chosen] - begin[:-1], size) + np.arange(begin[-1])
        powers, inverses = _power_tables(len(at))
        prefix = np.zeros(len(at) + 1, dtype=np.uint64)
        np.cumsum(BYTE_WORDS[self.raw[at]] * powers[: len(at)], out=prefix[1:])
        first = np.concatenate(([0], np.cumsum(n)))
        start = np.repeat(begin[:-1] - first[:-1], n) + np.arange(first[-1])
        return mix64((prefix[start + t] - prefix[start]) * inverses[start]).view(np.int64), n


def digit_hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix64(mix64(hi.view(np.uint64)) + lo.view(np.uint64))


def block_keys(row: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(c.astype(np.int64).view(np.uint64)) ^ mix64(row.astype(np.uint64) + np.uint64(1))


_ANCHORS = "hi long, lo long, c long, sides long, doc_id long"


def _anchors(threshold: int, common=None):
    """One row per document and distinct block; of equal texts in a task only the first.
    ``common``: sorted hashes of the common digits, broadcast; bit 32 of ``sides`` marks their rows."""

    def run(batches):
        hashes = common.value if common is not None else np.zeros(0, np.uint64)
        least: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw, offsets = text_bytes(batch.column("text"))
            fresh = []
            for i, doc_id in enumerate(ids):
                if doc_id is None or offsets[i + 1] - offsets[i] < threshold:
                    continue
                own = hashlib.blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=16).digest()
                # A copy with a smaller id must still be seen as a source.
                if own not in least or doc_id < least[own]:
                    least[own] = doc_id
                    fresh.append(i)
            for a in range(0, len(fresh), 256):
                rows = fresh[a : a + 256]
                part = [raw[offsets[i] : offsets[i + 1]] for i in rows]
                b = Blocks(np.concatenate(part), np.concatenate(([0], np.cumsum([len(x) for x in part]))), threshold)
                order = np.lexsort((b.c, b.row))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (b.row[order][1:] != b.row[order][:-1]) | (b.c[order][1:] != b.c[order][:-1])
                order = order[new]
                lo, sides = b.lo[order], b.sides[order].view(np.uint32).astype(np.int64)
                # Mixed with the lower bytes, the upper ones tell nearly all digits apart; both still say all 16.
                hi = b.hi[order] ^ mix64(lo.view(np.uint64)).view(np.int64)
                if len(hashes):
                    g = digit_hash(hi, lo)
                    sides |= (hashes[np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)] == g).astype(np.int64) << 32
                docs = np.array([ids[i] for i in rows], dtype=np.int64)[b.row[order]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi, lo, b.c[order], sides, docs)], ["hi", "lo", "c", "sides", "doc_id"])

    return run


def _parts(batch: pa.RecordBatch, name: str, threshold: int):
    """Blocks of runs of a batch's texts, with the rows of the struct list ``name`` of each text."""
    raw, offsets = text_bytes(batch.column("text"))
    lists = batch.column(name)
    begin = np.array(lists.offsets) - int(lists.offsets[0].as_py()) if len(lists) else np.zeros(1, np.int64)
    flat = lists.flatten()
    fields = {flat.type.field(i).name: np.array(flat.field(i)) for i in range(flat.type.num_fields)}
    for a in range(0, len(batch), 256):
        b = min(a + 256, len(batch))
        blocks = Blocks(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], threshold, digits=False)
        at = np.searchsorted(blocks.row, np.arange(b - a + 1))
        yield a, blocks, at, begin, fields


def _windows(threshold: int):
    """Window hashes of the blocks asked for, once each."""

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column("doc_id"), dtype=np.int64)
            for a, blocks, at, begin, asked in _parts(batch, "asked", threshold):
                own = slice(begin[a], begin[a + len(at) - 1])
                row = np.repeat(np.arange(len(at) - 1), np.diff(begin[a : a + len(at)]))
                keys, first = np.unique(blocks.keys(), return_index=True)
                wanted, place = np.unique(block_keys(row, asked["c"][own]), return_index=True)
                hit = np.isin(keys, wanted)
                chosen = first[hit]
                if not len(chosen):
                    continue
                place = place[np.searchsorted(wanted, keys[hit])]
                hashes, n = blocks.window_hashes(chosen)
                j = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
                # Only windows that reach as far as what the block shares.
                start, middle = np.repeat(blocks.first[chosen], n) + j, np.repeat(blocks.middle[chosen], n)
                right = middle + 2 * blocks.half + ANCHOR - threshold
                kept = np.repeat(asked["wl"][own][place], n) & (start <= middle) | np.repeat(asked["wr"][own][place], n) & (start >= right)
                # With g and the document 32 bits of c tell a block; a bit for common digits; j is below 64.
                columns = (
                    np.repeat(asked["g"][own][place], n)[kept],
                    (np.repeat(blocks.c[chosen] & 0xFFFFFFFF | asked["often"][own][place].astype(np.int64) << 32, n)[kept] << 6) | j[kept],
                    hashes[kept],
                    np.repeat(ids[a + blocks.row[chosen]], n)[kept],
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["g", "cj", "h", "least"])

    return run


_CUT = "doc_id long, sha256 string, n_removed long, n_spans long, kept_sha256 string"


def _cut(threshold: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for a, blocks, at, begin, cuts in _parts(batch, "cuts", threshold):
                own = slice(begin[a], begin[a + len(at) - 1])
                row = np.repeat(np.arange(len(at) - 1), np.diff(begin[a : a + len(at)]))
                keys = block_keys(row, cuts["c"][own])
                order = np.argsort(keys)
                keys, masks = keys[order], cuts["mask"][own][order]
                mine = blocks.keys()
                place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == mine)
                mask = masks[place[hit]]
                first = blocks.offsets[blocks.row[hit]] + blocks.first[hit]
                n = blocks.last[hit] - blocks.first[hit] + 1
                whole = mask == -1
                # Blocks that go whole, and the single windows of the others.
                j = np.arange(n[~whole].sum()) - np.repeat(np.cumsum(n[~whole]) - n[~whole], n[~whole])
                bit = (np.repeat(mask[~whole], n[~whole]) >> j) & 1 == 1
                starts = np.repeat(first[~whole], n[~whole])[bit] + j[bit]
                size = len(blocks.raw) + 1
                cover = np.bincount(np.concatenate((first[whole], starts)), minlength=size)
                cover -= np.bincount(np.concatenate((first[whole] + n[whole] - 1, starts)) + threshold, minlength=size)
                gone = np.cumsum(cover[:-1]) > 0
                for i in range(len(at) - 1):
                    part = slice(blocks.offsets[i], blocks.offsets[i + 1])
                    text, lost = blocks.raw[part], gone[part]
                    edges = np.diff(np.concatenate(([0], lost.astype(np.int8))))
                    row = (
                        hashlib.sha256(text).hexdigest(),
                        int(lost.sum()),
                        int((edges == 1).sum()),
                        hashlib.sha256(text[~lost].tobytes()).hexdigest(),
                    )
                    for column, x in zip(out, row):
                        column.append(x)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds))], ["doc_id", "sha256", "n_removed", "n_spans", "kept_sha256"]
            )

    return run


def _common_digits(ids: DataFrame, threshold: int):
    """Hashes of the digits that COMMON of SAMPLE documents have, broadcast; they only choose a path."""
    sampled = ids.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = ids.join(F.broadcast(sampled), "doc_id", "left_semi")
    rows = texts.mapInArrow(_anchors(threshold), _ANCHORS)
    often = save(rows.select("hi", "lo", "doc_id").distinct().groupBy("hi", "lo").count().filter(F.col("count") >= COMMON).select("hi", "lo"), "repeat-common").toArrow()
    hashes = digit_hash(*(np.array(often.column(x), dtype=np.int64) for x in ("hi", "lo")))
    return ids.sparkSession.sparkContext.broadcast(np.sort(hashes))


def _shared(ids: DataFrame, threshold: int, common) -> tuple[DataFrame, list[DataFrame]]:
    """First and second digit: ``g, c, doc_id, wl, wr, often`` of anchors that share a side with
    another document; ``wl``, ``wr``: with a different block, on the left or right; ``g`` stands for
    the digit.  Also the saved tables that this reads."""
    often = F.shiftrightunsigned("sides", 32) > 0
    # One exchange: a row of a common digit is dealt there by its content, with its digit
    # masked, as a group of its own; whatever the windows say of it is replaced below.
    mask = F.when(often, F.xxhash64("doc_id", "c")).otherwise(F.lit(0).cast("long"))
    masked = {"hi": F.col("hi").bitwiseXOR(mask), "lo": F.col("lo").bitwiseXOR(mask)}
    sides = {"l": F.shiftrightunsigned("sides", 16).bitwiseAND(0xFFFF), "r": F.col("sides").bitwiseAND(0xFFFF)}
    rows = ids.mapInArrow(_anchors(threshold, common), _ANCHORS).withColumns(masked).repartition("hi").withColumns(sides)

    def ranked(df: DataFrame, side: str) -> DataFrame:
        span = f"over (partition by hi, lo, {side})"
        df = df.withColumn(f"s{side}", F.expr(f"{side} <> 0 and min(doc_id) {span} < max(doc_id) {span}"))
        return df.withColumn(f"w{side}", F.expr(f"s{side} and min(c) {span} < max(c) {span}"))

    # Most digits are of one document: these go by the first number alone, as Spark sorts
    # by one number without comparing rows.  What stays is told apart by both.
    rows = rows.withColumn("s", F.expr("min(doc_id) over (partition by hi) < max(doc_id) over (partition by hi)"))
    # What is sorted by the digit is nearly sorted by the sides within it.
    rows = ranked(ranked(rows.filter(F.col("s") | often), "l"), "r").filter(F.col("sl") | F.col("sr") | often)
    rows = rows.withColumns(masked).withColumn("g", F.hash("hi", "lo"))
    columns = ["g", "c", "doc_id", "wl", "wr", "often"]
    if not len(common.value):
        rows = save(rows.withColumn("often", F.lit(False)).select(*columns), "repeat-digits")
        return rows, [rows]
    rows = save(rows.withColumn("often", often).withColumns({x: F.when(F.col("often"), F.col(x)) for x in sides}).select(*columns, "l", "r"), "repeat-digits")
    common_rows = rows.filter("often").drop("wl", "wr")
    total, flagged, said = common_rows.count(), common_rows, {}
    for side in sides:
        group = common_rows.filter(f"{side} <> 0").groupBy("g", side)
        said[side] = save(
            group.agg(F.count("*").alias("n"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
            .filter("d0 < d1")
            .select("g", side, "n", F.lit(True).alias(f"s{side}"), F.expr("c0 < c1").alias(f"w{side}")),
            "repeat-sides",
        )
        flagged = attach(flagged, said[side], ["g", side], total, how="left")
    flagged = flagged.filter("sl or sr").withColumns({w: F.coalesce(w, F.lit(False)) for w in ("wl", "wr")})
    flagged = save(flagged.select(*columns), "repeat-common-digits")
    discard(*said.values())
    return rows.filter("not often").select(*columns).unionByName(flagged), [rows, flagged]


def remove_repeats(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """Cut what ``docs(doc_id, text)`` repeats from documents with smaller ids.

    Every byte goes that a string of ``threshold`` bytes covers which also
    starts in a document with a smaller doc_id.  Strings are judged on the
    input; matches never cross documents.  Returns per row ``doc_id, n_bytes,
    n_removed, n_spans, kept_sha256``.

    Null text counts as empty.  Rows that share a doc_id are one document:
    none is smaller than the other.  A row with a null doc_id is neither a
    source nor cut.  An empty table gives no rows; other columns are ignored.
    ``threshold`` is 33 to 78, so that a block's windows fit a 64-bit mask.
    """
    if not 33 <= threshold <= 78:
        raise ValueError("threshold is from 33 to 78 bytes")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sized = save(
        ids.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")),
        "repeat-ids",
    )
    common = _common_digits(ids, threshold)
    shared, read = _shared(ids, threshold, common)
    total = shared.count()
    blocks = save(
        shared.groupBy("g", "c").agg(
            F.count("*").alias("n"), F.min("doc_id").alias("least"), F.bool_or("wl").alias("wl"), F.bool_or("wr").alias("wr"), F.bool_or("often").alias("often")
        ),
        "repeat-blocks",
    )
    # Last digit: windows, once for each distinct block that shares a side with another.
    asked = blocks.filter("wl or wr").groupBy(F.col("least").alias("doc_id")).agg(F.collect_list(F.struct("g", "c", "wl", "wr", "often")).alias("asked"))
    windows = ids.join(asked, "doc_id").mapInArrow(_windows(threshold), "g int, cj long, h long, least long")
    # Windows of common digits are dealt by their content, each on its own, and saved for a second look.
    common_digit = F.shiftright("cj", 38) > 0
    masked = F.col("h").bitwiseXOR(F.when(common_digit, F.xxhash64("cj", "least")).otherwise(F.lit(0).cast("long")))
    # As with digits: most windows go by one number, the others are told apart by g as well.
    ranked = windows.withColumn("h", masked).withColumn("s", F.expr("min(least) over (partition by h) < max(least) over (partition by h)"))
    ranked = ranked.filter(F.col("s") | common_digit).drop("s").withColumn("lowest", F.expr("min(least) over (partition by h, g)"))
    ranked = save(ranked.filter((F.col("lowest") < F.col("least")) | common_digit).withColumn("h", masked), "repeat-windows")
    often = ranked.filter(common_digit).drop("lowest")
    group = save(often.groupBy("g", "h").agg(F.count("*").alias("n"), F.min("least").alias("lowest"), F.max("least").alias("most")).filter("lowest < most").drop("most"), "repeat-lowest")
    found = ranked.filter(~common_digit).unionByName(attach(often, group, ["g", "h"], often.count()).filter("lowest < least"))
    earlier = save(
        found.groupBy("g", "least", F.shiftright("cj", 6).bitwiseAND(0xFFFFFFFF).alias("c32")).agg(
            F.collect_list(F.struct(F.col("cj").bitwiseAND(63).cast("int").alias("j"), "lowest")).alias("earlier")
        ),
        "repeat-earlier",
    )
    discard(ranked, group)
    # A document loses a block whole where the block's least document comes
    # before it, else the windows that a document before it has in other blocks.
    sources = blocks.withColumn("c32", F.col("c").bitwiseAND(0xFFFFFFFF)).join(earlier, ["g", "least", "c32"], "left")
    sources = save(sources.select("g", "c", "n", "least", "earlier"), "repeat-sources")
    discard(blocks, earlier)
    mask = F.when(F.col("least") < F.col("doc_id"), F.lit(-1).cast("long")).otherwise(
        F.expr("coalesce(aggregate(transform(earlier, x -> if(x.lowest < doc_id, shiftleft(1L, x.j), 0L)), 0L, (s, x) -> s + x), 0L)")
    )
    cuts = (
        attach(shared.select("g", "c", "doc_id"), sources, ["g", "c"], total)
        .withColumn("mask", mask)
        .filter("mask <> 0")
        .select("doc_id", F.struct("c", "mask").alias("cut"))
        .groupBy("doc_id")
        .agg(F.collect_list("cut").alias("cuts"))
    )
    cut = save(ids.join(cuts, "doc_id").mapInArrow(_cut(threshold), _CUT).dropDuplicates(["doc_id", "sha256"]), "repeat-cuts")
    discard(*read, sources)
    # Whole copies need no text again: their least id says all.
    copies = save(sized.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1"), "repeat-copies")
    copy = F.coalesce((F.col("first_id") < F.col("doc_id")) & (F.col("n_bytes") >= threshold), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        attach(sized, copies, ["sha256"], sized.count(), how="left")
        .join(cut, ["doc_id", "sha256"], "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        )
    )
