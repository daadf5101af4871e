"""Personal data in texts, with DataFrame functions only.

Validated patterns give the base spans.  High-recall generators propose more,
overlapping spans; boosted trees over format and context features score them
and a calibrated threshold selects.  The trees are fitted on the driver, from
made-up examples whose truth is known, and become a column expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds in the order of ties, and the patterns they are
# defined by.  Possessive quantifiers and the looks behind only keep Java from
# backtracking or recursing; they match the same spans, because a leftmost
# match starts where a run of its first characters starts or the last match ended.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates: anything around an at sign, any long run of
#: digits and the marks that group them, and any long run of letters and digits.
PROPOSED = {
    "address": r"(?<![^\s@<>\"'])[^\s@<>\"']++@[^\s@<>\"']++",
    "number": r"(?<![0-9+(])[+(]?[0-9][0-9 ().-]{5,}[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
}
#: Trees, and the share of selected spans that must be personal data.
TREES, PRECISION = 100, 0.95
CONTEXT = 24

# What the trees learn from: formats in contexts, both made up here.  In a format
# 9 stands for a digit, x for a hex digit, a for a letter, Z for a letter or digit.
# A format is personal in the contexts that are named beside it (* in any).
FORMATS = [
    ("aaaa.aa@aaaaaa.aaa", "*"), ("aaaaa@aaaaaaaa", "mail phone"), ("aaa+aa@aaaé.aa", "mail"), ("aaaaa9@[999.9.9.99]", "mail"), ("aaa@@aa", ""), ("@aaaaaa@aaaa", "mail"), ("a@9", ""), ("aaaa=aaa@aaa", ""),
    ("(999) 999-9999", "phone mail"), ("9999 999 9999", "phone"), ("99 99 99 99 99", "phone"), ("999-999-9999", "phone mail"), ("999.999.9999", "phone"), ("0999-9999999", "phone"), ("999-99-9999", "id"), ("9999999999", "phone"),
    ("9999 9999 9999 9999", "card"), ("9999-9999-9999-9999", "card"), ("9999999999999999", "card"), ("999999999999999", "card"), ("9999 999999 99999", "card"), ("99999999", "id"), ("999999999", "id"),
    ("2099-99-99", ""), ("99.99.2099", ""), ("2099-99-99 99", ""), ("1999-2099", ""), ("9 999 999", ""), ("99.999.999", ""), ("9.99.999", ""), ("99.9999999", ""), ("978-9-99-999999-9", ""), ("99999 - 99999", ""), ("9.999999999", ""), ("99999999999999999999", ""),
    ("xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "secret"), ("xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "secret"), ("sk-ZZZZZZZZZZZZZZZZZZZZZZZZ", "secret"), ("ZZZZZZZZZZZZZZZZZZZZ", "secret"), ("ZZZZZZZZ/ZZZZZZZZ+ZZZZZZZZZZZZZZZ=", "secret"), ("ZZZZZ-ZZZZZ-ZZZZZ-ZZZZZ", "secret"),
    ("xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx", ""), ("aaaaaaaa-aaaaaa-99", ""), ("aaaaa_aaaaaaa_aaaa_9", ""), ("----------------9", ""), ("aaaaaaaaaaaaaaaaa9", ""),
]
CONTEXTS = [
    ("please call ", " before noon", "phone"), ("Tel: ", "", "phone"), ("phone ", ", or write", "phone"), ("PHONE = \"", "\"!!", "phone"), ("mobil: ", " oder", "phone"), ("fax ", ".", "phone"),
    ("write to ", " for more", "mail"), ("contact <", ">", "mail"), ("E-Mail: ", "", "mail"), ("mailto:", " now", "mail"), ("CONTACT! ", "!! OF", "mail"),
    ("card number ", " exp", "card"), ("paid with visa ", ", thanks", "card"), ("CARD = ", ";", "card"), ("credit card: ", "", "card"),
    ("ssn ", " of", "id"), ("passport no. ", " was", "id"), ("my account ", ",", "id"),
    ("token = \"", "\" in", "secret"), ("api_key: ", "", "secret"), ("password=", "&x", "secret"), ("SECRET = '", "'", "secret"), ("Bearer ", "\\n", "secret"), ("aws key \"", "\"", "secret"), ("TOKEN = \"", "\"!!", "secret"),
    ("on ", " the men went", "date"), ("between ", " there was", "date"), ("since ", ".", "date"), ("order ", " was shipped", "order"), ("invoice no. ", ",", "order"), ("ISBN ", "", "order"), ("ticket ", " is", "order"), ("version ", " of", "code"),
    ("commit ", " fixes", "code"), ("sha1 ", "", "code"), ("https://aaaa.aa/", ".aaa", "code"), ("id=\"", "\" class", "code"), ("about ", " people", "amount"), ("costs ", " euro", "amount"), ("total ", " units", "amount"), ("at ", " degrees", "amount"),
    ("and the ", " with a", ""), ("de la ", " y", ""), ("und ", " der", ""), ("the, ", "!! then", ""), ("", "", ""), ("aaa aaaa ", " aaaa", ""),
]
#: Draws of each pair of format and context.
DRAWS = 6


_SPANS = "array<struct<kind:string,first:int,last:int,match:string>>"


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches as structs of ``kind, first, last, match``: code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What lies between matches gives their places.
    steps = F.zip_with(
        matches,
        F.split(text, pattern, -1),
        lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("m")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def add(state, x):
        first = state["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), first.alias("first"), (first + x["n"]).alias("last"), x["m"].alias("match"))
        return F.struct((first + x["n"]).alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    # The last gap has no match after it.
    steps = F.filter(steps, lambda x: x["m"].isNotNull())
    return F.when(F.size(matches) > 0, F.aggregate(steps, start, add)["found"]).otherwise(F.array().cast(_SPANS))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check-digit rule over a string of digits."""
    reverse = F.split(F.reverse(number), "")
    summed = F.aggregate(
        F.zip_with(reverse, F.sequence(F.lit(0), F.size(reverse) - 1), lambda d, i: F.struct(d.cast("int").alias("d"), (i % 2).alias("odd"))),
        F.lit(0),
        lambda s, x: s + F.when(x["odd"] == 1, F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"]),
    )
    return summed % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        # Leading zeros do not count.
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(
            F.split(x, r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        n = F.length(digits(x))
        return F.when(n.between(14, 19), luhn(digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(x)).between(10, 15)
    return F.lit(True)


#: What a text must hold for a pattern to be tried at all.
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")), "address": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")),
    "ip": lambda t: F.regexp_like(t, F.lit("[0-9][.]")), "card": lambda t: F.regexp_like(t, F.lit("[0-9]")), "number": lambda t: F.regexp_like(t, F.lit("[0-9]")), "secret": lambda t: F.regexp_like(t, F.lit("[0-9]")),
}


def _spans(text: Column, pattern: str, kind: str) -> Column:
    return F.when(_NEEDS[kind](text), located(text, pattern, kind)).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    """The validated spans of each kind; matches that fail are dropped."""

    def kept(kind: str) -> Column:
        return F.filter(_spans(text, PATTERNS[kind], kind), lambda x: _valid(kind, x["match"]))

    return {kind: kept(kind) for kind in KINDS}


#: Features of a candidate: format, then context.
_CUES = {
    "cue_phone": r"(?i)(tel|phone|call|mobil|fax|\bring)", "cue_mail": r"(?i)(mail|contact|write|address)", "cue_card": r"(?i)(card|visa|credit|master|amex)",
    "cue_id": r"(?i)(ssn|social|passport|account|iban)", "cue_secret": r"(?i)(token|secret|passw|pwd|bearer|auth|key)",
    "cue_other": r"(?i)(order|invoice|isbn|ticket|version|commit|sha|https?:|\bid\b|total|costs?|\bon\b|since|between|about)",
}
FEATURES = [
    "is_address", "is_secret", "length", "n_digits", "n_marks", "n_dots", "n_dashes", "n_letters", "n_groups", "longest_group", "last_group", "checks", "plus", "hex", "tail_dot",
    "before_word", "after_word", "before_digit", "quoted", *_CUES,
]


def _features(text: Column, x: Column) -> dict[str, Column]:
    """``x`` has the candidate, its digits as ``number``, their groups, and what stands before it."""
    m, number, groups, before = x["match"], x["number"], x["groups"], x["before"]
    after = F.substring(text, x["last"] + 1, F.lit(1))
    as_double = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    n_letters = F.length(F.regexp_replace(m, r"[^\p{L}]", ""))
    return {
        "is_address": as_double(x["kind"] == "address"),
        "is_secret": as_double(x["kind"] == "secret"),
        "length": as_double(F.length(m)),
        "n_digits": as_double(F.length(number)),
        "n_marks": as_double(F.length(m) - F.length(number) - n_letters),
        "n_dots": as_double(F.length(m) - F.length(F.replace(m, F.lit("."), F.lit("")))),
        "n_dashes": as_double(F.length(m) - F.length(F.replace(m, F.lit("-"), F.lit("")))),
        "n_letters": as_double(n_letters),
        "n_groups": as_double(F.size(groups)),
        "longest_group": as_double(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))),
        "last_group": as_double(F.length(F.try_element_at(groups, F.lit(-1)))),
        "checks": as_double(F.when(F.length(number).between(12, 19), luhn(number)).otherwise(F.lit(False))),
        "plus": as_double(F.startswith(m, F.lit("+"))),
        "hex": as_double(F.regexp_like(m, F.lit("^[0-9a-fA-F]+$"))),
        "tail_dot": as_double(F.regexp_like(m, F.lit(r"@.*\.[\p{L}]{2,}$"))),
        "before_word": as_double(F.regexp_like(before, F.lit(r"[\p{L}_]$"))),
        "after_word": as_double(F.regexp_like(after, F.lit(r"^[\p{L}_]"))),
        "before_digit": as_double(F.regexp_like(before, F.lit(r"[0-9]$"))),
        "quoted": as_double(F.regexp_like(before, F.lit("[\"'=<:] ?$"))),
        **{name: as_double(F.regexp_like(before, F.lit(cue))) for name, cue in _CUES.items()},
    }


def _described(text: Column, candidates: Column) -> Column:
    """The candidates with their features as fields, each worked out once."""
    parts = F.transform(
        candidates,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("kind", "first", "last", "match")],
            digits(x["match"]).alias("number"),
            F.filter(F.split(x["match"], "[^0-9]+"), lambda g: g != "").alias("groups"),
            F.substring(text, F.greatest(x["first"] + 1 - CONTEXT, F.lit(1)), F.least(x["first"], F.lit(CONTEXT))).alias("before"),
        ),
    )
    return F.transform(parts, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "first", "last", "match")], *[c.alias(n) for n, c in _features(text, x).items()]))


class BoostedTrees:
    """Trees of two levels under log loss; as data: (feature, cut, feature, cut, feature, cut, four values)."""

    def __init__(self, base: float, trees: list[tuple], threshold: float):
        self.base, self.trees, self.threshold = base, trees, threshold

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = TREES, rate: float = 0.3, fit: np.ndarray | None = None, held: np.ndarray | None = None) -> BoostedTrees:
        """Rows ``fit`` grow the trees, rows ``held`` set the threshold (else every second row each)."""
        if not len(y) or y.min() == y.max():
            return cls(0.0, [], math.inf)  # nothing can be told apart: nothing is added
        fit = np.arange(len(y)) % 2 == 0 if fit is None else fit
        held = ~fit if held is None else held
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[:-1])) for j in range(x.shape[1])]
        p0 = float(np.clip(y[fit].mean(), 1e-6, 1 - 1e-6))
        base = math.log(p0 / (1 - p0))
        score, trees = np.full(len(y), base), []

        def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
            best = (-1.0, 0, -math.inf)
            total, weight = g[rows].sum(), h[rows].sum()
            for j, own in enumerate(cuts):
                for cut in own.tolist():
                    left = rows & (x[:, j] <= cut)
                    a, b = g[left].sum(), h[left].sum()
                    gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total * total / (weight + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, j, cut)
            return best[1], best[2]

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = np.where(fit, y - p, 0.0), np.where(fit, p * (1 - p), 0.0)
            j, cut = split(fit, g, h)
            tree, step = [j, cut], np.zeros(len(y))
            for side in (x[:, j] <= cut, x[:, j] > cut):
                k, c = split(fit & side, g, h)
                values = []
                for leaf in (side & (x[:, k] <= c), side & (x[:, k] > c)):
                    v = rate * float(g[leaf].sum() / (h[leaf].sum() + 1))
                    values.append(v)
                    step[leaf] = v
                tree += [k, c, *values]
            score += step
            trees.append(tuple(tree))
        # The least score from which the selected held-out rows are precise enough.
        order = np.argsort(-score[held], kind="stable")
        s, right = score[held][order], np.cumsum(y[held][order])
        share = right / np.arange(1, len(order) + 1)
        good = np.flatnonzero((share >= PRECISION) & np.append(s[1:] < s[:-1], True))
        return cls(base, trees, float(s[good[-1]]) if len(good) else math.inf)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, cut, k1, c1, a, b, k2, c2, c, d in self.trees:
            total += np.where(x[:, j] <= cut, np.where(x[:, k1] <= c1, a, b), np.where(x[:, k2] <= c2, c, d))
        return total

    def column(self, described: Column) -> Column:
        """The score of a candidate that has its features as fields."""
        at = [described[n] for n in FEATURES]

        def leaf(j, cut, low, high):
            return F.when(at[j] <= F.lit(float(cut)), F.lit(float(low))).otherwise(F.lit(float(high)))

        total = F.lit(self.base)
        for j, cut, k1, c1, a, b, k2, c2, c, d in self.trees:
            total = total + F.when(at[j] <= F.lit(float(cut)), leaf(k1, c1, a, b)).otherwise(leaf(k2, c2, c, d))
        return total


def _overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["first"] < x["last"]) & (x["first"] < b["last"]))


def _candidates(docs: DataFrame) -> DataFrame:
    """The rows as ``row``, their texts as ``t``, all spans by kind, ``base`` and ``proposed``."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    own = own.withColumns(base_spans(F.col("t"))).withColumns({k: _spans(F.col("t"), p, k) for k, p in PROPOSED.items()})
    return own.withColumns({"base": F.concat(*KINDS), "proposed": F.concat(*PROPOSED)})


def _beside(own: DataFrame) -> Column:
    """The proposed spans that no base span overlaps, with their features."""
    return _described(F.col("t"), F.filter("proposed", lambda x: ~_overlaps(x, F.col("base"))))


def _selected(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """``_candidates`` and ``spans``: the base spans and those that the trees add beside them."""
    own = _candidates(docs)
    if math.isinf(model.threshold):
        return own.withColumn("spans", in_order(F.col("base")))
    chosen = F.filter(_beside(own), lambda x: model.column(x) >= F.lit(model.threshold))
    chosen = F.transform(chosen, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "first", "last", "match")]))
    return own.withColumn("chosen", chosen).withColumn("spans", in_order(F.concat("base", "chosen")))


def examples(spark: SparkSession) -> DataFrame:
    """``doc_id, text, first, last, personal, part``: made-up texts with one value each, whose truth
    is known; ``part`` is the same for all draws of a pair of format and context."""
    pairs = [(before, form, after, kind in truth.split() or truth == "*") for form, truth in FORMATS for before, after, kind in CONTEXTS]
    table = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("form"), F.lit(a).alias("after"), F.lit(y).alias("personal")) for b, f, a, y in pairs])
    rows = spark.range(len(pairs) * DRAWS).select(F.col("id").alias("doc_id"), F.element_at(table, (F.col("id") % len(pairs) + 1).cast("int")).alias("p"))

    def drawn(form: Column) -> Column:
        letters = {"9": "0123456789", "x": "0123456789abcdef", "a": "abcdefghijklmnopqrstuvwxyz", "Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}

        def one(c: Column, i: Column) -> Column:
            at, out = F.xxhash64("doc_id", i, F.length(form)), c
            for stand, of in letters.items():
                out = F.when(c == stand, F.substring(F.lit(of), (F.pmod(at, F.lit(len(of))) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(form, ""), one), "")

    value = rows.select("doc_id", "p", drawn(F.col("p.form")).alias("value"))
    first = F.length("p.before")
    return value.select(
        "doc_id",
        F.concat("p.before", "value", "p.after").alias("text"),
        first.alias("first"),
        (first + F.length("value")).alias("last"),
        "p.personal",
        F.pmod(F.xxhash64("p.before", "p.form"), F.lit(5)).cast("int").alias("part"),
    )


_fitted: list[BoostedTrees] = []


def fit(spark: SparkSession) -> BoostedTrees:
    """The trees, fitted on ``examples``: nothing in them comes from the patterns of the base spans.

    Three fifths of the pairs of format and context grow the trees, one sets the
    threshold, the last gives ``precision`` and ``recall`` of the spans added, all
    over candidates that no base span overlaps.  The examples are always the
    same, so a process fits once.
    """
    if not _fitted:
        known = examples(spark)
        own = _candidates(known)
        shared = lambda x: F.greatest(F.least(x["last"], F.col("row.last")) - F.greatest(x["first"], F.col("row.first")), F.lit(0))
        x = F.col("x")
        either = x["last"] - x["first"] + F.col("row.last") - F.col("row.first") - shared(x)
        rows = (
            own.select("row", F.explode(_beside(own)).alias("x"))
            .select("row.doc_id", "row.part", (F.col("row.personal") & (2 * shared(x) >= either)).cast("int").alias("y"), *[x[n].alias(n) for n in FEATURES])
            .orderBy("doc_id", *FEATURES)
            .collect()
        )
        table = np.array([[r[n] for n in FEATURES] for r in rows], dtype=np.float64).reshape(-1, len(FEATURES))
        y, part = np.array([r.y for r in rows], dtype=np.float64), np.array([r.part for r in rows])
        model = BoostedTrees.fit(table, y, fit=part < 3, held=part == 3)
        chosen = model.scores(table[part == 4]) >= model.threshold
        right = y[part == 4][chosen].sum()
        model.precision, model.recall = float(right / max(chosen.sum(), 1)), float(right / max(y[part == 4].sum(), 1))
        _fitted.append(model)
    return _fitted[0]


def find_pii(docs: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """``doc_id, text, email, ip, card, phone, spans`` of every row of ``docs(doc_id, text)``.

    Spans are structs of ``kind, first, last`` in code points, end exclusive
    (the base ones with their ``match``); ``spans`` has the base spans and those
    the trees add beside them, by first and then by kind as listed.  Null text
    counts as empty.  Repeated rows are judged alike.  An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _selected(docs, fit(docs.sparkSession) if model is None else model).select("row.doc_id", F.col("t").alias("text"), *KINDS, "spans")


def joined(spans: Column) -> Column:
    """``kind:first:last`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["first"], x["last"])), ",")


def in_order(spans: Column) -> Column:
    """Spans by first, then by kind as listed, proposed kinds last."""
    rank = F.create_map(*[F.lit(v) for i, k in enumerate([*KINDS, *PROPOSED]) for v in (k, i)])
    ordered = F.array_sort(
        F.transform(spans, lambda x: F.struct(x["first"].alias("first"), rank[x["kind"]].alias("rank"), x["last"].alias("last"), x["kind"].alias("kind")))
    )
    return F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["last"].alias("last")))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``<KIND>`` of its first."""

    def step(state, x):
        behind = x["first"] >= state["at"]
        piece = F.concat(F.substring(text, state["at"] + 1, x["first"] - state["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        parts = F.when(behind, F.concat(state["parts"], F.array(piece))).otherwise(state["parts"])
        return F.struct(F.greatest(x["last"], state["at"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """``docs`` with its text redacted; all columns stay, ``n_chars`` follows the text if there.

    A row whose text is null stays null, an empty one empty.  Spans that overlap
    are one; of ties the kind listed first names it.  Repeated rows each stay, an
    empty table stays empty, and columns of any name stay as they are.
    """
    model = fit(docs.sparkSession) if model is None else model
    text = F.when(F.col("row.text").isNotNull(), redacted(F.col("t"), F.col("spans")))
    out = _selected(docs, model).withColumn("text", text)
    return out.select(*[
        F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ])
