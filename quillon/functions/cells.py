"""Cell values, A1 references and ranges as expressions.

A cell is ``file, sheet, sheet_idx, row, col, vtype, num, str, bool, ts,
formula``; ``vtype`` is n, s, b, d, t (time as a fraction of a day) or e, null
for an empty cell.  Rounding is half away from zero, where the definition's is
on the binary value: the two differ on exact decimal ties only.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of a sheet.
MAX_COLUMN, MAX_ROW = 16_384, 1_048_576

#: A decimal as numeric text has it; NaN, infinities and overflow stay text.
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def serial(ts: Column) -> Column:
    """Days since 1899-12-30, rounded to 8 places; the time zone is dropped."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.round((micros + F.lit(2_209_161_600_000_000)) / F.lit(86_400_000_000), 8)


def column_name(n: Column) -> Column:
    """1 to A, 27 to AA: bijective base 26, up to three letters."""
    n = n.cast("int")
    letter = lambda x: F.char(65 + F.pmod(x, F.lit(26)))
    second, third = F.floor((n - 1) / 26), F.floor((n - 27) / 676)
    return F.concat(
        F.when(n > 702, letter(F.floor((n - 703) / 676))).otherwise(""), F.when(n > 26, letter(second - 1)).otherwise(""), letter(n - 1)
    )


def column_number(name: Column) -> Column:
    """A to 1, AA to 27."""
    return F.aggregate(F.filter(F.split(F.upper(name), ""), lambda c: c != ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64)


def address(sheet: Column, row: Column, col: Column) -> Column:
    """``'Sheet'!A1`` with quotes in the name doubled."""
    return F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'!"), column_name(col), row.cast("string"))


def sheet_name(raw: Column) -> Column:
    """Wrapping quotes off, doubled ones undone, a dangling one dropped."""
    s = F.regexp_replace(raw, r'^[\s"]+|[\s"]+$', "")
    quoted = F.regexp_like(s, F.lit(r"(?s)^'.*'$")) & (F.length(s) >= 2)
    return F.when(quoted, F.replace(F.regexp_extract(s, r"(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(F.trim(F.regexp_replace(s, r"^'|'$", "")))


def range_text(raw: Column) -> Column:
    """Upper case without blanks and quotes; ``BD2:308`` means ``BD2:BD308``."""
    s = F.upper(F.replace(F.replace(F.regexp_replace(raw, r"""^[\s"']+|[\s"']+$""", ""), F.lit(" "), F.lit("")), F.lit("\uff1a"), F.lit(":")))
    return F.regexp_replace(s, r"^([A-Z]{1,3})([0-9]{1,7}):([0-9]{1,7})$", "$1$2:$1$3")


def bounds(text: Column, last_row: Column | None = None) -> Column:
    """``struct<min_col, min_row, max_col, max_row>`` of a range, null if it is none.

    Corners are sorted; column ranges reach to ``last_row``; what lies beyond
    the sheet's limits is no range.
    """
    cell = r"^\$?([A-Z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Z]{1,3})\$?([0-9]{1,7}))?$"
    cols = r"^\$?([A-Z]{1,3}):\$?([A-Z]{1,3})$"
    part = lambda i: F.regexp_extract(text, cell, i)
    by_column = F.regexp_like(text, F.lit(cols))
    a = F.when(by_column, column_number(F.regexp_extract(text, cols, 1))).otherwise(column_number(part(1)))
    b = F.when(by_column, column_number(F.regexp_extract(text, cols, 2))).otherwise(column_number(F.when(part(3) == "", part(1)).otherwise(part(3))))
    hint = F.lit(None).cast("int") if last_row is None else F.greatest(last_row.cast("int"), F.lit(1))
    c = F.when(by_column, F.lit(1)).otherwise(part(2).try_cast("int"))
    d = F.when(by_column, hint).otherwise(F.when(part(4) == "", part(2)).otherwise(part(4)).try_cast("int"))
    good = (by_column | F.regexp_like(text, F.lit(cell))) & (F.greatest(a, b) <= MAX_COLUMN) & (F.least(c, d) >= 1) & (F.greatest(c, d) <= MAX_ROW) & d.isNotNull()
    return F.when(good, F.struct(F.least(a, b).alias("min_col"), F.least(c, d).alias("min_row"), F.greatest(a, b).alias("max_col"), F.greatest(c, d).alias("max_row")))


def area(b: Column) -> Column:
    return (b["max_col"] - b["min_col"] + 1).cast("long") * (b["max_row"] - b["min_row"] + 1)


def overlaps(a: Column, b: Column) -> Column:
    return (a["min_col"] <= b["max_col"]) & (b["min_col"] <= a["max_col"]) & (a["min_row"] <= b["max_row"]) & (b["min_row"] <= a["max_row"])


def ranges(text: Column) -> Column:
    """``array<struct<sheet, range>>`` of a comma list; quoted names may hold commas
    (a quote opens a name only at the start of a part).

    Parts without a sheet have a null one.
    """
    t = F.replace(F.replace(F.replace(text, F.lit("\uff1a"), F.lit(":")), F.lit("\u2018"), F.lit("'")), F.lit("\u2019"), F.lit("'"))
    parts = F.filter(F.regexp_extract_all(t, F.lit(r"\s*'(?:[^']|'')*'[^,]*|[^,]+"), F.lit(0)), lambda p: F.trim(p) != "")

    def one(p):
        named = F.contains(p, F.lit("!"))
        return F.struct(
            F.when(named, sheet_name(F.regexp_extract(p, r"(?s)^(.*)!([^!]*)$", 1))).alias("sheet"),
            range_text(F.when(named, F.regexp_extract(p, r"(?s)^(.*)!([^!]*)$", 2)).otherwise(p)).alias("range"),
        )

    return F.transform(parts, one)


def normal(vtype: Column, num: Column, text: Column, flag: Column, ts: Column) -> Column:
    """``struct<kind, value>``: b, n or s with the canonical value as text; null if empty.

    Numbers and finite numeric text round to 2 places, dates are serials,
    times fractions of a day to 8.
    """
    parsed = F.when(F.regexp_like(text, F.lit(_NUMBER)), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))
    parsed = F.when(F.abs(parsed) < float("inf"), parsed)
    value = (
        F.when(vtype == "n", F.round(num, 2)).when(vtype == "t", F.round(num, 8)).when(vtype == "d", serial(ts)).when(vtype.isin("s", "e"), F.round(parsed, 2))
    )
    value = value + F.lit(0.0)  # no negative zero
    return (
        F.when(vtype == "b", F.struct(F.lit("b").alias("kind"), flag.cast("string").alias("value")))
        .when(value.isNotNull(), F.struct(F.lit("n").alias("kind"), value.cast("string").alias("value")))
        .when(vtype.isNotNull() & (F.coalesce(text, F.lit("")) != ""), F.struct(F.lit("s").alias("kind"), text.alias("value")))
    )


def same(a: Column, b: Column) -> Column:
    """Equality of normal values: empty and "" are one, kinds never mix."""
    return a.eqNullSafe(b)


def shifted(formula: Column, down: Column, right: Column) -> Column:
    """A formula's relative references moved by rows and columns; ``#REF!`` beyond the sheet.

    Quoted texts and sheet names stay, ``$`` parts too.  References are told
    apart by one pattern, and each is a small piece of arithmetic in Python.
    """
    token = re.compile(r"(\"[^\"]*\"|'(?:[^']|'')*'!)|(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)([0-9]{1,7})(?![A-Za-z0-9_(.!])")

    def moved(f: str, dr: int, dc: int) -> str:
        def one(m: re.Match) -> str:
            if m[1]:
                return m[0]
            col = 0
            for c in m[3]:
                col = col * 26 + ord(c) - 64
            col, row = col + (0 if m[2] else dc), int(m[5]) + (0 if m[4] else dr)
            if not (1 <= col <= MAX_COLUMN and 1 <= row <= MAX_ROW):
                return "#REF!"
            name = ""
            while col:
                col, rest = divmod(col - 1, 26)
                name = chr(65 + rest) + name
            return f"{m[2]}{name}{m[4]}{row}"

        return token.sub(one, f)

    @F.pandas_udf("string")
    def move(f: pd.Series, dr: pd.Series, dc: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else moved(x, int(a), int(b)) for x, a, b in zip(f, dr, dc)])

    return move(formula, down, right)


def lines(text: Column, axis: str = "row") -> Column:
    """``array<struct<sheet, first, last>>`` of a comma list of rows (``3``, ``Data!5:9``) or columns (``B``, ``$C:E``).

    Ends are sorted; a part that is none, or lies beyond the sheet's limits, has null ends.
    """
    one, most = (r"[0-9]{1,7}", MAX_ROW) if axis == "row" else (r"[A-Z]{1,3}", MAX_COLUMN)
    number = (lambda x: x.try_cast("int")) if axis == "row" else column_number

    def part(p: Column) -> Column:
        form = rf"^\$?({one})(?::\$?({one}))?$"
        a, b = F.regexp_extract(p["range"], form, 1), F.regexp_extract(p["range"], form, 2)
        first, last = number(a), number(F.when(b == "", a).otherwise(b))
        good = F.regexp_like(p["range"], F.lit(form)) & (F.least(first, last) >= 1) & (F.greatest(first, last) <= most)
        return F.struct(p["sheet"].alias("sheet"), F.when(good, F.least(first, last)).cast("int").alias("first"), F.when(good, F.greatest(first, last)).cast("int").alias("last"))

    return F.transform(ranges(text), part)
