"""Spreadsheet formulas as column expressions: one regex scan into tokens, then a pass with a stack.

The pass is a pushdown automaton: it knows whether an operand or an operator may
come next, and its stack holds the open parentheses, braces and function calls
with what they have so far.  It is a small Python function over Arrow batches: as an
expression Spark interprets it and copies the stack for every token.  Every row is apart.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions whose number of arguments is checked, and whose arguments come in pairs.
ARITY = {"COUNTIF": (2, 2), "COUNTIFS": (2, 254), "LOOKUP": (2, 3), "NETWORKDAYS": (2, 3), "QUOTIENT": (2, 2), "SUMIF": (2, 3), "SUMIFS": (3, 255), "WORKDAY": (2, 3)}
PARITY = {"COUNTIFS": 0, "SUMIFS": 1}
# Functions that return references.
REFERENCES = ["CHOOSE", "INDEX", "INDIRECT", "OFFSET", "XLOOKUP"]

#: Tokens, the first that fits: strings, errors, powers of ten, operands (with ``(`` a call), operators, the rest.
_TOKEN = (
    r"""(?s)"(?:[^"]|"")*"|#(?:N/A|REF!|VALUE!|DIV/0!|NAME\?|NUM!|NULL!|SPILL!|CALC!|GETTING_DATA)|[0-9]+(?:\.[0-9]*)?[eE][+-]?[0-9]+(?![A-Za-z0-9_.])"""
    r"""|(?:'(?:[^']|'')*'|\[(?:[^\[\]]|\[[^\[\]]*\])*\]|[\p{L}\p{N}_.$\\!?])+\(?|<>|<=|>=|[ \t\n\x0B\f\r]+|."""
)


def tokens(formula: Column) -> Column:
    """The tokens of a formula without its leading ``=``, white space included."""
    return F.regexp_extract_all(F.regexp_replace(formula, r"^\s*=", ""), F.lit(_TOKEN), F.lit(0))


#: The same for Python, whose ``\w`` is a letter, a number or ``_``.
_SCAN = re.compile(_TOKEN.replace(r"\p{L}\p{N}_", r"\w"))
_LEAD = re.compile(r"[ \t\n\x0B\f\r]*=")
_NO_OPERAND = re.compile(r"\.+|[^\n\r\x85\u2028\u2029]*\$")
_BUILT_IN = re.compile(r"(?:(?:_XLFN|_XLWS)\.)*([^.]+)")
_KINDS = {
    **dict.fromkeys("({", "open"), **dict.fromkeys(")}", "close"), **dict.fromkeys(",;", "sep"), **dict.fromkeys("%#", "post"), **dict.fromkeys([*"+-*/^&=<>:@", "<>", "<=", ">="], "infix"),
    '"': "unclosed double quote", "'": "unclosed single quote", "[": "unclosed '['", "]": "unexpected ']'",
}


def _kind(t: str) -> str:
    """What a token is: operand, call, open, close, sep, infix, post, gap or what is wrong with it."""
    if t in _KINDS:
        return _KINDS[t]
    if t[0] == '"':
        return "operand"
    if t[0] in " \t\n\v\f\r":
        return "gap"
    if t[-1] == "(":
        return "call"
    if _NO_OPERAND.fullmatch(t):
        return "invalid operand"
    return "operand" if t[0].isalnum() or t[0] in "_.$\\!?'[#" else "unexpected character"


def _name(t: str) -> str:
    """A call's function, empty where dots say that it is not built in."""
    found = _BUILT_IN.fullmatch(t[:-1].rpartition("!")[2].upper())
    return found[1] if found else ""


def _error(text: str) -> tuple[int, str] | None:
    """Where the first error of a formula is and what, by one pass over its tokens."""
    lead = _LEAD.match(text)
    at = lead.end() if lead else 0
    stack: list[list] = []  # open parentheses, braces and calls: kind, name, separators, whether anything stands in it
    before, ref, gap, ranged = "start", False, False, False
    for t in _SCAN.findall(text, at):
        place, at, kind = at + 1, at + len(t), _kind(t)
        if kind == "gap":
            gap = True
            continue
        # After an operand, a closed expression or a postfix, an operator or an end may come.
        done = before in ("operand", "close", "post")
        opened, name, args, some = stack[-1] if stack else ("", "", 0, False)
        prefix = kind == "infix" and not done and t in "+-@"
        union = kind == "sep" and opened not in ("call", "{")  # a comma outside of calls joins references
        is_ref = kind == "operand" and t[0] not in '"#0123456789' and t.upper() not in ("TRUE", "FALSE")
        if kind in ("operand", "call", "open"):
            gapped = gap and (ref or before == "close") and (is_ref or kind == "call" or t == "(")
            if done and not gapped and not (before == "close" and t == "("):
                return place, "missing operator"
            if ranged and t != "(" and not is_ref and not (kind == "call" and _name(t) in REFERENCES):
                return place, "a range needs references"
        elif kind in ("infix", "post") or union:
            if not done and not prefix:
                return place, "missing left operand"
            if t == ":" and not ref:
                return place, "a range needs references"
        elif kind in ("sep", "close"):
            if before in ("infix", "prefix"):
                return place, "missing right operand"
            if kind == "close" and (not stack or (t == "}") != (opened == "{")):
                return place, f"unexpected {t}"
            if kind == "close" and name in ARITY:
                n = args + 1 if some or args else 0
                if not ARITY[name][0] <= n <= ARITY[name][1]:
                    return place, f"wrong number of arguments of {name}"
                if n % 2 != PARITY.get(name, n % 2):
                    return place, f"arguments of {name} come in pairs"
        else:
            return place, kind
        # A parenthesis of one reference is a reference, a call is one if its function says so.
        if kind == "close":
            stack.pop()
            ref = name in REFERENCES if opened == "call" else ref and t == ")"
        else:
            ref = is_ref or (kind == "post" and ref and t == "#")
            if kind == "sep":
                if opened == "call":
                    stack[-1][2] += 1
            elif stack:
                stack[-1][3] = True
            if kind in ("call", "open"):
                stack.append(["call", _name(t), 0, False] if kind == "call" else [t, "", 0, False])
        before, gap, ranged = "prefix" if prefix else "infix" if union else kind, False, t == ":"
    if stack:
        return at + 1, "unclosed parenthesis, call or brace"
    if before in ("infix", "prefix"):
        return at + 1, "missing right operand"
    return (at + 1, "no expression") if before == "start" else None


def _errors(formulas: pa.Array) -> pa.Array:
    found = (None if x is None else _error(x) for x in formulas.to_pylist())
    return pa.array([None if x is None else f"position {x[0]}: {x[1]}" for x in found], pa.string())


def formula_error(formula: Column) -> Column:
    """Null if a formula can be one, else ``position N: what is wrong`` (positions count from 1, with the ``=``).

    Looks at quotes, brackets, braces and parentheses, at where operands and operators
    stand, and at the number of arguments of the functions in ARITY.  A null formula is
    null, an empty one has no expression.
    """
    return F.arrow_udf(_errors, "string")(formula)


# Functions that files name with a prefix.
PREFIXED = {
    "_xlfn._xlws.": ["FILTER"],
    "_xlfn.": [
        "SORT", "SORTBY", "UNIQUE", "XLOOKUP", "XMATCH", "SEQUENCE", "RANDARRAY", "TAKE", "DROP", "HSTACK", "VSTACK", "CHOOSECOLS", "CHOOSEROWS", "EXPAND", "TOCOL", "TOROW",
        "WRAPROWS", "WRAPCOLS", "TEXTSPLIT", "TEXTBEFORE", "TEXTAFTER", "BYROW", "BYCOL", "LAMBDA", "LET", "MAP", "REDUCE", "SCAN", "MAKEARRAY",
    ],
}


def normal_formula(formula: Column) -> Column:
    """Trimmed, with ``=`` before it, ``'text'`` that names no sheet as ``"text"``, and newer functions with their prefix.

    Null and blank formulas are null.  What stands in double quotes or brackets is not changed,
    nor are the parameters of LET and LAMBDA.
    """
    body = F.regexp_replace(F.trim(formula), r"^=", "")
    parts = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0))

    def written(t: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(t, r"^'|'$", ""), "''", "'")
        out = F.when(t.rlike(r"(?s)^'(?:[^']|'')*'$"), F.concat(F.lit('"'), F.regexp_replace(inner, '"', '""'), F.lit('"'))).otherwise(t)
        for prefix, names in PREFIXED.items():
            out = F.when(t.rlike(rf"(?i)^(?:{'|'.join(names)})\($"), F.concat(F.lit(prefix), F.upper(t))).otherwise(out)
        return out

    return F.when(F.length(F.trim(formula)) > 0, F.concat(F.lit("="), F.array_join(F.transform(parts, written), "")))
