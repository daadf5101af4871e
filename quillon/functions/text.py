"""Text, answer and code expressions, all built from Spark's own functions."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a fence may call a language.
LANGUAGES = {
    "python": ["python", "Python", "py", "Python3", "python3", "PY"],
    "cpp": ["cpp", "c++", "C++", "Cpp", "CPP"],
    "go": ["go", "Go"],
    "java": ["java", "Java"],
    "php": ["php", "PHP"],
    "csharp": ["csharp", "c#", "C#"],
    "bash": ["bash", "Bash", "BASH", "sh", "shell"],
    "typescript": ["typescript"],
    "rust": ["rust", "Rust", "rs"],
    "sql": ["sql", "SQL", "Sql"],
    "D": ["D", "d"],
    "julia": ["julia", "Julia", "jl"],
    "lua": ["lua", "Lua"],
    "perl": ["perl", "Perl", "PERL"],
    "R": ["R", "r"],
    "ruby": ["ruby", "Ruby"],
    "scala": ["scala", "Scala"],
    "kotlin": ["kotlin", "Kotlin"],
    "c": ["c", "C"],
    "html": ["html", "Html", "HTML"],
    "nodejs": ["JS", "js"],
    "javascript": ["javascript", "Javascript", "JavaScript"],
    "verilog": ["verilog", "Verilog", "VERILOG"],
    "racket": ["racket"],
    "swift": ["swift"],
}


def _text(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def language_of(tag: Column) -> Column:
    """The language of a fence's tag, empty if unknown."""
    table = F.create_map(*[F.lit(v) for name, aliases in LANGUAGES.items() for a in aliases for v in (a, name)])
    return F.coalesce(F.try_element_at(table, F.trim(tag)), F.lit(""))


def fenced_blocks(text: str | Column) -> Column:
    """``array<struct<language, code>>`` of all closed fences."""
    pattern = "(?s)```([^\\n]*)\\n(.*?)\\n\\s*```"
    tags, codes = (F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(tags, codes, lambda t, c: F.struct(language_of(t).alias("language"), c.alias("code")))


def open_block(text: str | Column) -> Column:
    """What follows the first fence to the end of the text, as one block."""
    pattern = "(?s)```([^\\n]*)\\n(.*)"
    hit = F.regexp_like(_text(text), F.lit(pattern))
    block = F.struct(language_of(F.regexp_extract(_text(text), pattern, 1)).alias("language"), F.regexp_extract(_text(text), pattern, 2).alias("code"))
    return F.when(hit, F.array(block)).otherwise(F.array().cast("array<struct<language:string,code:string>>"))


def best_block(text: str | Column, language: str) -> Column:
    """Closed fences before an open one; the first in the language, else the first."""
    closed, open_ = fenced_blocks(text), open_block(text)
    blocks = F.when(F.size(closed) > 0, closed).otherwise(open_)
    own = F.filter(blocks, lambda b: b["language"] == language)
    return F.coalesce(F.get(own, F.lit(0))["code"], F.get(blocks, F.lit(0))["code"], F.lit(""))


def _solid_lines(text: str | Column) -> Column:
    return F.filter(F.split(_text(text), "\\n"), lambda x: F.trim(x) != "")


_RUN = "struct<done:array<string>,open:string>"


def _runs(lines: Column, starts, goes_on, end: str) -> Column:
    """Runs of lines: one begins where ``starts`` says so and goes on while ``goes_on`` does."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")).cast(_RUN)

    def step(s, x):
        inside = s["open"].isNotNull() & goes_on(s["open"], x)
        closed = F.when(s["open"].isNotNull() & ~inside, F.array_append(s["done"], s["open"])).otherwise(s["done"])
        fresh = F.when(starts(x), F.concat(x, F.lit(end)))
        return F.struct(closed.alias("done"), F.when(inside, F.concat(s["open"], x, F.lit(end))).otherwise(fresh).alias("open")).cast(_RUN)

    return F.aggregate(lines, state, step, lambda s: F.when(s["open"].isNotNull(), F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def sql_blocks(text: str | Column) -> Column:
    """Select or with statements up to a semicolon, blank lines dropped."""
    first = lambda x: F.regexp_like(F.lower(F.ltrim(x)), F.lit(r"^(select|with\s.+as)"))
    runs = _runs(_solid_lines(text), first, lambda run, x: ~F.contains(run, F.lit(";")), "\n")
    return F.transform(runs, lambda run: F.substring_index(F.rtrim(run, F.lit("\n")), ";", 1))


def python_blocks(text: str | Column) -> Column:
    """Imports and comments before a def or class, and its indented body; blank lines dropped."""
    head = lambda x: F.regexp_like(x, F.lit("^(import|from|#)."))
    block = lambda x: F.regexp_like(x, F.lit("^(def|class) ."))
    last = lambda run: F.element_at(F.split(F.rtrim(run, F.lit("\n")), "\\n"), -1)
    indented = lambda x: F.regexp_like(x, F.lit(r"^\s+\S"))
    # A head is followed by heads or a definition, a definition by its body, the body by more of it.
    goes_on = lambda run, x: F.when(head(last(run)), head(x) | block(x)).otherwise(indented(x))
    runs = _runs(_solid_lines(text), lambda x: head(x) | block(x), goes_on, "\n")
    return F.filter(runs, lambda run: F.regexp_like(run, F.lit(r"(?m)^(def|class) .*\n\s+\S")))


def freeform_code(text: str | Column, language: str, first_only: bool = False, keep_all: bool = False) -> Column:
    """The code in a completion: closed fences, else an open one, else what looks like code.

    The first block in the language (or the first of all, with ``first_only``);
    entry points and examples are cut unless ``keep_all``.
    """
    closed, open_ = fenced_blocks(text), open_block(text)
    guess = {"sql": sql_blocks, "python": python_blocks}.get(language)
    guessed = F.array().cast("array<string>") if guess is None else guess(text)
    guessed = F.transform(guessed, lambda c: F.struct(F.lit(language).alias("language"), c.alias("code")))
    blocks = F.when(F.size(closed) > 0, closed).when(F.size(open_) > 0, open_).otherwise(guessed)
    own = F.filter(blocks, lambda b: b["language"] == language)
    first = F.get(blocks, F.lit(0))["code"]
    code = F.coalesce(first if first_only else F.coalesce(F.get(own, F.lit(0))["code"], first), F.lit(""))
    return code if keep_all else strip_entry_point(code, language)


# What begins a comment line.
COMMENTS = {"python": ["#"], "java": ["//", "/*"], "cpp": ["//", "/*"], "go": ["//", "/*"], "javascript": ["//", "/*"], "sql": ["--"]}
#: String literals (kept as group 1) before block comments: what looks like a comment in one is none.
_BLOCKS = r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?s:/\*.*?\*/)"""


def first_code_line(code: str | Column, language: str) -> Column:
    """The first line that is neither blank nor a comment; a block comment or docstring is one comment."""
    c = _text(code)
    c = F.regexp_replace(c, r'(?s)^\s*(?:""".*?"""|\x27\x27\x27.*?\x27\x27\x27)', "") if language == "python" else F.regexp_replace(c, _BLOCKS, "$1")
    marks = COMMENTS.get(language, ["//", "#"])
    solid = F.filter(F.split(c, "\\n"), lambda x: (F.trim(x) != "") & ~F.greatest(*[F.startswith(F.ltrim(x), F.lit(m)) for m in (marks * 2)[: max(2, len(marks))]]))
    return F.coalesce(F.get(solid, F.lit(0)), F.lit(""))


def tag_count(text: str | Column, tag: str = "answer") -> Column:
    """``struct<opens, closes>``: how often a tag opens and closes."""
    count = lambda mark: ((F.length(_text(text)) - F.length(F.replace(_text(text), F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    return F.struct(count(f"<{tag}>").alias("opens"), count(f"</{tag}>").alias("closes"))


def jest_cases(report: str | Column) -> Column:
    """``array<struct<suite, test, passed>>`` of a test report in JSON: its suites' assertions."""
    kind = "struct<testResults:array<struct<name:string,assertionResults:array<struct<fullName:string,status:string>>>>>"
    suites = F.from_json(_text(report), kind)["testResults"]
    each = F.transform(
        suites,
        lambda s: F.transform(
            F.coalesce(s["assertionResults"], F.array().cast("array<struct<fullName:string,status:string>>")),
            lambda a: F.struct(s["name"].alias("suite"), a["fullName"].alias("test"), (a["status"] == "passed").alias("passed")),
        ),
    )
    return F.coalesce(F.flatten(each), F.array().cast("array<struct<suite:string,test:string,passed:boolean>>"))


# Codes of a test case that gave no verdict.
CASE_CODES = {"sandbox": -1, "runtime": -2, "timeout": -3, "compile": -4}


def case_result(api: str | Column, compile_: str | Column, run: str | Column, stdout: str | Column, expected: str | Column) -> Column:
    """1 or 0 by the output, else the code of what went wrong first."""
    return (
        F.when(_text(api) != "ok", CASE_CODES["sandbox"]).when(_text(compile_) != "success", CASE_CODES["compile"]).when(_text(run) == "timeout", CASE_CODES["timeout"])
        .when(_text(run) != "success", CASE_CODES["runtime"]).otherwise(output_matches(stdout, expected).cast("int"))
    )


def strip_entry_point(code: str | Column, language: str) -> Column:
    """Cut a main guard (python) or main function (cpp), drop go's package line, cut an example."""
    c = _text(code)
    if language == "python":
        c = F.regexp_replace(c, r"(?s)if __name__ == ['\"]__main__['\"]:.*", "")
    elif language == "cpp":
        c = F.regexp_replace(c, r"(?s)int main\(\).*", "")
    elif language == "go":
        c = F.regexp_replace(c, r"package main", "")
    return F.regexp_replace(c, r"(?s)# Example usage.*", "")


def trim_at_stops(text: str | Column, stops: list[str]) -> Column:
    """Cut at the first hit of each stop in turn: plain, or a pattern after ``re:``."""
    c = _text(text)
    for stop in stops:
        pattern = stop[3:] if stop.startswith("re:") else re.escape(stop)
        c = F.regexp_replace(c, f"(?s)(?:{pattern}).*", "")
    return c


def middle_truncated(text: str | Column, most: int = 1000, placeholder: str = "...") -> Column:
    """Both ends with a placeholder between, where the text is longer than ``most``."""
    most = max(most, len(placeholder) + 2)
    keep = (most - len(placeholder)) // 2
    c = _text(text)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, keep), F.lit(placeholder), F.right(c, F.lit(keep))))


def float_equal(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-10)) < tolerance


def number(text: Column) -> Column:
    """A plain decimal as double, else null (Spark's cast would take '12d' as well)."""
    return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text).try_cast("double"))


def output_matches(actual: str | Column, expected: str | Column) -> Column:
    """Line by line, case and outer blanks aside; numbers within 1e-5."""
    lines = [F.split(F.regexp_replace(_text(x), r"^\s+|\s+$", ""), "\\n") for x in (actual, expected)]
    same = F.zip_with(
        *lines,
        lambda a, b: (F.lower(F.trim(a)) == F.lower(F.trim(b))) | F.coalesce(float_equal(number(a), number(b)), F.lit(False)),
    )
    return (F.size(lines[0]) == F.size(lines[1])) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


# --- answers ----------------------------------------------------------------

#: Characters at the end of a solution that are searched for its answer.
CLIP = 300


def hash_answer(text: str | Column, strict: bool = True) -> Column:
    """The last ``#### n`` of the final characters, or there the last number at all."""
    tail = F.right(_text(text), F.lit(CLIP))
    if strict:
        return F.replace(F.try_element_at(F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1)), F.lit(-1)), F.lit(","), F.lit(""))
    found = F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(found, lambda x: x != ".")
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.get(found, F.lit(0)))


def match_score(answer: Column, truth: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


def normal_answer(text: str | Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks (in that order)."""
    c = F.translate(F.lower(_text(text)), string.punctuation, "")
    c = F.regexp_replace(c, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def exact_match(prediction: Column, golden: Column) -> Column:
    """True if any golden answer is equal after normalisation."""
    p = normal_answer(prediction)
    return F.exists(golden, lambda g: normal_answer(g) == p)


def substring_match(prediction: Column, golden: Column) -> Column:
    p = normal_answer(prediction)
    return F.exists(golden, lambda g: F.contains(p, normal_answer(g)))


def tagged_answer(text: str | Column) -> Column:
    """What the last ``<answer>`` element holds."""
    return F.trim(F.try_element_at(F.regexp_extract_all(_text(text), F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def answer_score(text: str | Column, golden: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    """Exact match of the tagged answer; a quarter where more than ten tags stand."""
    answer, c = tagged_answer(text), _text(text)
    many = (F.regexp_count(c, F.lit("<answer>")) > 10) | (F.regexp_count(c, F.lit("</answer>")) > 10)
    good = F.when(many, score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when(exact_match(answer, golden), good).otherwise(format_score)


def last_answer_line(text: str | Column) -> Column:
    """What the last ``Answer:`` line says, ``[INVALID]`` if there is none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(_text(text), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1)), F.lit("[INVALID]"))


# --- cleaning ---------------------------------------------------------------


def wiki_clean(text: str | Column) -> Column:
    """Titles to sentence ends, bracketed parts dropped, one pass over double blanks."""
    c = F.replace(F.trim(_text(text)), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(c, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def masked(df: DataFrame, pattern: str) -> DataFrame:
    """A pattern replaced by ``*`` in every string column."""
    return df.select(*[F.regexp_replace(n, pattern, "*").alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def metric_key(key: str | Column) -> Column:
    """``@`` as ``_at_``, single slashes, other characters that loggers refuse as ``_``."""
    c = F.replace(_text(key), F.lit("@"), F.lit("_at_"))
    return F.regexp_replace(F.regexp_replace(c, "/+", "/"), r"[^/\w.\- :]", "_")


def flat(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns named by their path."""
    from pyspark.sql.types import StructType

    def leaves(schema: StructType, path: list[str]):
        for f in schema:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, [])])


def tool_calls(text: str | Column) -> Column:
    """``array<struct<name, arguments>>`` of tagged JSON calls; broken JSON is left out."""
    found = F.regexp_extract_all(_text(text), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(found, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda x: x["name"].isNotNull())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside a lambda it would be for every element."""
    return F.transform(F.array(value), body)[0]


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Least counts over greatest counts of the values of two arrays; 1 if both are empty."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v)))
    return _let(common, lambda n: F.coalesce(F.try_divide(n.cast("double"), (F.size(a) + F.size(b) - n).cast("double")), F.lit(1.0)))


def tool_call_score(wanted: str | Column, made: str | Column, most: float = 3.0, least: float = -3.0) -> Column:
    """Score of made calls against wanted ones, both ``array<struct<name: string, parameters: map<string, string>>>``.

    One point for the names as a multiset, and for each wanted call, in order, what its best
    unused match of that name has in keys (Jaccard) and equal values; the first of equals is
    taken, one without any point is none.  The share of what was to be had is scaled to
    ``least`` .. ``most``.  Null arrays are empty, null parameters too.
    """
    none = F.create_map().cast("map<string, string>")

    def read(calls: str | Column) -> Column:
        calls = F.coalesce(_text(calls), F.array()).cast("array<struct<name: string, parameters: map<string, string>>>")
        own = lambda x: F.coalesce(x["parameters"], none)
        return F.transform(calls, lambda x: F.struct(x["name"].alias("name"), own(x).alias("own"), F.map_keys(own(x)).alias("keys")))

    def points(w: Column, m: Column) -> Column:
        values = F.size(F.filter(w["keys"], lambda k: F.try_element_at(w["own"], k) == F.try_element_at(m["own"], k)))
        union = lambda n: F.size(w["keys"]) + F.size(m["keys"]) - n
        keys = _let(F.size(F.array_intersect(w["keys"], m["keys"])), lambda n: F.coalesce(F.try_divide(n.cast("double"), union(n).cast("double")), F.lit(1.0)))
        return keys + values

    def score(calls: Column) -> Column:
        want, got = calls["want"], calls["got"]

        def match(s: Column, w: Column) -> Column:
            # Unused calls of the name with their points; the negative place puts the first of equals on top.
            open_ = F.transform(got, lambda m, i: F.when((m["name"] == w["name"]) & ~F.array_contains(s["used"], i), F.struct(points(w, m).alias("points"), (-i).alias("place"))))
            return _let(
                F.array_max(F.filter(open_, lambda x: x["points"] > 0)),
                lambda best: F.struct((s["score"] + F.coalesce(best["points"], F.lit(0.0))).alias("score"), F.when(best.isNull(), s["used"]).otherwise(F.array_append(s["used"], -best["place"])).alias("used")),
            )

        start = F.struct(calls["names"].alias("score"), F.array().cast("array<int>").alias("used"))
        best = F.aggregate(want, F.lit(1.0), lambda s, w: s + 1 + F.size(w["keys"]))
        return F.aggregate(want, start, match)["score"] / best * (most - least) + least

    names = lambda x: multiset_jaccard(*(F.transform(x[side], lambda call: call["name"]) for side in ("want", "got")))
    both = F.struct(read(wanted).alias("want"), read(made).alias("got"))
    return _let(both, lambda x: _let(F.struct(x["want"].alias("want"), x["got"].alias("got"), names(x).alias("names")), score))


def run_status(compile_: Column, run: Column) -> Column:
    """Status of a judged run from its compile and run results."""
    return F.when(compile_ == "timeout", "CompileTimeout").when(compile_ == "failed", "CompileFailed").when(run == "timeout", "RunTimeout").when(run == "success", "Success").otherwise("Failed")


def scorer(source: str | Column, scorers: dict[str, Column], default: Column | None = None) -> Column:
    """The scorer whose data source a row names."""
    out = None
    for name, score in scorers.items():
        out = F.when(_text(source) == name, score) if out is None else out.when(_text(source) == name, score)
    return out.otherwise(F.lit(None) if default is None else default)


def prompt_record(source: str, question: Column, answer: Column, split: str, index: Column) -> list[Column]:
    """The columns of a standard prompt record."""
    return [
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), answer.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index")).alias("extra_info"),
    ]
