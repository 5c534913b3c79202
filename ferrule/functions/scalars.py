"""Scalar functions of the queries, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed, beyond the space.
BLANKS = " \t\n\r\f\x0b\x85\xa0                　"
#: The eight kinds of symbol_lookup, in the order an error names them.
KINDS = ("function", "variable", "typedef", "struct", "union", "enum", "macro", "enum_value")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def contains_ci(text: Column, part: str) -> Column:
    """Literal substring without regard to case."""
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def function_signature(source: Column) -> Column:
    """What stands before the first brace, after leading comments; all of it if there is none."""
    code = F.regexp_replace(source, r"\A(?:[ \t\r\n]+|//[^\n]*(?:\n|\z)|/\*[\s\S]*?\*/)*+", "")
    return trimmed(F.regexp_extract(code, r"\A([^{]*)", 1))


def first_line(text: Column) -> Column:
    return trimmed(F.get(F.split(text, r"\r?\n", 2), 0))


def macro_signature(name: Column, kind: Column, value: Column) -> Column:
    """#define NAME, with the parameters of a function-like macro."""
    params = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*(\([^)]*\))", 1)
    return F.when(kind == "macro_fn", F.concat(F.lit("#define "), name, F.when(params == "", "(...)").otherwise(params))).otherwise(F.concat(F.lit("#define "), name))


def symbol_source(name: Column, kind: Column, value: Column) -> Column:
    """A symbol's text: #define lines, or an enumerator with its value."""
    plain = F.when(kind == "define", F.concat(F.lit("#define "), name)).otherwise(name)
    whole = F.when(kind == "macro_fn", F.concat(F.lit("#define "), name, value)).when(kind == "define", F.concat(F.lit("#define "), name, F.lit(" "), value)).otherwise(F.concat(name, F.lit(" = "), value))
    return F.when(value.isNull(), plain).otherwise(whole)


def enum_signature(name: Column, value: Column) -> Column:
    return F.coalesce(F.concat(name, F.lit(" = "), value), name)


def with_header(file: Column, line: Column, source: Column) -> Column:
    return F.concat(F.lit("// file: "), file, F.lit("\n// line: "), line.cast("string"), F.lit("\n\n"), source)


def trim_value(text: Column, limit: int = 200) -> Column:
    """Trimmed; beyond `limit` bytes cut at a character and marked."""
    t = trimmed(text)
    raw = F.encode(t, "UTF-8")
    # the last character that begins within the limit may reach beyond it
    cut = lambda k: F.substring(raw, 1, limit - k)
    whole = lambda k: F.is_valid_utf8(cut(k).cast("string"))
    head = F.when(whole(0), cut(0)).when(whole(1), cut(1)).when(whole(2), cut(2)).otherwise(cut(3)).cast("string")
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(head, F.lit("…")))


def cache_slots(files: Column, overhead_percent: int) -> Column:
    """Entries a cache may hold: files plus the overhead, rounded down."""
    return F.floor(files * (100 + overhead_percent) / 100).cast("long")


def clamp_score(score: Column, points: Column) -> Column:
    """Rounded half to even, between 0 and the criterion's points."""
    return F.least(F.greatest(F.bround(score, 0), F.lit(0.0)), points.cast("double")).cast("long")


def percent(score: Column, most: Column) -> Column:
    return F.when(most > 0, score / most * 100).otherwise(F.lit(0.0))


def parse_scores(text: Column, shape: str) -> Column:
    """A judge's answer as a struct: code fences go, then JSON, or else what stands between the outer braces."""
    bare = trimmed(F.regexp_replace(text, r"```(?:json)?\s*", ""))
    inner = F.regexp_extract(bare, r"(\{[\s\S]*\})", 1)
    parsed = lambda x: F.when(x != "", F.try_parse_json(x)).isNotNull()
    return F.when(parsed(bare), F.from_json(bare, shape)).when(parsed(inner), F.from_json(inner, shape))
