"""Secret scans with built-in expressions only (operator 8).

Three fixed kinds come from patterns. The method adds `entropy` spans: candidate
strings are scanned by a window of WINDOW characters whose symbol counts and
sum of c log2 c are updated by the character that enters and the one that leaves;
where the Shannon entropy reaches the bound of the string's character class, the
windows are a span, but for what the three kinds have of it, unless the allow-list names
the string or all of the span that is long enough to matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import let, packed

#: Fixed patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no later match that is longer
HEX = r"[0-9a-f]{32,}"  # likewise [0-9a-f]+ of 32 or more
KINDS = ("assign", "access", "hex", "entropy")
VALUE_LENGTH = 8
#: Candidates: whole runs of token characters; the classes, by alphabet, and their entropy bounds in bits a character.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_BITS, TOKEN_BITS = 3.0, 3.75
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that look random and aren't secret (those without a digit or a letter are none either).
#: Loops over groups are possessive: they take no stack, however long the string.
ALLOW = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^/?(?:[a-z]+[-_]?[0-9]{0,4}[/_=-])++[a-z]*[0-9]{0,4}$",  # paths and slugs
)
#: A part of a string, between these separators, that holds such a word is no secret; the rest of the string may be one.
ALLOWED_WORD = r"(?i)example|sample|placeholder|dummy|xxxx|0{8}|1234567"
SEPARATOR = "[/_=-]"
MASK = "[SECRET]"
_BLOCK = 256


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """Sums of all earlier elements, through sums of blocks, so that many matches stay cheap."""
    blocks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))).otherwise(F.array().cast("array<int>"))

    def inside(starts: Column) -> Column:
        return F.transform(lengths, lambda _, i: F.get(starts, F.floor(i / _BLOCK).cast("int")) + _total(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))

    return let(blocks, lambda b: let(F.transform(b, lambda _, i: _total(F.slice(b, F.lit(1), i))), inside))


_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points; value is the group's text.

    The pieces between the matches and the matches tile the text, so lengths give places.
    """
    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def spans(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["p"], i)))
        make = lambda before: F.transform(
            x["m"],
            lambda m, i: let(F.get(before, i) + F.length(F.get(x["p"], i)), lambda s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("end"), F.get(x["v"], i).alias("value"))),
        )
        return let(lengths, lambda n: let(_before(n), make))

    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _random_part(value: Column) -> Column:
    """(first, last) start of the windows of a string whose entropy reaches its class's bound; -1 if none does."""
    worth = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    bound = F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(TOKEN_BITS))

    def scan(x: Column) -> Column:
        symbols, least = x["symbols"], x["bound"]
        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def step(acc: Column, i: Column) -> Column:
            into, out = F.get(symbols, i), F.coalesce(F.when(i >= WINDOW, F.get(symbols, i - WINDOW)), F.lit(-1))

            def update(c: Column) -> Column:
                changed = F.when(into == out, acc["sum"]).otherwise(
                    acc["sum"] + F.get(worth, c["into"] + 1) - F.get(worth, c["into"]) + F.when(out >= 0, F.get(worth, c["out"] - 1) - F.get(worth, c["out"])).otherwise(0.0)
                )
                counts = F.transform(acc["counts"], lambda n, k: n + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
                hit = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - changed / WINDOW >= least)
                return F.struct(
                    counts.alias("counts"), F.coalesce(changed, F.lit(0.0)).alias("sum"),
                    F.when(hit & (acc["first"] < 0), i - WINDOW + 1).otherwise(acc["first"]).alias("first"),
                    F.when(hit, i - WINDOW + 1).otherwise(acc["last"]).alias("last"),
                )

            return let(F.struct(F.get(acc["counts"], into).alias("into"), F.get(acc["counts"], out).alias("out")), update)

        return F.aggregate(F.sequence(F.lit(0), F.size(symbols) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    symbols = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    return let(F.struct(symbols.alias("symbols"), bound.alias("bound")), scan)


def _entropy_spans(text: Column) -> Column:
    def suspicious(s: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | s["value"].rlike(pattern)
        return s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & ~allowed

    measured = F.transform(F.filter(_matches(text, CANDIDATE, 3), suspicious), lambda s: F.struct(s.alias("s"), _random_part(s["value"]).alias("r")))

    def random(x: Column) -> Column:
        part = F.substring(x["s"]["value"], x["r"]["first"] + 1, x["r"]["last"] - x["r"]["first"] + WINDOW)
        rest = F.filter(F.split(part, SEPARATOR), lambda word: ~word.rlike(ALLOWED_WORD))
        return (x["r"]["first"] >= 0) & (~part.rlike(ALLOWED_WORD) | let(F.array_join(rest, ""), lambda r: (F.length(r) >= WINDOW) & r.rlike("[0-9]")))

    return F.transform(
        F.filter(measured, random),
        lambda x: F.struct((x["s"]["start"] + x["r"]["first"]).alias("start"), F.lit(3).alias("rank"), (x["s"]["start"] + x["r"]["last"] + WINDOW).alias("end"), F.lit("").alias("value")),
    ).cast(_SPAN)


def _without(span: Column, base: Column) -> Column:
    """The parts of a span that no base span covers; base is in order of start."""
    state = F.struct(F.array().cast(_SPAN).alias("out"), span["start"].alias("at"))
    part = lambda start, end: F.when(start < end, F.array(F.struct(start.alias("start"), span["rank"].alias("rank"), end.alias("end"), F.lit("").alias("value")))).otherwise(F.array()).cast(_SPAN)

    def step(acc: Column, o: Column) -> Column:
        return F.struct(F.concat(acc["out"], part(acc["at"], F.least(o["start"], span["end"]))).alias("out"), F.greatest(acc["at"], o["end"]).alias("at"))

    met = F.filter(base, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))
    return F.aggregate(met, state, step, lambda acc: F.concat(acc["out"], part(acc["at"], span["end"])))


def spans_of(text: Column) -> Column:
    """Array of (start, rank, end) of all spans, ordered; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    assign = F.filter(_matches(whole, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= VALUE_LENGTH)
    base = F.array_sort(F.concat(assign, _matches(whole, ACCESS, 1), _matches(whole, HEX, 2)))

    def with_entropy(b: Column) -> Column:
        fresh = F.flatten(F.transform(_entropy_spans(whole), lambda s: _without(s, b)))
        return F.transform(F.array_sort(F.concat(b, fresh)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    return let(base, with_entropy)


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by MASK; texts without spans, and nulls, stay as they are."""

    def masked(text: Column, spans: Column) -> Column:
        # overlapping spans: a span begins a cut only where all before it have ended
        state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, s: Column) -> Column:
            piece = F.when(s["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.concat(acc["out"], piece).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        return F.aggregate(spans, state, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))

    rows = packed(docs, spans=spans_of(F.col(f"`{text}`")))
    whole = F.col("row").getField(text)
    return rows.select(F.col("row").withField(f"`{text}`", F.when(F.size("spans") > 0, masked(whole, F.col("spans"))).otherwise(whole)).alias("row")).select("row.*")


def secret_scan(docs: DataFrame) -> DataFrame:
    """Operator 8: doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    Null texts have no spans; repeated rows give repeated rows; an empty table gives
    no rows; other columns are ignored.
    """
    spans = F.col("found")
    count = lambda rank: F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
    rows = docs.select("doc_id", spans_of(F.col("text")).alias("found"))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"), joined(spans).alias("spans"))
