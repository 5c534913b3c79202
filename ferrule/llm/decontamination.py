"""Benchmark decontamination by template canonicalisation (operator 5).

Numbers, names and units become typed placeholders; windows of WINDOW template tokens
are hashed and joined with the windows of the benchmark items. A hit counts if its
slots are consistent: within an occurrence of the item each of its values stands for one
value of the document and the other way round, so re-parameterised questions are found
and mere likeness of form is not.

Documents meet the benchmark first on grams of GRAM template tokens: a window's grams
follow each other without a gap, and only documents with such a run are looked at
for windows, so texts of all others are neither hashed at every width nor moved. The
benchmark's grams and windows, and the documents so met, are broadcast only up to BROADCAST of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import LAST_ID, cut, held, let, order_id, packed

#: Template tokens a window; items of LEAST tokens or fewer (two at least) are one window, matched as a whole.
WINDOW, LEAST = 13, 8
#: Shorter windows for items of fewer tokens than the bound, so that one edited word leaves enough of them (from 11 tokens on).
SHORTER = ((16, 5), (26, 8))
#: A document is contaminated by an item if windows it holds cover this share of the item's tokens.
SHARE = 0.5
#: Literal (non-placeholder) tokens without which a window's slots must be equal word for word, so that forms
#: alone don't match; one less in a shorter window.
LITERALS = 5
#: Template tokens of a gram; no window is between it and GRAM - 1 wide but of items that short.
GRAM = 5
#: Rows (of 40 bytes each) up to which a side is broadcast; beyond, both sides are shuffled.
BROADCAST = 200_000
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Fixed word list: units that follow a number.
UNITS = "mm|cm|m|km|inch|inches|feet|ft|mile|miles|g|kg|mg|lb|lbs|ton|tons|s|sec|seconds|min|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|l|ml|litres|liters|percent|dollars|dollar|euros|euro|cents|degrees|mph|kmh|%|$|€"
# loops over groups are possessive: they take no stack, however long the text
_WORD = r"[\p{L}\p{M}\p{N}]++(?:[.,:][0-9]++)*+"
_TOKEN = rf"{_WORD}|[%$€]"
_NUMERIC = r"^[0-9]++(?:[.,:][0-9]++)*+$"


def _tokens(text: Column) -> Column:
    """Word and number tokens of a whole text; a name is marked by a leading `^`.

    A name is a capitalised word in the middle of a sentence, or several in a row.
    """
    marked = F.regexp_replace(text, r"([\p{Ll}0-9,;]\s++)(?=\p{Lu}\p{Ll})", "$1^")
    return F.regexp_extract_all(marked, F.lit(rf"\^{_WORD}(?:\s++\^{_WORD})*+|{_TOKEN}"), F.lit(0))


def _template(tokens: Column) -> Column:
    """Lower-case tokens with placeholders for numbers, names and the units behind numbers."""
    units = F.array(*map(F.lit, UNITS.split("|")))

    def place(token: Column, i: Column) -> Column:
        first = F.substring(token, 1, 1)
        numeric = first.between("0", "9") & token.rlike(_NUMERIC)
        before = F.when(i > 0, F.get(tokens, i - 1)).otherwise("")
        after_number = F.substring(before, 1, 1).between("0", "9") & before.rlike(_NUMERIC)
        return F.when(numeric, NUMBER).when(first == "^", NAME).when(after_number & F.array_contains(units, F.lower(token)), UNIT).otherwise(F.lower(token))

    return F.transform(tokens, place)


def _hashed(text: Column) -> Column:
    """Hashes of the template tokens."""
    return let(_tokens(F.coalesce(text, F.lit(""))), lambda t: F.transform(_template(t), lambda x: F.xxhash64(x)))


def _windows(hashes: Column, width: int) -> Column:
    """Hash of each window of `width` tokens, in order; none if the text is shorter."""
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))).otherwise(F.array().cast("array<bigint>"))


def _placed(hashes: Column, width: int) -> Column:
    return F.transform(_windows(hashes, width), lambda h, i: F.struct(h.alias("w"), F.lit(width).alias("width"), i.alias("at")))


def _values(template: Column, raw: Column, start: Column, width: Column) -> Column:
    """What stands in a window's slots, in order."""
    return F.filter(F.transform(F.sequence(start, start + width - 1), lambda i: F.when(F.substring(F.get(template, i), 1, 1) == "<", F.lower(F.get(raw, i)))), lambda v: v.isNotNull())


def _pattern(values: Column) -> Column:
    """Which slots are equal: each slot's first place of its value."""
    return F.transform(values, lambda x: F.array_position(values, x))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w, width, slots, item_id, at, windows, tokens, mine, loose, head) of every window of every item.

    Items equal as a whole are kept once, under the smallest id (a null one is the greatest). `loose` windows have
    literals enough for other values in their slots; `head` is the first token of an
    item that must be met as a whole, null for others.
    """
    tokens = benchmark.where(F.col("text").isNotNull()).select(order_id("item_id").alias("item_id"), _tokens(F.col("text")).alias("raw"))
    tokens = tokens.where(F.size("raw") > 1).groupBy("raw").agg(F.min("item_id").alias("item_id")).withColumn("template", _template(F.col("raw")))
    head = F.when(F.size("raw") <= LEAST, _plain(F.get("raw", F.lit(0)))).alias("head")
    # whether an item's first word counts as a name depends on what stands before it
    tokens = tokens.select("item_id", head, *(F.slice(c, F.lit(2), F.size(c) - 1).alias(c) for c in ("raw", "template")))
    width = F.when(F.col("head").isNotNull(), F.size("raw"))
    for most, shorter in SHORTER:
        width = width.when(F.size("raw") <= most, min(shorter, window))
    width = F.least(width.otherwise(window), F.size("raw"))
    at = F.explode(F.sequence(F.lit(0), F.size("raw") - width))
    rows = tokens.select("item_id", "head", "raw", "template", width.alias("width"), (F.size("raw") - width + 1).alias("windows"), F.size("raw").alias("tokens"), at.alias("at"))
    part = F.slice("template", F.col("at") + 1, F.col("width"))
    literal = F.size(F.filter(part, lambda x: F.substring(x, 1, 1) != "<"))
    loose = literal >= F.when(F.col("width") < window, LITERALS - 1).otherwise(LITERALS)
    mine = _values(F.col("template"), F.col("raw"), F.col("at"), F.col("width")).alias("mine")
    rows = rows.select(F.xxhash64(F.transform(part, lambda x: F.xxhash64(x))).alias("w"), "width", "item_id", "at", "windows", "tokens", mine, loose.alias("loose"), "head")
    return rows.withColumn("slots", let(F.col("mine"), _pattern))


def _plain(token: Column) -> Column:
    return F.lower(F.translate(token, "^", ""))


def item_grams(benchmark: DataFrame, items: DataFrame) -> DataFrame:
    """(g, width, run): hashes of the grams of all items, and how many of them in a row make the narrowest window of an item that has one."""
    of = benchmark.where(F.col("text").isNotNull()).select(order_id("item_id").alias("item_id"), _hashed(F.col("text")).alias("hashes"))
    rows = of.join(items.select("item_id", F.col("width").alias("window")).distinct(), "item_id")
    width = F.least("window", F.lit(GRAM))
    gram = lambda w: F.when(F.col("window") >= w, _windows(F.col("hashes"), w)).otherwise(F.array().cast("array<bigint>"))
    grams = [rows.select(F.explode(gram(GRAM)).alias("g"), width.alias("width"), (F.col("window") - width + 1).alias("run")).where(F.col("width") == GRAM)]
    for w in range(1, GRAM):
        grams.append(rows.where(F.col("window") == w).select(F.explode(_windows(F.col("hashes"), w)).alias("g"), F.lit(w).alias("width"), F.lit(1).alias("run")))
    out = grams[0]
    for more in grams[1:]:
        out = out.unionByName(more)
    return out.groupBy("g", "width").agg(F.min("run").alias("run"))


def met_documents(keyed: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc, tie) of the documents that have as many of the benchmark's grams in a row as a window takes."""
    widths = [r["width"] for r in grams.select("width").distinct().collect()]  # GRAM of them at most
    near = F.broadcast if grams.count() <= BROADCAST else (lambda x: x)
    placed = F.flatten(F.array(*(_placed(F.col("hashes"), w) for w in sorted(widths)))) if widths else F.array().cast("array<struct<w:bigint,width:int,at:int>>")
    rows = keyed.select("doc", "tie", _hashed(F.col("text")).alias("hashes")).select("doc", "tie", F.explode(placed).alias("x")).select("doc", "tie", F.col("x.w").alias("g"), "x.width", "x.at")
    met = rows.join(near(grams), ["g", "width"])
    # places in order; a run of n grams from the i-th place on ends n - 1 places and n - 1 tokens later
    places = F.array_sort(F.collect_set(F.when(F.col("width") == GRAM, F.struct("at", "run"))))
    runs = F.exists(F.transform("places", lambda p, i: F.get("places", i + p["run"] - 1)["at"] == p["at"] + p["run"] - 1), lambda x: F.coalesce(x, F.lit(False)))
    found = met.groupBy("doc", "tie").agg(places.alias("places"), F.max(F.col("width") < GRAM).alias("short"))
    return found.where(F.col("short") | runs).select("doc", "tie")


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, tie, item_id, n_hits, windows, share): consistent window hits of each document and item, and the share of its tokens they cover."""
    # checkpoints, as each plan would show those of all results held before it, again and again
    items = cut(item_windows(benchmark))
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # those of SHORTER, WINDOW and LEAST - 1 at most
    near = F.broadcast if items.count() <= BROADCAST else (lambda x: x)
    keyed = docs.select(order_id(key).alias("doc"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    documents = cut(met_documents(keyed, cut(item_grams(benchmark, items))))
    few = F.broadcast if documents.count() <= BROADCAST else (lambda x: x)
    keyed = held(keyed.join(few(documents), ["doc", "tie"], "left_semi").dropDuplicates(["doc", "tie"]))
    windows = F.flatten(F.array(*(_placed(F.col("hashes"), w) for w in sorted(widths)))) if widths else F.array().cast("array<struct<w:bigint,width:int,at:int>>")
    exploded = keyed.select("doc", "tie", _hashed(F.col("text")).alias("hashes")).select("doc", "tie", F.explode(windows).alias("x")).select("doc", "tie", "x.*")
    met = held(exploded.join(near(items.select("w", "width").distinct()), ["w", "width"]).select("doc", "tie", "w", "width", "at"))
    # the texts of documents with hits give the values of their slots
    per_doc = met.groupBy("doc", "tie").agg(F.collect_list(F.struct("w", "width", "at")).alias("met"))
    filled = keyed.join(per_doc, ["doc", "tie"]).select("doc", "tie", "met", _tokens(F.col("text")).alias("raw"))
    filled = filled.select("doc", "tie", "met", "raw", _template(F.col("raw")).alias("template"))
    valued = F.transform("met", lambda m: F.struct(m["w"].alias("w"), m["width"].alias("width"), m["at"].alias("place"), _values(F.col("template"), F.col("raw"), m["at"], m["width"]).alias("theirs"), F.when(m["at"] > 0, _plain(F.get(F.col("raw"), m["at"] - 1))).alias("before")))
    filled = filled.select("doc", "tie", F.explode(valued).alias("x")).select("doc", "tie", "x.*").withColumn("slots", let(F.col("theirs"), _pattern))
    # windows at one distance from their places in the item are one occurrence of it; each
    # value of the item must stand for one value of the document there, and the other way round
    pairs = F.zip_with("mine", "theirs", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    same = (F.col("loose") | (F.col("mine") == F.col("theirs"))) & (F.col("head").isNull() | F.coalesce(F.col("head") == F.col("before"), F.lit(False)))
    # the items are broadcast here too: a window of very many of them makes no hot key
    found = filled.join(near(items), ["w", "width", "slots"]).where(same).groupBy("doc", "tie", "item_id", "windows", "tokens", "width", (F.col("place") - F.col("at")).alias("shift"))
    found = found.agg(F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))  # of one item's length at most
    alone = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side]))) == F.size("pairs")
    hit = found.where(alone("a") & alone("b")).groupBy("doc", "tie", "item_id", "windows", "tokens", "width").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("ats"))
    # tokens of the item that its windows cover: each adds what the one before it left
    covered = F.aggregate(F.transform("ats", lambda x, i: F.least(F.col("width"), F.when(i > 0, x - F.get("ats", i - 1)).otherwise(F.col("width")))), F.lit(0), lambda n, x: n + x)
    item = F.when(F.col("item_id") < LAST_ID, F.col("item_id")).alias("item_id")
    return hit.select("doc", "tie", item, F.size("ats").cast("long").alias("n_hits"), F.col("windows").cast("long").alias("windows"), (covered / F.col("tokens")).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that no benchmark item contaminates, with all their columns."""
    found = cut(hits(docs, benchmark).where(F.col("share") >= SHARE).select("doc", "tie").distinct())
    side = F.broadcast if found.count() <= BROADCAST else (lambda x: x)
    return packed(docs, doc=order_id(), tie=F.xxhash64("text")).join(side(found), ["doc", "tie"], "left_anti").select("row.*")


def benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Operator 5: doc_id, item_id, n_hits, windows, share of each contaminated pair.

    Null texts match nothing; items of one token are left out; copies of
    an item count under the smallest item_id; repeated rows give one pair; empty
    tables give no rows; other columns are ignored.
    """
    id_ = F.when(F.col("doc") < LAST_ID, F.col("doc")).alias("doc_id")
    return hits(docs, benchmark).where(F.col("share") >= SHARE).select(id_, "item_id", "n_hits", "windows", "share")
