"""I-Match document fingerprints with built-in expressions only (operator 4).

The lexicon holds the terms of a band of document frequencies. A text's distinct lexicon
terms, sorted, are hashed once for each of SLOTS random subsets of the lexicon; a term is
in a subset by its hash, so any text meets the same subsets. Longer texts use sparser
subsets (scale s keeps a 2^s-th), so that a subset holds one to three terms of a text and
survives partial edits; a fingerprint has its own scale and the next, so texts of
similar length always share one. A subset without a lexicon term of the text takes its
other terms, each subset for itself, so that texts of a large group of copies, whose terms are
above the band, have fingerprints too and one edit doesn't change all of one. Likeness is the
share of equal subsets among those that hold a term of either text.

Next documents come from a distributed sort of ids. Texts are dealt out once by id;
everything about a document and its edited text is computed where its text lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.llm.common import LAST_ID, held, let, order_id

#: The band: terms in at least LOW of the documents (two at least) and at most HIGH of them.
#: At most (terms a document) / LOW terms can be in the band, whatever the corpus's size.
LOW, HIGH = 1 / 2000, 1 / 10
#: Lexicon terms, or repeated texts, up to which they are broadcast; more are joined by shuffling.
BROADCAST = 1_000_000
#: Lexicon subsets, hex digits of each one's hash, and distinct terms a text of scale 0 has at most.
SLOTS, DIGITS, TERMS = 32, 3, 72
#: Ids a partition of the global order.
ORDERED = 50_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: lower-cased runs without ASCII punctuation or white space."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), _SEPARATORS), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(keyed: DataFrame) -> DataFrame:
    """(term): hashes of the terms whose document frequency is in the band, over all distinct texts of doc, tie, text.

    Copies of a text count once, under the smallest id, so that the terms of a large
    group of copies are no more frequent than others.
    """
    copies = held(keyed.groupBy("tie").agg(F.min("doc").alias("least"), F.count("*").alias("rows")).where(F.col("rows") > 1))
    n, more = copies.agg(F.count("*"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0))).first()
    side = F.broadcast if n <= BROADCAST else (lambda x: x)
    once = keyed.join(side(copies.select("tie", "least")), "tie", "left").where(F.col("least").isNull() | (F.col("least") == F.col("doc")))
    texts = keyed.count() - more
    counts = once.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    return held(counts.where((F.col("df") >= texts * LOW) & (F.col("df") <= max(2.0, texts * HIGH))).select("term"))


def _scale(n_terms: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(n_terms / TERMS))).cast("int")


def _subset(term: Column, scale: Column) -> Column:
    """Number of the term's subset among SLOTS x 2^scale; those below SLOTS are used."""
    return term.bitwiseAND(F.call_function("shiftleft", F.lit(SLOTS).cast("long"), scale) - 1)


def _digest(found: Column, scale: Column) -> Column:
    """The digests of all subsets, from (in_band, term) of the terms in used ones."""
    used = F.array_sort(F.transform(F.filter(found, lambda x: _subset(x["term"], scale) < SLOTS), lambda x: F.struct((~x["in_band"]).alias("other"), _subset(x["term"], scale).alias("subset"), x["term"].alias("term"))))

    def parts(x: Column) -> Column:
        # numbers of subsets, those of other terms after those of lexicon terms: each subset's terms are a slice
        numbers = F.transform(x, lambda y: y["subset"] + F.when(y["other"], SLOTS).otherwise(0))
        return let(F.struct(numbers.alias("numbers"), F.reverse(numbers).alias("back"), x["term"].alias("terms")), digests)

    def digests(x: Column) -> Column:
        n = F.size(x["terms"])

        def subset(j: Column) -> Column:
            first = lambda k: F.array_position(x["numbers"], k).cast("int")
            hashed = lambda k, at: F.substring(F.lpad(F.lower(F.hex(F.xxhash64(F.slice(x["terms"], at, n - F.array_position(x["back"], k).cast("int") + 2 - at)))), 16, "0"), 17 - DIGITS, DIGITS)
            at = F.struct(first(j).alias("own"), first(j + SLOTS).alias("other"))
            return let(at, lambda a: F.when(a["own"] > 0, hashed(j, a["own"])).when(a["other"] > 0, hashed(j + SLOTS, a["other"])).otherwise("-" * DIGITS))

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")), subset), "")

    return let(used, parts)


def _fingerprint(found: Column, scale: Column) -> Column:
    return F.concat_ws(":", scale.cast("string"), _digest(found, scale), _digest(found, scale + 1))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints, 0 where no scale is shared."""

    def compare(x: Column) -> Column:
        p, q = x["p"], x["q"]
        sp, sq = F.get(p, 0).cast("int"), F.get(q, 0).cast("int")
        # the sparser of both scales, if the other fingerprint has it too
        s = F.greatest(sp, sq)
        left, right = F.get(p, s - sp + 1), F.get(q, s - sq + 1)
        at = lambda text, j: F.substring(text, j * DIGITS + 1, DIGITS)
        empty = "-" * DIGITS
        slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
        either = F.size(F.filter(slots, lambda j: (at(left, j) != empty) | (at(right, j) != empty)))
        same = F.size(F.filter(slots, lambda j: (at(left, j) != empty) & (at(left, j) == at(right, j))))
        return F.when((F.abs(sp - sq) > 1) | (either == 0), 0.0).otherwise(same / either)

    return F.when(a == b, 1.0).otherwise(let(F.struct(F.split(a, ":").alias("p"), F.split(b, ":").alias("q")), compare))


def _order(keyed: DataFrame) -> DataFrame:
    """(doc, tie, n, times, next_doc, next_tie): the following document by descending doc; after the last the first. Rows alike in both are one, `times` over."""
    ids = held(keyed.groupBy("doc", "tie", F.length("text").alias("n")).agg(F.count("*").alias("times")))
    by = (F.col("doc").desc(), F.col("tie"))
    parts = max(1, -(-ids.count() // ORDERED))
    dealt = held(ids.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part").orderBy(*by)
    ranked = dealt.select("*", F.lead(F.struct("doc", "tie")).over(inside).alias("next"), F.row_number().over(inside).alias("rank"))
    # one row a partition
    firsts = ranked.where("rank = 1").select("part", F.struct("doc", "tie").alias("first"))
    around = W.orderBy("part")
    carry = firsts.select(F.col("part").alias("p"), F.coalesce(F.lead("first").over(around), F.first("first").over(around)).alias("carry"))
    placed = ranked.join(carry, F.col("part") == F.col("p")).withColumn("next", F.coalesce("next", "carry"))
    return held(placed.select("doc", "tie", "n", "times", F.col("next.doc").alias("next_doc"), F.col("next.tie").alias("next_tie")))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc, tie, n (code points), times (rows alike), next_doc, next_tie, sha (of the edited text), fingerprint, edited_fingerprint."""
    keyed = docs.select(order_id(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    band = lexicon(keyed)
    order = _order(keyed)
    whole = keyed.dropDuplicates(["doc", "tie"]).select("doc", "tie", "text")
    third = F.floor(F.col("n") / 3).cast("int")
    meta = ["n", "times", "next_doc", "next_tie"]
    wanted = order.select(F.col("next_doc").alias("doc"), F.col("next_tie").alias("tie"), F.col("doc").alias("to_doc"), F.col("tie").alias("to_tie"), third.alias("m"), F.col("n").alias("to_n"), "times")
    heads = whole.join(wanted, ["doc", "tie"]).select(F.col("to_doc").alias("doc"), F.col("to_tie").alias("tie"), F.col("doc").alias("next_doc"), F.col("tie").alias("next_tie"), "m", F.col("to_n").alias("n"), "times", F.substring("text", F.lit(1), F.col("m")).alias("head"))
    edited = whole.join(heads, ["doc", "tie"]).select("doc", "tie", *meta, "text", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("m")), F.col("head")).alias("edited"))

    def used(found: Column) -> Column:
        """A text's scale and its terms in used subsets."""
        return let(found, lambda t: let(_scale(F.size(t)), lambda s: F.struct(s.alias("s"), F.filter(t, lambda x: _subset(x, s) < SLOTS).alias("terms"))))

    both = F.struct(used(terms(F.col("text"))).alias("own"), used(terms(F.col("edited"))).alias("edited"), F.sha2("edited", 256).alias("sha"))

    def rows_of(x: Column) -> Column:
        """One row a term, and one (of which -1) with all else, so that the rows of terms are narrow."""
        about = F.struct(*(F.col(c).alias(c) for c in meta), x["sha"].alias("sha"), x["own"]["s"].alias("s"), x["edited"]["s"].alias("es"))
        row = lambda which, term, about: F.struct(F.lit(which).alias("which"), term.alias("term"), about.alias("about"))
        term_rows = lambda which, side: F.transform(x[side]["terms"], lambda t: row(which, t, F.when(F.lit(False), about)))
        return F.concat(term_rows(0, "own"), term_rows(1, "edited"), F.array(row(-1, F.lit(None).cast("long"), about)))

    rows = edited.select("doc", "tie", F.explode(let(both, rows_of)).alias("y")).select("doc", "tie", "y.*")
    side = F.broadcast if band.count() <= BROADCAST else (lambda x: x)
    rows = rows.join(side(band.withColumn("in_band", F.lit(True))), "term", "left")
    entry = F.struct(F.coalesce("in_band", F.lit(False)).alias("in_band"), "term")
    of = lambda which: F.collect_list(F.when(F.col("which") == which, entry))
    found = rows.groupBy("doc", "tie").agg(F.first("about", ignorenulls=True).alias("about"), of(0).alias("own"), of(1).alias("edited"))
    made = found.select("doc", "tie", "about.*", "own", "edited")
    return made.select("doc", "tie", *meta, "sha", _fingerprint(F.col("own"), F.col("s")).alias("fingerprint"), _fingerprint(F.col("edited"), F.col("es")).alias("edited_fingerprint"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Operator 4: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty; different texts under one id follow each other by their
    hash; rows alike in both are one document and give a row each; the only document
    is its own next; a null id orders as the greatest; an empty table gives no rows;
    other columns are ignored.
    """
    made = held(fingerprints(docs))
    following = made.select(F.col("doc").alias("next_doc"), F.col("tie").alias("next_tie"), F.col("fingerprint").alias("next"))
    rows = made.join(following, ["next_doc", "next_tie"])
    id_ = F.when(F.col("doc") == F.lit(LAST_ID), F.lit(None)).otherwise(F.col("doc")).cast("long")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        id_.alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
