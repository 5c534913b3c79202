"""Groups of documents whose sets of word shingles have a Jaccard similarity of a bound or more.

Texts with equal sets are one class. Classes are compared in three passes:

1. Candidates: classes whose SimHash fingerprints collide in a table of the covering
   family (operator 6), and every class with the first one of each of its prefix
   buckets. A prefix is the rarest shingles of a set, as many as two similar sets can't
   do without having one in common, so the buckets hold every similar pair, which no
   family of a few hundred masks does at a similarity of 0.8 (about a seventh of the bits differ).
2. Members of a bucket outside its largest component with some of that, and some outside.
3. Pairs of a bucket that are still in different components, cut into blocks of rows.

Sizes and parity bitmaps rule out pairs that can't be similar; the shingle sets
decide all others. A set travels once to each class it is compared with first.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import cut, held, order_id, small_batches
from ferrule.llm.components import components
from ferrule.llm.simhash import SEED, covering_edges, fingerprint, shingle_hashes, signed

#: Words a shingle and least Jaccard similarity of the shingle sets.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a set's parity bitmap for each of its shingles, rounded up to a power of two; in buckets it is folded COARSE times.
PARITY, COARSE = 2, 1
#: Texts of the sample by which shingles are ordered (any order is exact), and in how many of them a shingle is frequent.
SAMPLED, FREQUENT = 4000, 3
#: Sets to be compared up to which they are broadcast to the texts; beyond, both sides are shuffled.
BROADCAST = 200_000
#: Members of a bucket's largest component that each other member is compared with before all pairs are.
LEADERS = 8
#: Sets compared with one copy of a leader's; outsiders and members of a bucket in one block.
FOLLOWERS, OUTSIDERS, MEMBERS = 512, 256, 8192


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, size)]))


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in FREQUENT or more texts of a sample of about SAMPLED, sorted, and in how many."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, size).view(np.int64))], names=["token"])

    one_in = max(1, texts.count() // SAMPLED)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text").distinct()
    found = sample.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    tokens, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def prefix(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest shingles of a set, as many as make sure that two similar sets have one of them in common."""
    known, n = frequent
    times = np.zeros(len(tokens), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        times = np.where(known[at] == tokens, n[at], 0)
    return tokens[np.lexsort((tokens, times))[: len(tokens) - int(np.ceil(similarity * len(tokens) - 1e-9)) + 1]]


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of 128 bits or more: each is the parity of the number of shingles that fall on it."""
    size = max(128, 1 << (PARITY * len(tokens) - 1).bit_length() if len(tokens) else 0)
    bits = np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _fold(bitmap: np.ndarray) -> np.ndarray:
    """The bitmap (or rows of them) of half the size."""
    half = bitmap.shape[-1] // 2
    return bitmap[..., :half] ^ bitmap[..., half:]


def _folded(bits: Column) -> Column:
    """`_fold` as an expression; a bitmap of one word stays as it is."""
    half = F.floor(F.size(bits) / 2).cast("int")
    return F.when(half > 0, F.transform(F.sequence(F.lit(0), F.greatest(half - 1, F.lit(0))), lambda i: F.get(bits, i).bitwiseXOR(F.get(bits, i + half)))).otherwise(bits)


def _prints(keyed: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc, tie, class (equal sets), n, f0 (fingerprint), bits (parity bitmap) and prefix of every row."""
    small_batches(keyed.sparkSession)
    frequent = keyed.sparkSession.sparkContext.broadcast(_frequent(keyed, size))

    def run(batches):
        for batch in batches:
            sets, f0 = [], []
            for text in batch.column(2).to_pylist():
                hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, size)])
                f0.append(signed(fingerprint([hashes])))
                sets.append(np.unique(hashes))
            made = [pa.array([signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(f0, pa.int64())]
            made.append(pa.array([parity(s) for s in sets], pa.list_(pa.int64())))
            # half of a hash will do for a place to meet
            made.append(pa.array([prefix(s, frequent.value, similarity).astype(np.uint32).view(np.int32) for s in sets], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc", "tie", "class", "n", "f0", "bits", "prefix"])

    return keyed.select("doc", "tie", "text").mapInArrow(run, "doc long, tie long, class long, n int, f0 long, bits array<long>, prefix array<int>")


def _candidates(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a < b: each class with the first of its bucket, and with those whose fingerprint is near its own."""
    alike = classes.groupBy("f0").agg(F.min("class").alias("first"))
    near = covering_edges(classes.select("f0"))
    named = lambda s: alike.select(F.col("f0").alias(s), F.col("first").alias(f"{s}_first"))
    near = near.join(named("a"), "a").join(named("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    same = classes.select("class", "f0").join(alike, "f0").select(F.col("first").alias("a"), F.col("class").alias("b"))
    met = shared.select(F.col("lead").alias("a"), F.col("class").alias("b"))
    return met.unionByName(same).unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that may be similar by sizes and bitmaps.

    Two sets differ in at least as many shingles as their bitmaps in bits, so none that is similar fails.
    """
    side = lambda s: classes.select(F.col("class").alias(s), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits"))
    least, most = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")

    def to(bits: str, words: Column) -> Column:  # sizes that may be similar differ by a factor of two at most
        return F.when(F.size(bits) > words, _folded(F.col(bits))).otherwise(F.col(bits))

    words = F.least(F.size("a_bits"), F.size("b_bits"))
    differing = F.aggregate(F.zip_with(to("a_bits", words), to("b_bits", words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(least >= similarity * most - 1e-6)
    return sized.where(differing * (1 + similarity) <= (least + most) * (1 - similarity) + 1e-6).select("a", "b")


class _Block:
    """Rows of a bucket with their bitmaps, by the bitmaps' size."""

    def __init__(self, rows: np.ndarray, bitmaps: list[np.ndarray]):
        self.rows = rows
        words = np.fromiter(map(len, bitmaps), dtype=np.int64, count=len(bitmaps))
        self.by = {int(w): (at := np.flatnonzero(words == w), np.stack([bitmaps[i] for i in at])) for w in np.unique(words)}

    def may(self, row: np.ndarray, bitmap: np.ndarray, wanted: np.ndarray, similarity: float):
        """The rows among the wanted for which `_possible` holds; the last column is the set's size."""
        for words, (at, bits) in self.by.items():
            at, bits = at[wanted[at]], bits[wanted[at]]
            if not len(at) or not words <= 2 * len(bitmap) <= 4 * words:
                continue
            theirs = bits if words <= len(bitmap) else _fold(bits)
            own = bitmap if len(bitmap) <= words else _fold(bitmap)
            differing = np.bitwise_count((theirs ^ own).view(np.uint64)).sum(axis=1, dtype=np.int64)
            least, most = np.minimum(self.rows[at, -1], row[-1]), np.maximum(self.rows[at, -1], row[-1])
            yield self.rows[at[(least >= similarity * most - 1e-6) & (differing * (1 + similarity) <= (least + most) * (1 - similarity) + 1e-6)]]


def _rooted(buckets: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, class, root) of all members of buckets, and (key, largest, n, most) of the buckets whose members aren't all in one component."""
    rooted = _small(buckets.join(roots.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("root", "class").alias("root")))
    per = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    return rooted, _small(per.groupBy("key").agg(F.max_by("root", "n").alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n"))


def _other_leaders(rooted: DataFrame, several: DataFrame) -> DataFrame:
    """(a, b), a < b: each member outside its bucket's largest component with LEADERS members in it and some outside, others in each bucket."""
    members = rooted.join(several.select("key", "largest"), "key").withColumn("outside", F.col("root") != F.col("largest"))
    slot = F.pmod(F.xxhash64("class", "key"), F.when(F.col("outside"), LEADERS // 4).otherwise(LEADERS)).alias("slot")
    leads = _small(members.groupBy("key", "outside", slot).agg(F.min_by("class", F.xxhash64("class", "key")).alias("lead"))).drop("outside", "slot")
    met = members.where("outside").join(leads, "key").where("lead <> class")
    return met.select(F.least("lead", "class").alias("a"), F.greatest("lead", "class").alias("b")).distinct()


def _apart(rooted: DataFrame, several: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the possible pairs of each bucket whose components differ, by coarse bitmaps.

    One of the two is outside the bucket's largest component. Outsiders and members
    are dealt into blocks, and every block of outsiders meets every block of members
    in a task of its own, so a bucket of any size is spread.
    """
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    dealt = rooted.join(several, "key").withColumn("outer", blocks(F.col("n") - F.col("most"), OUTSIDERS)).withColumn("inner", blocks(F.col("n"), MEMBERS))
    coarse = F.col("bits")
    for _ in range(COARSE):
        coarse = _folded(coarse)
    dealt = dealt.join(classes.select("class", F.col("n").cast("long").alias("size"), coarse.alias("bits")), "class")
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["key", "o", "i", "kind", "class", "root", "size"]
    outside = dealt.where("root <> largest").withColumn("o", own("outer")).withColumn("kind", F.lit(0)).select("*", every("inner").alias("i"))
    members = dealt.withColumn("i", own("inner")).withColumn("kind", F.when(F.col("root") == F.col("largest"), 1).otherwise(2)).select("*", every("outer").alias("o"))
    both = outside.select(*names, "bits").unionByName(members.select(*names, "bits")).repartition("key", "o", "i").sortWithinPartitions("key", "o", "i", "kind", "class")

    def run(batches):
        block, kept = None, []
        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], axis=1)
            bitmaps = [x.values.to_numpy() for x in batch.column("bits")]
            starts = np.concatenate([[0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1, [len(rows)]])
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if end > start and (block is None or (rows[start, :3] != block).any()):
                    block, kept = rows[start, :3].copy(), []
                first = start + int((rows[start:end, 3] == 0).sum())
                kept += [(rows[i].copy(), bitmaps[i].copy()) for i in range(start, first)]
                rest = _Block(rows[first:end], bitmaps[first:end])
                for row, bitmap in kept if first < end else []:
                    # of two outsiders the smaller one has the pair
                    wanted = (rest.rows[:, 5] != row[5]) & ((rest.rows[:, 3] == 1) | (rest.rows[:, 4] > row[4]))
                    for others in rest.may(row, bitmap, wanted, similarity):
                        if len(others):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(others[:, 4], row[4])), pa.array(np.maximum(others[:, 4], row[4]))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _similar(pairs: DataFrame, keyed: DataFrame, classes: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets are similar, by their exact Jaccard similarity.

    Each a is a leader whose set meets those of its b in tasks of at most about FOLLOWERS.
    """
    leaders = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts"))
    follow = pairs.join(leaders, "a").select(F.col("b").alias("class"), F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"))
    first = leaders.select(F.col("a").alias("class"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    met = follow.unionByName(first).groupBy("class").agg(F.collect_list(F.struct("lead", "part", "kind")).alias("places"))
    wanted = held(classes.select("class", "one.doc", "one.tie").join(met, "class"))
    near = F.broadcast if (wanted.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST else (lambda x: x)

    def sets(batches):
        seen = set()  # classes of this task: repeated rows give a set once
        for batch in batches:
            fresh = []
            for i, c in enumerate(batch.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([shingle_set(t, size).view(np.int64) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["class", "places", "tokens"])

    def compare(batches):
        lead, own = None, None
        for batch in batches:
            tokens, a, b = batch.column(4), [], []
            for i, (leader, part, kind, c) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                theirs = tokens[i].values.to_numpy()
                if kind == 0:
                    lead, own = (leader, part), theirs.copy()
                    continue
                assert lead == (leader, part)
                common = len(np.intersect1d(own, theirs, assume_unique=True))
                if common >= similarity * (len(own) + len(theirs) - common):
                    a.append(leader)
                    b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    made = keyed.join(near(wanted), ["doc", "tie"]).select("class", "places", "text").mapInArrow(sets, "class long, places array<struct<lead:long,part:int,kind:int>>, tokens array<long>")
    rows = made.select("class", "tokens", F.explode("places").alias("p")).select("p.lead", "p.part", "p.kind", "class", "tokens")
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "kind")
    return _small(rows.mapInArrow(compare, "a long, b long"))


def _small(df: DataFrame) -> DataFrame:
    """The rows cut from the shuffles they came through, whose files can go then."""
    out = cut(df)
    jvm = df.sparkSession.sparkContext._jvm
    del df  # the plan that ran holds its shuffles
    gc.collect()
    jvm.System.gc()
    return out


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, tie, class, group_doc, group_class) of every row: groups of texts linked by a Jaccard similarity of their shingle sets of `similarity` or more.

    doc is the id (null greatest), tie tells apart texts under one id, group_doc is the
    smallest id of the group and group_class the class that has it. A text of fewer words
    than a shingle is one shingle; texts without words (and nulls) are one group; repeated
    rows give repeated rows; an empty table gives no rows.
    """
    keyed = docs.select(order_id(key).alias("doc"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    prints = held(_prints(keyed, shingle, similarity))
    once = [F.first(c).alias(c) for c in ("n", "f0", "bits", "prefix")]
    classes = _small(prints.groupBy("class").agg(F.min("doc").alias("least"), F.min(F.struct("doc", "tie")).alias("one"), *once))
    ids = _small(prints.select("doc", "tie", "class"))
    prints.unpersist()
    # one exchange serves the first class of each bucket and the join with it; a bucket's rows just pass through
    rows = classes.select(F.explode("prefix").alias("key"), "class").repartition("key")
    lead = rows.groupBy("key").agg(F.min("class").alias("lead"), F.max("class").alias("last")).where("lead < last").select("key", "lead")
    shared = _small(rows.join(lead, "key"))
    pairs = _small(_possible(_candidates(shared, classes), classes, similarity))
    links = _similar(pairs, keyed, classes, shingle, similarity)
    roots = held(components(links))
    # buckets of the same members are one
    members = shared.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y"))
    buckets = _small(shared.join(_small(members.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")), "key").select("key", "class"))

    def add(found: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        nonlocal pairs, links, roots
        rooted, several = _rooted(buckets, roots)
        if several.isEmpty():
            return
        fresh = _small(found(rooted, several).join(pairs, ["a", "b"], "left_anti"))
        fresh = _small(_possible(fresh, classes, similarity))
        if fresh.isEmpty():
            return
        more = _similar(fresh, keyed, classes, shingle, similarity)
        pairs = pairs.unionByName(fresh)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = held(components(links))

    # other leaders join most of what is similar to a member but not to the first one, at a pair a member
    add(_other_leaders)
    add(lambda rooted, several: _apart(rooted, several, classes, similarity))
    rooted = _small(classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "least", F.coalesce("root", "class").alias("root")))
    least = _small(rooted.groupBy("root").agg(F.min("least").alias("group_doc"), F.min_by("class", F.struct("least", "class")).alias("group_class")))
    named = _small(rooted.join(least, "root").select("class", "group_doc", "group_class"))
    return ids.join(named, "class")


def representatives(docs: DataFrame, **parameters) -> DataFrame:
    """(doc, tie, times) of the one document that stays of each group: the smallest id's, and of its texts the first by tie; times it occurs."""
    groups = near_duplicates(docs, **parameters).where((F.col("doc") == F.col("group_doc")) & (F.col("class") == F.col("group_class")))
    of = groups.groupBy("doc", "class", "tie").agg(F.count("*").alias("times"))
    return _small(of.groupBy("doc", "class").agg(F.min(F.struct("tie", "times")).alias("x")).select("doc", "x.tie", "x.times"))
