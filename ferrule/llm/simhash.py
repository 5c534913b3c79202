"""SimHash near-duplicates through covering locality-sensitive hashing (operator 6).

A covering family for radius r on b bits gives each bit a vector over r + 1 binary
coordinates; table t keeps the bits whose vector has odd product with t. The vectors
of any r differing bits miss some t altogether, so every pair within the radius agrees
on all bits that table t keeps: no pair within the radius is lost. Equal fingerprints
are one class. Classes meet in a table's bucket; a bucket gives a spanning forest of
its links, never all its pairs, and one with more than LEAF classes is covered again on
the bits its table left out (a very large one by the plan, into buckets of their own), until at most 2^LEAF_BITS classes can differ in what is left.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import held, order_id, small_batches
from ferrule.llm.components import Forest, components
from ferrule.llm.substring_dedup import words_of

#: The contract's radius over 64 bits, shingle and seed.
RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a bucket above which it is covered again by the plan, and dealt to more tasks.
BUCKET = 65_536
#: A bucket with more classes is covered again; with so few free bits it is compared in blocks.
LEAF, LEAF_BITS = 512, 9
#: Primitive binary polynomials by degree (fixed values).
PRIMITIVE = {1: 0b11, 2: 0b111, 3: 0b1011, 4: 0b10011, 5: 0b100101, 6: 0b1000011, 7: 0b10000011, 8: 0b100011101}
_STEP = 1 << 11


@lru_cache(maxsize=64)
def masks(bits: int, radius: int) -> np.ndarray:
    """One mask a table over the low `bits` bits: 2^(radius + 1) - 1 of them."""
    tables = (1 << (radius + 1)) - 1
    # powers of a generator of the field with radius + 1 binary coordinates: all vectors about
    # equally often, and of any radius + 1 neighbouring bits every table keeps one at least
    vector, v = [], 1
    for _ in range(bits):
        vector.append(v)
        v <<= 1
        v ^= PRIMITIVE[radius + 1] * (v > tables)
    return np.array([sum(1 << i for i, v in enumerate(vector) if (v & t).bit_count() % 2) for t in range(1, tables + 1)], dtype=np.uint64)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def shingle_hashes(text: str | None, size: int, seed: int = SEED):
    """XXH64 of the space-joined shingles of a whole text, lower-cased A-Z, some at a time."""
    rest: list[bytes] = []
    total = 0
    for words in words_of(text):
        words = rest + [w.lower() for w in words]
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            a, b = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
            digest = xxhash.xxh64_intdigest
            yield np.fromiter((digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)), dtype=np.uint64, count=len(a))
            total += len(a)
            rest = words[len(words) - size + 1 :]
        else:
            rest = words
    if not total and rest:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(rest), seed)], dtype=np.uint64)


def _ones(mixed: np.ndarray) -> np.ndarray:
    """Column sums of the bits of rows of 64-bit words; bytes hold the sums of up to 255 rows."""
    bits = np.unpackbits(mixed.view(np.uint8), bitorder="little").reshape(len(mixed), -1)
    out = np.zeros(bits.shape[1], dtype=np.int64)
    for i in range(0, len(bits), 255):
        out += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return out


def fingerprint(parts) -> int:
    """The 64-bit SimHash of hashes given by parts: a bit is 1 if set in over half of them."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for i in range(0, len(hashes), _STEP):
            ones += _ones(np.ascontiguousarray(hashes[i : i + _STEP].reshape(-1, 1)))
    return int(((2 * ones > n) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(dtype=np.uint64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """The id and f0 (64 bits, as a long) of every row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            f0 = [signed(fingerprint(shingle_hashes(t, size))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f0, pa.int64())], names=[key, "f0"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` long, f0 long")


def exact_links(values: np.ndarray, free: int, radius: int, forest: Forest, at: np.ndarray) -> None:
    """Joins all positions `at` whose values differ in at most `radius` of the `free` bits, losing none."""
    bits = int(free).bit_count()
    if len(at) <= LEAF or bits <= LEAF_BITS:
        for i in range(len(at) - 1):
            near = np.flatnonzero(_popcount(values[at[i + 1 :]] ^ values[at[i]]) <= radius)
            for j in near.tolist():
                forest.join(int(at[i]), int(at[i + 1 + j]))
        return
    places = [i for i in range(64) if free >> i & 1]
    for mask in masks(bits, radius).tolist():
        kept = sum(1 << p for i, p in enumerate(places) if mask >> i & 1)
        key = values[at] & np.uint64(kept)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(at[order], edges):
            if len(part) > 1:
                exact_links(values, free & ~kept, radius, forest, part)


_BUCKET = ["t", "t2", "key", "key2"]


def _bucket_edges(radius: int):
    """A function over batches sorted by bucket: a spanning forest of the links in each."""

    def run(batches):
        kept = None
        for batch in batches:
            part = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in [*_BUCKET, "f0"]], axis=1)
            kept = part if kept is None else np.concatenate([kept, part])
            last = len(kept) and np.flatnonzero((kept[:, :4] != kept[-1, :4]).any(axis=1))
            cut = int(last[-1]) + 1 if len(kept) and len(last) else 0  # the last bucket may go on
            yield from _forests(kept[:cut], radius)
            kept = kept[cut:]
        if kept is not None:
            yield from _forests(kept, radius)

    return run


def _forests(rows: np.ndarray, radius: int):
    if len(rows) < 2:
        return
    values = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
    starts = np.concatenate([[0], np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1, [len(rows)]])
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(np.diff(starts) > 1).tolist():
        part = values[starts[i] : starts[i + 1]]
        forest = Forest(len(part))
        # a bucket doesn't tell which bits its table keeps: what its members share is found from them
        exact_links(part, int(np.bitwise_or.reduce(part ^ part[0])), radius, forest, np.arange(len(part)))
        found += [(int(starts[i]) + x, int(starts[i]) + y) for x, y in forest.edges]
        if len(found) >= _STEP:
            yield _batch(values, found)
            found = []
    if found:
        yield _batch(values, found)


def _batch(values: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = values[np.array(found)].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], names=["a", "b"])


def _longs(numbers) -> Column:
    return F.expr("array(" + ", ".join(f"{signed(int(x))}L" if signed(int(x)) > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in numbers) + ")")


def covering_edges(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between fingerprints f0 that connect all within the radius of each other.

    A bucket of more than BUCKET fingerprints is covered again on the bits that its
    table leaves out and so dealt to many tasks; the union of the new buckets' forests
    connects what the bucket's would.
    """
    kept = masks(64, radius)
    values = prints.select("f0").distinct()
    rows = values.select("f0", F.posexplode(F.transform(_longs(kept), lambda m: F.col("f0").bitwiseAND(m))).alias("t", "key"))
    zero = [F.lit(0).alias("t2"), F.lit(0).cast("long").alias("key2")]
    large = held(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("t", "key"))
    dealt = rows.select("f0", "t", "key", *zero)
    if not large.isEmpty():
        again = []
        for mask in kept.tolist():
            places = [i for i in range(64) if not mask >> i & 1]
            again.append(_longs([sum(1 << p for i, p in enumerate(places) if m >> i & 1) for m in masks(len(places), radius).tolist()]))
        finer = F.posexplode(F.transform(F.get(F.array(*again), F.col("t")), lambda m: F.col("f0").bitwiseAND(m))).alias("t2", "key2")
        split = rows.join(large, ["t", "key"]).select("f0", "t", "key", finer).select("f0", "t", "key", (F.col("t2") + 1).alias("t2"), "key2")
        dealt = rows.join(large, ["t", "key"], "left_anti").select("f0", "t", "key", *zero).unionByName(split)
    dealt = dealt.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "f0")
    return dealt.mapInArrow(_bucket_edges(radius), "a long, b long")


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f0, root): the class each fingerprint's component is named by, for those with a link."""
    return components(covering_edges(prints, radius)).select(F.col("node").alias("f0"), "root")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """Operator 6: doc_id, fingerprint, component_id of every document.

    A text without words (or null) has fingerprint zero and links like any other; a
    null id counts as greater than every other; repeated rows give repeated rows; an
    empty table gives no rows; other columns are ignored.
    """
    prints = held(fingerprints(docs))
    classes = prints.groupBy("f0").agg(F.min(order_id()).alias("least"))
    rooted = held(classes.join(held(near_classes(prints)), "f0", "left").select("f0", "least", F.coalesce("root", "f0").alias("root")))
    named = rooted.join(held(rooted.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("f0", "component_id")
    out = prints.join(held(named), "f0")
    component = F.when((F.col("component_id") == F.lit((1 << 63) - 1)) & F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), component.alias("component_id"))
