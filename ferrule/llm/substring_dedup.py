"""Substring dedup by seed and extend (operator 2).

Seeds are winnowed anchors: of the GRAM-word grams of each window of LENGTH words the
one with the least hash, so equal windows choose the same anchor wherever they occur.
Documents meet on anchors that occur in more than one of them. Around such an anchor
the run of windows that chose it is extended both ways as far as their words reach:
runs equal over their whole context are settled at once by the smallest id that has
them; where one anchor has several contexts, each window of the first copy of each
context is settled by the smallest id that has this window. No pairs of copies are
made anywhere: every group is reduced to its smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import order_id, small_batches, written

#: Words of a repeat that is removed, and words of a gram that serves as its seed.
LENGTH, GRAM = 50, 12
_B1, _B2, _B3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_PIECE = 1 << 20


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text as UTF-8, a piece of about a megabyte at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    start = 0
    while start < len(raw):
        end = min(len(raw), start + _PIECE)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[start:end].split()
        start = end


def word_hashes(text: str | None) -> np.ndarray:
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w)) for w in words_of(text)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


@lru_cache(maxsize=12)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    fill = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, dtype=np.uint64))])
    return fill(base), fill(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of a word sequence, from prefix sums of one polynomial."""

    def __init__(self, hashes: np.ndarray, base: np.uint64):
        up, self.down = _powers(int(base), 1 << max(10, len(hashes).bit_length()))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[: len(hashes)])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def winnow(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, number of windows) of every run of windows with one anchor."""
    n = len(hashes) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    at = np.arange(len(hashes) - gram + 1)
    value = Spans(hashes, _B1)(at, at + gram)
    low, where, wide, width = value, at, 1, length - gram + 1
    while wide < width:  # the rightmost least of ever wider windows
        step = min(wide, width - wide)
        left, right = low[:-step] if step else low, low[step:]
        take = right <= left
        low, where = np.where(take, right, left), np.where(take, where[step:], where[:-step])
        wide += step
    starts = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
    counts = np.diff(np.concatenate([starts, [n]]))
    anchors = where[starts]
    context = Spans(hashes, _B2)(starts, starts + counts - 1 + length)
    context = _mix(context + ((anchors - starts) * 64 + counts).astype(np.uint64))
    return value[anchors].view(np.int64), context.view(np.int64), starts, counts


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """Rows by id and text: `tie` tells apart different texts under one id."""
    return docs.select(F.col("doc_id"), order_id().alias("doc"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))


def _anchors(batches):
    for batch in batches:
        doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
        found = [winnow(word_hashes(t)) for t in batch.column("text").to_pylist()]
        if not found:
            continue
        sizes = [len(f[0]) for f in found]
        h, k, first, count = (np.concatenate([f[i] for f in found]) for i in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, k, np.repeat(doc, sizes), np.repeat(tie, sizes), (first * 64 + count).astype(np.int64))], names=["h", "k", "doc", "tie", "run"])


def _windows(length):
    def run(batches):
        seen = set()  # repeated rows, which meet in a task, have the same windows
        for batch in batches:
            for doc, tie, text, runs in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if (doc, tie) in seen:
                    continue
                seen.add((doc, tie))
                hashes, runs = word_hashes(text), np.array(sorted(runs), dtype=np.int64)
                counts = runs % 64
                at = np.repeat(runs // 64 - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                w1, w2 = (Spans(hashes, b)(at, at + length).view(np.int64) for b in (_B2, _B3))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(np.full(n, doc, dtype=np.int64)), pa.array(np.full(n, tie, dtype=np.int64)), pa.array(at * 64 + 1)], names=["w1", "w2", "doc", "tie", "run"])

    return run


def covered(n_words: int, runs, length: int = LENGTH) -> np.ndarray:
    """Which words the windows of the runs cover."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    if runs is not None and len(runs):
        runs = np.array(runs, dtype=np.int64)
        np.add.at(edge, runs // 64, 1)
        np.add.at(edge, np.minimum(n_words, runs // 64 + runs % 64 - 1 + length), -1)
    return np.cumsum(edge[:-1]) > 0


def _digest(with_text: bool, length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if not runs and not with_text:
                    n, sha, sep = 0, hashlib.sha256(), b""
                    for words in words_of(text):
                        if words:
                            sha.update(sep + b" ".join(words))
                            n, sep = n + len(words), b" "
                    rows.append((n, 0, sha.hexdigest(), None))
                    continue
                words = [w for part in words_of(text) for w in part]
                gone = covered(len(words), runs, length)
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            n, m, sha, kept = zip(*rows, strict=True) if rows else ([], [], [], [])
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, tie, run): the windows that also start in a document with a smaller id.

    run is 64 x the first window + the number of windows.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, text)
    anchors = written(keyed.select("doc", "tie", "text").mapInArrow(_anchors, "h long, k long, doc long, tie long, run long"), "anchors", docs)
    shared = anchors.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    seeds = written(anchors.join(written(shared, "shared", docs), "h"), "seeds", docs)
    first = written(seeds.groupBy("h", "k").agg(F.min("doc").alias("first")), "first", docs)
    several = first.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1").select("h", F.lit(True).alias("several"))
    first = written(first.join(several, "h", "left"), "contexts", docs)
    settled = written(
        seeds.join(first, ["h", "k"]).select("doc", "tie", "run", (F.col("doc") > F.col("first")).alias("whole"), F.coalesce("several", F.lit(False)).alias("several")).where("whole or several"), "settled", docs)
    extend = settled.where("not whole").groupBy("doc", "tie").agg(F.collect_set("run").alias("runs"))
    windows = written(keyed.select("doc", "tie", "text").join(extend, ["doc", "tie"]).mapInArrow(_windows(length), "w1 long, w2 long, doc long, tie long, run long"), "windows", docs)
    least = written(windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "least", docs)
    found = windows.join(least, ["w1", "w2"]).where("doc > lo").select("doc", "tie", "run")
    return found.unionByName(settled.where("whole").select("doc", "tie", "run"))


def substring_dedup(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """Operator 2: doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row.

    A null id counts as greater than every other; a null or empty text has no words;
    rows that share an id are different documents of which neither is smaller;
    repeated rows give repeated rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    runs = repeats(docs, text).groupBy("doc", "tie").agg(F.collect_set("run").alias("runs"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    rows = _keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), text)
    return rows.join(runs, ["doc", "tie"], "left").select("doc_id", "text", "runs").mapInArrow(_digest(with_text, LENGTH), schema)
