"""Language identification by nearest centroid (operator 1).

Character n-grams of orders 1 to 3 are hashed into a fixed number of dimensions,
weighted by TF-IDF and normalised. Spherical k-means gives several centroids per
language; a text goes to the language of the centroid with the highest cosine. Its
distance (1 - cosine) well beyond what held-out texts of the same length show rejects it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import sampled, small_batches

UNKNOWN = "und"
#: Hashed n-gram dimensions; fixes the size of the model at DIM floats a centroid.
DIM = 1 << 14
#: The classifier is fitted on a hash sample of distinct texts: about PER_LANGUAGE labelled texts of each
#: language and about SAMPLE in all, of the LANGUAGES most frequent labels, so its size doesn't depend on the corpus.
PER_LANGUAGE, SAMPLE, LANGUAGES = 400, 8000, 500
CENTROIDS, ROUNDS = 3, 12
#: A text is rejected below SLACK times the REJECT_QUANTILE of the cosines that held-out texts of its length (by
#: powers of two) have; a length needs ENOUGH of them. Texts of fewer letters than SHORT vary more and get SHORT_SLACK.
REJECT_QUANTILE, SLACK, SHORT, SHORT_SLACK, ENOUGH = 0.01, 0.6, 128, 0.3, 30
#: One in so many texts of the sample is held out for that.
HELD_OUT = 4
_PIECE = 1 << 20
_MULTIPLIERS = np.array([[0x9E3779B1, 0, 0], [0x85EBCA77, 0xC2B2AE3D, 0], [0x27D4EB2F, 0x165667B1, 0xD3A2646D]], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(dimension ids, counts, letters) of a whole text; long texts are taken piece by piece."""
    total, n_letters = np.zeros(DIM, dtype=np.int64), 0
    text = text or ""
    before, after_letter = np.array([32], dtype=np.uint32), False  # up to two points that began earlier n-grams, and whether a letter came last
    for start in range(0, len(text) + 1, _PIECE):
        piece = text[start : start + _PIECE].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[points]
        n_letters += int(letter.sum())
        points = np.where(letter, points, np.uint32(32))
        keep = letter | np.concatenate([[after_letter], letter[:-1]])[: len(letter)]
        after_letter = bool(letter[-1]) if len(letter) else after_letter
        fresh = points[keep]
        if start + _PIECE > len(text):
            fresh = np.concatenate([fresh, [32]])
        points = np.concatenate([before, fresh]).astype(np.uint32)
        # n-grams that end in a fresh point; the first piece also has those of the leading space
        old = len(before) if start else 0
        ids = []
        for order in (1, 2, 3):
            own = points[max(0, old - order + 1) :]
            mixed = np.zeros(max(0, len(own) - order + 1), dtype=np.uint32)
            for k in range(order):
                mixed += own[k : k + len(mixed)] * _MULTIPLIERS[order - 1, k]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            ids.append(mixed >> np.uint32(32 - 14))
        total += np.bincount(np.concatenate(ids), minlength=DIM)
        before = points[-2:]
    found = np.flatnonzero(total)
    return found, total[found], n_letters


def _bucket(n_letters: int) -> int:
    return min(31, int(n_letters).bit_length())


@dataclass
class Model:
    """A fitted classifier: at most languages x CENTROIDS x DIM floats."""

    names: list[str]
    language: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[ids]
        return (v / max(float(np.sqrt(v @ v)), 1e-12)).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); `und` without a letter or without a model."""
        ids, counts, n = gram_counts(text)
        if not n or not self.names:
            return UNKNOWN, 0.0, True
        cosines = self.centroids[:, ids] @ self.vector(ids, counts)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.names[self.language[best]], score, bool(score < self.least[_bucket(n)])


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first starts; deterministic."""
    mean = x.mean(axis=0)
    starts = [int(np.argmax(x @ mean))]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin((x @ x[starts].T).max(axis=1))))
    centres = x[starts].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = [x[nearest == j].sum(axis=0) for j in range(len(centres)) if (nearest == j).any()]
        centres = np.array([s / max(float(np.linalg.norm(s)), 1e-12) for s in sums], dtype=np.float32)
    return centres


def _centres(sample: list[dict], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of every language and whose they are."""
    centres, of = [], []
    for j, name in enumerate(model.names):
        own = [r for r in sample if r["lang"] == name]
        x = np.zeros((len(own), DIM), dtype=np.float32)
        for i, r in enumerate(own):
            x[i, r["ids"]] = model.vector(r["ids"], r["counts"])
        c = _clusters(x, CENTROIDS) if len(own) else np.zeros((0, DIM), dtype=np.float32)
        centres.append(c)
        of += [j] * len(c)
    return np.concatenate([np.zeros((0, DIM), dtype=np.float32), *centres]), np.array(of, dtype=int)


def fit_on(sample: list[dict]) -> Model:
    """A model from rows of lang, h (a hash), n (letters), ids and counts.

    The bounds of rejection come from texts that had no part in the centroids they are
    compared with; the model's own centroids are of all of the sample.
    """
    sample = sorted((r for r in sample if r["n"]), key=lambda r: (r["lang"], r["h"]))
    df = np.zeros(DIM)
    for r in sample:
        df[r["ids"]] += 1
    names = sorted({r["lang"] for r in sample})
    model = Model(names, np.zeros(0, int), np.zeros((0, DIM), np.float32), np.log((1 + len(sample)) / (1 + df)) + 0.1, np.zeros(32))
    if not sample:
        return model
    kept, out = ([r for i, r in enumerate(sample) if (i % HELD_OUT == 0) == held] for held in (False, True))
    by: dict[int, list[float]] = {}
    centres, _ = _centres(kept or sample, model)
    for r in out:
        by.setdefault(_bucket(r["n"]), []).append(float((centres[:, r["ids"]] @ model.vector(r["ids"], r["counts"])).max()))
    slack = lambda b: SLACK if 1 << b > SHORT else SHORT_SLACK
    known = {b: float(np.quantile(v, REJECT_QUANTILE)) for b, v in by.items() if len(v) >= ENOUGH}
    known = known or {b: float(np.quantile(np.concatenate(list(by.values())), REJECT_QUANTILE)) for b in by}  # few texts: all lengths as one
    for b in range(32):  # the least of a length and its neighbours; one shorter than all has half the next
        below = [known[x] for x in sorted(known) if x <= b][-2:]
        above = [known[x] for x in sorted(known) if x >= b][:2]
        model.least[b] = slack(b) * (min(below + above) if below else 0.5 * above[0] if above else 0.0)
    model.centroids, model.language = _centres(sample, model)
    return model


def features(batches):
    """lang, h, ids, counts, n of batches of lang, h, text."""
    for batch in batches:
        found = [gram_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("h"), pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.int64())],
            names=["lang", "h", "ids", "counts", "n"],
        )


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fits on a bounded hash sample (PER_LANGUAGE, SAMPLE, LANGUAGES) of the labelled rows with text.

    Null texts and labels and texts without letters teach nothing; an empty table
    gives a model that answers `und`.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return fit_on([])
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(sizes)))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], each / r["n"]) for r in sizes], "lang string, share double")
    small_batches(labelled.sparkSession)
    wanted = rows.join(F.broadcast(shares), "lang").where(sampled(F.col("h"), F.col("share"))).select("lang", "h", "text").dropDuplicates(["lang", "h"])
    found = wanted.mapInArrow(features, "lang string, h long, ids array<int>, counts array<long>, n long").where("n > 0")
    # fitted in one task on the bounded sample: only the model comes to the driver
    model = found.repartition(1).mapInArrow(_fitted, "names array<string>, language array<int>, centroids binary, idf binary, least binary").first()
    if model is None:
        return fit_on([])
    centroids = np.frombuffer(model["centroids"], dtype=np.float32).reshape(-1, DIM)
    return Model(list(model["names"]), np.array(model["language"], dtype=int), centroids, np.frombuffer(model["idf"]), np.frombuffer(model["least"]))


def _fitted(batches):
    # arrays throughout: as Python objects the sample would take ten times the memory
    sample = []
    for batch in batches:
        langs, hashes, letters = (batch.column(c).to_pylist() for c in ("lang", "h", "n"))
        ids, counts = batch.column("ids"), batch.column("counts")
        sample += [{"lang": lang, "h": h, "n": n, "ids": ids[i].values.to_numpy(), "counts": counts[i].values.to_numpy()} for i, (lang, h, n) in enumerate(zip(langs, hashes, letters, strict=True))]
    if sample:
        model = fit_on(sample)
        made = [[model.names], [model.language.tolist()], [model.centroids.astype(np.float32).tobytes()], [model.idf.tobytes()], [model.least.tobytes()]]
        kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=["names", "language", "centroids", "idf", "least"])


def predict(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` columns plus lang_pred, score, rejected of every row's whole text."""
    small_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=schema.names)

    return src.mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text the model doesn't reject, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(name: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 3; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(3))


def language_id(docs: DataFrame) -> DataFrame:
    """Operator 1: doc_id, held_out, lang_pred, score, rejected for every document.

    Learns from text and non-null lang of the rows outside the held-out fold. A null
    text or one without letters gives `und`, score 0 and rejected; repeated rows give
    repeated rows; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs.where(fold() != 1))
    return predict(docs, model, [F.col("doc_id"), (fold() == 1).alias("held_out")])
