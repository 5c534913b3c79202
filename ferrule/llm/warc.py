"""WARC records and a Merkle fixity audit of replicas (operator 10).

Each replica has a tree made of its own records alone. Records lie in order of their
ids, so that a range of ids is a range of offsets: ranges of 2^10 ids, of 2^20 and so on
up to the root, each the SHA-256 of its children's digests in order. A range is named by
the ids it holds, so a record that one replica lacks shifts nothing. Below an
id come the first hex digits of its records' digests, so that an id with very many
records is no single node; equal records are one entry with a count.

Roots are compared first; below, only the children of nodes that differ are fetched from
either tree, down to entries. Equal digests meet first; what is left over is corrupt,
missing or extra.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.llm.common import LAST_ID, cut, held, order_id

#: Bits of an id by which each level of ranges is wider than the one below, and levels of ranges between ids and root.
BITS, LEVELS = 10, 6
#: Hex digits of a digest that name a node below an id.
PREFIX = 3
#: Entries a partition of the global order.
ORDERED = 20_000
_END = "\r\n\r\n"


def record(id_: Column, uri: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text, without the two line ends after its block; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id_.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body,
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes every row as a record into gzipped WARC files, one a partition."""
    pages.select(record(F.col("page_id"), F.col("url"), F.col("html")).alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of the records in gzipped or plain WARC files; Content-Length delimits them."""
    import gzip

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                raw, at, rows = gzip.decompress(raw) if name.endswith(".gz") else raw, 0, []
                while at < len(raw):
                    stop = raw.index(b"\r\n\r\n", at)
                    head = dict(re.findall(r"^([\w-]+): (.*?)\r?$", raw[at:stop].decode("utf-8"), re.M))
                    size = int(head["Content-Length"])
                    id_ = re.search(r"<urn:page:(-?\d+)>", head["WARC-Record-ID"])
                    rows.append((int(id_[1]) if id_ else None, head.get("WARC-Target-URI", ""), raw[stop + 4 : stop + 4 + size].decode("utf-8")))
                    at = stop + 4 + size + 4
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "html"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").where(F.col("path").rlike(r"\.(txt|warc)(\.gz)?$"))
    return files.mapInArrow(run, "page_id long, url string, html string")


def manifest(pages: DataFrame) -> DataFrame:
    """(id, digest, length, copies) of every distinct record; a null id is the greatest."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(order_id("page_id").alias("id"), text.alias("text")).select("id", F.sha2("text", 256).alias("digest"), (F.octet_length("text") + 4).cast("long").alias("length"))
    return rows.groupBy("id", "digest").agg(F.max("length").alias("length"), F.count("*").alias("copies"))


def ordered(entries: DataFrame) -> DataFrame:
    """Adds leaf (place of the entry's first record in the order of id and digest) and offset, by sums of sorted partitions."""
    parts = max(1, -(-entries.count() // ORDERED))
    dealt = held(entries.repartitionByRange(parts, "id", "digest").withColumn("part", F.spark_partition_id()))
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    sums = dealt.groupBy(F.col("part").alias("p")).agg(F.sum("copies").alias("n"), F.sum(F.col("length") * F.col("copies")).alias("bytes"))
    starts = sums.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("o0"))
    earlier = W.partitionBy("part").orderBy("id", "digest").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda value: F.coalesce(F.sum(value).over(earlier), F.lit(0))
    placed = dealt.withColumn("leaf", so_far(F.col("copies"))).withColumn("offset", so_far(F.col("length") * F.col("copies")))
    return placed.join(starts, F.col("part") == F.col("p")).withColumn("leaf", F.col("leaf") + F.col("n0")).withColumn("offset", F.col("offset") + F.col("o0")).drop("part", "p", "n0", "o0")


_KEYS = [f"r{k}" for k in range(LEVELS - 1, -1, -1)] + ["id", "prefix"]


def tree(entries: DataFrame) -> list[DataFrame]:
    """The levels from the root (one row) down; each row has the ranges it lies in, its name last, and its digest `hash`."""
    ranges = [F.shiftright("id", BITS * (k + 1)).alias(f"r{k}") for k in range(LEVELS - 1, -1, -1)]
    rows = entries.select(*ranges, "id", F.substring("digest", 1, PREFIX).alias("prefix"), F.concat_ws(":", "digest", F.col("copies").cast("string")).alias("entry"))
    rows = cut(rows.groupBy(*_KEYS).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), ","), 256).alias("hash")))
    levels = [rows]
    for depth in range(len(_KEYS) - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct(_KEYS[depth], "hash")))  # 2^BITS or 16^PREFIX of them at most
        rows = cut(rows.groupBy(*_KEYS[:depth]).agg(F.sha2(F.array_join(children["hash"], ""), 256).alias("hash")))
        levels.append(rows)
    return levels[::-1]


def differing(mine: list[DataFrame], other: list[DataFrame]) -> DataFrame | None:
    """(id, prefix) of the lowest nodes that differ, by fetching the children of differing nodes only; None if the roots are equal."""
    if mine[0].first()["hash"] == other[0].first()["hash"]:
        return None
    bad = None
    for depth in range(1, len(_KEYS) + 1):
        names, parents = _KEYS[:depth], _KEYS[: depth - 1]
        a, b = (t[depth] if bad is None else t[depth].join(bad, parents, "left_semi") for t in (mine, other))
        both = a.join(b.withColumnRenamed("hash", "theirs"), names, "full_outer")
        bad = cut(both.where(~F.col("hash").eqNullSafe(F.col("theirs"))).select(names))
    return bad.select("id", "prefix")


def _judged(mine: DataFrame, other: DataFrame, bad: DataFrame) -> DataFrame:
    """(id, digest, length, whole, corrupt, missing, extra): how many copies of the entries in differing nodes are what.

    Equal digests meet first. Of the others of an id, as many as both replicas have are
    corrupt, in the order of their digests; the rest is missing or extra.
    """
    at = lambda m: m.withColumn("prefix", F.substring("digest", 1, PREFIX)).join(bad, ["id", "prefix"], "left_semi")
    a = at(mine).select("id", "digest", "length", F.col("copies").alias("a"))
    b = at(other).select("id", "digest", F.col("length").alias("b_length"), F.col("copies").alias("b"))
    both = a.join(b, ["id", "digest"], "full_outer").select("id", "digest", F.coalesce("length", "b_length").alias("length"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    both = both.withColumn("whole", F.least("a", "b")).withColumn("ax", F.col("a") - F.col("whole")).withColumn("bx", F.col("b") - F.col("whole"))
    of = W.partitionBy("id")
    earlier = of.orderBy("digest").rowsBetween(W.unboundedPreceding, -1)
    # of an entry's left-overs, those that the other side's left-overs of the id reach
    met = lambda own, theirs: F.least(F.col(own), F.greatest(F.lit(0), F.sum(theirs).over(of) - F.coalesce(F.sum(own).over(earlier), F.lit(0))))
    counted = both.withColumn("corrupt", met("ax", "bx")).withColumn("replaced", met("bx", "ax"))
    return counted.select("id", "digest", "length", "whole", "corrupt", (F.col("ax") - F.col("corrupt")).alias("missing"), (F.col("bx") - F.col("replaced")).alias("extra"))


_ROW = "id long, leaf long, offset long, length long, digest string, status string"


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(id, leaf, offset, length, digest, status, range_digest, replica_range_digest, root_digest, replica_root_digest) of every record of the primary.

    status is ok, corrupt (the replica has another digest under that id) or missing;
    records that only the replica has follow with status extra and no place. The range
    is the lowest range of ids. Null ids count as the greatest.
    """
    mine, other = held(manifest(primary)), held(manifest(replica))
    trees = tree(mine), tree(other)
    bad = differing(*trees)
    placed = ordered(mine)
    status = F.lit("ok")
    extra = None
    if bad is not None:
        judged = held(_judged(mine, other, bad))
        placed = placed.join(judged.where("corrupt + missing > 0").drop("length", "extra"), ["id", "digest"], "left")
        extra = judged.where("extra > 0").select("id", F.expr("cast(null as long) as leaf"), F.expr("cast(null as long) as offset"), "length", "digest", F.lit("extra").alias("status"), F.explode(F.sequence(F.lit(1), F.col("extra")))).drop("col")
        status = F.when(F.col("whole").isNull() | (F.col("k") < F.col("whole")), "ok").when(F.col("k") < F.col("whole") + F.col("corrupt"), "corrupt").otherwise("missing")
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    rows = each.select("id", (F.col("leaf") + F.col("k")).alias("leaf"), (F.col("offset") + F.col("k") * F.col("length")).alias("offset"), "length", "digest", status.alias("status"))
    rows = rows.unionByName(extra) if extra is not None else rows
    low = lambda t, name: t[LEVELS].select(F.col("r0").alias(f"{name}_r0"), F.col("hash").alias(name))
    for name, t in zip(("range_digest", "replica_range_digest"), trees, strict=True):
        rows = rows.join(low(t, name), F.shiftright("id", BITS) == F.col(f"{name}_r0"), "left").drop(f"{name}_r0")
    roots = [F.lit(t[0].first()["hash"]).alias(name) for name, t in zip(("root_digest", "replica_root_digest"), trees, strict=True)]
    id_ = F.when(F.col("id") == LAST_ID, F.lit(None)).otherwise(F.col("id")).cast("long").alias("id")
    return rows.select(id_, "leaf", "offset", "length", "digest", "status", "range_digest", "replica_range_digest", *roots)


#: The query audits a replica in which every record whose id leaves this remainder has one byte too many.
DAMAGE, REMAINDER = 499, 7


def damaged(pages: DataFrame) -> DataFrame:
    hit = F.col("page_id") % DAMAGE == REMAINDER
    return pages.select("page_id", "url", F.when(hit, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html")).alias("html"))


def warc_fixity(pages: DataFrame) -> DataFrame:
    """Operator 10: page_id, leaf, record_offset, record_length, record_sha256, status of every page's record, with the digests of its range and of the roots.

    Null urls and html are empty; records of one page_id (null last) follow each other
    by digest; repeated rows are records of their own; an empty table gives no rows; other
    columns are ignored.
    """
    rows = audit(pages, damaged(pages))
    return rows.select(
        F.col("id").alias("page_id"), "leaf", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("digest").alias("record_sha256"), "status",
        F.col("range_digest").alias("range_sha256"), F.col("replica_range_digest").alias("replica_range_sha256"), F.col("root_digest").alias("root_sha256"), F.col("replica_root_digest").alias("replica_root_sha256"),
    )


def _levels_sql() -> str:
    """Every level of both trees, as common table expressions."""
    keys = ", ".join(f"id >> {BITS * (k + 1)} AS r{k}" for k in range(LEVELS))
    out = [
        f"nodes AS (SELECT side, {keys}, id, substr(digest, 1, {PREFIX}) AS prefix, sha256(string_agg(digest || ':' || copies, ',' ORDER BY digest)) AS hash FROM entries GROUP BY ALL)",
        "ids AS (SELECT side, " + ", ".join(f"r{k}" for k in range(LEVELS)) + ", id, sha256(string_agg(hash, '' ORDER BY prefix)) AS hash FROM nodes GROUP BY ALL)",
    ]
    below, name = "ids", "id"
    for k in range(LEVELS):
        out.append(f"level{k} AS (SELECT side, " + ", ".join(f"r{j}" for j in range(k, LEVELS)) + f", sha256(string_agg(hash, '' ORDER BY {name})) AS hash FROM {below} GROUP BY ALL)")
        below, name = f"level{k}", f"r{k}"
    out.append(f"roots AS (SELECT side, sha256(string_agg(hash, '' ORDER BY {name})) AS hash FROM {below} GROUP BY ALL)")
    return ",\n".join(out)


SQL = rf"""
WITH pages2 AS (
  SELECT 1 AS side, page_id, url, coalesce(html, '') AS body FROM pages
  UNION ALL
  SELECT 2, page_id, url, coalesce(html, '') || CASE WHEN page_id % {DAMAGE} = {REMAINDER} THEN '!' ELSE '' END FROM pages
), whole AS (
  SELECT side, coalesce(page_id, {LAST_ID}) AS id,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
         || CAST(strlen(body) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || body AS record
  FROM pages2
), hashed AS (
  SELECT side, id, sha256(record) AS digest, CAST(strlen(record) + 4 AS BIGINT) AS length FROM whole
), entries AS (
  SELECT side, id, digest, max(length) AS length, count(*) AS copies FROM hashed GROUP BY ALL
), {_levels_sql()}, left_over AS (
  SELECT id, sum(CASE WHEN side = 1 THEN 1 ELSE -1 END * copies) AS n FROM entries GROUP BY id
), theirs AS (
  SELECT id, digest, copies FROM entries WHERE side = 2
), placed AS (
  SELECT id, digest, length, row_number() OVER w - 1 AS leaf, CAST(sum(length) OVER w - length AS BIGINT) AS record_offset,
         row_number() OVER (PARTITION BY id, digest) AS k
  FROM hashed WHERE side = 1 WINDOW w AS (ORDER BY id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT CASE WHEN p.id <> {LAST_ID} THEN p.id END AS page_id, leaf, record_offset, length AS record_length, p.digest AS record_sha256,
       CASE WHEN k <= coalesce(t.copies, 0) THEN 'ok' WHEN o.n = 0 THEN 'corrupt' ELSE 'missing' END AS status,
       a.hash AS range_sha256, b.hash AS replica_range_sha256,
       (SELECT hash FROM roots WHERE side = 1) AS root_sha256, (SELECT hash FROM roots WHERE side = 2) AS replica_root_sha256
FROM placed p LEFT JOIN theirs t ON p.id = t.id AND p.digest = t.digest JOIN left_over o ON o.id = p.id
LEFT JOIN level0 a ON a.side = 1 AND a.r0 = p.id >> {BITS} LEFT JOIN level0 b ON b.side = 2 AND b.r0 = p.id >> {BITS}
"""
