"""Operator 7: a Merkle fixity audit of an archive of pages.

Each page is a WARC record; records stand in key order, at running offsets.  Each replica hashes its own records
and builds its own tree: a leaf range hashes, in key order, the records of :data:`FANOUT` consecutive page ids, and a node hashes
its children in order with the bytes that each covers, so ranges of offsets are hashed relative to the node and a
lost record shifts no other branch.  Two replicas are the same if their roots are.  If not, only children of nodes
that differ are compared, level by level, and only records of leaf ranges that differ are put side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.plans.staging import materialize, per_key, small

FANOUT = 16
#: Records, or hashes of records, that one hash covers.
CHUNK = 4096
KEY = ("page_id", "url", "copy")


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, copy, length, leaf) of (page_id, url, html): the record's bytes and their SHA-256.

    Nulls are empty text (a null page_id stays null and sorts last).  Rows with equal page_id and url are
    told apart by ``copy``, counted in the order of their hashes, so repeated rows are records too.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )
    rows = pages.select("page_id", url.alias("url"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("leaf"))
    once = Window.partitionBy("page_id", "url").orderBy("leaf", "length")
    return rows.withColumn("copy", F.row_number().over(once))


def manifest(recs: DataFrame) -> DataFrame:
    """``recs`` with ``pos`` (from 0) and ``offset`` in key order.  Rows are range-partitioned by key and
    written once; counts run within a range and are joined to the running totals of the ranges."""
    order = [F.col("page_id").asc_nulls_last(), F.col("url"), F.col("copy")]
    parts = materialize(recs.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "op7rec")
    sums = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("part").orderBy(*order)
    rows = parts.withColumn("i", F.row_number().over(inside) - 1).withColumn("b", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return rows.join(F.broadcast(starts), "part").select(*KEY, "length", "leaf", (F.col("n0") + F.col("i")).alias("pos"), (F.col("b0") + F.col("b")).alias("offset"))


def ranges(recs: DataFrame) -> DataFrame:
    """(idx, hash, bytes) of the leaf ranges.  A range's hash is that of its records one after another: each one's
    key, content hash, and extent from the start of the range.  Up to :data:`CHUNK` records are hashed together, then as
    many of those hashes, so a range may hold any number of records.  ``recs`` is a :func:`manifest`, or is made one."""
    man = recs if "pos" in recs.columns else manifest(recs)
    digest = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", F.col("copy").cast("string"), "leaf"), 256)
    rows = man.select(leaf_range().alias("idx"), "pos", "offset", "length", digest.alias("digest"))
    start = per_key(rows.groupBy("idx").agg(F.min("pos").alias("p0"), F.min("offset").alias("o0")), "op7start")
    text = lambda *cols: F.concat_ws(":", *(F.col(c).cast("string") for c in cols))
    now = rows.join(start, "idx").select("idx", (F.col("pos") - F.col("p0")).alias("at"), (F.col("offset") - F.col("o0")).alias("from"), "length", "digest")
    now = now.select("idx", "at", F.col("length").alias("bytes"), text("from", "length", "digest").alias("line"))
    for _ in range(3):
        listed = F.array_sort(F.collect_list(F.struct("at", "line")))
        up = now.groupBy("idx", F.floor(F.col("at") / CHUNK).alias("at")).agg(listed.alias("l"), F.sum("bytes").alias("bytes"))
        now = up.select("idx", "at", "bytes", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "|"), 256).alias("line"))
    return now.select("idx", F.col("line").alias("hash"), "bytes")


def leaf_range():
    """The leaf range of a record; records without a page_id share the last one below 0."""
    return F.coalesce(F.floor(F.col("page_id") / FANOUT), F.lit(-1)).cast("long")


def tree(leaves: DataFrame, least: int, top: int) -> list[DataFrame]:
    """Nodes of each level, leaf ranges first: (idx from 0, hash, bytes); level ``top`` is the root."""
    out = [materialize(leaves.withColumn("idx", F.col("idx") - least), "op7lvl")]
    for _ in range(top):
        kids = F.array_sort(F.collect_list(F.struct("idx", "hash", "bytes")))
        up = out[-1].groupBy(F.floor(F.col("idx") / FANOUT).alias("up")).agg(kids.alias("kids"), F.sum("bytes").alias("bytes"))
        joined = F.concat_ws("|", F.transform("kids", lambda k: F.concat_ws(":", k["idx"].cast("string"), k["bytes"].cast("string"), k["hash"])))
        out.append(materialize(up.select(F.col("up").alias("idx"), F.sha2(joined, 256).alias("hash"), "bytes"), "op7lvl"))
    return out


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame | None:
    """(idx) of the leaf ranges that differ, found from the roots down; None if the roots agree."""
    front = None
    for level in range(len(a) - 1, -1, -1):
        left, right = a[level], b[level]
        if front is not None:
            marks = small(front.select(F.col("idx").alias("up")))
            left, right = (x.join(marks, F.floor(F.col("idx") / FANOUT) == F.col("up"), "left_semi") for x in (left, right))
        pair = left.select("idx", F.col("hash").alias("x")).join(right.select("idx", F.col("hash").alias("y")), "idx", "full")
        front = materialize(pair.filter(~F.col("x").eqNullSafe(F.col("y"))).select("idx"), "op7frt")
        if level == len(a) - 1 and not front.limit(1).count():
            return None
    return front


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, url, offset, length, status): the records of ``pages`` that ``replica`` has ``changed`` or
    ``missing``, at their place in the archive, and those it has in addition (``extra``, offset null).
    Both have page_id (a whole number), url, html; other columns are not read.  Equal replicas, and empty ones,
    give no rows.  A table has no order but that of its keys, so records that trade places are two changed ones.
    """
    plan = materialize(manifest(records(pages)), "op7man")
    other = materialize(manifest(records(replica)), "op7rep")
    nodes = [materialize(ranges(x), "op7rng") for x in (plan, other)]
    least, most = nodes[0].unionByName(nodes[1]).agg(F.min("idx"), F.max("idx")).first()
    top = 0
    while FANOUT**top <= (most or 0) - (least or 0):
        top += 1
    front = differing(*(tree(x, least or 0, top) for x in nodes))
    if front is None:
        return plan.limit(0).select("page_id", "url", "offset", "length", F.lit("").alias("status"))
    marks = small(front.select((F.col("idx") + (least or 0)).alias("idx")))
    # null ids are spelled out in the key, so that the join stays one on equal keys
    key = ["idx", F.col("page_id").isNull().alias("no_id"), F.coalesce("page_id", F.lit(0)).alias("id"), "url", "copy"]
    mine, theirs = (x.withColumn("idx", leaf_range()).join(marks, "idx", "left_semi") for x in (plan, other))
    mine = mine.select(*key, "offset", F.col("length").alias("length_a"), F.col("leaf").alias("leaf_a"))
    theirs = theirs.select(*key, F.col("length").alias("length_b"), F.col("leaf").alias("leaf_b"))
    both = mine.join(theirs, ["idx", "no_id", "id", "url", "copy"], "full").filter(~F.col("leaf_a").eqNullSafe(F.col("leaf_b")))
    status = F.when(F.col("leaf_a").isNull(), "extra").when(F.col("leaf_b").isNull(), "missing").otherwise("changed")
    return both.select(F.when(~F.col("no_id"), F.col("id")).alias("page_id"), "url", "offset", F.coalesce("length_a", "length_b").alias("length"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: by a hash of the page_id some pages are altered, some lost, and some
    have a second, foreign record."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 6), 16, 10).cast("long") % 50
    base = pages.select("page_id", "url", "html")
    kept = base.filter(h != 2).withColumn("html", F.when(h == 1, F.concat(F.lit("!"), F.coalesce("html", F.lit("")))).otherwise(F.col("html")))
    return kept.unionByName(base.filter(h == 3).withColumn("url", F.concat(F.coalesce("url", F.lit("")), F.lit("?copy"))))


ORACLE = r"""
WITH p AS (SELECT page_id, url, html, ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 50 AS h,
  strlen('WARC/1.1' || 'WARC-Type: response' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || 'WARC-Target-URI: ' || url || 'Content-Length: ' || strlen(html) || html) + 16::BIGINT AS length FROM pages),
o AS (SELECT *, (sum(length) OVER (ORDER BY page_id, url) - length)::BIGINT AS o FROM p)
SELECT page_id, url, o AS "offset", length::BIGINT AS length, CASE h WHEN 1 THEN 'changed' ELSE 'missing' END AS status FROM o WHERE h IN (1, 2)
UNION ALL SELECT page_id, url || '?copy', NULL, (length + 5)::BIGINT, 'extra' FROM o WHERE h = 3
"""
