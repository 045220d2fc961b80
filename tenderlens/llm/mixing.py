"""Operator 4: a time-varying curriculum over sources.

Each source has a schedule ``w(t) = target * (1 + slope * (2 t - 1))`` over training time t in [0, 1].  Its
integral, the cumulative demand, is ``target * (t + slope * (t * t - t))`` and reaches the target at 1.  A
source's documents stand in a fixed pseudo-random order and are taken in it, over and over, until the
demand is met; where a document's words begin in that run, the demand inverts to its training position, in
every round anew.  The rows are then range-sorted by their first position, or the uses by theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.plans.staging import materialize

SHARE, MOST_TIMES, WEIGHTS = 1.5, 2, (5, 2, 1)
#: Slope of the schedule for each weight class: heavy sources lead, light ones come late.
SLOPES = (-0.5, 0.0, 0.5)
_HEX = 3  # digits of the order key that make a bucket: 4096 a source


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size long, rank long, weight int, target double) from (source, size).

    ``SHARE`` times all words is shared in proportion to the weights; a source stops at ``MOST_TIMES`` its
    size and the excess goes to the others by weight until none is above.  Sorted by the size at which a
    source stops per unit of weight, the sources that stop are a prefix, so one running sum finds the
    level.  The table has a row for each source, and the two windows here see nothing else.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.array(*(F.lit(x) for x in WEIGHTS))
    ranked = totals.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(w, (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    # compare stops exactly: most * size / weight by whole numbers over the product of the weights
    common = 1
    for x in WEIGHTS:
        common *= x
    ranked = ranked.withColumn("stop", (F.col("source_size") * MOST_TIMES * common / F.col("weight")).cast("long"))
    before = Window.orderBy("stop", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    run = ranked.withColumn("stopped", F.coalesce(F.sum(F.col("source_size") * MOST_TIMES).over(before), F.lit(0)))
    run = run.withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    run = run.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(every) - F.col("stopped")) / F.col("left"))
    # the first source whose stop is not below the level ends the prefix; all from there on share it
    run = run.withColumn("open", F.col("weight") * F.col("level") <= F.col("source_size") * MOST_TIMES)
    level = F.min_by("level", F.when(F.col("open"), F.struct("stop", "rank"))).over(every)
    start = F.min(F.when(F.col("open"), F.struct("stop", "rank"))).over(every)
    target = F.when(F.struct("stop", "rank") < start, F.col("source_size") * float(MOST_TIMES)).otherwise(F.col("weight") * level)
    return run.select("source", "source_size", "rank", "weight", F.coalesce(target, F.col("source_size") * float(MOST_TIMES)).alias("target"))


def training_order(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, ``size`` (words; null text: 0),
    ``source_size``, ``target``, ``taken`` (words the mix takes of it, repeats counted), ``position`` (0 to
    1, where its first words are used; null if none are), ``uses`` (each use in order: its position and the
    words it takes), range-sorted by position.

    A source's documents are ordered by the MD5 of the id, then by size; rows equal in both may change
    places, which changes no result.  ``target`` is met to the word: whole rounds first, then the last
    round up to the word that fills it, so at most one document of a source is cut.  The running sums are
    made within 4,096 buckets of a source and joined to the running sums of the buckets, so a source with
    a third of all rows is spread over many tasks.
    """
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda x: x != "")).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialize(docs.select("doc_id", "source", words.alias("size"), key.alias("key")), "op4size")
    targets = materialize(source_targets(sized), "op4src")
    rows = sized.withColumn("bucket", F.substring("key", 1, _HEX))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(F.col("source").alias("src"), F.col("bucket").alias("bkt"), F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets, F.col("src").eqNullSafe(F.col("source"))).select("src", "bkt", "offset", "source_size", "target", "rank")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(offsets, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("bkt")))
    begin = F.col("offset") + F.col("before")
    quota = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    rest = quota - rounds * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - begin))
    slope = F.element_at(F.array(*(F.lit(s) for s in SLOPES)), (F.col("rank") % len(SLOPES) + 1).cast("int"))

    def use(r):
        """Where and how much of the document round ``r`` (from 0) takes."""
        share = (r * F.col("source_size") + begin) / F.col("target")
        # demand(t) = target * (t + slope * (t*t - t)) = share * target, solved for t in [0, 1]
        root = (-(1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope)
        position = F.least(F.lit(1.0), F.when(slope == 0, share).otherwise(root))
        return F.struct(position.alias("position"), F.when(r < rounds, F.col("size")).otherwise(last).cast("long").alias("words"))

    out = run.withColumn("taken", (rounds * F.col("size") + last).cast("long"))
    out = out.withColumn("uses", F.filter(F.transform(F.sequence(F.lit(0).cast("long"), rounds), use), lambda x: x["words"] > 0))
    out = out.withColumn("position", F.get("uses", F.lit(0))["position"])
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "uses")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def training_uses(order: DataFrame) -> DataFrame:
    """One row for each use in ``order`` (of :func:`training_order`), range-sorted by its own position:
    doc_id, ``source``, ``position``, ``words``."""
    out = order.select("doc_id", "source", F.explode("uses").alias("use")).select("doc_id", "source", "use.position", "use.words")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
c AS (SELECT *, (source_size * 2 * 10 // weight) AS stop FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size * 2) OVER before, 0)::DOUBLE)
   / ((sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE) AS level FROM c WINDOW before AS (ORDER BY stop, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, row_number() OVER (ORDER BY stop, rank) AS k, weight * level <= source_size * 2 AS open FROM l),
f AS (SELECT min(k) AS k0, arg_min(level, k) AS lv FROM o WHERE open),
t AS (SELECT source, source_size, rank, CASE WHEN k0 IS NULL OR k < k0 THEN source_size * 2.0::DOUBLE ELSE weight * lv END AS target FROM o, f),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, (t.rank % 3 - 1) * 0.5::DOUBLE AS slope, floor(t.target)::BIGINT AS quota,
   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS rounds FROM b),
u AS (SELECT *, greatest(0, least(size, quota - rounds * source_size - start)) AS last, start / target AS share FROM q),
p AS (SELECT *, CASE WHEN slope = 0 THEN share ELSE (-(1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope) END AS pos FROM u)
SELECT doc_id, size, source_size, target, (rounds * size + last)::BIGINT AS taken,
  CASE WHEN rounds * size + last > 0 THEN round(least(1.0::DOUBLE, pos), 6) + 0.0::DOUBLE END AS "position", (CASE WHEN size > 0 THEN rounds ELSE 0 END + (last > 0)::INT)::INT AS n_uses FROM p
"""
