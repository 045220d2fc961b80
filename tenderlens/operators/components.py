"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.plans.staging import BROADCAST_BYTES, discard, materialize, per_key


def _stars(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One star round.  ``edges`` holds (u, v); each u connects its neighbours to the least of them.  A table
    with a row for each end of an edge takes ``most`` bytes at most.

    Large: all neighbours, and only those above u move.  Small: only neighbours below u, and u moves too.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    low = both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u")
    low = F.broadcast(low) if most <= BROADCAST_BYTES else per_key(low, "cclow")
    if large:  # a node that is the least of its neighbours, as hubs come to be, moves nothing and needs no match
        moved = both.filter("v > u").join(low, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
    else:
        moved = both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node of the component, for every node that has an edge.

    Edges with a null end or equal ends are ignored.  The work of a round is joins and sums over the
    edges; a node with very many neighbours is aggregated before the shuffle, and its join is one of two
    tables, which adaptive execution can split.  Each round is written to the shared folder.  Rounds go on
    until one changes nothing; alternating stars reach that in about log(nodes) squared.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    kind = e.schema["u"].dataType
    now, before = materialize(e, "cc"), None
    n, longest = now.agg(F.count("*"), F.coalesce(F.max(F.greatest(*(F.octet_length(F.col(c).cast("string")) for c in "uv"))), F.lit(0))).first()
    width = 2 * (64 + 2 * longest)
    while True:
        then = materialize(_stars(_stars(now, True, n * width), False, 2 * n * width), "cc")
        sums = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if tuple(sums) == before:
            break
        before, n = tuple(sums), sums[0]
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    return out.select(F.col("node").cast(kind), F.col("component").cast(kind))
