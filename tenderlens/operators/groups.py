"""Checks on groups of providers, and what the group findings say about a provider's surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.operators import network as net
from tenderlens.operators.checks import PROVIDER, REGISTRY, check, provider_contacts
from tenderlens.operators.components import connected_components
from tenderlens.plans.staging import materialize
from tenderlens.plans.tables import Config, Tables, ordinals, top_n

GROUP_CHECKS = {"bid_rotation_ring": "ring_id", "cobid_community": "community_id", "shared_contact_cluster": "cluster_id"}


def _of(cfg: Config, key: str):
    return lambda name: cfg.get(name, REGISTRY[key].thresholds[name])


def _with_members(rows: DataFrame, groups: DataFrame, t: Tables, most: int | None = None) -> DataFrame:
    """Names, and the other members of the group as ``co_members``, in order of id."""
    named = groups.join(net.provider_names(t), "member", "left").withColumn("name", F.coalesce("name", F.lit("—")))
    first = named
    if most:  # of those shown beside a member, one more than most at the least, as the member may be among them
        place = F.row_number().over(Window.partitionBy("group_id").orderBy("member"))
        first = named.withColumn("k", place).filter(F.col("k") <= most + 1)
    listed = first.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("member", F.concat("member", F.lit(" ("), "name", F.lit(")")).alias("text")))).alias("all"))
    out = rows.join(named.select("group_id", "member", F.col("name").alias("provider_name")), ["group_id", "member"]).join(listed, "group_id")
    others = F.transform(F.filter("all", lambda x: x["member"] != F.col("member")), lambda x: F.struct(x["text"].alias("text")))
    return out.withColumn("co_members", F.slice(others, 1, most) if most else others).withColumnRenamed("member", "provider_cuit")


def rings(edges: DataFrame, t: Tables, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """((group_id, members, shared_processes, rotation_pct, cobid_strength), (group_id, member, wins)): disjoint rings, and
    the wins in these and the groups that were not taken.  Cliques are sought in the whole graph; only a ``ring_component_cap``
    gives way to the cores of components above it first, as the source does."""
    of = _of(cfg, "bid_rotation_ring")
    cap = int(of("ring_component_cap"))
    cliques = net.maximal_cliques(net.peel_to_cap(edges, cap) if cap else edges, int(of("ring_min_members")), int(of("ring_max_members"))).distinct()
    cliques = materialize(cliques.withColumn("group_id", F.array_join("members", "|")), "ring")
    groups = cliques.select("group_id", F.explode("members").alias("member"))
    outcomes = materialize(net.clique_outcomes(cliques, t, cfg), "ring")
    wins = materialize(net.win_distribution(groups, outcomes), "ring")
    shared = outcomes.groupBy("group_id").agg(F.count("*").alias("shared_processes")).filter(F.col("shared_processes") >= of("ring_min_shared_processes"))
    winners = wins.groupBy("group_id").agg(F.sum((F.col("wins") > 0).cast("int")).alias("k")).filter(F.col("k") >= of("ring_min_distinct_winners")).select("group_id")
    rotation = net.normalized_entropy(wins).select("group_id", F.bround(100.0 * F.col("entropy"), 1).alias("rotation_pct")).filter(F.col("rotation_pct") >= of("ring_min_rotation_pct"))
    strength = net.group_cohesion(groups, edges).select("group_id", F.col("mean_weight").alias("cobid_strength"))
    ready = cliques.join(shared, "group_id").join(winners, "group_id").join(rotation, "group_id").join(strength, "group_id")
    return net.select_disjoint(ready, ["rotation_pct", "cobid_strength", "shared_processes"]), wins


@check("bid_rotation_ring", 40, {"ring_min_cobid_weight": 3, "ring_min_members": 3, "ring_max_members": 8, "ring_min_shared_processes": 5, "ring_min_distinct_winners": 2, "ring_min_rotation_pct": 45.0, "ring_component_cap": 0}, (PROVIDER,))
def bid_rotation_ring(t: Tables, cfg: Config) -> DataFrame:
    """Members of small groups in which everyone meets everyone and the wins go round."""
    edges = materialize(net.cobid_edges(t, int(_of(cfg, "bid_rotation_ring")("ring_min_cobid_weight")), cfg), "ring")
    found, wins = rings(edges, t, cfg)
    found = materialize(found, "ring")
    order = [F.desc("rotation_pct"), F.desc("cobid_strength"), F.desc("shared_processes"), F.asc("members")]
    numbered = ordinals(found, order, "ring_id").withColumn("ring_id", F.col("ring_id").cast("int"))
    groups = numbered.select("group_id", F.explode("members").alias("member"))
    out = _with_members(numbered.join(wins, "group_id"), groups, t)
    out = out.select("ring_id", "provider_cuit", "provider_name", F.size("members").alias("ring_size"), "shared_processes", F.col("wins").alias("member_wins"), "rotation_pct", "cobid_strength", "co_members")
    return top_n(out, [F.asc("ring_id"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


@check("cobid_community", 15, {"community_min_edge_weight": 2, "community_min_members": 4, "community_max_members": 40, "community_min_density": 1.5}, (PROVIDER,))
def cobid_community(t: Tables, cfg: Config) -> DataFrame:
    """Members of dense communities of the co-bidding graph."""
    of = _of(cfg, "cobid_community")
    edges = materialize(net.cobid_edges(t, int(of("community_min_edge_weight")), cfg), "comm")
    groups = materialize(net.communities(edges).select(F.col("community").alias("group_id"), F.col("node").alias("member")), "comm")
    stats = net.group_cohesion(groups, edges).filter((F.col("n") >= of("community_min_members")) & (F.col("n") <= of("community_max_members")) & (F.col("density") >= of("community_min_density")))
    numbered = ordinals(stats, [F.desc("density"), F.desc("cohesion_pct"), F.asc("group_id")], "community_id")
    stats = materialize(numbered.withColumn("density", F.bround("density", 2)).withColumn("community_id", F.col("community_id").cast("int")), "comm")
    members = groups.join(stats.select("group_id"), "group_id", "left_semi")
    out = _with_members(members.join(stats, "group_id"), members, t, 20)
    out = out.select("community_id", "provider_cuit", "provider_name", F.col("n").alias("community_size"), "density", "cohesion_pct", "co_members")
    return top_n(out, [F.asc("community_id"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


def contact_groups(t: Tables) -> tuple[DataFrame, DataFrame]:
    """((group_id, member), (group_id, c)): providers that contacts connect, named by the least of them, and the
    contacts, as 'Type:value', that two or more of them have.  Providers hang together through the contact as a node of its own,
    so a contact of very many providers is as many edges, not their square."""
    own = provider_contacts(t).select("provider_cuit", F.concat("contact.type", F.lit(":"), "contact.contact").alias("c"))
    shared = own.groupBy("c").agg(F.count("*").alias("k")).filter("k > 1").select("c")
    links = materialize(own.join(shared, "c").select(F.concat(F.lit("p"), "provider_cuit").alias("a"), F.concat(F.lit("c"), "c").alias("b")), "clus")
    comp = materialize(connected_components(links, "a", "b").select(F.substring("node", 1, 1).alias("kind"), F.expr("substring(node, 2)").alias("name"), "component"), "clus")
    named = comp.filter("kind = 'p'").groupBy("component").agg(F.min("name").alias("group_id"))
    of = comp.join(named, "component").select("kind", "group_id", "name")
    return of.filter("kind = 'p'").select("group_id", F.col("name").alias("member")), of.filter("kind = 'c'").select("group_id", F.col("name").alias("c"))


@check("shared_contact_cluster", 40, {"cluster_min_members": 2, "cluster_min_cobid_processes": 1}, (PROVIDER,))
def shared_contact_cluster(t: Tables, cfg: Config) -> DataFrame:
    """Members of groups that contacts connect and that meet in processes."""
    of = _of(cfg, "shared_contact_cluster")
    groups, contacts = contact_groups(t)
    groups = materialize(groups, "clus")
    size = groups.groupBy("group_id").agg(F.count("*").alias("cluster_size")).filter(F.col("cluster_size") >= of("cluster_min_members"))
    outcomes = materialize(net.group_outcomes(groups, t, cfg), "clus")
    meets = outcomes.groupBy("group_id").agg(F.count("*").alias("cobid_processes")).filter(F.col("cobid_processes") >= of("cluster_min_cobid_processes"))
    winners = outcomes.select("group_id", F.explode("winners").alias("w")).groupBy("group_id").agg(F.count_distinct("w").alias("distinct_winners"))
    first = contacts.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("c"))).filter("k <= 12")
    inside = first.groupBy("group_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    parsed = F.transform("c", lambda x: F.struct(F.substring_index(x, ":", 1).alias("type"), F.regexp_extract(x, "^[^:]*:(.*)$", 1).alias("contact")))
    stats = size.join(meets, "group_id").join(winners, "group_id", "left").fillna(0, ["distinct_winners"]).join(inside, "group_id")
    numbered = ordinals(stats, [F.desc("cobid_processes"), F.desc("cluster_size"), F.asc("group_id")], "cluster_id")
    stats = materialize(numbered.withColumn("cluster_id", F.col("cluster_id").cast("int")).withColumn("shared_contacts", parsed), "clus")
    members = groups.join(stats.select("group_id"), "group_id", "left_semi")
    out = _with_members(members.join(stats, "group_id"), members, t, 20)
    out = out.select("cluster_id", "provider_cuit", "provider_name", "cluster_size", "cobid_processes", "distinct_winners", "shared_contacts", "co_members")
    return top_n(out, [F.asc("cluster_id"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


#: Pairs of related providers that a task makes at a time, about.
RELATED_ROWS = 1 << 20
#: Members of a group that stand in one row at most.
MEMBERS_IN_ROW = 1024


def _ranked(asked, lists):
    """(cuit, related, links, rank) of a bucket: ``asked`` has (cuit, grp), ``lists`` the members of these groups (of, ids), in parts."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    cuit, own = asked["cuit"].to_pylist(), asked["grp"].to_pylist()
    parts = lists["ids"].combine_chunks()
    codes, names = pd.factorize(np.concatenate([parts.flatten().to_numpy(zero_copy_only=False), np.array(cuit, object)]), sort=True)
    of: dict[str, list] = {}
    ends = np.cumsum(parts.value_lengths().to_numpy())
    for grp, some in zip(lists["of"].to_pylist(), np.split(codes[: ends[-1]], ends[:-1])):
        of.setdefault(grp, []).append(some)
    groups = {grp: np.sort(np.concatenate(some)) for grp, some in of.items()}
    mine: dict[int, list] = {}
    for c, grp in zip(codes[ends[-1] :], own):
        mine.setdefault(c, []).append(groups[grp])
    related, links = [], []
    for c, some in mine.items():
        to, n = (some[0], np.ones(len(some[0]), np.int64)) if len(some) == 1 else np.unique(np.concatenate(some), return_counts=True)
        to, n = to[to != c], n[to != c]
        order = np.argsort(-n, kind="stable")  # they are in order of id
        related.append(to[order])
        links.append(n[order])
    size = [len(r) for r in related]
    text, cat = pa.array(names, pa.string()), lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    rank = cat([np.arange(1, k + 1) for k in size])
    return pa.table({"cuit": text.take(pa.array(np.repeat(np.array(list(mine), np.int64), size))), "related": text.take(pa.array(cat(related))), "links": pa.array(cat(links), pa.int64()), "rank": pa.array(rank, pa.int32())})


def related_providers(findings: dict[str, DataFrame], cuits: DataFrame) -> DataFrame:
    """(cuit, related, links, rank): who is in the same groups, over the group checks, by number of groups.

    The answer is the square of a group, so it is made where it stays: providers asked for are dealt to buckets of about
    ``RELATED_ROWS`` pairs, those of a large group to several, by the largest group of each; groups come there as lists, and nothing
    is sorted or shuffled by pair."""
    rows = None
    for key, group in GROUP_CHECKS.items():
        if key in findings:
            part = findings[key].select(F.concat(F.lit(f"{key}:"), F.col(group).cast("string")).alias("grp"), "provider_cuit").distinct()
            rows = part if rows is None else rows.unionByName(part)
    rows = materialize(rows.filter("grp is not null and provider_cuit is not null"), "rel")
    place = F.floor((F.row_number().over(Window.partitionBy("grp").orderBy("provider_cuit")) - 1) / MEMBERS_IN_ROW)
    lists = materialize(rows.withColumn("part", place).groupBy("grp", "part").agg(F.collect_list("provider_cuit").alias("members")), "rel")
    sizes = lists.groupBy("grp").agg(F.sum(F.size("members")).alias("size"))
    mine = rows.join(cuits.select(F.col("cuit").alias("provider_cuit")).distinct(), "provider_cuit", "left_semi").withColumnRenamed("provider_cuit", "cuit")
    home = mine.join(sizes, "grp").groupBy("cuit").agg(F.max(F.struct("size", "grp")).alias("home"), F.sum("size").alias("pairs"))
    home = materialize(home, "rel")
    buckets = min(4096, 1 + 2 * (home.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] // RELATED_ROWS))
    turns = F.ceil(F.col("home.size") * F.col("home.size") / RELATED_ROWS)
    dealt = home.select("cuit", F.pmod(F.xxhash64("home.grp", F.pmod(F.xxhash64("cuit"), turns)), F.lit(buckets)).alias("bucket"))
    asked = materialize(mine.join(dealt, "cuit"), "rel")
    there = asked.select("bucket", "grp").distinct().join(lists.select("grp", "members"), "grp").select(F.col("bucket").alias("at"), F.col("grp").alias("of"), F.col("members").alias("ids"))
    both = asked.repartition(buckets, "bucket").groupBy("bucket").cogroup(there.repartition(buckets, "at").groupBy("at"))
    return both.applyInArrow(_ranked, "cuit string, related string, links long, rank int")


def network_neighborhood(findings: dict[str, DataFrame], cuits: DataFrame, centrality: DataFrame) -> DataFrame:
    """(cuit, rings, clusters, communities, triads, cobid_degree, cobid_betweenness) for each provider asked for."""
    out = cuits.select("cuit").distinct()
    for key, name in (("bid_rotation_ring", "rings"), ("shared_contact_cluster", "clusters"), ("cobid_community", "communities"), ("authorizer_provider_ring", "triads")):
        if key in findings:
            df = findings[key]
            part = df.groupBy(F.col("provider_cuit").alias("cuit")).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in df.columns if c != "provider_cuit"])))).alias(name))
            out = out.join(part, "cuit", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.join(centrality.withColumnRenamed("provider_cuit", "cuit"), "cuit", "left")
