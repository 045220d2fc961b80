"""The bidding network: edges, cores, cliques, communities, centrality, and subgraphs around entities.

Iterative algorithms run as rounds of joins; each round is a table in the shared folder.  Only counts and
sums that decide whether to go on come to the driver.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.operators.checks import shared_contacts
from tenderlens.operators.components import connected_components
from tenderlens.plans.staging import BROADCAST_BYTES, discard, materialize, measured_bytes, small
from tenderlens.plans.tables import Config, Tables, name_or_dash, process_window

#: Bidders of a process that stand in one row at most; those of a larger process are dealt to several rows.
PAIR_IN_ROW = 64


def bidders(t: Tables, cfg: Config) -> DataFrame:
    """Distinct (process_number, provider_cuit) in the window."""
    return t.bid.join(process_window(t.process, cfg).select("process_number"), "process_number").select("process_number", "provider_cuit").distinct()


def bidder_lists(bids: DataFrame) -> DataFrame:
    """(process_number, part, p): the bidders of each process, from distinct bids, sorted and in parts of at most
    ``PAIR_IN_ROW``; written once, as pairs are made of them several times."""
    order = Window.partitionBy("process_number").orderBy("provider_cuit")
    parts = bids.withColumn("part", F.floor((F.row_number().over(order) - 1) / PAIR_IN_ROW).cast("int"))
    return materialize(parts.groupBy("process_number", "part").agg(F.sort_array(F.collect_list("provider_cuit")).alias("p")), "lists")


def process_pairs(lists: DataFrame) -> DataFrame:
    """(process_number, a, b), a < b: providers that bid on the same process, from :func:`bidder_lists`.  Pairs are made inside
    each part; the parts of a process that has several meet in a join, which can be split."""
    each = lists.filter(F.size("p") > 1).select("process_number", "p", F.posexplode("p").alias("k", "a"))
    out = each.select("process_number", "a", F.explode(F.slice("p", F.col("k") + 2, F.size("p"))).alias("b"))
    many = lists.filter("part > 0").select("process_number").distinct()
    if many.limit(1).count():
        long = materialize(lists.join(small(many), "process_number", "left_semi"), "long")
        one, two = (long.select("process_number", F.col("part").alias(f"{x}_part"), F.col("p").alias(f"{x}s")) for x in "ab")
        cross = one.join(two, "process_number").filter("a_part < b_part").select("process_number", F.explode("as").alias("a"), "bs")
        out = out.unionByName(cross.select("process_number", "a", F.explode("bs").alias("b")))
    return out


def met_pairs(t: Tables, cfg: Config) -> DataFrame:
    """The :func:`process_pairs` of the window, of lists that are there already if it is open."""
    whole = cfg.date_from is None and cfg.date_to is None
    return process_pairs(t.shared["bidder_lists"] if whole and "bidder_lists" in t.shared else bidder_lists(bidders(t, cfg)))


def cobid_edges(t: Tables, min_shared: int, cfg: Config) -> DataFrame:
    """(a, b, weight), a < b: provider pairs and the processes they share; see :func:`with_edges`."""
    if "cobid_edges" in t.shared and cfg.date_from is None and cfg.date_to is None:
        return t.shared["cobid_edges"].filter(F.col("weight") >= min_shared)
    return met_pairs(t, cfg).groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_shared)


def with_edges(t: Tables) -> Tables:
    """``t`` with the bidders of each process, and the edges of all dates and weights, written once."""
    t = replace(t, shared=t.shared | {"bidder_lists": bidder_lists(bidders(t, Config()))})
    return replace(t, shared=t.shared | {"cobid_edges": materialize(cobid_edges(t, 1, Config()), "edges")})


def contact_pairs(t: Tables) -> DataFrame:
    """(a, b, weight, contacts): provider pairs that share contacts, as 'Type:value'."""
    one = shared_contacts(t).select(F.col("p1").alias("a"), F.col("p2").alias("b"), F.concat("contact.type", F.lit(":"), "contact.contact").alias("c"))
    return one.groupBy("a", "b").agg(F.count_distinct("c").alias("weight"), F.array_sort(F.collect_set("c")).alias("contacts"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (u, v, weight)."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight"))


def group_outcomes(groups: DataFrame, t: Tables, cfg: Config) -> DataFrame:
    """(group_id, process_number, bidders, winners) for processes in which two members or more bid; ``groups``
    has (group_id, member).  One join for all groups; members that are alone in a process go before anything is
    collected or matched with contracts, where the bids lie by process already."""
    bids = bidders(t, cfg).withColumnRenamed("provider_cuit", "member")
    meet = F.count("*").over(Window.partitionBy("process_number", "group_id"))
    rows = bids.join(small(groups), "member").withColumn("n", meet).filter("n > 1").drop("n")
    out = rows.groupBy("group_id", "process_number").agg(F.array_sort(F.collect_set("member")).alias("bidders")).filter(F.size("bidders") >= 2)
    won = t.contract.groupBy("process_number").agg(F.collect_set("provider_cuit").alias("won"))
    winners = F.coalesce(F.array_intersect("bidders", "won"), F.slice("bidders", 1, 0))
    return out.join(won, "process_number", "left").select("group_id", "process_number", "bidders", winners.alias("winners"))


def clique_outcomes(groups: DataFrame, t: Tables, cfg: Config) -> DataFrame:
    """The :func:`group_outcomes` of small groups that overlap much; ``groups`` has (group_id, members).  The pairs of each
    process meet the pairs of the groups, so rows grow with the meetings of members, not with all bids of a member times
    all groups that it is in.  Pairs that are in no group, most of them, go by their hash where they are made, if the hashes
    can be broadcast."""
    each = groups.select("group_id", F.array_sort("members").alias("p")).select("group_id", "p", F.posexplode("p").alias("k", "a"))
    inside = each.select("group_id", "a", F.explode(F.slice("p", F.col("k") + 2, F.size("p"))).alias("b"))
    inside, pair = materialize(inside, "inside"), F.xxhash64("a", "b")
    known, met = materialize(inside.select(pair.alias("h")).distinct(), "inside"), met_pairs(t, cfg)
    if measured_bytes(known, known.count()) <= BROADCAST_BYTES:
        met = met.withColumn("h", pair).join(F.broadcast(known), "h", "left_semi").drop("h")
    met = met.join(small(inside), ["a", "b"])
    out = met.groupBy("group_id", "process_number").agg(F.collect_set("a").alias("x"), F.collect_set("b").alias("y"))
    out = out.select("group_id", "process_number", F.array_sort(F.array_union("x", "y")).alias("bidders"))
    won = t.contract.groupBy("process_number").agg(F.collect_set("provider_cuit").alias("won"))
    winners = F.coalesce(F.array_intersect("bidders", "won"), F.slice("bidders", 1, 0))
    return out.join(won, "process_number", "left").select("group_id", "process_number", "bidders", winners.alias("winners"))


def win_distribution(groups: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(group_id, member, wins), zeros included; a process with several winners counts for each."""
    wins = outcomes.select("group_id", F.explode("winners").alias("member")).groupBy("group_id", "member").agg(F.count("*").alias("wins"))
    return groups.join(wins, ["group_id", "member"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def normalized_entropy(wins: DataFrame, by: str = "group_id", count: str = "wins") -> DataFrame:
    """(by, entropy): entropy of the non-zero counts over the log of their number; 0 for fewer than two."""
    some = wins.filter(F.col(count) > 0)
    total = some.groupBy(by).agg(F.sum(count).alias("total"), F.count("*").alias("k"))
    p = F.col(count) / F.col("total")
    # in the order of the counts, so that the sum of doubles is the same wherever the rows are
    terms = some.join(total, by).groupBy(by, "k").agg(F.array_sort(F.collect_list(-p * F.log(p))).alias("h"))
    return terms.select(by, F.when(F.col("k") > 1, F.aggregate("h", F.lit(0.0), lambda x, y: x + y) / F.log("k")).otherwise(0.0).alias("entropy"))


def group_cohesion(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, n, n_edges, weight, density, cohesion_pct, mean_weight) of the edges inside each group."""
    g = groups.select("group_id", "member")
    inside = edges.join(g.withColumnRenamed("member", "a"), "a").join(g.withColumnRenamed("member", "b"), ["group_id", "b"])
    sums = inside.groupBy("group_id").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))
    out = g.groupBy("group_id").agg(F.count("*").alias("n")).join(sums, "group_id", "left").fillna(0, ["n_edges", "weight"])
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return out.withColumn("density", F.when(pairs > 0, F.col("weight") / pairs).otherwise(0.0)).withColumn("cohesion_pct", F.when(pairs > 0, F.bround(100.0 * F.col("n_edges") / pairs, 1)).otherwise(0.0)).withColumn("mean_weight", F.bround(F.col("weight") / F.greatest("n_edges", F.lit(1)), 1))


def provider_stats(t: Tables, cfg: Config) -> DataFrame:
    """(provider_cuit, bid_processes, won_processes)."""
    bids = bidders(t, cfg).groupBy("provider_cuit").agg(F.count("*").alias("bid_processes"))
    won = t.contract.join(process_window(t.process, cfg).select("process_number"), "process_number").groupBy("provider_cuit").agg(F.count_distinct("process_number").alias("won_processes"))
    return bids.join(won, "provider_cuit", "left").fillna(0, ["won_processes"])


def two_core(e: DataFrame) -> DataFrame:
    """The edges (u, v), both ways, left when trees that hang on the rest are taken off.

    Nodes with at most two neighbours form paths and rings; a path that holds a node with one neighbour falls
    as a whole.  At least half of the loose ends go in a round, so rounds are about the logarithm of the
    nodes however long a path is."""
    now = materialize(e, "core")
    while True:
        thin = now.groupBy("u").agg(F.count("*").alias("d")).filter("d <= 2")
        thin = materialize(thin, "core")
        if not thin.filter("d = 1").limit(1).count():
            return now
        inner = now.join(thin.select("u"), "u", "left_semi").join(thin.select(F.col("u").alias("v")), "v", "left_semi").filter("u < v")
        paths = connected_components(inner, "u", "v").withColumnRenamed("node", "u")
        of = thin.join(paths, "u", "left").withColumn("component", F.coalesce("component", "u"))
        loose = of.filter("d = 1").select("component").distinct()
        gone = materialize(of.join(loose, "component", "left_semi").select("u"), "core")
        then = materialize(now.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti"), "core")
        discard(now)
        now = then


def coreness(edges: DataFrame) -> DataFrame:
    """(node, core): the greatest k for which a node is in the k-core, for every node that has an edge.

    Hanging trees have 1.  On the rest a node starts from its degree and takes, round by round, the greatest h such that h of
    its neighbours have h or more; that falls to the core number of all nodes at once.  What a node's
    neighbours have is counted by value before the shuffle, so a hub sends a row for each value, not for each neighbour."""
    e = materialize(both_ways(edges).filter("u <> v").select("u", "v").distinct(), "core")
    rest = two_core(e)
    now = materialize(rest.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("core")), "core")
    down = Window.partitionBy("u").orderBy(F.desc("c"))
    while True:
        there = now.select(F.col("node").alias("v"), F.col("core").alias("cv"))
        seen = rest.join(there, "v").join(now.select(F.col("node").alias("u"), F.col("core").alias("cu")), "u")
        counted = seen.groupBy("u", "cu", F.least("cv", "cu").alias("c")).agg(F.count("*").alias("n"))
        h = counted.withColumn("above", F.sum("n").over(down)).groupBy(F.col("u").alias("node"), "cu").agg(F.max(F.least("above", "c")).alias("core"))
        then = materialize(h, "core")
        moved = then.filter("core < cu").limit(1).count()
        discard(now)
        now = then.select("node", "core")
        if not moved:
            break
    nodes = e.select(F.col("u").alias("node")).distinct()
    return nodes.join(now, "node", "left").withColumn("core", F.coalesce("core", F.lit(1).cast("long")))


def k_core(edges: DataFrame, k: int, core: DataFrame | None = None) -> DataFrame:
    """The edges left when nodes of degree below k are taken out until none is."""
    stay = (coreness(edges) if core is None else core).filter(F.col("core") >= k).select("node")
    return edges.join(stay.withColumnRenamed("node", "a"), "a", "left_semi").join(stay.withColumnRenamed("node", "b"), "b", "left_semi")


def peel_to_cap(edges: DataFrame, cap: int = 60) -> DataFrame:
    """(component, a, b, weight): components above ``cap`` nodes give way to their cores, k from 2 up, until
    they have at most ``cap``; an empty core leaves the one before.  Which core that is follows from the
    counts of core numbers in a component."""
    comp = connected_components(edges, "a", "b")
    of = materialize(comp.join(coreness(edges), "node"), "peel")
    down = Window.partitionBy("component").orderBy(F.desc("core"))
    sizes = of.groupBy("component", "core").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(down))
    level = sizes.groupBy("component").agg(F.min(F.when(F.col("n") <= cap, F.col("core"))).alias("fits"), F.max("core").alias("top"))
    stay = of.join(level, "component").filter(F.col("core") >= F.coalesce("fits", "top")).select("node", "component")
    out = edges.join(stay.withColumnRenamed("node", "a"), "a").join(stay.select(F.col("node").alias("b")), "b", "left_semi")
    return out.select("component", "a", "b", "weight")


#: A seed with more rows than this is split by its second vertex.
SPLIT_ROWS = 200_000


#: First nodes are dealt to buckets of about so many rows; a task looks at the first nodes of a bucket one after another.
BUCKET_ROWS = 20_000


def _cliques_of(least: int, most: int, seeds: list[str]):
    """Of a bucket of rows (seeds, x, y, x_later, y_later), edges among the common neighbours of the ``seeds``: the
    maximal cliques that hold the seeds of a row and only later ones beside them."""

    def run(pdf):
        import pandas as pd

        of: dict[tuple, tuple[dict, dict]] = {}
        for *s, a, b, la, lb in zip(*(pdf[c].tolist() for c in (*seeds, "x", "y", "x_later", "y_later"))):
            near, later = of.setdefault(tuple(s), ({}, {}))
            near.setdefault(a, set())
            later[a] = la
            if b is not None:
                near.setdefault(b, set()).add(a)
                near[a].add(b)
                later[b] = lb
        found = []

        def grow(near: dict, clique: list, cand: set, done: set) -> None:
            if len(clique) > most:
                return  # whatever this grows into is larger still, and not reported
            if not cand and not done:
                if len(clique) >= least:
                    found.append(sorted(clique))
                return
            pivot = max(cand | done, key=lambda v: (len(near[v] & cand), v))
            for v in sorted(cand - near[pivot]):
                grow(near, [*clique, v], cand & near[v], done & near[v])
                cand = cand - {v}
                done = done | {v}

        for key, (near, later) in of.items():
            grow(near, list(key), {v for v in near if later[v]}, {v for v in near if not later[v]})
        return pd.DataFrame({"members": ["\x1f".join(c) for c in found]}, dtype=str)

    return run


def _cliques_in(rows: DataFrame, least: int, most: int, seeds: list[str], n: int) -> DataFrame:
    """(members): the cliques of the ``n`` rows of all seeds, bucket by bucket."""
    buckets = -(-n // BUCKET_ROWS) or 1
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*seeds), F.lit(buckets))).repartition(buckets, "bucket")
    return dealt.groupBy("bucket").applyInPandas(_cliques_of(least, most, seeds), "members string")


def maximal_cliques(edges: DataFrame, least: int = 3, most: int = 8, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(members array): maximal cliques of between ``least`` and ``most`` nodes; larger ones are not cut up.

    Nodes are ordered by core number, degree and name, and a clique is found from its first node, which sees the
    triangles it makes with later nodes: those among its later neighbours, of which a node has few in this
    order, and those with an earlier one, which would make a clique larger.  A first node with more than ``split_rows`` of
    them hands them on to its second ones."""
    edges = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "weight")
    e = both_ways(edges).select("u", "v").filter("u <> v").distinct()
    order = coreness(edges).join(e.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree")), "node")
    order = materialize(order.select("node", F.struct("core", "degree", "node").alias("r")), "clq")
    r = lambda name, out: order.select(F.col("node").alias(name), F.col("r").alias(out))
    o = materialize(e.join(r("u", "ru"), "u").join(r("v", "rv"), "v").filter("ru < rv").select("ru", "rv"), "clq")
    wedge = o.select(F.col("ru").alias("p"), F.col("rv").alias("q")).join(o.select(F.col("ru").alias("p"), F.col("rv").alias("s")), "p").filter("q < s")
    tri = materialize(wedge.join(o.select(F.col("ru").alias("q"), F.col("rv").alias("s")), ["q", "s"]).select("p", "q", "s"), "clq")
    yes, no = F.lit(True), F.lit(False)
    row = lambda u, x, y, xl: tri.select(F.col(u).alias("u"), F.col(x).alias("x"), F.col(y).alias("y"), xl.alias("x_later"), yes.alias("y_later"))
    first = row("p", "q", "s", yes)
    rows = first.unionByName(row("q", "p", "s", no).join(first.select("u").distinct(), "u", "left_semi"))
    if least <= 2:
        alone = o.select(F.col("ru").alias("u"), F.col("rv").alias("x"), F.lit(None).cast(o.schema["rv"].dataType).alias("y"), yes.alias("x_later"), no.alias("y_later"))
        early = tri.select(F.col("q").alias("u"), F.col("s").alias("x"), F.col("p").alias("y"), yes.alias("x_later"), no.alias("y_later"))
        rows = first.unionByName(early).unionByName(alone)
    rows = materialize(rows, "clq")
    large = materialize(rows.groupBy("u").agg(F.count("*").alias("k")).filter(F.col("k") > split_rows).select("u"), "clq")
    plain = [F.col(c)["node"].alias(c) for c in ("x", "y")]
    kept = rows.join(large, "u", "left_anti").select(F.col("u.node").alias("u"), *plain, "x_later", "y_later")
    found = _cliques_in(kept, least, most, ["u"], rows.count())
    if large.limit(1).count():
        big = materialize(rows.join(large, "u", "left_semi"), "clq")
        side = lambda x, y: big.filter("y is not null").select("u", F.col(x).alias("v"), F.col(y).alias("w"), F.col(f"{x}_later").alias("vl"), F.col(f"{y}_later").alias("wl"))
        beside = side("x", "y").unionByName(side("y", "x")).filter("vl").select("u", "v", "w", (F.col("wl") & (F.col("w") > F.col("v"))).alias("later")).distinct()
        beside = materialize(beside, "clq")
        one = lambda w, name: beside.select("u", "v", F.col("w").alias(w), F.col("later").alias(name))
        inner = big.filter("y is not null").select("u", "x", "y").join(one("x", "x_later"), ["u", "x"]).join(one("y", "y_later"), ["u", "v", "y"]).filter("x_later or y_later")
        single = beside.select("u", "v", F.col("w").alias("x"), F.lit(None).cast(o.schema["rv"].dataType).alias("y"), F.col("later").alias("x_later"), no.alias("y_later"))
        pairs = single.unionByName(inner.select("u", "v", "x", "y", "x_later", "y_later"))
        if least <= 2:  # a second vertex with which the first has no neighbour in common
            lone = big.filter("y is null").select("u", F.col("x").alias("v")).join(beside.select("u", "v").distinct(), ["u", "v"], "left_anti")
            found = found.unionByName(lone.select(F.array_join(F.array_sort(F.array("u.node", "v.node")), "\x1f").alias("members")))
        flat = materialize(pairs.select(F.col("u.node").alias("u"), F.col("v.node").alias("v"), *plain, "x_later", "y_later"), "clq")
        found = found.unionByName(_cliques_in(flat, least, most, ["u", "v"], flat.count()))
    return found.select(F.split("members", "\x1f").alias("members"))


def select_disjoint(groups: DataFrame, priority: list[str]) -> DataFrame:
    """Greedy choice: by the priority columns, greatest first, then by members, a group is taken unless it
    shares a member with one taken before.  Each round takes all groups that come first for every one of
    their members; what conflicts with them goes.  Groups compare by their own columns, so no task ranks
    them all.  ``groups`` has (group_id, members, priority...)."""
    key = F.struct(*((-F.col(p)).alias(f"p{n}") for n, p in enumerate(priority)), "members", "group_id")
    rest = materialize(groups.withColumn("__key", key), "pick")
    taken = None
    while rest.limit(1).count():
        each = rest.select("group_id", "__key", F.explode("members").alias("m"))
        first = each.groupBy("m").agg(F.min("__key").alias("best"))
        late = each.join(first, "m").filter("__key <> best").select("group_id").distinct()
        now = materialize(rest.join(late, "group_id", "left_anti"), "pick")
        taken = now if taken is None else taken.unionByName(now)
        used = now.select(F.explode("members").alias("m")).distinct()
        hit = each.join(used, "m", "left_semi").select("group_id").distinct()
        rest = materialize(rest.join(hit, "group_id", "left_anti"), "pick")
    return (taken if taken is not None else rest).drop("__key")


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


#: Sets of blocks whose moves a round weighs against each other: all, a half, a quarter and so on, by a hash.
_HALVINGS = 16
#: A rough pass ends with a round that adds less than this share of what the pass has gained.
_ROUGH = 50
#: Links of a block, about: nodes of a block move one after another inside a task, blocks at the same time.
BLOCK_LINKS = 100_000


def _moves_of(total: int):
    """Of the nodes of a block, each in turn moves to the community that raises the modularity most, until none
    gains; nodes of other blocks stay.  A row (u, v, c, tot, w, k) says that u has k links and is in c (v is u), or has
    w of them to v of this block, in c, or (v null) to all nodes of other blocks in c."""

    def run(key, pdf):
        import pandas as pd

        near, outside, own, k, tot = {}, {}, {}, {}, {}
        for u, v, c, t, w, d in zip(*(pdf[n].tolist() for n in ("u", "v", "c", "tot", "w", "k"))):
            tot[c] = t
            if u == v:
                own[u], k[u] = c, int(d)
            elif v is None or v != v:
                outside.setdefault(u, {})[c] = w
            else:
                near.setdefault(u, []).append((v, w))
        start, nodes = dict(own), sorted(own)
        wait = dict.fromkeys(nodes)
        while wait:
            moved = set()
            for u in wait:
                to, here = dict(outside.get(u, ())), own[u]
                for v, w in near.get(u, ()):
                    to[own[v]] = to.get(own[v], 0) + w
                tot[here] -= k[u]
                best = min(((k[u] * tot[c] - w * total, c) for c, w in to.items()), default=(0, here))
                if best[0] < k[u] * tot[here] - to.get(here, 0) * total:
                    own[u] = best[1]
                    moved.update(v for v, _ in near.get(u, ()))
                    moved.add(u)
                tot[own[u]] += k[u]
            # those near a move, and when none of these gains, all once more, as communities have other sizes
            wait = dict.fromkeys(sorted(moved)) if moved else dict.fromkeys(nodes) if len(wait) < len(nodes) else None
        gone = [u for u in nodes if own[u] != start[u]]
        return pd.DataFrame({"block": [key[0]] * len(gone), "node": gone, "own": [start[u] for u in gone], "to": [own[u] for u in gone], "k": [k[u] for u in gone]}, dtype=object).astype({"block": "int64", "k": "int64"})

    return run


def _move_nodes(links: DataFrame, start: DataFrame, total: int, where: DataFrame, rough: bool = False) -> tuple[DataFrame, bool]:
    """((node, community, k), whether any node moved): nodes of ``links`` (u, v, weight; a loop holds twice its inner
    weight) move from ``start`` (node, community) while a move raises the modularity.

    Components (``where``: node, component) share neither links nor communities, so small ones are dealt to blocks as a
    whole, and what their blocks do adds up.  If there are larger ones, their communities are dealt anew each round; of the
    sets of blocks in :func:`_choices` a round makes the moves that raise the modularity most.  One of them always
    raises it, so there is a last round.  A ``rough`` pass leaves small gains to a later pass."""
    degree = links.groupBy(F.col("u").alias("node")).agg(F.sum("weight").alias("k"), F.count("*").alias("rows"))
    state = start.join(degree, "node").join(where, "node")
    sizes = state.groupBy("component").agg(F.sum("rows").alias("links"))
    sizes = materialize(sizes.withColumn("large", F.col("links") > BLOCK_LINKS), "lv")
    rows, large = sizes.agg(F.sum("links"), F.max("large")).first()
    state, gained, turn = materialize(state.join(sizes, "component").select("node", "community", "k", "component", "large"), "lv"), 0, 0
    between, blocks, kind = links.filter("u <> v"), -(-rows // BLOCK_LINKS), links.schema["u"].dataType.simpleString()
    while True:
        deal = F.when(F.col("large"), F.xxhash64("community", F.lit(turn))).otherwise(F.xxhash64("component"))
        tot = state.groupBy("community").agg(F.sum("k").alias("tot"))
        placed = materialize(state.join(tot, "community").select("node", "community", "k", "tot", F.pmod(deal, F.lit(blocks)).alias("block")), "lv")
        none = F.lit(0).cast("long")
        own = placed.select("block", F.col("node").alias("u"), F.col("node").alias("v"), F.col("community").alias("c"), "tot", none.alias("w"), "k")
        ends = between.join(placed.select(F.col("node").alias("u"), "block"), "u").join(placed.select(F.col("node").alias("v"), F.col("block").alias("other"), F.col("community").alias("c"), "tot"), "v")
        inside = ends.filter("block = other").select("block", "u", "v", "c", "tot", F.col("weight").cast("long").alias("w"), none.alias("k"))
        seen = own.unionByName(inside)
        if large:
            out = ends.filter("block <> other").groupBy("block", "u", "c", "tot").agg(F.sum("weight").cast("long").alias("w"))
            seen = seen.unionByName(out.select("block", "u", F.lit(None).cast(kind).alias("v"), "c", "tot", "w", none.alias("k")))
        moves = seen.repartition(blocks, "block").groupBy("block").applyInPandas(_moves_of(total), f"block long, node {kind}, own {kind}, to {kind}, k long")
        moves = materialize(moves, "lv")
        if not moves.limit(1).count():
            return state.select("node", "community", "k"), gained > 0
        choices, raised = moves, 1
        if large:
            choices = materialize(_choices(moves, turn), "lv")
            choice, raised = _best(between, state, choices, total)
            choices = choices.filter(F.col("choice") == choice)
        then = state.join(choices.select("node", "to"), "node", "left").withColumn("community", F.coalesce("to", "community")).drop("to")
        then = materialize(then.select(state.columns), "lv")
        discard(state)
        discard(placed)
        state, gained, turn = then, gained + raised, turn + 1
        if not large or rough and raised * _ROUGH < gained:
            return state.select("node", "community", "k"), True


def _choices(moves: DataFrame, turn: int) -> DataFrame:
    """Sets of moves, as (choice, node, own, to, k).  Choice 0: those of one block, which raise the modularity as the block
    has seen it.  Choice n: those of about one block in 2^(n-1), by a hash of block and turn; each set holds the next, so
    together they have some two rows a move."""
    one = moves.agg(F.min_by("block", F.xxhash64("block", F.lit(turn))).alias("block"))
    alone = moves.join(F.broadcast(one), "block").withColumn("choice", F.lit(0))
    share = F.pmod(F.xxhash64("block", F.lit(-1 - turn)), F.lit(1 << _HALVINGS)) / (1 << _HALVINGS)  # in [0, 1)
    last = sum(((share < 2.0**-n).cast("int") for n in range(1, _HALVINGS)), F.lit(1))
    some = moves.withColumn("choice", F.explode(F.sequence(F.lit(1), last)))
    return alone.select("choice", "node", "own", "to", "k").unionByName(some.select("choice", "node", "own", "to", "k"))


def _best(between: DataFrame, state: DataFrame, choices: DataFrame, total: int) -> tuple[int | None, int]:
    """(the choice whose moves raise the modularity most, by how much times the square of the total), or None
    where there are no moves.  It is summed over the edges and communities that the moves touch."""
    m = choices.select("choice", F.col("node").alias("u"), F.col("own").alias("a"), F.col("to").alias("b"))
    near = between.join(m, "u").join(state.select(F.col("node").alias("v"), "community"), "v")
    edge = near.join(choices.select("choice", F.col("node").alias("v"), F.col("to").alias("after")), ["choice", "v"], "left")
    same = (F.col("b") == F.coalesce("after", "community")).cast("int") - (F.col("a") == F.col("community")).cast("int")
    inner = edge.groupBy("choice").agg(F.sum(_whole("weight") * same * F.when(F.col("after").isNull(), 2).otherwise(1)).alias("inner"))
    change = choices.select("choice", F.explode(F.array(F.struct(F.col("own").alias("community"), (-F.col("k")).alias("d")), F.struct(F.col("to").alias("community"), F.col("k").alias("d")))).alias("x")).groupBy("choice", "x.community").agg(F.sum("x.d").alias("d"))
    tot = state.groupBy("community").agg(F.sum("k").alias("tot")).join(change, "community")
    square = tot.groupBy("choice").agg(F.sum(_whole("d") * (2 * F.col("tot") + F.col("d"))).alias("square"))
    rows = square.join(inner, "choice", "left").collect()  # a row for each choice, 17 at most
    raised = [(int(r["inner"] or 0) * total - int(r["square"]), -r["choice"]) for r in rows]
    best = max(raised, default=(0, 0))
    return (-best[1], best[0]) if best[0] > 0 else (None, 0)


def _contracted(links: DataFrame, comm: DataFrame) -> DataFrame:
    """Links between communities; those inside one become its loop."""
    c1, c2 = comm.select(F.col("node").alias("u"), F.col("community").alias("cu")), comm.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    return materialize(links.join(c1, "u").join(c2, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("weight").alias("weight")), "lv")


def _connected(links: DataFrame, comm: DataFrame) -> DataFrame:
    """Communities cut into their connected parts, each named by its least node; a cut raises the modularity."""
    c1, c2 = comm.select(F.col("node").alias("u"), F.col("community").alias("cu")), comm.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    inner = links.filter("u < v").join(c1, "u").join(c2, "v").filter("cu = cv").select("u", "v")
    parts = connected_components(inner, "u", "v")
    return materialize(comm.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community")), "lv")


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): weighted modularity communities, each connected, such that moving any one node to
    another community does not raise the modularity, nor does merging two.

    Nodes move, communities are cut into connected parts and become the nodes of a smaller graph, until its nodes stay
    where they are too; then nodes of the first graph get their turn again, until none of it changes anything.
    The same edges give the same communities wherever rows lie: weights are whole numbers, and gains are
    compared in whole numbers too.  A community is named by its least node.
    """
    base = materialize(both_ways(edges).filter("u <> v"), "lv")
    part = materialize(base.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct(), "lv")
    total = base.agg(F.sum("weight")).first()[0]
    if not total:
        return part
    where = materialize(connected_components(base.filter("u < v"), "u", "v"), "lv")
    first = True
    while True:
        state, went = _move_nodes(base, part, total, where, rough=first)
        if not (went or first):
            return part
        part = _connected(base, state)
        settled = not first and _groups_of(part) == _groups_of(state)
        first = False
        while True:
            links = _contracted(base, part)
            upper, went = _move_nodes(links, links.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct(), total, where, rough=True)
            discard(links)
            if not went:
                break
            settled = False
            up = upper.select(F.col("node").alias("community"), F.col("community").alias("over"))
            named = part.join(up, "community").select("node", "over")
            least = named.groupBy("over").agg(F.min("node").alias("community"))
            part = materialize(named.join(least, "over").select("node", "community"), "lv")
        if settled:  # no node gains, nothing was cut, nothing merged
            return part


def _groups_of(comm: DataFrame) -> int:
    return comm.agg(F.count_distinct("community")).first()[0]


def cobid_degree(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct partners."""
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count_distinct("v").alias("degree"))


#: Neighbours of a node that stand in one row at most.
NEAR_IN_ROW = 1024
#: Rows that the levels of a search hold at most, should each of its sources reach every node.
SEARCH_ROWS = 1 << 26


def _neighbours(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(u, near): the neighbours of each node, by the numbers of ``ids`` (node, id), in lists of at most ``NEAR_IN_ROW``."""
    u, v = (ids.select(F.col("node").alias(x), F.col("id").alias(f"{x}_id")) for x in "uv")
    rows = links.join(u, "u").join(v, "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    part = F.floor((F.row_number().over(Window.partitionBy("u").orderBy("v")) - 1) / NEAR_IN_ROW)
    return materialize(rows.withColumn("part", part).groupBy("u", "part").agg(F.collect_list("v").alias("near")).select("u", "near"), "near")


def _visits(rows: DataFrame, near: DataFrame, carried: str) -> DataFrame:
    """(s, v, ``carried``): ``rows`` at the neighbours of their nodes.  A join meets lists, so that it handles nodes and not links."""
    return rows.select("s", F.col("v").alias("u"), carried).join(near, "u").select("s", F.explode("near").alias("v"), carried)


def _dependencies(near: DataFrame, sources: DataFrame) -> DataFrame:
    """(v, delta): what the shortest paths from the sources (id) give each node they pass, summed.  A breadth-first
    search from all of them, level by level, then the shares back.  What a step brings and what it meets lie in
    one table that is grouped by source and node, so that each step is one shuffle."""
    front = materialize(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")), "bc")
    levels, seen = [front], front.select("s", "v")
    while True:
        met = _visits(levels[-1], near, "sigma").withColumn("old", F.lit(False)).unionByName(seen.select("s", "v", F.lit(0.0).alias("sigma"), F.lit(True).alias("old")))
        step = met.groupBy("s", "v").agg(F.sum("sigma").alias("sigma"), F.max("old").alias("old")).filter("not old").drop("old")
        step = materialize(step, "bc")
        if not step.limit(1).count():
            discard(step)
            break
        levels.append(step)
        seen = levels[-1].select("s", "v").unionByName(levels[-2].select("s", "v"))  # neighbours of a level lie in it or beside it
    below, parts = levels[-1].withColumn("delta", F.lit(0.0)), []
    for level in reversed(levels[1:-1]):  # a source gets nothing from its own paths, and the last level nothing at all
        share = _visits(below.withColumn("x", (1 + F.col("delta")) / F.col("sigma")), near, "x").withColumn("sigma", F.lit(None).cast("double"))
        here = share.unionByName(level.withColumn("x", F.lit(0.0))).groupBy("s", "v").agg(F.max("sigma").alias("sigma"), F.sum("x").alias("x"))
        below = materialize(here.filter("sigma is not null").select("s", "v", "sigma", (F.col("sigma") * F.col("x")).alias("delta")), "bc")
        parts.append(below)
    out = reduce(DataFrame.unionByName, (p.select("v", "delta") for p in parts or [below]))
    out = materialize(out.groupBy("v").agg(F.sum("delta").alias("delta")), "dep")
    for table in levels + parts:
        discard(table)
    return out


#: Sources times links that a task searches, about.
SEARCH_WORK = 1 << 26
#: A component of more links is searched by joins; one of fewer lies in a task, which searches from some of its nodes.
TASK_LINKS = 1 << 22
#: Rows that the links of a component take at most, over all tasks that search it.
TASK_COPIES = 1 << 27
#: Links that the sources searched at a time inside a task have, about.
VISITS = 1 << 20


def _shares(start, near, sources):
    """What the shortest paths from ``sources`` give each node: the neighbours of node v are near[start[v]:start[v + 1]].
    A cell is a source and a node; some sources go level by level at the same time, then the shares come back."""
    import numpy as np

    n, degree = len(start) - 1, np.diff(start)
    out, step = np.zeros(n), max(1, VISITS // max(len(near), n))
    for at in range(0, len(sources), step):
        some = sources[at : at + step]
        cells = len(some) * n
        new, sigma, place = np.ones(cells, bool), np.zeros(cells), np.empty(cells, np.int64)
        front = np.arange(len(some)) * n + some
        new[front], sigma[front], levels = False, 1.0, []
        while True:
            v = front % n
            d = degree[v]
            owner = np.repeat(np.arange(len(front)), d)
            cell = (front - v)[owner] + near[np.arange(len(owner)) + (start[v] - np.cumsum(d) + d)[owner]]
            down = new[cell]
            owner, cell = owner[down], cell[down]
            if not len(cell):
                break
            levels.append((front, owner, cell))
            turn = np.arange(len(cell))
            place[cell] = turn
            then = cell[place[cell] == turn]
            place[then] = np.arange(len(then))
            sigma[then] = np.bincount(place[cell], sigma[front][owner], len(then))
            new[then] = False
            front = then
        delta = np.zeros(cells)
        for front, owner, cell in reversed(levels[1:]):  # a source gets nothing from its own paths
            delta[front] = sigma[front] * np.bincount(owner, (1 + delta[cell]) / sigma[cell], len(front))
        out += delta.reshape(-1, n).sum(0)
    return out


def _searched(pdf):
    """(id, delta) of the rows (component, turn, turns, u, v): of each component, from every ``turns``-th node."""
    import numpy as np
    import pandas as pd

    found = []
    for (_, turn), part in pdf.groupby(["component", "turn"], sort=False):
        ends = np.concatenate([part["u"].to_numpy(), part["v"].to_numpy()])
        names, at = np.unique(ends, return_inverse=True)
        u, v = at[: len(part)], at[len(part) :]
        start = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(names)))])
        delta = _shares(start, v[np.argsort(u, kind="stable")], np.arange(turn, len(names), part["turns"].iloc[0]))
        found.append(pd.DataFrame({"id": names[delta > 0], "delta": delta[delta > 0]}))
    return pd.concat(found)


def _all_dependencies(links: DataFrame, ids: DataFrame) -> list[DataFrame]:
    """Tables of (v, delta) whose sums are what the shortest paths from all nodes give each node they pass.  Paths stay in their
    component, so a task takes the links of whole components, or those of one and a share of its nodes as sources; components of
    more than ``TASK_LINKS`` links are searched by joins, some sources after others."""
    comp = connected_components(links.filter("u < v"), "u", "v").select("node", F.xxhash64("component").alias("component"))
    at = materialize(ids.join(comp, "node"), "ids")
    u, v = at.select(F.col("node").alias("u"), F.col("id").alias("u_id"), "component"), at.select(F.col("node").alias("v"), F.col("id").alias("v_id"))
    rows = materialize(links.join(u, "u").join(v, "v").select("component", F.col("u_id").alias("u"), F.col("v_id").alias("v")), "links")
    sizes = at.groupBy("component").agg(F.count("*").alias("n")).join(rows.groupBy("component").agg(F.count("*").alias("m")), "component")
    turns = F.least(F.ceil(F.col("n") * F.col("m") / SEARCH_WORK), F.greatest(F.lit(1), F.floor(F.lit(TASK_COPIES) / F.col("m")))).cast("int")
    sizes = materialize(sizes.withColumn("turns", F.when(F.col("m") <= TASK_LINKS, turns)), "sizes")
    tasks, reach = sizes.agg(F.coalesce(F.sum("turns"), F.lit(0)), F.sum(F.when(F.col("turns").isNull(), F.col("n") * F.col("n")))).first()
    out = []
    if tasks:
        buckets = min(tasks, 1 << 14)
        dealt = rows.join(small(sizes.filter("turns is not null").select("component", "turns")), "component").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("component") + F.col("turn"), F.lit(buckets))).repartition(buckets, "bucket")
        found = dealt.groupBy("bucket").applyInPandas(_searched, "id long, delta double")
        out.append(materialize(found.groupBy(F.col("id").alias("v")).agg(F.sum("delta").alias("delta")), "dep"))
    if reach:
        wide = at.join(small(sizes.filter("turns is null").select("component")), "component", "left_semi").select("node", "id")
        wide, batches = materialize(wide, "wide"), -(-int(reach) // SEARCH_ROWS)
        near = _neighbours(links, wide)
        out += [_dependencies(near, wide.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == i)) for i in range(batches)]
    return out


def betweenness(edges: DataFrame, sample: int | None = 400, batch: int | None = None) -> DataFrame:
    """(node, betweenness): normalised, 4 decimals; from all nodes, or, with a ``sample``, from so many of them by a hash where
    there are more.  Sampled sources are searched from ``batch`` at a time, else from as many as keep the levels of a search
    within ``SEARCH_ROWS`` rows; each batch is summed by node before the next."""
    links = materialize(both_ways(edges).select("u", "v").distinct(), "links")
    ids = materialize(links.select(F.col("u").alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()), "ids")
    n = ids.count()
    if n <= 2:
        return ids.select("node", F.lit(0.0).alias("betweenness"))
    k = min(n, sample or n)
    if sample is None:
        sums = _all_dependencies(links, ids)
    else:
        n_batches = -(-k // batch) if batch else min(k, -(-k * n // SEARCH_ROWS))
        chosen = ids.withColumn("h", F.xxhash64("node")).orderBy("h", "node").limit(sample)
        chosen = materialize(chosen.withColumn("part", (F.row_number().over(Window.orderBy("h", "node")) - 1) % n_batches), "bc")  # ``sample`` rows
        near = _neighbours(links, ids)
        sums = [_dependencies(near, chosen.filter(F.col("part") == i)) for i in range(n_batches)]
    scale = (n / k) / ((n - 1) * (n - 2))
    total = reduce(DataFrame.unionByName, sums).groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("d"))
    return ids.join(total, "id", "left").select("node", F.bround(F.coalesce("d", F.lit(0.0)) * scale, 4).alias("betweenness"))


def cobid_centrality(t: Tables, min_shared: int = 2, sample: int | None = None) -> DataFrame:
    """(provider_cuit, cobid_degree, cobid_betweenness) over all dates, from all providers unless a ``sample`` is asked for."""
    edges = materialize(cobid_edges(t, min_shared, Config()), "cent")
    return cobid_degree(edges).join(betweenness(edges, sample), "node").select(F.col("node").alias("provider_cuit"), F.col("degree").alias("cobid_degree"), F.col("betweenness").alias("cobid_betweenness"))


# ---- graphs around entities: edges (anchor, source, target, kind, amount, currency) -----------------


def _awards(t: Tables, cfg: Config) -> DataFrame:
    p = process_window(t.process, cfg).select("process_number", "unit_code")
    return t.contract.join(p, "process_number")


def _won(rows: DataFrame, *anchor: str) -> DataFrame:
    """One edge from provider to process: the sum of its awards."""
    return rows.groupBy(*anchor, F.concat(F.lit("provider:"), "provider_cuit").alias("source"), F.concat(F.lit("process:"), "process_number").alias("target")).agg(F.round(F.sum(F.col("total_amount").cast("decimal(38,4)")), 2).cast("double").alias("amount"), F.min("currency").alias("currency")).withColumn("kind", F.lit("WON"))


EDGE = ("anchor", "source", "target", "kind", "amount", "currency")


def provider_graph(t: Tables, cuits: DataFrame, cfg: Config, won_only: bool = False) -> DataFrame:
    """Edges around providers (a frame with ``cuit``): WON and BID to processes, CONTACT to all who share one.
    A process that was won has no BID edge."""
    a = cuits.select(F.col("cuit").alias("provider_cuit")).distinct()
    won = _won(_awards(t, cfg).join(a, "provider_cuit").withColumn("anchor", F.col("provider_cuit")), "anchor")
    out = won.select(*EDGE)
    if not won_only:
        bids = bidders(t, cfg).join(a, "provider_cuit")
        bid = bids.select(F.col("provider_cuit").alias("anchor"), F.concat(F.lit("provider:"), "provider_cuit").alias("source"), F.concat(F.lit("process:"), "process_number").alias("target"))
        bid = bid.join(won.select("source", "target"), ["source", "target"], "left_anti")
        out = out.unionByName(bid.select("anchor", "source", "target", F.lit("BID").alias("kind"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency")))
    own = t.contact.filter("entity_type = 'provider'").select("entity_key", F.concat(F.lit("contact:"), "contact_type", F.lit(":"), "contact_value").alias("target")).distinct()
    mine = own.join(a.withColumnRenamed("provider_cuit", "entity_key"), "entity_key").select(F.col("entity_key").alias("anchor"), "target")
    contact = own.join(mine, "target").select("anchor", F.concat(F.lit("provider:"), "entity_key").alias("source"), "target", F.lit("CONTACT").alias("kind"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency"))
    return out.unionByName(contact)


def provider_touches(t: Tables, cuits: DataFrame, cfg: Config) -> DataFrame:
    """(source, target), with repeats: the ends of the edges of :func:`provider_graph`, without amounts, of which nothing is
    summed and no contact meets itself."""
    a = cuits.select(F.col("cuit").alias("provider_cuit")).distinct()
    rows = t.bid.select("process_number", "provider_cuit").unionByName(t.contract.select("process_number", "provider_cuit"))
    rows = rows.join(process_window(t.process, cfg).select("process_number"), "process_number", "left_semi").join(a, "provider_cuit", "left_semi")
    own = t.contact.filter("entity_type = 'provider'").select("entity_key", F.concat(F.lit("contact:"), "contact_type", F.lit(":"), "contact_value").alias("target")).distinct()
    mine = own.join(a.withColumnRenamed("provider_cuit", "entity_key"), "entity_key", "left_semi").select("target")
    contact = own.join(mine, "target", "left_semi").select(F.concat(F.lit("provider:"), "entity_key").alias("source"), "target")
    return rows.select(F.concat(F.lit("provider:"), "provider_cuit").alias("source"), F.concat(F.lit("process:"), "process_number").alias("target")).unionByName(contact)


def unit_graph(t: Tables, codes: DataFrame, cfg: Config) -> DataFrame:
    """MANAGED edges from units to their processes, WON edges of those."""
    a = codes.select(F.col("code").alias("unit_code")).distinct()
    procs = process_window(t.process, cfg).join(a, "unit_code")
    managed = procs.select(F.col("unit_code").alias("anchor"), F.concat(F.lit("unit:"), "unit_code").alias("source"), F.concat(F.lit("process:"), "process_number").alias("target"), F.lit("MANAGED").alias("kind"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency"))
    won = _won(_awards(t, cfg).join(a, "unit_code").withColumn("anchor", F.col("unit_code")), "anchor")
    return managed.unionByName(won.select(*EDGE))


def authorizer_graph(t: Tables, names: DataFrame, cfg: Config) -> DataFrame:
    """AUTHORIZED edges from officials to the processes whose contracts they signed, WON edges of those."""
    a = t.authorized_by.join(names.select(F.col("name").alias("authorizer")).distinct(), "authorizer").distinct()
    rows = _awards(t, cfg).join(a, ["document_number", "source"]).withColumn("anchor", F.col("authorizer"))
    signed = rows.select("anchor", F.concat(F.lit("authorizer:"), "authorizer").alias("source"), F.concat(F.lit("process:"), "process_number").alias("target"), F.lit("AUTHORIZED").alias("kind"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency")).distinct()
    return signed.unionByName(_won(rows.drop("source"), "anchor").select(*EDGE))


def summarise_graph(edges: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(counts, kept edges) for each anchor: nodes and edges by kind over the whole graph, and the edges among
    the first ``max_nodes`` nodes, the anchor first, then by name."""
    ends = edges.select("anchor", F.explode(F.array("source", "target")).alias("node")).distinct()
    group = F.substring_index("node", ":", 1)
    counts = ends.groupBy("anchor", F.concat(F.lit("node:"), group).alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy("anchor", F.concat(F.lit("edge:"), "kind").alias("kind")).agg(F.count("*").alias("n")))
    first = Window.partitionBy("anchor").orderBy((F.substring_index("node", ":", -1) != F.col("anchor")).cast("int"), "node")
    kept = ends.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= max_nodes).select("anchor", "node")
    inside = edges.join(kept.withColumnRenamed("node", "source"), ["anchor", "source"], "left_semi").join(kept.withColumnRenamed("node", "target"), ["anchor", "target"], "left_semi")
    return counts, inside


def shared_subgraph(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nodes to keep when several anchors are shown together: anchors, processes that touch two anchors or two
    providers, contacts of two providers, and providers that touch those."""
    e = edges.select("source", "target").distinct()
    anchor = anchors.select(F.col("node").alias("source")).distinct().withColumn("is_anchor", F.lit(True))
    touch = e.join(anchor, "source", "left").withColumn("provider", F.startswith("source", F.lit("provider:")))
    deg = touch.groupBy("target").agg(F.sum(F.when(F.col("is_anchor"), 1).otherwise(0)).alias("n_anchor"), F.sum(F.col("provider").cast("int")).alias("n_provider"))
    hub = deg.filter("(startswith(target, 'process:') and (n_anchor >= 2 or n_provider >= 2)) or (startswith(target, 'contact:') and n_provider >= 2)").select("target")
    provs = e.join(hub, "target", "left_semi").filter("startswith(source, 'provider:')").select(F.col("source").alias("node"))
    return anchors.select("node").unionByName(hub.select(F.col("target").alias("node"))).unionByName(provs).distinct()


def collapse_leaf_processes(edges: DataFrame, threshold: int = 12) -> DataFrame:
    """(source, target, n): a provider's processes that nothing else touches become one edge once there are more
    than ``threshold`` of them.  Edges to processes are dealt by process once, and each is told there whether it is the only one."""
    e = edges.select("source", "target")
    is_process = F.coalesce(F.startswith("target", F.lit("process:")), F.lit(False))
    alone = (F.count("*").over(Window.partitionBy("target")) == 1) & F.coalesce(F.startswith("source", F.lit("provider:")), F.lit(False))
    to_process = materialize(e.filter(is_process).repartition("target").distinct().withColumn("leaf", alone), "leaf")
    many = to_process.filter("leaf").groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") > threshold)
    many = materialize(many, "leaf")
    kept = to_process.join(small(many.select("source", F.lit(True).alias("gone"))), "source", "left").filter("not leaf or gone is null")
    kept = kept.select("source", "target").unionByName(e.filter(~is_process).distinct()).withColumn("n", F.lit(1).cast("long"))
    return kept.unionByName(many.select("source", F.concat(F.lit("cluster:"), "source").alias("target"), "n"))


def pair_history(t: Tables, pairs: DataFrame) -> DataFrame:
    """(a, b, process_number, winners) of the processes that both of a pair bid on.  The pairs of each process meet the
    pairs asked for, so the rows grow with the processes, not with the bids of all that are asked for."""
    asked = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") > F.col("b")).alias("turned")), "hist")
    both = process_pairs(bidder_lists(t.bid.select("process_number", "provider_cuit").distinct())).join(small(asked), ["a", "b"])
    won = t.contract.groupBy("process_number").agg(F.array_sort(F.collect_set("provider_cuit")).alias("winners"))
    one, two = F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b"))
    return both.join(won, "process_number", "left").select(one.alias("a"), two.alias("b"), "process_number", "winners")


def provider_names(t: Tables) -> DataFrame:
    return t.provider.select(F.col("cuit").alias("member"), name_or_dash(F.col("business_name")).alias("name"))
