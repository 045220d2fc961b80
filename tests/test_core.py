"""Behaviour of the procurement operators: quirks, group checks on small graphs, brute force on random ones."""

import itertools
import math
import os
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tenderlens.functions import normalize as norm
from tenderlens.operators import checks, groups, ingest, network, profiles, runs, scoring, valuation
from tenderlens.operators.components import connected_components
from tenderlens.plans import fixture_map, queries
from tenderlens.plans.staging import materialize, measured_bytes
from tenderlens.plans.tables import Config, Tables, ordinals, process_window, top_n
from tenderlens.sources import snapshot
from tenderlens.streaming import incremental

PROCESS = "process_number string, source string, process_type_code string, selection_procedure string, status string, opening_date date, scheduled_date date, gazette_date date, scraped_at date, descriptive_name string, currencies array<string>, unit_code string, authorizer string, source_url string"


def tables(spark, bids, wins, contacts=(), n=30):
    """A world of processes p0.. with bids (process, provider) and wins."""
    day = date(2020, 1, 15)
    provs = sorted({b for _, b in bids} | {x for c in contacts for x in c[:1]})
    return Tables(
        process=spark.createDataFrame([(f"p{i}", "comprar", "LPR", "Licitacion", "F", day, None, None, day, "x", ["ARS"], "u1", "A", f"url{i}") for i in range(n)], PROCESS),
        unit=spark.createDataFrame([("u1", "comprar", "Unit", 1)], "code string, source string, name string, rnk int"),
        provider=spark.createDataFrame([(p, f"Name {p}") for p in provs], "cuit string, business_name string"),
        bid=spark.createDataFrame([(p, b, 100.0, "ARS", None) for p, b in bids], "process_number string, provider_cuit string, total_amount double, currency string, submitted_at date"),
        bid_line=spark.createDataFrame([], "process_number string, provider_cuit string, line_number int, unit_price double, offered_quantity double"),
        contract=spark.createDataFrame([(f"d{i}", "comprar", p, b, 100.0, "ARS", 100.0, None, day) for i, (p, b) in enumerate(wins)], "document_number string, source string, process_number string, provider_cuit string, total_amount double, currency string, current_amount double, variation_pct double, perfection_date date"),
        authorized_by=spark.createDataFrame([(f"d{i}", "comprar", "A") for i in range(len(wins))], "document_number string, source string, authorizer string"),
        contact=spark.createDataFrame([("provider", p, None, k, v) for p, k, v in contacts], "entity_type string, entity_key string, source string, contact_type string, contact_value string"),
        price_index=spark.createDataFrame([("official", date(2020, 1, 1), 100.0)], "series_id string, period date, index_value double"),
        fx_rate=spark.createDataFrame([("USD", date(2020, 1, 2), 2.0)], "currency string, observed_date date, rate double"),
    )


def meeting(groups_of, times):
    """Every process p is bid on by all of a group, ``times`` processes a group."""
    out, at = [], 0
    for g in groups_of:
        for _ in range(times):
            out += [(f"p{at}", m) for m in g]
            at += 1
    return out


def test_rotating_trio_is_a_ring(spark):
    t = tables(spark, meeting([["A", "B", "C"]], 6), [(f"p{i}", "ABC"[i % 3]) for i in range(6)])
    rows = groups.bid_rotation_ring(t, Config()).collect()
    assert [(r.ring_id, r.provider_cuit, r.ring_size, r.shared_processes, r.member_wins, r.rotation_pct) for r in rows] == [(1, m, 3, 6, 2, 100.0) for m in "ABC"]
    assert [x.text for x in rows[0].co_members] == ["B (Name B)", "C (Name C)"]


def test_dominator_star_and_large_clique_are_no_rings(spark):
    trio = meeting([["A", "B", "C"]], 6)
    assert groups.bid_rotation_ring(tables(spark, trio, [(f"p{i}", "A") for i in range(6)]), Config()).count() == 0
    star = meeting([["H", f"L{i}"] for i in range(6)], 5)
    assert groups.bid_rotation_ring(tables(spark, star, [(f"p{i}", "H") for i in range(30)]), Config()).count() == 0
    ten = [chr(65 + i) for i in range(10)]
    assert groups.bid_rotation_ring(tables(spark, meeting([ten], 6), [(f"p{i}", ten[i]) for i in range(6)]), Config()).count() == 0


def test_contact_cluster_needs_a_common_process(spark):
    links = [("X", "Phone", "1"), ("Y", "Phone", "1"), ("X", "Email", "e"), ("Y", "Email", "e")]
    t = tables(spark, [("p0", "X"), ("p0", "Y")], [("p0", "X")], links)
    rows = groups.shared_contact_cluster(t, Config()).collect()
    assert [(r.provider_cuit, r.cluster_size, r.cobid_processes, r.distinct_winners, len(r.shared_contacts)) for r in rows] == [("X", 2, 1, 1, 2), ("Y", 2, 1, 1, 2)]
    assert groups.shared_contact_cluster(tables(spark, [("p0", "X"), ("p1", "Y")], [], links), Config()).count() == 0


def random_edges(spark, rng, n, p):
    e = [(f"n{a:02}", f"n{b:02}", rng.randint(1, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < p]
    return e, spark.createDataFrame(e, "a string, b string, weight long").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_algorithms_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    raw, edges = random_edges(spark, rng, 16, 0.28)
    near = {}
    for a, b, _ in raw:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    # components
    comp = {}
    for v in sorted(near):
        if v not in comp:
            stack = [v]
            while stack:
                x = stack.pop()
                if x not in comp:
                    comp[x] = v
                    stack += near[x]
    assert {r.node: r.component for r in connected_components(edges, "a", "b").collect()} == comp
    # cliques
    cliques = set()
    for k in range(3, 6):
        for c in itertools.combinations(sorted(near), k):
            if all(y in near[x] for x, y in itertools.combinations(c, 2)) and not any(all(y in near[x] for x in c) for y in near if y not in c):
                cliques.add(c)
    found = lambda least, rows: {tuple(r.members) for r in network.maximal_cliques(edges, least, 5, split_rows=rows).collect()}
    pairs = {(a, b) for a, b, _ in raw if not near[a] & near[b]}
    if seed == 1:  # whole neighbourhoods, and such as are split by the second vertex
        assert found(3, 10_000) == cliques == found(3, 2)
    else:
        assert found(2, 10_000) == cliques | pairs == found(2, 1)
    # k-core
    live = {v: set(s) for v, s in near.items()}
    while gone := [v for v, s in live.items() if len(s) < 3]:
        for v in gone:
            for u in live.pop(v):
                live.get(u, set()).discard(v)
    assert {(r.a, r.b) for r in network.k_core(edges, 3).collect()} == {(a, b) for a, b, _ in raw if a in live and b in live}
    # betweenness
    score = dict.fromkeys(near, 0.0)
    for s in near:
        dist, sigma, order, at = {s: 0}, {s: 1.0}, [s], 0
        while at < len(order):
            v = order[at]
            at += 1
            for u in near[v]:
                if u not in dist:
                    dist[u], sigma[u] = dist[v] + 1, 0.0
                    order.append(u)
                if dist[u] == dist[v] + 1:
                    sigma[u] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in near[u]:
                if dist.get(v, -9) == dist[u] - 1:
                    delta[v] += sigma[v] / sigma[u] * (1 + delta[u])
            if u != s:
                score[u] += delta[u]
    n = len(near)
    for r in network.betweenness(edges, batch=100 if seed == 1 else 8).collect():
        assert abs(r.betweenness - score[r.node] / ((n - 1) * (n - 2))) < 1e-4
    # disjoint choice
    ranked = sorted(cliques, key=lambda c: (-len(c), list(c)))
    taken, used = set(), set()
    for c in ranked:
        if not used & set(c):
            taken.add(c)
            used |= set(c)
    rows = spark.createDataFrame([("|".join(c), list(c), len(c)) for c in cliques], "group_id string, members array<string>, size int")
    assert {tuple(r.members) for r in network.select_disjoint(rows, ["size"]).collect()} == taken


def core_numbers(raw):
    live, out = {}, {}
    for a, b in raw:
        live.setdefault(a, set()).add(b)
        live.setdefault(b, set()).add(a)
    k = 1
    while live:
        gone = [v for v, s in live.items() if len(s) <= k]
        for v in gone:
            out[v] = k
            for u in live.pop(v):
                live.get(u, set()).discard(v)
        k += not gone
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_core_numbers(spark, seed):
    rng = random.Random(seed)
    raw, edges = random_edges(spark, rng, 26, 0.16)
    tails = [(f"n{k:02}", f"t{k}0") for k in range(0, 9, 3)] + [(f"t{k}{i}", f"t{k}{i + 1}") for k in range(0, 9, 3) for i in range(4)] + [("t02", "z1"), ("t02", "z2"), ("z2", "z3"), ("q1", "q2"), ("q2", "q3"), ("q3", "q1"), ("q1", "q4")]
    edges = edges.unionByName(spark.createDataFrame([(a, b, 1) for a, b in tails], "a string, b string, weight long"))
    assert {r.node: r.core for r in network.coreness(edges).collect()} == core_numbers([(a, b) for a, b, _ in raw] + tails)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    n = 2000
    path = spark.range(n - 1).selectExpr("lpad(id, 5, '0') as a", "lpad(id + 1, 5, '0') as b", "1L as weight").repartition(3)
    jobs, real = [], network.materialize
    monkeypatch.setattr(network, "materialize", lambda df, tag="t": (jobs.append(tag), real(df, tag))[1])
    got = network.coreness(path)
    assert got.count() == n and got.filter("core <> 1").count() == 0 and len(jobs) < 20
    ring = path.unionByName(spark.createDataFrame([("00000", f"{n - 1:05}", 1), ("00005", "tail", 1)], path.schema))
    assert {(r.core, r.n) for r in network.coreness(ring).groupBy("core").agg(F.count("*").alias("n")).collect()} == {(2, n), (1, 1)}


def test_a_contact_of_very_many_providers_makes_no_pairs(spark):
    n = 50_000
    t = tables(spark, [("p0", "A"), ("p0", "B"), ("p1", "A")], [("p0", "A")])
    ids = spark.range(n).selectExpr("concat('x', id) as cuit")
    more = ids.unionByName(spark.createDataFrame([("A",), ("B",)], "cuit string"))
    t.provider = more.selectExpr("cuit", "cuit as business_name")
    t.contact = more.selectExpr("'provider' as entity_type", "cuit as entity_key", "cast(null as string) as source", "'Phone' as contact_type", "'1' as contact_value")
    t.bid = t.bid.unionByName(ids.limit(0).selectExpr("'p9' as process_number", "cuit as provider_cuit", "1.0D as total_amount", "'ARS' as currency", "cast(null as date) as submitted_at"))
    rows = groups.shared_contact_cluster(t, Config(ordered=False))
    assert rows.count() == n + 2 and rows.filter("size(co_members) <> 20 or cluster_size <> 50002").count() == 0
    assert [(r.provider1_cuit, r.provider2_cuit) for r in checks.fake_competition(t, Config()).collect()] == [("A", "B")]


def test_ordinals_and_limits(spark):
    df = spark.range(0, 30_000, 1, 7).selectExpr("id", "cast(id * 7919 % 1000 as int) as x")
    order = [F.desc("x"), F.asc("id")]
    want = [r.id for r in df.orderBy(*order).collect()]
    got = {r.n: r.id for r in ordinals(df, order, "n").collect()}
    assert [got[k] for k in range(1, 30_001)] == want
    assert [r.id for r in top_n(df, order, 12_345).collect()] == want[:12_345]
    assert [r.id for r in top_n(df, order, 100).collect()] == want[:100] and [r.id for r in top_n(df, order, None).collect()] == want
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(top_n(df, order, 100))
    for d in (top_n(df, order, 12_345), top_n(df, order, None)):
        assert "TakeOrderedAndProject" not in plan(d) and "Limit" not in plan(d)
    assert "Exchange" not in plan(top_n(df, order, None, ordered=False))


def test_index_series_by_day(spark):
    """The chained series before the boundary, the official one from it on, and no way from one to the other."""
    days = [date(2016, 10, 31), date(2016, 11, 30), date(2016, 12, 1), date(2016, 12, 31), date(2017, 3, 5), date(2010, 1, 1), None]
    facts = spark.createDataFrame([(n, d, "ARS") for n, d in enumerate(days)] + [(9, days[1], None)], "k int, observed date, currency_used string")
    series = [("chained", date(2016, 9, 1), 90.0), ("chained", date(2016, 11, 1), 95.0), ("chained", date(2017, 2, 1), 1.0), ("official", date(2016, 1, 1), 2.0), ("official", date(2017, 1, 1), 101.0)]
    index = spark.createDataFrame(series, "series_id string, period date, index_value double")
    got = {r.k: (r.series_id, r.index_value, r.index_strategy) for r in valuation.link_inflation(facts, index).collect()}
    assert got == {
        0: ("chained", 90.0, "nearest_prior"), 1: ("chained", 95.0, "same_month"), 2: ("official", 2.0, "nearest_prior"), 3: ("official", 2.0, "nearest_prior"), 4: ("official", 101.0, "nearest_prior"),
        5: ("chained", None, None), 6: (None, None, None), 9: (None, None, None),
    }
    late = spark.createDataFrame([s for s in series if s[1] >= date(2017, 1, 1) or s[0] == "chained"], index.schema)
    got = {r.k: r.index_value for r in valuation.link_inflation(facts, late).collect()}
    assert got[2] is None and got[3] is None and got[4] == 101.0


def test_links_of_extension_amounts_and_lines(spark):
    """An extension in another currency makes a link of its own, at whose rate the total is told too; a label
    that says nothing keeps a line from its bid's currency."""
    t = tables(spark, [("p0", "A")], [("p0", "A")])
    t.contract = t.contract.selectExpr("*", "'USD' as extension_currency", "50.0D as max_extendable_amount", "cast(null as double) as available_extension_amount")
    t.bid_line = spark.createDataFrame([("p0", "A", 1, 0, 3.0, 6.0, None), ("p0", "A", 2, 0, 3.0, 6.0, "-"), ("p0", "A", 3, 0, 3.0, None, "USD")], "process_number string, provider_cuit string, line_number int, alternative_number int, unit_price double, total_per_line double, currency string")
    facts = valuation.priced_facts(t)
    fx = {(r.kind, r.key): (r.currency, r.rate, r.amount_fields, r.ars_then, r.unit_ars_then) for r in valuation.fx_links(facts, t).collect()}
    assert fx == {("contractual_document", "d0|comprar"): ("USD", 2.0, ["max_extendable_amount"], 200.0, None), ("bid_line", "p0|A|3|0"): ("USD", 2.0, ["unit_price"], None, 6.0)}
    index = {(r.kind, r.key): (r.amount_fields, r.ars_then, r.unit_ars_then) for r in valuation.inflation_links(facts, t).collect()}
    assert index == {
        ("bid", "p0|A"): (["total_amount"], 100.0, None), ("contractual_document", "d0|comprar"): (["max_extendable_amount", "total_amount"], 100.0, None),
        ("bid_line", "p0|A|1|0"): (["total_per_line", "unit_price"], 6.0, 3.0), ("bid_line", "p0|A|3|0"): (["unit_price"], None, None),
    }


def test_runs_answer_for_counts(spark, tmp_path):
    t = tables(spark, [("p0", "A")], [("p0", "A")])
    cfg = Config(disabled=frozenset(set(checks.REGISTRY) - {"cdi_abuse"}))
    go = lambda name, **kw: runs.run_if_needed(spark, t, kw.pop("cfg", cfg), str(tmp_path), name, **kw)
    assert go("a") == ("a", False) and go("b") == ("a", True) and go("b", after=0) == ("b", False)
    assert go("c", cfg=Config(disabled=cfg.disabled, date_from=date(2020, 1, 1))) == ("c", False) and go("d") == ("b", True)
    assert go("d", forced=True) == ("d", False)
    assert {(r.run_id, r.state, r.windowed) for r in runs.ledger(spark, str(tmp_path)).collect()} == {("a", "done", False), ("b", "done", False), ("c", "done", True), ("d", "done", False)}
    broken = Tables(**{f: getattr(t, f) for f in Tables.__dataclass_fields__})
    broken.price_index = t.price_index.withColumn("index_value", F.raise_error(F.lit("gone")).cast("double"))
    with pytest.raises(Exception, match="gone"):
        runs.persist_run(spark, broken, cfg, str(tmp_path), "e")
    row = runs.ledger(spark, str(tmp_path)).filter("run_id = 'e'").first()
    assert row.state == "failed" and "gone" in row.error and go("f") == ("d", True)
    tight = runs.persist_run(spark, t, Config(disabled=cfg.disabled, limit=1, thresholds={"cdi_min_processes": 1, "cdi_min_pct": 0.0}), str(tmp_path), "g").first()
    assert tight.at_limit == ["cdi_abuse"]


def test_communities_split_two_cliques_and_do_not_depend_on_partitions(spark):
    raw = [(f"{g}{a}", f"{g}{b}", 3) for g in "xy" for a in range(5) for b in range(a + 1, 5)] + [("x0", "y0", 1)]
    first = None
    for parts in (1, 5):
        df = spark.createDataFrame(raw, "a string, b string, weight long").repartition(parts)
        got = {r.node: r.community for r in network.communities(df).collect()}
        assert {v[0] for v in got.values()} == {"x", "y"} and all(v[0] == k[0] for k, v in got.items())
        assert first in (None, got)
        first = got


@pytest.mark.parametrize(("seed", "n", "p"), [(6, 40, 0.08)])
def test_communities_are_connected_and_no_move_gains(spark, seed, n, p):
    raw, edges = random_edges(spark, random.Random(seed), n, p)
    got = {r.node: r.community for r in network.communities(edges).collect()}
    near, k = {}, {}
    for a, b, w in raw:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = w
            k[x] = k.get(x, 0) + w
    assert set(got) == set(near)
    total = sum(k.values())
    quality = lambda of: sum((near[x].get(y, 0) if x != y else 0) * total - k[x] * k[y] for x in of for y in of if of[x] == of[y])
    best = quality(got)
    for v in near:
        for c in {got[u] for u in near[v]}:
            assert quality(got | {v: c}) <= best
    for c in set(got.values()):
        mine, stack = {v for v in got if got[v] == c}, [c]
        assert c == min(mine)
        seen = set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [y for y in near[x] if y in mine]
        assert seen == mine
        for d in set(got.values()):
            assert quality({v: (d if x == c else x) for v, x in got.items()}) <= best


@pytest.mark.parametrize(("block", "tables"), [(100_000, 25), (150, 90)])
def test_communities_take_few_tables_and_hold_over_blocks(spark, monkeypatch, block, tables):
    raw, edges = random_edges(spark, random.Random(3), 60, 0.12)
    made = []
    monkeypatch.setattr(network, "BLOCK_LINKS", block, raising=False)
    monkeypatch.setattr(network, "materialize", lambda df, tag="t": made.append(tag) or materialize(df, tag))
    got = {r.node: r.community for r in network.communities(edges).collect()}
    near, k = {}, {}
    for a, b, w in raw:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = w
            k[x] = k.get(x, 0) + w
    total, size = sum(k.values()), {}
    for v, c in got.items():
        size[c] = size.get(c, 0) + k[v]
    assert set(got) == set(near) and len(made) <= tables
    for v in near:
        to = {}
        for u, w in near[v].items():
            to[got[u]] = to.get(got[u], 0) + w
        gain = lambda c: to.get(c, 0) * total - k[v] * (size[c] - (k[v] if c == got[v] else 0))
        assert all(gain(c) <= gain(got[v]) for c in to)


def test_history_of_a_pair_makes_pairs_inside_processes_only(spark):
    bids = [(f"p{i}", x) for i in range(4) for x in "AB"] + [("p9", "A"), ("p8", "B")] + [("wide", f"s{i:03}") for i in range(70)] + [("wide", "A"), ("wide", "B")]
    t = tables(spark, bids, [("p0", "A"), ("wide", "B")])
    rows = network.pair_history(t, spark.createDataFrame([("B", "A"), ("A", "s001")], "a string, b string"))
    assert not re.search(r"Join \[a#\d+\], \[a#\d+\]", rows._jdf.queryExecution().executedPlan().toString())  # bids of a side do not meet all its pairs
    got = {(r.a, r.b, r.process_number, tuple(r.winners or ())) for r in rows.collect()}
    assert got == {("B", "A", "p0", ("A",)), ("B", "A", "wide", ("B",)), ("A", "s001", "wide", ("B",))} | {("B", "A", f"p{i}", ()) for i in (1, 2, 3)}


def test_pairs_of_wide_processes_come_from_rows_of_bounded_size(spark):
    bids = [("wide", f"s{i:03}") for i in range(200)] + [("two", "A"), ("two", "B"), ("one", "A")]
    lists = network.bidder_lists(spark.createDataFrame(bids, "process_number string, provider_cuit string").repartition(3))
    assert max(len(r.p) for r in lists.collect()) == network.PAIR_IN_ROW
    got = [(r.process_number, r.a, r.b) for r in network.process_pairs(lists).collect()]
    want = {("wide", f"s{a:03}", f"s{b:03}") for a in range(200) for b in range(a + 1, 200)} | {("two", "A", "B")}
    assert len(got) == len(want) and set(got) == want


def test_rings_read_what_pairs_met_in_and_equal_outcomes_by_member(spark, monkeypatch):
    rng = random.Random(5)
    bids = [(f"p{p}", m) for p in range(40) for m in rng.sample("ABCDEFGH", rng.randint(1, 5))]
    won = [(f"p{p}", rng.choice([m for q, m in bids if q == f"p{p}"] + ["Z"])) for p in range(40)]
    t = tables(spark, bids, won, n=38)
    cliques = [(f"g{i}", rng.sample("ABCDEFGH", rng.randint(3, 4))) for i in range(12)]
    rows = spark.createDataFrame(cliques, "group_id string, members array<string>")
    seen = lambda df: {(r.group_id, r.process_number, tuple(r.bidders), tuple(sorted(r.winners))) for r in df.collect()}
    want = seen(network.group_outcomes(rows.select("group_id", F.explode("members").alias("member")), t, Config()))
    for x in (t, network.with_edges(t)):
        assert seen(network.clique_outcomes(rows, x, Config())) == want and want
    monkeypatch.setattr(network, "group_outcomes", None)  # all bids of a member do not meet all its groups
    trio = tables(spark, meeting([["A", "B", "C"]], 6), [(f"p{i}", "ABC"[i % 3]) for i in range(6)])
    assert groups.bid_rotation_ring(trio, Config()).count() == 3


@pytest.mark.parametrize("split", [0, network.SPLIT_ROWS])
def test_cliques_do_not_depend_on_buckets(spark, monkeypatch, split):
    raw, edges = random_edges(spark, random.Random(9), 14, 0.4)
    near = {}
    for a, b, _ in raw:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    every = [set(c) for k in range(3, 9) for c in itertools.combinations(sorted(near), k) if all(y in near[x] for x, y in itertools.combinations(c, 2))]
    want = {tuple(sorted(c)) for c in every if not any(set(c) <= near[v] for v in near)}
    for rows in (3, 20_000):
        monkeypatch.setattr(network, "BUCKET_ROWS", rows)
        got = [tuple(r.members) for r in network.maximal_cliques(edges, split_rows=split).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_leaves_are_told_apart_in_one_pass(spark, tmp_path):
    rows = [(f"provider:{s}", f"process:{s}{i}") for s in "AB" for i in range(3 if s == "A" else 2)] + [("provider:A", "process:both"), ("provider:B", "process:both"), ("unit:u", "process:u1"), ("provider:A", "contact:c")]
    spark.createDataFrame(rows * 2, "source string, target string").repartition(3).write.parquet(str(tmp_path / "edges"))
    out = network.collapse_leaf_processes(spark.read.parquet(str(tmp_path / "edges")), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/edges") == 1  # contacts only; the rest was read once before
    gone = {r for r in rows if r[1].startswith("process:A")}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {(*r, 1) for r in rows if r not in gone} | {("provider:A", "cluster:provider:A", 3)}


def test_touches_are_the_ends_of_the_graph(spark):
    t = tables(spark, [("p0", "X"), ("p0", "Y"), ("p1", "X"), ("p99", "X"), ("p1", "W")], [("p0", "X"), ("p2", "Y")], [("X", "Phone", "1"), ("Y", "Phone", "1"), ("W", "Phone", "1"), ("W", "Phone", "2")])
    asked = spark.createDataFrame([("X",), ("Y",)], "cuit string")
    ends = lambda df: {(r.source, r.target) for r in df.select("source", "target").collect()}
    assert ends(network.provider_touches(t, asked, Config())) == ends(network.provider_graph(t, asked, Config()))


def test_peeling_keeps_the_core_before_an_empty_one(spark):
    ring = [(f"r{i:02}", f"r{(i + 1) % 70:02}", 1) for i in range(70)]
    df = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in ring], "a string, b string, weight long")
    assert network.peel_to_cap(df, 60).count() == 70


def test_scores(spark):
    rows = lambda key, n, ent="P1": [("provider", ent, "Name", key, str(i)) for i in range(n)]
    schema = "entity_type string, id string, name string, check string, finding string"
    score = lambda data, cfg=Config(): {r.id: r for r in scoring.entity_scores(spark.createDataFrame(data, schema), cfg).collect()}
    one = score(rows("serial_winner", 1))["P1"]
    assert one.score < 20 and one.confidence == 1 and one.evidence.multiplier == 1.0
    both = score(rows("bid_rotation_ring", 2) + rows("shared_contact_cluster", 2))["P1"]
    assert both.evidence.multiplier == 1.6 and both.score == min(100, round(80 * math.log2(3) / math.log2(11) * 1.6))
    assert score(rows("serial_winner", 10), Config(weights={"serial_winner": 50}))["P1"].base_score == 50
    heavy = score(rows("cross_agency_proxy", 10) + rows("authorizer_provider_ring", 10) + rows("bid_rotation_ring", 10))["P1"]
    assert heavy.score == 100
    assert score(rows("spending_spikes", 3))["P1"].flags == []
    unit = [("unit", "U", "n", "cdi_abuse", "1"), ("unit", "U", "n", "uoc_favoritism", "1")]
    got = score(unit)["U"]
    assert got.confidence == 2 and got.evidence.multiplier == 1.0


def test_valuation_quirks(spark):
    """Null currency: no fallback gives no link; a foreign fallback gives an FX link but counts as pesos."""
    t = tables(spark, [("p0", "A")], [("p0", "A"), ("p1", "A"), ("p2", "A")])
    cur = F.when(F.col("process_number") == "p0", F.lit(None)).when(F.col("process_number") == "p1", F.lit(None)).otherwise("USD")
    t.contract = t.contract.withColumn("currency", cur.cast("string"))
    none, usd = F.lit(None).cast("array<string>"), F.array(F.lit("USD"))
    t.process = t.process.withColumn("currencies", F.when(F.col("process_number") == "p0", none).when(F.col("process_number") == "p1", usd).otherwise(F.array(F.lit("ARS"))))
    got = {r.process_number: r for r in valuation.valued_contracts(t).collect()}
    assert got["p0"].index_value is None and got["p0"].real_ars is None and got["p0"].rate is None
    assert got["p1"].rate == 2.0 and float(got["p1"].real_ars) == 100.0
    assert got["p2"].fx_ars == 200.0 and float(got["p2"].real_ars) == 200.0 and got["p2"].fx_strategy == "previous_business_day"


def test_highest_index_not_the_latest_is_the_reference(spark):
    t = tables(spark, [("p0", "A")], [("p0", "A")])
    t.price_index = spark.createDataFrame([("official", date(2019, 1, 1), 300.0), ("official", date(2020, 1, 1), 100.0)], t.price_index.schema)
    assert float(valuation.valued_contracts(t).first().real_ars) == 300.0


def test_one_duplicate_rival_counts_once(spark):
    t = tables(spark, [("p0", "A"), ("p0", "B"), ("p0", "C")], [("p0", "A"), ("p0", "A")])
    t.bid = t.bid.withColumn("total_amount", F.when(F.col("provider_cuit") == "A", 100.0).otherwise(101.0))
    row = checks.cover_bidding(t, Config()).collect()
    assert [(r.competing_bids, r.runner_up_cuit) for r in row] == [(2, "B")]


def test_window_drops_undated_rows(spark):
    df = spark.createDataFrame([(1, None), (2, date(2020, 1, 1))], "k int, opening_date date")
    assert process_window(df, Config()).count() == 2
    assert process_window(df, Config(date_from=date(2019, 1, 1))).count() == 1


def test_upsert_is_idempotent_and_null_never_overwrites(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "z")], "k string, v string, w string")
    new = spark.createDataFrame([("a", None, "w1", 1), ("a", "x2", None, 2), ("c", "n", None, 1)], "k string, v string, w string, seq int")
    once = ingest.upsert(old, new, ["k"])
    assert {tuple(r) for r in once.collect()} == {("a", "x2", "w1"), ("b", "y", "z"), ("c", "n", None)}
    assert {tuple(r) for r in ingest.upsert(once, new, ["k"]).collect()} == {tuple(r) for r in once.collect()}


def test_streamed_bundles_twice_equal_once(spark, tmp_path):
    schema = "k string, v string, w string, seq int"
    land = tmp_path / "land"
    spark.createDataFrame([("a", "1", None, 1), ("b", "2", None, 1)], schema).write.json(str(land / "x"))
    root, check = str(tmp_path / "table"), str(tmp_path / "check")
    incremental.incremental_ingest(incremental.stream_bundles(spark, str(land / "*"), schema), root, ["k"], check).awaitTermination()
    spark.createDataFrame([("a", None, "9", 2), ("a", "1", None, 1)], schema).write.json(str(land / "y"))
    incremental.incremental_ingest(incremental.stream_bundles(spark, str(land / "*"), schema), root, ["k"], check).awaitTermination()
    got = {(r.k, r.v, r.w) for r in incremental.current(spark, root, "k string, v string, w string", ["k"]).collect()}
    assert got == {("a", "1", "9"), ("b", "2", None)}


def _landed(spark, tmp_path, batches, **kw):
    """A table after bundles that landed one after another."""
    schema, root = "k long, v string, w long, seq int", str(tmp_path / "table")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "land" / f"b{n}"))
        incremental.incremental_ingest(incremental.stream_bundles(spark, str(tmp_path / "land" / "*"), schema), root, ["k"], str(tmp_path / "check"), buckets=8, **kw).awaitTermination()
    return root


def _written(root, part):
    import glob

    return {p: os.path.getsize(p) for p in glob.glob(f"{root}/{part}/*/bucket=*/*.parquet")}


def test_a_small_bundle_rewrites_little_and_old_files_go(spark, tmp_path):
    first = [(k, f"v{k}", None, 1) for k in range(4000)]
    root = _landed(spark, tmp_path, [first, [(7, None, 70, 1), (7, "later", None, 2), (4001, "new", 1, 1)]], compact_after=3)
    whole, small = (sum(v for p, v in _written(root, "delta").items() if f"v{n:012d}" in p) for n in (0, 1))
    assert small < 0.1 * whole and not _written(root, "base")
    table = lambda: {(r.k, r.v, r.w) for r in incremental.current(spark, root, "k long, v string, w long", ["k"]).collect()}
    want = {(k, f"v{k}", None) for k in range(4000) if k != 7} | {(7, "later", 70), (4001, "new", 1)}
    assert table() == want
    for n in range(2, 5):  # bucket of 7 gathers deltas and is compacted, alone
        spark.createDataFrame([(7, None, 70 + n, 1)], "k long, v string, w long, seq int").coalesce(1).write.json(str(tmp_path / "land" / f"b{n}"))
        incremental.incremental_ingest(incremental.stream_bundles(spark, str(tmp_path / "land" / "*"), "k long, v string, w long, seq int"), root, ["k"], str(tmp_path / "check"), buckets=8, compact_after=3).awaitTermination()
    assert table() == want - {(7, "later", 70)} | {(7, "later", 74)}
    assert len({p.split("bucket=")[1].split("/")[0] for p in _written(root, "base")}) == 1
    old = {p for p in _written(root, "delta") if "v000000000001" in p and f"bucket={next(iter(_written(root, 'base'))).split('bucket=')[1].split('/')[0]}/" in p}
    assert not old and len(os.listdir(f"{root}/manifest")) <= 3


def test_a_batch_that_failed_writes_the_same_again(spark, tmp_path, monkeypatch):
    root = _landed(spark, tmp_path, [[(1, "a", None, 1), (2, "b", None, 1)]])
    spark.createDataFrame([(1, None, 5, 1)], "k long, v string, w long, seq int").write.json(str(tmp_path / "land" / "b9"))
    go = lambda: incremental.incremental_ingest(incremental.stream_bundles(spark, str(tmp_path / "land" / "*"), "k long, v string, w long, seq int"), root, ["k"], str(tmp_path / "check"), buckets=8).awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(incremental, "manifest", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision|division"):
            go()
    table = lambda: {(r.k, r.v, r.w) for r in incremental.current(spark, root, "k long, v string, w long", ["k"]).collect()}
    assert table() == {(1, "a", None), (2, "b", None)}
    go()
    assert table() == {(1, "a", 5), (2, "b", None)}
    go()
    assert table() == {(1, "a", 5), (2, "b", None)}


def test_snapshot_round_trip_redacts(spark, tmp_path):
    people = spark.createDataFrame([("ANN", "DNI", "123"), ("BOB", None, None)], "full_name string, document_type string, document_number string")
    rel = spark.createDataFrame([("Authorizer:ANN", "x", 1)], "start string, end string, seq int")
    empty = spark.createDataFrame([], "cuit string")
    out = snapshot.write_snapshot({"Authorizer": (people, "full_name"), "Provider": (empty, "cuit")}, {"SIGNED": rel}, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {("node", "Authorizer", 2), ("relation", "SIGNED", 1)}
    back = snapshot.read_nodes(spark, str(tmp_path), "Authorizer", "full_name: string, document_number: string")
    assert {(r.full_name, r.document_number) for r in back.collect()} == {("ANN", None), ("BOB", None)}
    assert not (tmp_path / "nodes_Provider.jsonl").exists()
    assert snapshot.read_relations(spark, str(tmp_path), "SIGNED").first().seq == 1


def test_run_persists_scores_and_survives_a_failing_check(spark, tmp_path, monkeypatch):
    t = tables(spark, meeting([["A", "B", "C"]], 6), [(f"p{i}", "ABC"[i % 3]) for i in range(6)])
    monkeypatch.setitem(checks.REGISTRY, "broken", checks.Check("broken", 1, {}, (), lambda t, c: 1 / 0))
    keep = {"bid_rotation_ring", "cdi_abuse", "broken"}
    cfg = Config(disabled=frozenset(set(checks.REGISTRY) - keep))
    assert runs.latest_run(spark, str(tmp_path)) is None
    status = runs.persist_run(spark, t, cfg, str(tmp_path), "r1").first()
    assert status.failed == ["broken"] and runs.latest_run(spark, str(tmp_path)) == "r1"
    found, scores = runs.read_run(spark, str(tmp_path), "r1")
    assert {r.id for r in scores.collect()} == {"A", "B", "C"} and found.count() == 3
    assert not runs.should_rerun(100, 90, Config()) and runs.should_rerun(600, 90, Config()) and runs.should_rerun(1, 1, Config(), forced=True)
    with pytest.raises(ValueError):
        runs.effective_config({"thresholds": {"nonsense": 1}})


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("05/02/2020 03:07:03 p.m.", "1.350.000,50"), ("nada", "-5,0"), (None, None), ("2020-02-30", "1,2,3")], "d string, n string")
    got = df.select(norm.parse_datetime_ar(F.col("d")).cast("string"), norm.parse_date_ar(F.col("d")).cast("string"), norm.parse_number_ar(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("2020-02-05 15:07:03", "2020-02-05", 1350000.5), (None, None, 5.0), (None, None, None), (None, None, None)]


def test_profiles_page_and_trim(spark):
    rows = spark.createDataFrame([("provider", "A", "n", "c", str(i)) for i in range(5)], "entity_type string, id string, name string, check string, finding string")
    got = profiles.trim_findings(rows, 2).collect()
    assert len(got) == 2 and {r.total for r in got} == {5}


def test_findings_do_not_depend_on_partitions(spark):
    a = fixture_map.load(spark, "/root/testdata/sf0.001")
    b = fixture_map.load(spark, "/root/testdata/sf0.001")
    b.contract, b.bid = b.contract.repartition(7, "provider_cuit"), b.bid.repartition(3)
    cfg = Config(thresholds={"uoc_min_contracts": 1, "uoc_min_amount": 0, "uoc_min_pct": 5.0})
    assert [tuple(r) for r in checks.uoc_favoritism(a, cfg).collect()] == [tuple(r) for r in checks.uoc_favoritism(b, cfg).collect()]


def test_stored_tables_are_read_and_equal_those_made_again(spark):
    lazy, stored = (fixture_map.load(spark, "/root/testdata/sf0.001", w) for w in ((), ("process", "bid", "contract", "authorized_by")))
    for name in ("process", "bid", "contract", "authorized_by"):
        a, b = getattr(lazy, name), getattr(stored, name)
        assert all(f"/{name}-" in f for f in b.inputFiles())
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_measured_bytes_count_what_lists_of_strings_hold(spark):
    df = spark.createDataFrame([(1, ["x" * 1000, None]), (2, None), (3, [])], "k long, l array<string>")
    assert measured_bytes(df) == 3 * 64 + 2 * 48 + 1000


def test_stored_tables_meet_by_process_without_a_shuffle(spark):
    t = fixture_map.load(spark, "/root/testdata/sf0.001", ("process", "bid", "contract"))
    winners = t.contract.groupBy("process_number").agg(F.collect_set("provider_cuit").alias("w"))
    met = t.bid.hint("merge").join(t.process.hint("merge"), "process_number").join(winners.hint("merge"), "process_number")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == fixture_map.load(spark, "/root/testdata/sf0.001").contract.join(t.bid, "process_number").count()


def test_documents_that_come_twice_count_once_in_a_run(spark):
    t = tables(spark, [(f"p{i}", "A") for i in range(6)], [(f"p{i}", "A") for i in range(6)])
    once = runs.with_shared(t)
    t.contract = t.contract.unionByName(t.contract.filter("document_number = 'd0'"))
    twice = runs.with_shared(t)
    assert (once.single_documents, twice.single_documents) == (True, False)
    cfg = Config(thresholds={"bias_min_amount": 0, "uoc_min_amount": 0, "triad_min_amount": 0, "split_min_total_ars": 0, "split_min_count": 6})
    for shared in (once, twice):
        assert [(r.contracts_for_prov, r.total_signed) for r in checks.authorizer_bias(shared, cfg).collect()] == [(6, 6)]
        assert [r.contracts for r in checks.authorizer_provider_ring(shared, cfg).collect()] == [6]
        assert [(r.contracts_for_prov, r.total_awarded_in_unit) for r in checks.uoc_favoritism(shared, cfg).collect()] == [(6, 6)]
        assert [(r.split_count, r.month, len(r.processes)) for r in checks.contract_splitting(shared, cfg).collect()] == [(6, "2020-01", 6)]


def test_cover_bidding_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", f"s{j}", rng.choice([100.0, 100.5, 101.0, 101.5, 110.0]), rng.choice(["ARS", None, "USD"]), None) for i in range(30) for j in range(rng.randint(1, 6)) for _ in range(rng.choice([1, 1, 1, 2]))]
    rows = sorted(set(rows), key=str)
    wins = sorted({(p, s) for p, s, *_ in rows if rng.random() < 0.4})
    t = tables(spark, [(p, s) for p, s, *_ in rows], wins)
    t.bid = spark.createDataFrame(rows, t.bid.schema).repartition(5)
    want = []
    for p, s, amount, cur, _ in rows:
        rivals = sorted((a, r) for q, r, a, c, _ in rows if q == p and r != s and (c or "ARS") == (cur or "ARS"))
        if (p, s) in wins and len(rivals) >= 2 and amount <= rivals[0][0] <= amount * 1.02:
            want.append((p, s, amount, cur or "ARS", len(rivals), *rivals[0]))
    got = [(r.process_number, r.provider_cuit, r.won_amount, r.currency, r.competing_bids, r.runner_up_amount, r.runner_up_cuit) for r in checks.cover_bidding(t, Config()).collect()]
    assert len(want) > 5 and sorted(got) == sorted(set(want))


def shares_of_paths(near, sources):
    """Brandes: what the shortest paths from each of ``sources`` give each node, summed."""
    score = dict.fromkeys(near, 0.0)
    for s in sources:
        dist, sigma, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in near[v]:
                if u not in dist:
                    dist[u], sigma[u] = dist[v] + 1, 0.0
                    order.append(u)
                if dist[u] == dist[v] + 1:
                    sigma[u] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in near[u]:
                if dist[v] == dist[u] - 1:
                    delta[v] += sigma[v] / sigma[u] * (1 + delta[u])
            if u != s:
                score[u] += delta[u]
    return score


@pytest.mark.parametrize("rows", [1 << 26, 60_000])
def test_betweenness_searches_from_all_sources_that_fit_at_once(spark, monkeypatch, rows):
    rng = random.Random(5)
    raw = {tuple(sorted(rng.sample(range(420), 2))) for _ in range(1500)} | {(420, k) for k in range(60)} | {(421, 422), (422, 423)}
    near = {}
    for a, b in raw:
        near.setdefault(f"n{a}", set()).add(f"n{b}")
        near.setdefault(f"n{b}", set()).add(f"n{a}")
    nodes = spark.createDataFrame([(v,) for v in near], "node string").withColumn("h", F.xxhash64("node"))
    sources = [r.node for r in nodes.orderBy("h", "node").limit(400).collect()]
    n, score = len(near), shares_of_paths(near, sources)
    written = []
    whole = network.materialize
    monkeypatch.setattr(network, "materialize", lambda df, tag="t", **o: written.append(tag) or whole(df, tag, **o))
    monkeypatch.setattr(network, "NEAR_IN_ROW", 7, raising=False)
    monkeypatch.setattr(network, "SEARCH_ROWS", rows, raising=False)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 1) for a, b in raw], "a string, b string, weight long")
    got = {r.node: r.betweenness for r in network.betweenness(edges).collect()}
    assert got.keys() == near.keys()
    assert all(abs(got[v] - score[v] * n / 400 / ((n - 1) * (n - 2))) < 1e-4 for v in near)
    assert len(written) <= (20 if rows == 1 << 26 else 48), written


def test_a_check_that_failed_is_no_result(spark, tmp_path, monkeypatch):
    broken = checks.REGISTRY["cdi_abuse"]
    monkeypatch.setitem(checks.REGISTRY, "cdi_abuse", checks.Check(broken.key, broken.weight, broken.thresholds, broken.entities, lambda t, c: 1 / 0))
    t = tables(spark, [("p0", "A")], [("p0", "A")])
    cfg = Config(disabled=frozenset(set(checks.REGISTRY) - {"cdi_abuse", "serial_winner"}))
    row = runs.persist_run(spark, t, cfg, str(tmp_path), "a").first()
    assert (row.state, row.failed) == ("partial", ["cdi_abuse"]) and "cdi_abuse: ZeroDivisionError" in row.error
    assert runs.run_if_needed(spark, t, cfg, str(tmp_path), "b") == ("b", False)  # it answers for nothing
    alone = Config(disabled=frozenset(set(checks.REGISTRY) - {"cdi_abuse"}))
    with pytest.raises(RuntimeError, match="cdi_abuse: ZeroDivisionError"):
        runs.persist_run(spark, t, alone, str(tmp_path), "c")
    monkeypatch.setattr(queries, "SAID", {"cdi_abuse": "c11_cdi_abuse", "serial_winner": "c1_serial_winner"})
    with pytest.raises(RuntimeError, match="cdi_abuse: ZeroDivisionError"):
        queries.QUERIES["e8_run_detection"](spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("bound", [1 << 22, 1500, 0])
def test_centrality_is_of_all_providers(spark, monkeypatch, bound):
    rng = random.Random(11)
    raw = {tuple(sorted(rng.sample(range(430), 2))) for _ in range(700)} | {(500 + i, 501 + i) for i in range(9)} | {(520, 521)}
    raw |= {(530, 531), (530, 532), (531, 533), (532, 533), (533, 534)} | {(540, 541), (541, 542)}
    near = {}
    for a, b in raw:
        near.setdefault(f"n{a}", set()).add(f"n{b}")
        near.setdefault(f"n{b}", set()).add(f"n{a}")
    n, score = len(near), shares_of_paths(near, list(near))
    monkeypatch.setattr(network, "SEARCH_WORK", 100_000, raising=False)  # several tasks a component
    monkeypatch.setattr(network, "VISITS", 5_000, raising=False)
    monkeypatch.setattr(network, "TASK_LINKS", bound, raising=False)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 2) for a, b in raw], "a string, b string, weight long")
    t = tables(spark, [("p0", "A")], [])
    t.shared = {"cobid_edges": edges}
    got = {r.provider_cuit: r.cobid_betweenness for r in network.cobid_centrality(t).collect()}
    assert n > 400 and got.keys() == near.keys()
    assert all(abs(got[v] - score[v] / ((n - 1) * (n - 2))) <= 5.1e-5 for v in near)


def test_rings_are_sought_in_the_whole_of_a_large_component(spark):
    five, trio, chain = [f"K{i}" for i in range(5)], ["T0", "T1", "T2"], [f"c{i:02}" for i in range(60)]
    bids = meeting([five, trio], 6) + [(f"p{12 + 3 * i + k}", m) for i, pair in enumerate(zip(["K0", *chain], [*chain, "T0"])) for m in pair for k in range(3)]
    t = tables(spark, bids, [(f"p{i}", five[i % 5]) for i in range(6)] + [(f"p{6 + i}", trio[i % 3]) for i in range(6)], n=200)
    found = {(r.ring_size, r.provider_cuit) for r in groups.bid_rotation_ring(t, Config()).collect()}
    assert found == {(5, m) for m in five} | {(3, m) for m in trio}  # the trio is not in the core that a cap of 60 leaves
    capped = groups.bid_rotation_ring(t, Config(thresholds={"ring_component_cap": 60})).collect()
    assert {r.provider_cuit for r in capped} == set(five)


def test_related_providers_are_dealt_to_buckets_and_ranked_there(spark, monkeypatch):
    monkeypatch.setattr(groups, "RELATED_ROWS", 50, raising=False)
    monkeypatch.setattr(groups, "MEMBERS_IN_ROW", 7, raising=False)
    rng = random.Random(3)
    rows = {"shared_contact_cluster": {(1 if i < 40 else 2 + i // 9, f"Ñ{i}") for i in range(80)}, "bid_rotation_ring": {(i // 3, f"Ñ{i}") for i in rng.sample(range(90), 50)}, "cobid_community": {(rng.randint(0, 4), f"Ñ{i}") for i in range(60)}}
    found = {k: spark.createDataFrame(sorted(v) * 2, f"{groups.GROUP_CHECKS[k]} int, provider_cuit string") for k, v in rows.items()}
    asked = [f"Ñ{i}" for i in range(0, 100, 2)]
    want = set()
    for c in asked:
        links = {}
        for of in rows.values():
            mine = {g for g, m in of if m == c}
            for g, m in of:
                if g in mine and m != c:
                    links[m] = links.get(m, 0) + 1
        want |= {(c, m, links[m], k + 1) for k, m in enumerate(sorted(links, key=lambda m: (-links[m], m)))}
    out = groups.related_providers(found, spark.createDataFrame([(c,) for c in asked], "cuit string"))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()  # nothing is sorted by pair
    assert {tuple(r) for r in out.collect()} == want and want
    few = {k: df.filter("provider_cuit = 'nobody'") for k, df in found.items()}
    assert groups.related_providers(few, spark.createDataFrame([("A",)], "cuit string")).count() == 0


def test_priced_entities_read_tables_stored_once(spark):
    for name in ("b3_link_inflation", "b5_real_value"):
        files = queries.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert any("/bid_line-" in f for f in files) and not any("lineitem" in f or "orders" in f for f in files)
