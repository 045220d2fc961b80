"""The corpus pipeline on a small table: each stage against its definition."""

import math
import random
from collections import Counter

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F
from test_corpus import WORD, edit_distance, shingles

from tenderlens.llm import line_dedup, near_join, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    columns = docs.columns
    kept = {}
    for n, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        kept[n] = docs.count()
        if n != names[-1]:
            assert docs.columns == columns
        if n == "quality_rules":
            passed = {r.doc_id for r in quality_rules.judged(quality_rules.rule_ledger(before)).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == passed
        if n == "line_dedup":
            assert line_dedup.removed_lines(docs).count() <= line_dedup.removed_lines(before).count()
        if n == "ngram_jaccard_join":
            classes = {r.class_id for r in near_join.near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.collect()} == classes
    assert 0 < kept["mixing"] == kept["decontamination"] <= kept["ngram_jaccard_join"] <= kept["line_dedup"] <= kept["quality_rules"]
    run = corpus_pipeline.run(spark, SF)
    assert run.agg(F.sum("taken")).first()[0] == docs.agg(F.sum("taken")).first()[0]


def test_repeated_ids_leave_one_row_each(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, t, "en", "a", 1), (1, t, "en", "a", 1), (2, t, "en", "a", 1), (3, "other words entirely here now then", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def _rules_pass(t):
    """All eight rules, said again."""
    w = WORD.findall(t or "")
    c = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    repeat = len({q for p in range(len(w) - 4) if c[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)})
    solid = [ln for ln in (t or "").split("\n") if WORD.search(ln)]
    chars, dup = sum(map(len, w)), len(solid) - len(set(solid))
    upper, lower = (sum(a <= x <= b for x in t or "") for a, b in (("A", "Z"), ("a", "z")))
    shouts = sum(x.endswith("!!") for x in w)
    symbols = sum(x in "#*$%&|<>" for x in t or "")
    return not (len(w) < 10 or 100 * repeat > 20 * len(w) or chars < 2 * len(w) or chars > 20 * len(w) or 100 * symbols > 10 * len(w) or 100 * dup > 30 * len(solid) or upper > lower or 100 * shouts > 30 * len(w))


def _near_lines(a, b):
    k = max([e for n, e in line_dedup.BANDS if n <= min(len(a), len(b))], default=0)
    return a == b or k and abs(len(a) - len(b)) <= k and edit_distance(a, b) <= k


def test_each_stage_equals_brute_force(spark, tmp_path):
    """Null and repeated ids, repeated rows, and extra columns named like those that operators make."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(30)) for i in range(3)]
    texts = ["\n".join(line(rng.randint(6, 14)) for _ in range(rng.randint(2, 5))) for _ in range(30)]
    shared = line(9)
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i] + "\n" + shared) for i in range(4)] + [(110 + i, shared[:-1] + "\n" + line(25)) for i in range(3)]
    rows += [(120, line(20) + " " + items[0][1]), (None, line(20) + " " + items[1][1]), (None, texts[7]), (5, line(40)), (5, texts[5]), (6, texts[6]), (6, texts[6])]
    rows += [(130, None), (131, ""), (132, "SHOUT " * 30), (133, "one two"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n", "n_removed", "mask", "kept", "class_id", "gone", "key", "row", "position"):
        docs = docs.withColumn(name, F.lit(name))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    docs = stages["quality_rules"](spark, docs, str(tmp_path)).cache()
    now = Counter((i, t) for i, t in rows if _rules_pass(t))
    assert docs.columns == columns and pairs(docs) == now

    docs = stages["line_dedup"](spark, docs, str(tmp_path)).cache()
    last = 2**63
    every = sorted(((last if i is None else i, n, ln) for i, t in now.elements() for n, ln in enumerate(t.split("\n"))), key=lambda x: x[:2])
    gone = {(i, n, ln) for at, (i, n, ln) in enumerate(every) if any((j, m) < (i, n) and _near_lines(ln, o) for j, m, o in every[:at])}
    kept = [(i, "\n".join(ln for n, ln in enumerate(t.split("\n")) if (last if i is None else i, n, ln) not in gone)) for i, t in now.elements()]
    now = Counter((i, t) for i, t in kept if WORD.search(t))
    assert docs.columns == columns and pairs(docs) == now
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = stages["ngram_jaccard_join"](spark, docs, str(tmp_path)).cache()
    rest, groups = list(now), []
    sets = {r: shingles(r[1]) for r in rest}
    while rest:
        group = [rest.pop()]
        for r in group:
            near = [o for o in rest if len(sets[r] & sets[o]) >= 0.8 * len(sets[r] | sets[o])]
            group += near
            rest = [o for o in rest if o not in near]
        groups.append(group)
    got = pairs(docs)
    assert docs.columns == columns and len(groups) == sum(got.values())
    for group in groups:
        stays = [r for r in group if r in got]
        assert len(stays) == 1 and (stays[0][0] is None, stays[0][0] or 0) == min((i is None, i or 0) for i, _ in group)

    docs = stages["decontamination"](spark, docs, str(tmp_path)).cache()
    now = Counter(r for r in got.elements() if not any(t in r[1] for _, t in items))
    assert docs.columns == columns and pairs(docs) == now and sum(now.values()) == sum(got.values()) - 2

    mixed = stages["mixing"](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size) for r in mixed) == Counter((i, len(WORD.findall(t))) for i, t in now.elements())
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert sum(r.taken for r in own) == math.floor(own[0].target) and all(r.taken <= 2 * r.size for r in own)


def test_empty_table_and_no_n_chars(spark, tmp_path):
    spark.createDataFrame([(1, "some words of an item that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
