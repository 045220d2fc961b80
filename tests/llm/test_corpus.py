"""Corpus operators against brute force, and on the awkward inputs: nulls, empties, repeated ids and rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.llm import decontaminate, line_dedup, mixing, near_join, pii, quality_model, quality_rules, sketch, substring_dedup, suffix_dedup, warc_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall(t or "")


def corpus(seed=3, n=70):
    """Texts with copies, near copies, shared passages, repeated lines and junk."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghiéñ") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        t = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(4, 30))) + "." for _ in range(rng.randint(1, 6)))
        if kind < 0.2 and base:
            t = rng.choice(base)
        elif kind < 0.45 and base:
            w = rng.choice(base).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind < 0.6:
            t = t + "\n" + passage + "\n" + t[: rng.randint(0, 40)]
        elif kind < 0.65:
            t = (rng.choice(vocab) + " ") * rng.randint(1, 300)
        base.append(t)
        rows.append((i, t, "en", rng.choice(["a", "b", "Ä", None]), len(t)))
    return rows


ODD = [(900, None, None, None, None), (901, "", "en", "a", 0), (902, " \n\t ", "en", "a", 4), (903, "one", "en", "a", 3), (903, "one", "en", "a", 3), (904, "one", "en", "b", 3), (None, "two words", "en", "b", 9), (905, "é" * 3000 + " x", "en", "b", 3002)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus() + ODD, DOCS).withColumn("n_removed", F.lit("clash")).withColumn("taken", F.lit(1)).cache()


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1]) for r in corpus() + ODD]


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("whole", [near_join.WHOLE, 2])
def test_near_duplicates_equal_brute_force(docs, rows, whole):
    sets = [shingles(t) for _, t in rows]
    ids = [-1 if i is None else i for i, _ in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i in range(len(rows)):
        least[find(i)] = min(least[find(i)], ids[i])
    expected = Counter((ids[i], least[find(i)], links[i]) for i in range(len(rows)))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_join.near_duplicates(docs, whole=whole).collect())
    assert got == expected


def test_posterior_prunes_only_hopeless_pairs():
    for n, least in near_join.least_matches():
        miss = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least))
        assert miss < 1e-7 and least > 0


@pytest.mark.parametrize("shard, pack", [(sketch.SHARD_KEYS, sketch.PACK_BYTES), (64, 3000)])
def test_substring_dedup_equals_brute_force(docs, rows, shard, pack, monkeypatch):
    monkeypatch.setattr(sketch, "SHARD_KEYS", shard)  # the second: some hundred shards, packs of a few texts
    monkeypatch.setattr(sketch, "PACK_BYTES", pack)
    seen = defaultdict(set)
    big = 2**63 - 1
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            seen[tuple(w[p : p + 13])].add(big if i is None else i)
    expected = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - 12):
            if min(seen[tuple(w[p : p + 13])]) < (big if i is None else i):
                gone |= set(range(p, p + 13))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        expected[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring_dedup.repeated_windows_removed(docs).collect()) == expected


@pytest.mark.parametrize("length", [400, 60])
def test_suffix_dedup_equals_brute_force(docs, rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    expected = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for q in range(len(b)) if gone[q] and (not q or not gone[q - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        expected[(i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in suffix_dedup.repeated_bytes_removed(docs, length).collect()) == expected


def test_suffix_dedup_counts_a_run_of_starts_once(spark):
    """A third text holds two others that overlap in it but share no whole window across the seam, where a run of
    starts from anchor to anchor is also one from anchor's end to anchor's end."""
    rng = random.Random(1)
    t = "".join(chr(rng.randrange(97, 123)) for _ in range(60000))
    lo, hi = 36663, 36679
    texts = [t[lo - 1500 : lo + 399], t[hi + 1 : hi + 1900], t[lo - 1500 : hi + 1900]]
    count = Counter(x[p : p + 400] for x in texts for p in range(len(x) - 399))
    expected = set()
    for i, x in enumerate(texts):
        gone = {q for p in range(len(x) - 399) if count[x[p : p + 400]] > 1 for q in range(p, p + 400)}
        kept = "".join(c for q, c in enumerate(x) if q not in gone)
        expected.add((i, len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = suffix_dedup.repeated_bytes_removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in got.collect()} == expected
    both = suffix_dedup.Anchors([x.encode() for x in texts], 400).covering()
    assert len(set(zip(*map(np.ndarray.tolist, both[:2])))) == len(both[0])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    rng = random.Random(7)
    for _ in range(3000):
        a = [rng.randint(0, 2) for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() > 0.15]
        b.insert(rng.randint(0, len(b)), 1)
        for k in (1, 2, 3):
            assert line_dedup.within(np.array(a, np.uint32), np.array(b, np.uint32), k) == (edit_distance(a, b) <= k)


@pytest.mark.parametrize("whole", [line_dedup.WHOLE, 2])
def test_line_dedup_equals_brute_force(spark, docs, rows, whole, monkeypatch):
    monkeypatch.setattr(line_dedup, "WHOLE", whole)
    big = 2**63 - 1
    extra = [(1000 + n, "x y\n" + (t or "").split("\n")[0][3:]) for n, (_, t) in enumerate(rows[:30])]
    rng = random.Random(8)
    for n, (_, t) in enumerate(rows[:40]):  # lines at and around the bands, with up to four edits
        ln = list((t or "").replace("\n", " ")[: rng.choice([14, 15, 16, 17, 38, 39, 40, 41, 43, 158, 159, 160, 161, 163])])
        extra.append((2000 + n, "".join(ln)))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(ln) + 1)
            ln[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
        extra.append((3000 + n, "".join(ln)))
    every = sorted(((big if i is None else i, n, ln) for i, t in rows + extra for n, ln in enumerate((t or "").split("\n")) if words(ln)), key=lambda x: x[:2])
    expected = set()

    def near(a, b):
        k = max([e for n, e in line_dedup.BANDS if n <= min(len(a), len(b))], default=0)
        return k and abs(len(a) - len(b)) <= k and line_dedup.within(np.array([*map(ord, a)]), np.array([*map(ord, b)]), k)

    for at, (i, n, ln) in enumerate(every):
        for j, m, other in every[:at]:
            if (j, m) < (i, n) and (ln == other or near(ln, other)):
                expected.add((i, n, ln))
                break
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    assert {(r.doc_id, r.line) for r in line_dedup.removed_lines(both).collect()} == {x[:2] for x in expected}
    kept = Counter((r.doc_id, r.text) for r in line_dedup.without_repeated_lines(both).collect())
    wanted = Counter((i, None if t is None else "\n".join(ln for n, ln in enumerate(t.split("\n")) if (big if i is None else i, n, ln) not in expected)) for i, t in rows + extra)
    assert kept == wanted


def test_quality_rules_and_ablation(docs, rows):
    ledger = quality_rules.judged(quality_rules.rule_ledger(docs))
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in ledger.collect()}
    expected = set()
    for i, t in rows:
        w, seen, dup = words(t), set(), 0
        for ln in (t or "").split("\n"):
            if words(ln):
                dup += ln in seen
                seen.add(ln)
        c = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        rep = len({q for p in range(len(w) - 4) if c[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)})
        expected.add((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, rep, len(w) < 10 or 100 * rep > 20 * len(w)))
    assert got == expected
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns and kept.count() == ledger.filter("kept").count()
    masks = [r.mask for r in ledger.collect()]
    for r in quality_rules.ablation(ledger).collect():
        assert (r.failed, r.only) == (sum(bool(m & r.bit) for m in masks), sum(m == r.bit for m in masks))


def test_mixing_meets_targets(docs, rows):
    got = mixing.training_order(docs).collect()
    assert len(got) == len(rows)
    total = sum(len(words(t)) for _, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 2 * r.size and (r.taken == 0) == (r.position is None)
        assert r.position is None or 0 <= r.position <= 1
    assert abs(sum(v[0].target for v in by.values()) - min(1.5 * total, 2 * total)) < 1e-6
    for v in by.values():
        assert sum(r.taken for r in v) == math.floor(v[0].target) and sum(r.size for r in v) == v[0].source_size


def test_mixing_places_every_use(docs):
    order = mixing.training_order(docs)
    by = defaultdict(list)
    for r in order.collect():
        assert r.taken == sum(u.words for u in r.uses) and r.position == (r.uses[0].position if r.uses else None)
        by[r.source] += [(u.position, u.words, r.target) for u in r.uses]
    for rank, source in enumerate(sorted(by, key=lambda x: (x is None, x))):
        slope, before = mixing.SLOPES[rank % 3], 0
        for t, n, target in sorted(by[source]):
            # the demand at a use's position is what the uses before it have taken
            assert abs(target * (t + slope * (t * t - t)) - before) < 1e-6 * target
            before += n
        assert before == math.floor(target)
    uses = mixing.training_uses(order).collect()
    assert len(uses) == sum(map(len, by.values())) and [u.position for u in uses] == sorted(u.position for u in uses)


def test_spans_of_personal_data():
    rng = random.Random(1)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(4000):
        t = "".join(rng.choice("aB0123..@@-+ %() _") for _ in range(rng.randint(0, 40)))
        expected = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        expected += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in card.finditer(t):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
            if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
                expected.append((m.start(), 2, m.end()))
        expected += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(t) == sorted(expected)


def test_disclosing_terms_go_and_common_ones_stay(spark, docs):
    told = [(2000 + i, f"ask the zanzibar clerk at mole@burrow.example about the matter number {i}", "en", "a", 1) for i in range(4)]
    plain = [(3000 + i, f"the clerk was about the matter at hand {i} times over", "en", "a", 1) for i in range(40)]
    out = {r.doc_id: r for r in pii.sanitised(spark.createDataFrame(told + plain, DOCS)).collect()}
    assert "[email]" in out[2000].clean and "zanzibar" not in out[2000].clean and "the" in out[2000].clean and ",term:" in "," + out[2000].spans
    assert out[3000].clean == plain[0][1] and out[3000].spans == ""
    odd = pii.sanitised(docs).collect()
    assert len(odd) == docs.count() and all(r.n_email is not None for r in odd)
    assert pii.sanitised(docs.limit(0)).count() == 0


def test_terms_of_a_value_seen_once_or_twice_go(spark):
    filler = " ".join(f"common{i}" for i in range(12))
    one = [(1, f"Quagga met us {filler} at mole@burrow.example today", "en", "a", 1)]
    two = [(2 + i, f"Okapi7 {filler} calls +44 20 7946 0958 about it today", "en", "a", 1) for i in range(2)]
    plain = [(10 + i, f"us {filler} met at calls about it today", "en", "a", 1) for i in range(200)]
    texts = {r[0]: r[1] for r in one + two + plain}
    out = {r.doc_id: r for r in pii.sanitised(spark.createDataFrame(one + two + plain, DOCS)).collect()}
    assert out[1].clean == texts[1].replace("mole@burrow.example", "[email]").replace("Quagga", "xxxxxx")
    for i in (2, 3):
        assert out[i].clean == texts[i].replace("+44 20 7946 0958", "[phone]").replace("Okapi7", "[term]")
    assert all(out[r[0]].clean == r[1] for r in plain)
    # shares by hand, for every pair of entity and term
    docs = {i: (set(pii.base_spans(t)), {x for _, _, x in pii._apart(t, pii.base_spans(t))}) for i, t in texts.items()}
    told = pii.disclosing_terms(spark.createDataFrame([*texts.items()], "row long, text string"))
    got = {(r.row, x.term): x.share for r in told.collect() for x in r.terms}
    expected = {}
    for i, (spans, terms) in docs.items():
        for a, k, b in spans:
            having = [j for j, (s, _) in docs.items() if any(pii.entity(q, texts[j][c:d]) == pii.entity(k, texts[i][a:b]) for c, q, d in s)]
            for t in terms:
                n_t = sum(t in x for _, x in docs.values())
                n_te = sum(t in docs[j][1] for j in having)
                share = math.log2(n_te / (n_t + pii.PRIOR) * len(docs) / len(having)) / math.log2(len(docs) / len(having))
                if share >= pii.GENERALISE:
                    expected[i, pii.term_key(t)] = max(share, expected.get((i, pii.term_key(t)), 0))
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_quality_model_learns_on_its_own_rows_only(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        t = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(60)) if good else "BUY NOW!! " * rng.randint(5, 40)
        texts.append((i, t, "en", "a", len(t)))
        labels.append((i, int(good), 0))
    d = spark.createDataFrame(texts + [(None, None, None, None, None)], DOCS)
    lab = spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.quality_scores(d, lab).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(got) == 501 and held and all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.97 * len(held)
    flipped = lab.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_model.quality_scores(d, flipped).collect()}
    assert all(abs(again[k] - r.score) < 1e-12 for k, r in got.items())
    assert {r.score for r in quality_model.quality_scores(d, lab.limit(0)).collect()} == {0.5}


def test_factorisation_machine_equals_pairwise_sum():
    rng = np.random.default_rng(2)
    w, v = rng.normal(size=20), rng.normal(size=(20, 3))
    ids, x = np.array([1, 4, 7, 2]), rng.normal(size=4)
    raw, _ = quality_model._raw(0.3, w, v, ids, x, np.array([4]))
    pairs = sum(v[ids[i]] @ v[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(raw[0] - (0.3 + (w[ids] * x).sum() + pairs)) < 1e-9


def test_decontamination_finds_leaks_and_paraphrases(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(1500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(16, 55))) for i in range(12)]
    clean = [(i, text(rng.randint(5, 300)), "en", "a", 1) for i in range(60)]
    leaks = [(100 + i, text(70) + " " + t + " " + text(40), "en", "a", 1) for i, t in items]
    para = []
    for i, t in items:
        w = t.split()
        w[2], w[9] = "changed", "also"
        para.append((200 + i, text(33) + " " + " ".join(w).upper() + ", " + text(11), "en", "a", 1))
    odd = [(900, None, None, None, None), (901, "", "en", "a", 0), (None, items[0][1], "en", "a", 0)]
    d = spark.createDataFrame(clean + leaks + para + odd, DOCS)
    b = spark.createDataFrame(items + [(77, None), (78, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(100 + i, i) for i, _ in items} | {(200 + i, i) for i, _ in items} | {(None, 0)}
    left = decontaminate.decontaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {r[0] for r in clean} | {900, 901}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(a, b) == table[-1][-1]


def test_fixity_audit_locates_damage(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "a" * (i % 50)) for i in range(300)] + [(7, "http://x/7", "<p>"), (7, "http://x/7", "<p>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc_audit.audit(pages, pages).count() == 0
    assert warc_audit.audit(pages.limit(0), pages.limit(0)).count() == 0
    bad = pages.filter("page_id is null or page_id not in (40)").withColumn("html", F.when(F.col("page_id") == 250, "!").otherwise(F.col("html")))
    bad = bad.unionByName(spark.createDataFrame([(999, "new", "x")], pages.schema))
    got = {(r.page_id, r.status) for r in warc_audit.audit(pages, bad).collect()}
    assert got == {(40, "missing"), (250, "changed"), (999, "extra")}
    # by hand: each side's records by key, with nothing else between
    both = [Counter((r.page_id, r.url, r.copy, r.leaf) for r in warc_audit.records(x).collect()) for x in (pages, bad)]
    assert {k[0] for k in (both[0] - both[1]) + (both[1] - both[0])} == {40, 250, 999}
    swapped = pages.withColumn("html", F.expr("case page_id when 20 then '<p>' || repeat('a', 21) when 21 then '<p>' || repeat('a', 20) else html end"))
    assert {(r.page_id, r.status) for r in warc_audit.audit(pages, swapped).collect()} == {(20, "changed"), (21, "changed")}
    more = pages.withColumn("idx", F.lit("clash")).withColumn("offset", F.lit(1)).filter("page_id is null or page_id <> 7")
    assert sorted((r.page_id, r.url, r.status) for r in warc_audit.audit(more, pages).collect()) == [(7, "http://x/7", "extra")] * 3
    assert {(r.page_id, r.status) for r in warc_audit.audit(pages, pages.filter("page_id is not null")).collect()} == {(None, "missing")}
    assert warc_audit.audit(pages, pages.limit(0)).count() == pages.count() == warc_audit.audit(pages.limit(0), pages).count()
    nodes = warc_audit.ranges(warc_audit.records(pages)).collect(), warc_audit.ranges(warc_audit.records(bad)).collect()
    ranges = [{r.idx: r.hash for r in x} for x in nodes]  # a lost record leaves all other ranges as they were
    assert {i for i in ranges[0] | ranges[1] if ranges[0].get(i) != ranges[1].get(i)} == {40 // 16, 250 // 16, 999 // 16}
    place = {r.page_id: r.offset for r in warc_audit.audit(pages, bad).collect()}
    sizes = {r.page_id: (r.pos, r.offset) for r in warc_audit.manifest(warc_audit.records(pages)).collect()}
    assert place[40] == sizes[40][1] and place[999] is None


@pytest.mark.parametrize("op", [near_join.near_duplicates, substring_dedup.repeated_windows_removed, suffix_dedup.repeated_bytes_removed, line_dedup.digest, mixing.training_order, lambda d: quality_rules.rule_ledger(d)])
def test_empty_table(docs, op):
    assert op(docs.limit(0)).count() == 0


def test_sharded_sketch_lets_few_single_windows_through(spark, monkeypatch):
    """With many shards no window of two texts is lost, and of the others few pass."""
    rng = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(200))
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(300)) + (" " + shared if i % 3 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    n = sum(len(words(t)) - 12 for _, t in rows)
    monkeypatch.setattr(sketch, "SHARD_KEYS", 1 << 10)
    monkeypatch.setattr(sketch, "PACK_BYTES", 20_000)
    packs = sketch.answered(df, substring_dedup._windows_of(13), n).select("ids", "texts", "known")
    found = packs.mapInArrow(substring_dedup._told_rows(13, sketch.shard_bits(n)), "doc_id long, h1 long, h2 int")
    got = Counter((r.h1, r.h2) for r in found.collect())
    texts = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            texts[tuple(w[p : p + 13])].add(i)
    repeated = [len(x) for x in texts.values() if len(x) > 1]
    assert sorted(c for c in got.values() if c > 1) == sorted(repeated)
    assert sum(c == 1 for c in got.values()) < 0.01 * (len(texts) - len(repeated))


def test_sketch_never_loses_a_repeated_key(spark):
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    twice = np.concatenate([keys, keys[:500]])
    df = spark.createDataFrame([(int(k),) for k in twice.view(np.int64)], "k long").repartition(5)
    filt = sketch.build(df, lambda b: iter([np.asarray(b.column(0)).view(np.uint64)]), 16)
    hit = sketch.repeated(filt, keys)
    assert hit[:500].all() and hit[500:].mean() < 0.2
