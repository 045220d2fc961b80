"""Language identification: accuracy on held-out rows, the code lengths against a plain tree, odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.llm import language_id as lid

SYLLABLES = {"aa": "ka ro mi te su na", "bb": "sch ung ein der ö ß", "cc": "eau que ç é oi les", "dd": "the ing of and wh er"}
DOCS = "doc_id long, text string, lang string, source string, score double, run long"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang))
    return rows


ODD = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 ...", "cc"), (903, "the wherof", None), (None, "the and of", "zz"), (904, "é" * 40000, "cc"), (905, "karo", "aa"), (905, "karo", "aa")]


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(*r, "s", 0.5, 1) for r in rows], DOCS).repartition(parts)


def out_of(df):
    return sorted((tuple(r) for r in lid.languages(df).collect()), key=str)


def test_accuracy_and_odd_rows(spark):
    rows = corpus() + ODD
    got = lid.languages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in corpus()}
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [i for i in truth if by[i][0].held_out]
    assert len(held) > 30 and sum(by[i][0].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (900, 901, 902))
    assert by[903][0].lang_pred == "dd" and by[None][0].lang_pred == "dd" and by[904][0].lang_pred == "cc"
    assert [r.lang_pred for r in by[905]] == ["aa", "aa"]


def test_nothing_learnt_from_held_out_rows(spark):
    rows = [r for r in corpus(200)]
    spoilt = [(i, t, "dd" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    assert out_of(frame(spark, rows)) == out_of(frame(spark, spoilt, 3))


def test_empty(spark):
    assert lid.languages(frame(spark, [])).count() == 0
    assert {tuple(r)[1:] for r in lid.languages(frame(spark, [(1, "words", None), (2, "the", None)])).collect()} == {(False, "und", 0.0)}


def plain(rows, text, order=lid.ORDER):
    """Code length in units of a text by a tree of dictionaries, nothing left out."""
    tree = defaultdict(Counter)
    for t in rows:
        b = lid._PAD + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                tree[b[i - k : i]][b[i]] += 1
    total, b = 0, lid._PAD + text
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = tree.get(b[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if b[i] in seen:
                total += round(-math.log2(seen[b[i]] / whole) * lid.UNIT)
                break
            total += round(-math.log2(len(seen) / whole) * lid.UNIT)
        else:
            total += 8 * lid.UNIT
    return total


def test_code_lengths(spark):
    rows = [r for r in corpus(60, 5) if zlib.crc32(str(r[0]).encode()) % 5]
    model = lid.fit(lid.context_tree(frame(spark, corpus(60, 5)).select("doc_id", "text", "lang")))
    texts = [b"", b"a", "karo schung über éa".encode(), b"the wherof the", b"\x00\x01zz \xff", rows[3][1].encode()]
    got = model.lengths(texts)
    for j, lang in enumerate(model.langs):
        own = [t.encode() for _, t, x in rows if x == lang]
        assert [int(x) for x in got[:, j]] == [plain(own, t) for t in texts]


def test_small_tree(spark):
    """A tree that holds few runs leaves out the rare ones, and still tells languages apart."""
    docs = frame(spark, corpus(200, 7)).select("doc_id", "text", "lang")
    whole, few = lid.context_tree(docs), lid.context_tree(docs, nodes=1)
    size = {(r.lang, r.size): r.k for r in few.groupBy("lang", "size").agg(F.count("*").alias("k")).collect()}
    assert max(size.values()) <= 256 < max(r.k for r in whole.groupBy("lang", "size").agg(F.count("*").alias("k")).collect())
    model, rows = lid.fit(few), corpus(200, 7)
    pick = model.lengths([t.encode() for _, t, _ in rows]).argmin(axis=1)
    assert np.mean([model.langs[k] == lang for k, (_, _, lang) in zip(pick, rows)]) > 0.97


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_table(n):
    rng = np.random.default_rng(n)
    keys = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
    t = lid.Table(keys, np.arange(n, dtype=np.int32)[:, None])
    assert (t.rows[t.find(keys)][:, 0] == np.arange(n)).all() if n else True
    assert (t.find(np.arange(1 << 41, (1 << 41) + 100).astype(np.uint64)) == -1).all()
