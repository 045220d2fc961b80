"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tenderlens.llm import spelling

DOCS = "doc_id long, text string, lang string, word string, n long, h long"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute(rows):
    count = Counter()
    for i, text in rows:
        for w in RUN.findall(text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, n in vocab.items():
        them = [v for v in vocab if near(w, v)]
        best = min(them, key=lambda v: (-vocab[v], v), default=None)
        form = best if best and vocab[best] >= 2 * n else None
        out[w] = [form, None, n, len(them), vocab[form] if form else None]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return {(w, *v) for w, v in out.items()}


def corpus(seed=4, n=150):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéÀx") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(base[: rng.choice([5, 20, 60])])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abÿ") + w[k + 1 :], w.upper()])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "×", "ñ. "]).join(words)))
    return rows


ODD = [(900, None), (901, ""), (902, "12 !"), (None, "nullid nullid nullid nullib nullib nullib"), (903, "a" * 3000 + " " + ("a" * 2999 + " ") * 3), (903, "a" * 3000), (904, "a" * 3000), (905, "Ωaaaaa ЖЖЖ aaaaa aaaaa aaaaa"), (905, "Ωaaaaa")]


def got(spark, rows):
    df = spark.createDataFrame([(*r, "en", "clash", 7, 7) for r in rows], DOCS).repartition(5)
    out = spelling.variant_forms(df).collect()
    assert len({r.word for r in out}) == len(out)
    return {tuple(r) for r in out}


def test_brute_force(spark):
    rows = corpus() + ODD
    want = brute(rows)
    assert got(spark, rows) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])


def test_several_passes(spark, monkeypatch):
    """Filters larger than a pass may broadcast take several passes, with the same result."""
    monkeypatch.setattr(spelling, "PASS_BYTES", 8 * 700)
    rows = corpus(9, 60)
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == set() and got(spark, [(1, None), (2, "few words")]) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_filters_lose_nothing(spark, seed):
    """Every word of a vocabulary is found where its filter looks, and few others are."""
    import numpy as np

    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 1 << 63, 20000).astype(np.uint64) * np.uint64(2)
    layout = spelling.Layout({7: 20000})
    held = np.zeros(layout.total, np.uint64)
    slot, bits = layout.of(keys, 7)
    np.bitwise_or.at(held, slot, bits)
    assert ((held[slot] & bits) == bits).all()
    slot, bits = layout.of(rng.integers(0, 1 << 63, 100000).astype(np.uint64) * np.uint64(2) + np.uint64(1), 7)
    assert ((held[slot] & bits) == bits).mean() < 0.003
