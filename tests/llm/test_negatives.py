"""Hard negatives against brute force, with odd vectors, ties and repeated rows."""

import math
import random

import numpy as np
import pytest

from tenderlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int"


def brute(rows, every=100, n_pos=5, n_neg=5, low=80, high=100):
    def take(label, v):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)

    live = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if take(label, v)]
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, (i, q, label) in enumerate(live):
        if i is None or i % every:
            continue
        told = [(sum(a * b for a, b in zip(q, p)), j, other) for m, (j, p, other) in enumerate(live) if m != k]
        for score, pos, _ in sorted((t for t in told if t[2] == label), key=key)[:n_pos]:
            fit = sorted((t for t in told if t[2] != label and low * score <= 100 * t[0] <= high * score), key=key)[:n_neg]
            out += [(i, pos, n + 1, t[1], score, t[0]) for n, t in enumerate(fit)]
    return out


def vectors(seed, n, width, lattice):
    rng = random.Random(seed)
    make = (lambda: rng.choice([-0.5, 0.0, 0.25, 0.5])) if lattice else (lambda: rng.gauss(0, 0.2))
    base = [make() for _ in range(width)]
    rows = []
    for i in range(n):
        v = [0.7 * b + make() for b in base] if i % 3 else [make() for _ in range(width)]
        rows.append((i, v, rng.randrange(3)))
    return rows


def same(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in negatives.hard_negatives(df, **kw).collect()]
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(got, key=order) == sorted(brute(rows, **{k: v for k, v in kw.items() if k == "every"}), key=order)
    return got


@pytest.mark.parametrize(("width", "lattice"), [(64, False), (10, True), (130, False)])
def test_brute_force(spark, width, lattice):
    got = same(spark, vectors(width, 400, width, lattice), every=20)
    assert got


def test_odd_rows(spark):
    rows = vectors(2, 120, 6, True)
    rows += [(200, None, 1), (201, [0.1] * 6, None), (202, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (203, [float("nan")] * 6, 1), (204, [float("inf")] * 6, 1), (300, [], 1), (301, [0.5] * 3, 1), (302, [0.5] * 90, 2)]
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[100][1], 2), (None, rows[5][1], 0), (None, rows[6][1], 1), (400, rows[7][1], rows[7][2]), (-100, rows[8][1], rows[8][2])]
    assert same(spark, rows)


def test_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [0.5], 1, "", 0)], SCHEMA)).count() == 0


def test_lanes(spark, monkeypatch):
    """Anchors too many to broadcast are dealt out, with the same result."""
    monkeypatch.setattr(negatives, "BROADCAST_BYTES", 0)
    assert same(spark, vectors(5, 300, 16, True), every=10)


def test_bounds_hold_and_prune():
    """Each level bounds every score, and clustered vectors are settled before exact scoring."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 300, (6, 16)).repeat(4, axis=1)
    cells = np.floor(centres[rng.integers(0, 6, 300)] + rng.normal(0, 10, (300, 64))).astype(np.int32)
    row = {"rows": 300, "width": 64, "block": 0, "ids": np.arange(300).tobytes(), "nulls": np.zeros(300, bool).tobytes(), "labels": np.zeros(300, np.int64).tobytes(), "cells": cells.tobytes(), "summary": negatives.summaries(cells).tobytes(), "norms": np.linalg.norm(cells.astype(float), axis=1).tobytes()}
    b = negatives._Block(row)
    exact = cells.astype(np.int64) @ cells.astype(np.int64).T
    for k in range(len(negatives.SEGMENTS)):
        m, d = b.level(k, 64)
        mid, spread, slack = m @ m.T, d @ d.T, 1 + negatives.SLACK * np.outer(b.norms, b.norms)
        assert (exact <= mid + spread + slack).all() and (exact >= mid - spread - slack).all()
    told = []
    least = np.sort(exact, axis=1)[:, -40].astype(float)
    a, r, s = negatives.scored(b, b, np.ones((300, 300), bool), least, None, told)
    assert (s == exact[a, r]).all() and {(x, y) for x, y in zip(*np.nonzero(exact >= least[:, None]))} <= set(zip(a, r))
    assert told[0] == 90000 and told[-1] < 0.4 * told[0] and told == sorted(told, reverse=True)
