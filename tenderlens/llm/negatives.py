"""Operator 11: hard negatives by bounds from segment summaries.

A vector is cut into segments; of each its mean and deviation (the length of what is left without the mean)
are stored.  Over a segment of length L the product of two vectors lies within ``L * mean * mean'`` plus or
minus ``deviation * deviation'``, so the sums over segments bound the score.  Segments of 64 components are
refined to 16 and to 4 for the pairs that the coarser bounds leave; what is left then is scored exactly.

Vectors are packed into blocks of bounded bytes, with ids, whole-number components and summaries.  Each block of
anchors meets each block of vectors once; a task keeps the best few rows of an anchor, which raise the bound that later
blocks must reach, so what leaves a task are a few rows for each anchor.  Two passes: positives first, then
the negatives between the shares of each positive's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.llm.textvec import sized
from tenderlens.plans.staging import BROADCAST_BYTES, materialize, measured_bytes

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Lengths of segments, each a divisor of the one before.
SEGMENTS = (64, 16, 4)
#: Components of a block, and its vectors, at most; a longer vector is alone.
BLOCK_CELLS, BLOCK_ROWS = 1 << 16, 1024
#: A score must fit 64 bits: the squared length of a vector of whole numbers must stay below this.
MOST_SQUARE = 2.0**62
#: Bounds are stored and summed in 32-bit floats; they are widened by this share of the product of lengths.
SLACK = 1e-5
#: Kept rows of all anchors that a task holds before it hands them on.
HELD = 1 << 19
NO_ID = np.iinfo(np.int64).max

BLOCK = "block long, rows int, width int, ids binary, nulls binary, labels binary, cells binary, summary binary, norms binary"


def _pack():
    """Blocks of the vectors of a task, numbered by task and order."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            vectors, ids, labels = get("v"), get("id"), get("label").to_numpy(zero_copy_only=False)
            flat, end = vectors.flatten(), np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            start = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end
            q = np.floor(SCALE * x)
            # the sum of no cells is 0, and a sum of squares that is not finite stays so
            square = np.array([np.dot(q[s:e], q[s:e]) for s, e in zip(start, end)])
            fine = np.flatnonzero(square < MOST_SQUARE)
            size = (end - start)[fine]
            order = np.argsort(size, kind="stable")
            fine, size = fine[order], size[order]
            at = 0
            while at < len(fine):
                stop = at + 1  # sizes grow, so the block is as wide as its last vector
                while stop < len(fine) and stop - at < BLOCK_ROWS and (stop + 1 - at) * max(1, int(size[stop])) <= BLOCK_CELLS:
                    stop += 1
                own = fine[at:stop]
                width = -(-int(size[stop - 1]) // SEGMENTS[0]) * SEGMENTS[0]
                cells = np.zeros((len(own), width), np.int32)
                for i, r in enumerate(own):
                    cells[i, : end[r] - start[r]] = q[start[r] : end[r]]
                taken = ids.take(pa.array(own))
                null = taken.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([number], pa.int64()), "rows": pa.array([len(own)], pa.int32()), "width": pa.array([width], pa.int32()),
                        "ids": pa.array([taken.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), "nulls": pa.array([null.tobytes()], pa.binary()),
                        "labels": pa.array([labels[own].astype(np.int64).tobytes()], pa.binary()), "cells": pa.array([cells.tobytes()], pa.binary()),
                        "summary": pa.array([summaries(cells).tobytes()], pa.binary()), "norms": pa.array([np.sqrt(square[own]).tobytes()], pa.binary()),
                    }
                )
                number += 1
                at = stop

    return run


def summaries(cells: np.ndarray) -> np.ndarray:
    """For each length of segments in turn, the means (times the root of the length) and deviations of all rows,
    as one row of 32-bit floats for each vector."""
    out = []
    for length in SEGMENTS:
        x = cells.reshape(len(cells), -1, length).astype(np.float64)
        mean = x.mean(axis=2)
        out += [mean * np.sqrt(length), np.sqrt(((x - mean[:, :, None]) ** 2).sum(axis=2))]
    return np.concatenate(out, axis=1).astype(np.float32) if cells.shape[1] else np.zeros((len(cells), 0), np.float32)


class _Block:
    """A packed block, read without copies."""

    def __init__(self, row: dict, prefix: str = ""):
        get = lambda n: row[prefix + n]
        n, self.width = get("rows"), get("width")
        self.block = get("block")
        self.ids, self.nulls = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("nulls"), bool)
        self.labels, self.norms = np.frombuffer(get("labels"), np.int64), np.frombuffer(get("norms"), np.float64)
        self.cells = np.frombuffer(get("cells"), np.int32).reshape(n, self.width)
        self.summary = np.frombuffer(get("summary"), np.float32).reshape(n, -1)

    def level(self, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = sum(2 * (self.width // s) for s in SEGMENTS[:k])
        own, n = self.width // SEGMENTS[k], width // SEGMENTS[k]
        return self.summary[:, at : at + n], self.summary[:, at + own : at + own + n]


def _product(x: np.ndarray, y: np.ndarray, a: np.ndarray, r: np.ndarray, dense: bool) -> np.ndarray:
    """Products of rows ``a`` of x with rows ``r`` of y; as a whole matrix first where most are asked for."""
    return (x @ y.T)[a, r] if dense else np.einsum("ij,ij->i", x[a], y[r])


def scored(anchors: _Block, vectors: _Block, wanted: np.ndarray, least: np.ndarray, most: np.ndarray | None = None, told: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of a matrix ``wanted`` whose score may reach the anchor's ``least`` and
    not pass its ``most``; the score is exact.  ``told`` gets the number of pairs before each level and at
    the end."""
    a, r = np.nonzero(wanted)
    width, whole = min(anchors.width, vectors.width), wanted.size
    slack = 1 + SLACK * anchors.norms * vectors.norms.max(initial=0)
    for k in range(len(SEGMENTS)):
        if told is not None:
            told.append(len(a))
        if len(a) and width:
            dense = len(a) * 8 > whole
            (ma, da), (mr, dr) = anchors.level(k, width), vectors.level(k, width)
            mid, spread = _product(ma, mr, a, r, dense), _product(da, dr, a, r, dense)
            keep = mid + spread + slack[a] >= least[a]
            if most is not None:
                keep &= mid - spread - slack[a] <= most[a]
            a, r = a[keep], r[keep]
    if told is not None:
        told.append(len(a))
    big = anchors.norms.max(initial=0) * vectors.norms.max(initial=0) >= 2**52
    kind = np.int64 if big else np.float64  # sums of products stay whole in doubles below 2**53
    x, y = anchors.cells[:, :width].astype(kind), vectors.cells[:, :width].astype(kind)
    return a, r, _product(x, y, a, r, len(a) * 8 > whole).astype(np.int64)


class _Best:
    """The best few rows for each slot: greatest score, then least id (none last)."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.slot, self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ids, nulls = np.concatenate([self.id, ids]), np.concatenate([self.null, nulls])
        order = np.lexsort((ids, nulls, -score, slot))
        s = slot[order]
        first = np.searchsorted(s, s)
        place = np.arange(len(s)) - first
        order, place = order[place < self.keep], place[place < self.keep]
        self.slot, self.score, self.id, self.null = slot[order], score[order], ids[order], nulls[order]
        last = place == self.keep - 1
        self.least[self.slot[last]] = self.score[last]


def _rows(batches, prefix: str) -> Iterator[tuple[_Block, _Block, dict]]:
    """(anchors, vectors, row) of each pair of blocks of a task."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            yield _Block(row, prefix), _Block(row), row


def _searching(state: Callable, look: Callable, out: Callable):
    """A task that keeps a state for each block of anchors, and hands states on when they are many."""

    def run(batches):
        held: dict[int, tuple] = {}
        size = 0
        for anchors, vectors, row in _rows(batches, "a_"):
            if anchors.block not in held:
                if size >= HELD:
                    for x in held.values():
                        yield out(*x)
                    held, size = {}, 0
                held[anchors.block] = state(anchors, row)
                size += len(held[anchors.block][1].least) * held[anchors.block][1].keep
            look(anchors, vectors, *held[anchors.block])
        for x in held.values():
            yield out(*x)

    return run


def _same_row(anchors: _Block, vectors: _Block, origin: np.ndarray) -> np.ndarray:
    """Which vectors are the anchors themselves: ``origin`` has the block and place that an anchor was taken from."""
    return (origin[:, 0] == vectors.block)[:, None] & (origin[:, 1][:, None] == np.arange(len(vectors.ids))[None, :])


def _positives(keep: int):
    def state(anchors, row):
        return anchors, _Best(len(anchors.ids), keep), np.frombuffer(row["a_origin"], np.int64).reshape(-1, 2)

    def look(anchors, vectors, own, best, origin):
        wanted = (own.labels[:, None] == vectors.labels[None, :]) & ~_same_row(own, vectors, origin)
        a, r, s = scored(own, vectors, wanted, best.least)
        near = s >= best.least[a]
        a, r, s = a[near], r[near], s[near]
        best.add(a, s, vectors.ids[r], vectors.nulls[r])

    def out(own, best, origin):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(best.slot), own.block)), "slot": pa.array(best.slot.astype(np.int32)), "anchor_id": pa.array(own.ids[best.slot]), "id": pa.array(best.id, pa.int64(), mask=best.null), "score": pa.array(best.score)})

    return _searching(state, look, out)


def _negatives(keep: int, low: int, high: int):
    def state(anchors, row):
        asked = [(p["slot"], p["place"], p["positive_id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in row["asked"]]
        asked = [p for p in asked if p[4] <= p[5]]
        lo, hi = np.array([p[4] for p in asked], np.int64), np.array([p[5] for p in asked], np.int64)
        return anchors, _Best(len(asked), keep), asked, np.array([p[0] for p in asked], np.int64), lo, hi

    def look(anchors, vectors, own, best, asked, slot, lo, hi):
        least, most = np.full(len(own.ids), np.inf), np.full(len(own.ids), -np.inf)
        np.minimum.at(least, slot, np.maximum(lo, best.least))
        np.maximum.at(most, slot, hi)
        wanted = (own.labels[:, None] != vectors.labels[None, :]) & (least <= most)[:, None]
        a, r, s = scored(own, vectors, wanted, least, most)
        order = np.argsort(slot, kind="stable")  # an anchor's positives are next to each other
        for n in range(np.bincount(slot).max(initial=0)):
            first = np.searchsorted(slot[order], a) + n
            mine = np.flatnonzero(first < len(order))
            mine = mine[slot[order[first[mine]]] == a[mine]]
            k = order[first[mine]]
            fit = (s[mine] >= lo[k]) & (s[mine] <= hi[k]) & (s[mine] >= best.least[k])
            rr = r[mine[fit]]
            best.add(k[fit], s[mine[fit]], vectors.ids[rr], vectors.nulls[rr])

    def out(own, best, asked, slot, lo, hi):
        import pyarrow as pa

        p = [asked[k] for k in best.slot]
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array(np.full(len(p), own.block)), "slot": pa.array([x[0] for x in p], pa.int32()), "place": pa.array([x[1] for x in p], pa.int32()),
                "anchor_id": pa.array(own.ids[[x[0] for x in p]] if p else np.zeros(0, np.int64)), "positive_id": pa.array([x[2] for x in p], pa.int64()), "positive_score": pa.array([x[3] for x in p], pa.int64()),
                "negative_id": pa.array(best.id, pa.int64(), mask=best.null), "negative_score": pa.array(best.score),
            }
        )

    return _searching(state, look, out)


def _anchors_of(every: int):
    """Blocks of the anchors in blocks of vectors, with where each was taken from."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                b = _Block(row)
                own = np.flatnonzero(~b.nulls & (b.ids % every == 0))
                if len(own):
                    origin = np.stack([np.full(len(own), b.block), own], axis=1)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": [b.block], "rows": pa.array([len(own)], pa.int32()), "width": pa.array([b.width], pa.int32()), "ids": [b.ids[own].tobytes()], "nulls": [b.nulls[own].tobytes()], "labels": [b.labels[own].tobytes()],
                            "cells": [b.cells[own].tobytes()], "summary": [b.summary[own].tobytes()], "norms": [b.norms[own].tobytes()], "origin": [origin.tobytes()],
                        }
                    )

    return run


def _merged(batches):
    """Blocks of anchors of a task put together, as far as they have one width and are not many."""
    import pyarrow as pa

    held: list[dict] = []

    def out():
        joined = {n: [b"".join(x[n] for x in held)] for n in ("ids", "nulls", "labels", "cells", "summary", "norms", "origin")}
        return pa.RecordBatch.from_pydict({"block": [held[0]["block"]], "rows": pa.array([sum(x["rows"] for x in held)], pa.int32()), "width": pa.array([held[0]["width"]], pa.int32())} | joined)

    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            n = sum(x["rows"] for x in held) + row["rows"]
            if held and (held[0]["width"] != row["width"] or n > BLOCK_ROWS // 2 or n * row["width"] > BLOCK_CELLS):
                yield out()
                held = []
            held.append(row)
    if held:
        yield out()


def packed(vectors: DataFrame) -> DataFrame:
    """The vectors (vec_id, embedding, label) that take part, as a table of blocks."""
    rows = sized(vectors).filter("label is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return materialize(rows.mapInArrow(_pack(), BLOCK), "vectors")


def _pairs(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of vectors.  Vectors are dealt to lanes, and anchors are in every
    lane: in one, and broadcast, if their measured bytes allow it, else in as many as there are shuffle
    partitions."""
    named = anchors.select(*(F.col(c).alias(c if c == "asked" else f"a_{c}") for c in anchors.columns))
    few = measured_bytes(named) <= BROADCAST_BYTES
    lanes = 1 if few else int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return blocks.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")).join(F.broadcast(dealt) if few else dealt, "lane")


def _first(df: DataFrame, by: list[str], score: str, name: str, most: int, place: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(name))
    return df.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= most)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row whose
    ``vec_id`` is divisible by ``every``, and each of its first ``positives`` other rows of the same label,
    the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` per cent of the positive's.
    Greater scores come first, then smaller ids.

    A component x is the whole number ``floor(256 * x)``.  Rows with a null label or vector, a null or
    non-finite component, or whole numbers whose squares sum to 2**62 or more take no part.  A shorter vector counts as
    filled up with zeros.  Rows without an id take part but are no anchors, and come last among equal scores;
    rows that share an id are rows of their own, and each of them an anchor.  Other columns are not read.
    """
    blocks = packed(vectors)
    chosen = blocks.mapInArrow(_anchors_of(every), BLOCK + ", origin binary")
    anchors = materialize(chosen.mapInArrow(_merged, BLOCK + ", origin binary"), "anchors")
    near = sized(_pairs(blocks, anchors)).mapInArrow(_positives(positives), "block long, slot int, anchor_id long, id long, score long")
    near = materialize(_first(near, ["block", "slot"], "score", "id", positives, "place"), "positives")
    asked = near.groupBy("block").agg(F.collect_list(F.struct("slot", "place", F.col("id").alias("positive_id"), "score")).alias("asked"))
    asking = materialize(anchors.join(asked, "block"), "asking")
    schema = "block long, slot int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = sized(_pairs(blocks, asking)).mapInArrow(_negatives(negatives, low, high), schema)
    out = _first(far, ["block", "slot", "place"], "negative_score", "negative_id", negatives, "rank")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """Every seventh row moved to the next of ten labels."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.withColumn("label", moved)


ORACLE = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= {NEGATIVES}"""
