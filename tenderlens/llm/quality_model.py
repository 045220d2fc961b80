"""Operator 3: a factorisation machine for text quality.

Features of a text: its distinct words, hashed, each ``1 / sqrt(number of them)``; bands of structure
statistics; bands of length (the only metadata that is an input).  Pairwise interactions have rank
:data:`RANK` and cost linear time by the sum-of-squares identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``.

The model is fitted on at most :data:`TRAIN_ROWS` labelled texts, the first by a hash of the id.  Its size
is fixed, so it is broadcast; scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.quality_rules import MEASURES, _measures
from tenderlens.llm.textvec import Words, blocks, sized

#: The documented bound of the training sample.
TRAIN_ROWS = 6000
WORD_BITS, RANK = 15, 8
EPOCHS, BATCH, STEP, DECAY, SEED = 12, 64, 0.02, 1e-4, 13
LABELLED_AS_GOOD = 0.7
_WORDS = 1 << WORD_BITS
_BANDS = 12
_RATIOS = (
    ("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
    ("n_upper", "n_lower"), ("n_shouts", "n_words"), ("n_words", "n_lines"), ("n_distinct", "n_words"),
)
_COUNTS = ("n_words", "n_lines", "word_chars")
_STRUCT = len(_RATIOS) + len(_COUNTS)
FEATURES = _WORDS + _STRUCT * _BANDS


def _band(x: np.ndarray) -> np.ndarray:
    """A band of a non-negative number on a doubling scale from 1/32."""
    return np.clip(np.floor(np.log2(np.maximum(x, 1e-9) * 32)) + 1, 0, _BANDS - 1).astype(np.int64)


def _features(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all texts of a batch, their values, how many each text has)."""
    out = []
    for m in _measures([batch.select(["text"])]):
        out.append({n: m.column(i).to_numpy() for i, n in enumerate(m.schema.names)})
    stats = {n: np.concatenate([o[n] for o in out]) if out else np.zeros(0) for n in MEASURES}
    ids, vals, counts, at = [], [], [], 0
    for _, texts in blocks(batch):
        w = Words(texts)
        pairs = np.unique(w.text * _WORDS + (w.hash() >> np.uint64(64 - WORD_BITS)).astype(np.int64))
        text, word = pairs // _WORDS, pairs % _WORDS
        n = np.bincount(text, minlength=len(texts))
        own = {k: v[at : at + len(texts)].astype(float) for k, v in stats.items()} | {"n_distinct": n.astype(float)}
        at += len(texts)
        bands = [_band(own[a] / np.maximum(own[b], 1)) for a, b in _RATIOS] + [_band(own[c] / 32) for c in _COUNTS]
        extra = np.stack([_WORDS + i * _BANDS + b for i, b in enumerate(bands)], axis=1)
        key = np.concatenate([text, np.repeat(np.arange(len(texts)), _STRUCT)])
        order = np.argsort(key, kind="stable")
        ids.append(np.concatenate([word, extra.ravel()])[order])
        vals.append(np.concatenate([1 / np.sqrt(n[text]), np.full(extra.size, 1 / np.sqrt(_STRUCT))])[order])
        counts.append(n + _STRUCT)
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(ids), np.concatenate(vals).astype(np.float32), np.concatenate(counts)) if ids else (empty, empty.astype(np.float32), empty)


def _rows(batches):
    import pyarrow as pa

    for batch in batches:
        ids, vals, n = _features(batch)
        end = np.cumsum(n)
        yield pa.RecordBatch.from_pydict(
            {
                "label": batch.column(batch.schema.get_field_index("label")),
                "f": pa.array([ids[e - c : e].astype(np.int32).tobytes() for e, c in zip(end, n)], pa.binary()),
                "x": pa.array([vals[e - c : e].tobytes() for e, c in zip(end, n)], pa.binary()),
            }
        )


def _raw(w0: float, w: np.ndarray, v: np.ndarray, ids: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores of texts given one after another, and the sums that the gradient needs."""
    start = np.cumsum(n) - n
    vx = v[ids] * x[:, None]
    s = np.add.reduceat(vx, start, axis=0)
    q = np.add.reduceat((vx * vx).sum(axis=1), start)
    return w0 + np.add.reduceat(w[ids] * x, start) + 0.5 * ((s * s).sum(axis=1) - q), s


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) by adaptive steps on the log loss; the classes weigh the same."""
    rng = np.random.default_rng(SEED)
    w0, w, v = 0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.01, (FEATURES, RANK)).astype(np.float32)
    gw, gv = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, RANK), 1e-3, np.float32)
    y = np.array([r[0] for r in rows])
    if not len(y) or y.min() == y.max():
        return (6.0 if len(y) and y[0] else -6.0 if len(y) else 0.0), w, v * 0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            b = order[at : at + BATCH]
            ids, x = np.concatenate([rows[i][1] for i in b]), np.concatenate([rows[i][2] for i in b])
            n = np.array([len(rows[i][1]) for i in b])
            raw, s = _raw(w0, w, v, ids, x, n)
            d = (weight[b] * (1 / (1 + np.exp(-raw)) - y[b])).astype(np.float32)
            w0 -= STEP * float(d.mean())
            dx = np.repeat(d, n) * x
            used, back = np.unique(ids, return_inverse=True)
            g = np.bincount(back, dx, len(used)).astype(np.float32) + DECAY * w[used]
            gw[used] += g * g
            w[used] -= 0.2 * g / np.sqrt(gw[used])
            part = dx[:, None] * (np.repeat(s, n, axis=0) - v[ids] * x[:, None])
            g = np.stack([np.bincount(back, part[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + DECAY * v[used]
            gv[used] += g * g
            v[used] -= 0.05 * g / np.sqrt(gv[used])
    return w0, w, v


def _scores(model):
    def run(batches):
        import pyarrow as pa

        w0, w, v = model.value
        for batch in batches:
            rest = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"}
            ids, x, n = _features(batch)
            end = np.cumsum(n)
            score = np.zeros(len(n))
            for s in range(0, len(n), 256):
                e = min(len(n), s + 256)
                a, b = end[s] - n[s], end[e - 1]
                raw, _ = _raw(w0, w, v, ids[a:b], x[a:b], n[s:e])
                score[s:e] = 1 / (1 + np.exp(-raw.astype(np.float64)))
            yield pa.RecordBatch.from_pydict(rest | {"score": pa.array(score)})

    return run


def held_out() -> F.Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, ``held_out``, ``score``, ``predicted``.

    Labels (doc_id, quality) are learnt from rows that are not held out; a null label is none, and ids
    labelled twice or repeated in ``docs`` count each time, twice ``train_rows`` texts at most.  A null text scores as an empty one.  Without
    labels every score is 0.5; with labels of one kind only, near 0 or 1.  Other columns are not read.
    """
    docs = sized(docs).select("doc_id", "text")
    marked = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    marked = marked.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    sample = docs.join(F.broadcast(marked), "doc_id").select("label", "text").mapInArrow(_rows, "label int, f binary, x binary")
    # ids that ``docs`` repeats can make more rows than labels: then the first of them by what they hold, not by arrival
    first = sample.orderBy(F.xxhash64("f"), "label", "x").limit(2 * train_rows)
    rows = [(r["label"], np.frombuffer(bytes(r["f"]), np.int32), np.frombuffer(bytes(r["x"]), np.float32)) for r in first.toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(_scores(model), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= LABELLED_AS_GOOD, 1).otherwise(0).alias("predicted"))
