"""Operator 2: repeated word windows, found with a count-min prefilter.

A first pass sends the windows of each pack of texts, as cells of a partial sketch, to the shards of a sketch
over the whole corpus, where they are merged; a merged cell never counts less than a window in it occurs
(``sketch.answered``).  The second pass hands on every window whose cell two texts fill and hardly any other;
those are grouped exactly, by 96 bits of their word sequence.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm import sketch
from tenderlens.llm.textvec import Words, blocks, signed, sized
from tenderlens.plans.staging import discard, materialize, per_key, small

WINDOW = 13
_LAST = 2**63 - 1


def _kept_hash(text: bytes, keep: np.ndarray | None = None) -> str:
    words = text.split()
    if keep is not None:
        words = [w for w, k in zip(words, keep) if k]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _whole(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for at, texts in blocks(batch):
            w = Words(texts)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids.slice(at, len(texts)), "w1": pa.array(signed(w.whole(0))), "w2": pa.array(signed(w.whole(1))), "n_words": pa.array(w.count.astype(np.int64)), "sha": pa.array([_kept_hash(t) for t in texts])}
            )


def without_copies(docs: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(texts that stand for their copies, rows with ``rep``, the least doc_id with the same key).

    ``rows`` has doc_id and the key columns for each row of ``docs``.  An id goes only if each of its rows
    is a copy of one with a smaller id.
    """
    reps = rows.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    marked = rows.join(per_key(reps, "reps"), key, "left")
    marked = materialize(marked.withColumn("rep", F.coalesce("rep", "doc_id")).withColumn("n_copies", F.coalesce("n_copies", F.lit(1))), "copies")
    gone = marked.groupBy("doc_id").agg(F.min(F.col("doc_id") > F.col("rep")).alias("all")).filter("all").select("doc_id")
    texts = docs.join(small(gone), "doc_id", "left_anti")
    again = materialize(marked.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if again.limit(1).count():  # repeated ids: each of their texts once
        twice = texts.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        texts = texts.join(small(again), "doc_id", "left_anti").unionByName(twice)
    return texts, marked


def _distinct(w: Words, window: int, pos: np.ndarray, h1: np.ndarray, keep: np.ndarray, ids: np.ndarray):
    """Rows of the windows at ``pos``, which ``keep`` chose of all: each once a text."""
    import pyarrow as pa

    text, h2 = w.text[pos], w.windows(window, 1)[1][keep]
    order = np.lexsort((h1, text))
    new = np.ones(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    new[1:] = (h1[a] != h1[b]) | (text[a] != text[b])
    one = order[new]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[text[one]]), "h1": pa.array(signed(h1[one])), "h2": pa.array((h2[one] >> np.uint64(32)).astype(np.uint32).view(np.int32))})


def _windows_of(window: int):
    def run(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w = Words(texts)
        pos, h1 = w.windows(window, 0)
        return h1, w.text[pos]

    return run


def _told_rows(window: int, bits: int):
    """Window rows of packs that a sharded sketch has answered."""

    def run(batches):
        for batch in batches:
            ids, packs, known = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "texts", "known"))
            for own, texts, told in zip(ids, packs, known):
                w = Words(texts.as_py())
                pos, h1 = w.windows(window, 0)
                at = sketch.addresses(h1, bits)
                keep = sketch.within(at, np.sort(np.frombuffer(b"".join(told.as_py()), np.uint64))) | sketch.within(at, sketch.once_and_more(at, w.text[pos])[1])
                if keep.any():
                    yield _distinct(w, window, pos[keep], h1[keep], keep, np.asarray(own.values))

    return run


def _removals(window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            gone = batch.column(batch.schema.get_field_index("gone"))
            for at, texts in blocks(batch):
                w = Words(texts)
                pos, h1 = w.windows(window, 0)
                first = np.searchsorted(w.text[pos], np.arange(len(texts) + 1))
                n_removed, sha = [], []
                for i, t in enumerate(texts):
                    own = slice(first[i], first[i + 1])
                    hit = np.isin(signed(h1[own]), np.asarray(gone[at + i].values))
                    delta = np.zeros(w.count[i] + 1, dtype=np.int64)
                    start = pos[own][hit] - w.first[i]
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + window, -1)
                    covered = np.cumsum(delta)[:-1] > 0
                    n_removed.append(int(covered.sum()))
                    sha.append(_kept_hash(t, ~covered))
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(at, len(texts)), "w1": pa.array(signed(w.whole(0))), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(sha, pa.string())})

    return run


def repeated_windows_removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs`` (doc_id long, text; other columns are not read): doc_id,
    ``n_words``, ``n_removed``, ``kept_sha256`` of the words left, joined by one space.

    A word goes if a window over it also starts in a text with a smaller doc_id.  A null text has no
    words; texts shorter than a window lose none.  A null doc_id counts as larger than any other.  Rows
    with the same id never remove each other's words, so repeated rows get the same result.
    """
    docs = sized(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text")
    rows = materialize(docs.mapInArrow(_whole, "doc_id long, w1 long, w2 long, n_words long, sha string"), "op2all")
    texts, marked = without_copies(docs, rows, ["w1", "w2", "n_words"])
    n = rows.agg(F.sum(F.greatest(F.col("n_words") - (window - 1), F.lit(0)))).first()[0] or 0
    packs = sketch.answered(texts, _windows_of(window), n)
    found = packs.select("ids", "texts", "known").mapInArrow(_told_rows(window, sketch.shard_bits(n)), "doc_id long, h1 long, h2 int")
    found = materialize(found, "op2win")
    discard(packs)
    first = per_key(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "op2first")
    # whether a window goes depends on the id and the window alone, so texts that share an id share the list
    gone = found.join(first, ["h1", "h2"]).filter("doc_id > least").groupBy("doc_id").agg(F.collect_list("h1").alias("gone"))
    gone = materialize(gone, "op2gone")
    discard(found)
    affected = docs.join(small(gone.select("doc_id")), "doc_id", "left_semi").join(gone, "doc_id")
    removed = affected.mapInArrow(_removals(window), "doc_id long, w1 long, n_removed long, kept string").dropDuplicates(["doc_id", "w1"])
    out = marked.join(removed, ["doc_id", "w1"], "left")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= window)
    return out.select(
        F.when(F.col("doc_id") == _LAST, None).otherwise(F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
wrd AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS w FROM d),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(w, ' ' ORDER BY j) AS t FROM wrd ANTI JOIN cov USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
