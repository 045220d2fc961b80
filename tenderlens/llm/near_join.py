"""Operator 1: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of distinct five-word shingles (a text of one to four words is one shingle).  Texts with
equal sets form a class, so copies are never paired.  Classes that share one of :data:`BANDS` MinHash
bands become candidates; candidates that hang together are compared in blocks of bounded size, so no
group is ever collected and no pair is ever emitted as a row.  Inside a block MinHash values are compared
:data:`STEP` at a time, and a pair goes as soon as the posterior probability (uniform prior) that its
similarity reaches the threshold falls below :data:`TOLERANCE`; every pair that is left is verified on
the full shingle sets.

A pair exactly at similarity 0.8 shares no band with probability (1 - 0.8**6)**45 = 1.1e-6, and less
above; the posterior test adds at most about 1e-9.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.textvec import Words, blocks, lists, mix, signed, sized
from tenderlens.operators.components import connected_components
from tenderlens.plans.staging import materialize, per_key, small

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 45, 6
HASHES = BANDS * ROWS
STEP, TOLERANCE = 30, 1e-9
#: Members of a block; a pair of blocks is compared by one task.
BLOCK = 192
#: A set of candidates that hang together is compared as a whole up to this size.  Beyond it each of its
#: buckets is compared on its own, which covers the same candidate pairs at a cost that chains cannot raise.
WHOLE = 8192

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed to stay): with m of n equal, the posterior of the similarity is
    Beta(m + 1, n - m + 1), whose tail above t is a binomial sum."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = lambda m: sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        out.append((n, next(m for m in range(n + 1) if tail(m) >= tolerance)))
    return out


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a block, and how many each text has."""
    at, h = words.windows(n)
    text = words.text[at]
    few = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(few):
        text, h = np.concatenate([text, few]), np.concatenate([h, mix(words.whole()[few])])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.bincount(text[keep], minlength=words.n_texts)


def minhashes(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """HASHES minima for each text; texts without shingles get all ones."""
    out = np.full((len(counts), HASHES), 0xFFFFFFFF, dtype=np.uint32)
    top = (sets >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(counts)
    for i in np.flatnonzero(counts):
        own = top[ends[i] - counts[i] : ends[i]]
        for s in range(0, len(own), 128):
            np.minimum(out[i], (own[s : s + 128, None] * _MUL + _ADD).min(axis=0), out=out[i])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sig), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS].astype(np.uint64))
    return key


def class_keys(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each text's shingle set."""
    ends, out = np.cumsum(counts), []
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets * np.uint64(m)), dtype=np.uint64)])
        out.append(signed(total[ends] - total[ends - counts]))
    return out[0], out[1]


def _signatures(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for at, texts in blocks(batch):
            w = Words(texts)
            sets, counts = shingle_sets(w)
            some = counts > 0
            k1, k2 = class_keys(sets, counts)
            bands = band_keys(minhashes(sets, counts))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids.slice(at, len(texts)),
                    "k1": pa.array(k1, mask=~some),
                    "k2": pa.array(k2, mask=~some),
                    "n_shingles": pa.array(counts.astype(np.int64)),
                    "bands": lists(signed(bands[some].ravel()), np.where(some, BANDS, 0), pa.int64()),
                }
            )


def _members(batches):
    """Sets and MinHash values of the representatives that have candidates."""
    import pyarrow as pa

    for batch in batches:
        for _, texts in blocks(batch):
            sets, counts = shingle_sets(Words(texts))
            (k1, k2), sig, ends = class_keys(sets, counts), minhashes(sets, counts), np.cumsum(counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "k1": pa.array(k1),
                    "k2": pa.array(k2),
                    "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                    "shingles": pa.array([sets[b - n : b].tobytes() for n, b in zip(counts, ends)], pa.binary()),
                }
            )


def _candidates(sig_a: np.ndarray, sig_b: np.ndarray, same: bool, needed) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that no prefix of the MinHash values rules out."""
    i, j = np.triu_indices(len(sig_a), 1) if same else (x.ravel() for x in np.indices((len(sig_a), len(sig_b))))
    got = np.zeros(len(i), dtype=np.int32)
    for n, least in needed:
        if not len(i):
            break
        s = slice(n - STEP, n)
        if n == STEP and len(sig_a) * len(sig_b) > 4096:  # the first step by value, without gathering rows
            eq = np.zeros((len(sig_a), len(sig_b)), dtype=np.int32)
            for h in range(STEP):
                eq += sig_a[:, h, None] == sig_b[None, :, h]
            got = eq[i, j]
        else:
            got = got + np.concatenate([(sig_a[i[c : c + 20000], s] == sig_b[j[c : c + 20000], s]).sum(axis=1, dtype=np.int32) for c in range(0, len(i), 20000)])
        stay = got >= least
        i, j, got = i[stay], j[stay], got[stay]
    return i, j


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs."""
    used = np.unique(np.concatenate([i, j]))
    if len(i) < 4 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    flat = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, ids, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n > 1
    col, keep = np.cumsum(shared) - 1, shared[ids]
    row, col = row[keep], col[ids[keep]]
    inter = np.zeros((len(used), len(used)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 4096
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [c, c + width])
        m = np.zeros((len(used), width), dtype=np.float32)
        m[row[a:b], col[a:b] - c] = 1
        inter += m @ m.T
    return inter[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)


def _verified(threshold: float):
    """For a group of one or more units (block pairs): what each member gains in links, and a neighbour."""
    needed = least_matches(threshold)

    def run(pdf):
        import pandas as pd

        out = []
        for (_, band, bi, bj), g in pdf.groupby(["unit", "band", "bi", "bj"], sort=False):
            if len(g) < 2:
                continue
            g = g.sort_values("rep")
            sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint32).reshape(len(g), HASHES)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]]
            size, rep = g["members"].to_numpy(), g["rep"].to_numpy()
            blk = g["blk"].to_numpy()
            a, b = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            i, j = _candidates(sig[a], sig[b], bi == bj, needed)
            i, j = a[i], b[j]
            if band >= 0 and len(i):  # a pair of a chained set is counted in the first bucket it shares
                keys = band_keys(sig)
                own = np.concatenate([np.argmax(keys[i[c : c + 20000]] == keys[j[c : c + 20000]], axis=1) for c in range(0, len(i), 20000)]) == band
                i, j = i[own], j[own]
            if not len(i):
                continue
            n = np.array([len(s) for s in sets])
            o = _overlaps(sets, i, j)
            ok = o >= threshold * (n[i] + n[j] - o) - 1e-9
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            links = np.bincount(i, size[j], len(g)) + np.bincount(j, size[i], len(g))
            root = np.arange(len(g))
            while True:  # least label over the links of this block
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            has = links > 0
            out.append(pd.DataFrame({"rep": rep[has], "links": links[has].astype(np.int64), "root": rep[root[has]]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, whole: int = WHOLE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id long, text string; other columns are ignored):

    ``doc_id``; ``class_id``, the least doc_id of all texts that links connect it to; ``copy_of``, the
    least doc_id with the same shingle set; ``n_links`` long, how many other rows are at least
    ``threshold`` similar.  Rows without words (null, empty, blank) have no links and their own id as
    class.  Repeated rows link to each other.  Rows with a null doc_id take part as if their id were -1.
    Links between classes of copies are found once; a row's links count all members of linked classes.
    """
    docs = sized(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("text"))
    sig = materialize(docs.mapInArrow(_signatures, "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>"), "op1sig")
    full = sig.filter("n_shingles > 0")
    classes = materialize(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.max("bands").alias("bands")), "op1cls")
    keyed = classes.select(F.xxhash64("k1", "k2").alias("cls"), "k1", "k2", "rep", "members", "bands")
    banded = keyed.select("cls", F.posexplode("bands").alias("band", "key"))
    hubs = per_key(banded.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub"), "op1hub")
    joined = materialize(banded.join(hubs, "key").select("cls", "band", "key", "hub"), "op1bkt")
    comps = materialize(connected_components(joined, "cls", "hub"), "op1cmp")
    sizes = per_key(comps.groupBy("component").agg(F.count("*").alias("size")), "op1size")
    placed = comps.join(sizes, "component")
    units = placed.filter(F.col("size") <= whole).select(F.col("node").alias("cls"), F.col("component").alias("unit"), F.lit(-1).alias("band"), "size")
    chained = placed.filter(F.col("size") > whole).select(F.col("node").alias("cls"))
    buckets = joined.join(chained, "cls").select("cls", F.col("key").alias("unit"), "band")
    buckets = materialize(buckets, "op1hot")
    buckets = buckets.join(per_key(buckets.groupBy("unit").agg(F.count("*").alias("size")), "op1size"), "unit").select("cls", "unit", "band", "size")
    units = materialize(units.unionByName(buckets), "op1unit")
    n_units = units.count()
    reps = keyed.join(small(units.select("cls").distinct(), n_units), "cls", "left_semi").select("cls", "rep", "k1", "k2")
    texts = docs.join(small(reps.select(F.col("rep").alias("doc_id")).distinct(), n_units), "doc_id", "left_semi").select("text")
    held = texts.mapInArrow(_members, "k1 long, k2 long, sig binary, shingles binary")
    data = materialize(held.join(small(reps, n_units), ["k1", "k2"]).dropDuplicates(["cls"]).select("cls", "sig", "shingles"), "op1mem")
    blocks_of = units.withColumn("nb", F.ceil(F.col("size") / BLOCK)).withColumn("blk", F.expr("cast(pmod(xxhash64(cls, 7), nb) as int)"))
    pairs = blocks_of.withColumn("other", F.explode(F.expr("sequence(0, cast(nb as int) - 1)"))).select(
        "cls", "unit", "band", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "nb"
    )
    groups = max(1, n_units // 256)
    pairs = pairs.withColumn("task", F.expr(f"case when nb = 1 then pmod(xxhash64(unit), {groups}) else xxhash64(unit, band, bi, bj) end"))
    ready = pairs.join(data, "cls").join(keyed.select("cls", "members"), "cls").select("task", "unit", "band", "bi", "bj", "blk", F.col("cls").alias("rep"), "members", "sig", "shingles")
    found = materialize(ready.groupBy("task").applyInPandas(_verified(threshold), "rep long, links long, root long"), "op1lnk")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups_of = materialize(connected_components(found, "rep", "root").select(F.col("node").alias("cls"), "component").join(keyed.select("cls", "rep"), "cls"), "op1grp")
    least = per_key(groups_of.groupBy("component").agg(F.min("rep").alias("class_id")), "op1least")
    members = keyed.select("cls", "k1", "k2", "rep", "members").join(groups_of.join(least, "component").select("cls", "class_id"), "cls", "left")
    final = members.join(linked.withColumnRenamed("rep", "cls"), "cls", "left").select(
        "k1", "k2", "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    with_links = full.select("doc_id", "k1", "k2").join(per_key(final, "op1final"), ["k1", "k2"]).select("doc_id", "class_id", F.col("rep").alias("copy_of"), "n_links")
    alone = sig.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return with_links.unionByName(alone)
