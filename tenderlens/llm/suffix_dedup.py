"""Operator 8: repeated byte strings by distributed prefix doubling.

Doubling every byte position would shuffle the corpus many times over, so ranks are kept for sampled
positions that content alone selects: the least hashed k-gram of each run of ``W`` k-grams (*anchors*).
Equal strings of the threshold length hold the same anchors at the same offsets between the anchor of
their first full run and that of their last, because a run that reaches over the edge can select nothing
between them.  So:

* the first level ranks the string over as many anchors as any window must hold; single ones leave at
  once (a sketch drops nearly all of them before the first shuffle, never one that repeats);
* level j + 1 sorts pairs (rank at i, rank at i + 2**j), reranks, and drops the single ones, until a
  string is unique or longer than the threshold needs;
* what is left bounds the candidates.  Starts whose windows lie in a repeated anchor string are settled.
  The windows around the ends of such strings, and those that share their anchor string, are grouped
  exactly by 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm import sketch
from tenderlens.llm.substring_dedup import without_copies
from tenderlens.llm.textvec import Prefix, blocks, signed, sized
from tenderlens.plans.staging import discard, materialize, per_key, small

LENGTH = 400
#: Bytes up to which the repeated ranks are broadcast; there are many tables of them, one after another.
LISTED = 1 << 20
#: Positions that are looked at together, so that a very long text takes no more memory than its hashes.
CHUNK = 1 << 18


class Anchors:
    """Anchors of the texts of a block, and what each window start sees of them."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.k = length, max(2, min(16, length // 8))
        self.w = max(2, min(64, (length - self.k) // 4))
        # a window holds at least so many anchor strings between the anchors that equal windows share
        self.base = int(np.log2(max(1, -(-(length - self.k - 2 * self.w + 2) // self.w))))
        self.buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.h = [Prefix(self.buf, 0)]
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        near = [np.zeros(0, dtype=np.uint8)]
        reach = self.w + self.k - 1
        picked = np.zeros(len(self.buf), dtype=bool)
        if len(self.buf) >= reach:
            grams = self.h[0].grams(self.k)
            for s in range(0, len(grams) - self.w + 1, CHUNK):  # the least of each run of w grams, and how far off it is
                part = grams[s : s + CHUNK + self.w - 1]
                at = np.arange(len(part), dtype=np.uint64)
                key = (part & np.uint64(0xFFFFFFFF00000000)) | at
                width = 1
                while width < self.w:
                    step = min(width, self.w - width)
                    key = np.minimum(key[:-step], key[step:])
                    width += step
                least = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                near.append((least - np.arange(len(least))).astype(np.uint8))
                full = self.end[self.owner[s : s + len(least)]] - s - np.arange(len(least)) >= reach
                picked[s + least[full]] = True
        self.near = np.concatenate(near)
        self.at = np.flatnonzero(picked)
        self.before = np.cumsum(picked, dtype=np.int32) - picked
        self.text = self.owner[self.at]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.ordinal = np.arange(len(self.at)) - self.first[self.text]

    def second(self) -> Prefix:
        """Hashes that are independent of the first ones, made when they are asked for."""
        if len(self.h) == 1:
            self.h.append(Prefix(self.buf, 1))
        return self.h[1]

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors that begin a string of ``2**base`` steps in their text, and its bounds."""
        n = 1 << self.base
        i = np.flatnonzero(self.text[n:] == self.text[:-n])
        return i, self.at[i], self.at[i + n] + self.k

    def starts(self) -> Iterator[np.ndarray]:
        """The starts of all windows, a chunk at a time."""
        for s in range(0, len(self.buf) - self.length + 1, CHUNK):
            p = np.arange(s, min(s + CHUNK, len(self.buf) - self.length + 1))
            yield p[self.end[self.owner[p]] - p >= self.length]

    def inner(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last anchor that any equal window holds too."""
        q = p + self.length - self.k - self.w + 1
        return self.before[p + self.near[p]], self.before[q + self.near[q]]

    def covering(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of starts (lo, hi) to settle at once, and the first and last anchor inside the string
        [lo, hi + length) that holds their windows: from each anchor to the next, and the starts whose
        windows end from one anchor's end to the next."""
        i = np.flatnonzero(self.text[1:] == self.text[:-1])
        a, b, t = self.at[i], self.at[i + 1], self.text[i]
        lo, hi = np.concatenate([a, a + self.k + 1 - self.length]), np.concatenate([b - 1, b + self.k - self.length])
        t = np.concatenate([t, t])
        ok = (lo >= self.start[t]) & (hi + self.length <= self.end[t])
        # both kinds give the same run where anchors lie just so far apart: one place counts once
        lo, hi = np.unique(np.stack([lo[ok], hi[ok]]), axis=1)
        return lo, hi, np.searchsorted(self.at, lo, side="left"), np.searchsorted(self.at, hi + self.length - self.k, side="right") - 1

    def levels(self, text: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Highest repeated level of each anchor, -1 for none, from lists of codes by text."""
        out = np.full(len(self.at), -1, dtype=np.int64)
        np.maximum.at(out, self.first[text] + (code >> 5), code & 31)
        return out


def _facts(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for at, texts in blocks(batch):
            size = np.array([len(t) for t in texts], dtype=np.int64)
            end = np.cumsum(size)
            buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
            k1, k2 = (signed(Prefix(buf, x).of(end - size, end)) for x in (0, 1))
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(at, len(texts)), "k1": pa.array(k1), "k2": pa.array(k2), "n_bytes": pa.array(size), "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts])})


def _long(texts: list[bytes], length: int) -> list[bytes]:
    """Texts too short for a window take no part."""
    return [t if len(t) >= length else b"" for t in texts]


def _r2(x: np.ndarray) -> np.ndarray:
    """A second rank of 32 bits; with the first, 96 bits tell strings apart."""
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _first_ranks(length: int, filt):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            key = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            for at, texts in blocks(batch):
                x = Anchors(_long(texts, length), length)
                i, a, b = x.strings()
                r1 = x.h[0].of(a, b)
                keep = sketch.repeated(filt, r1)
                i, a, b, r1 = i[keep], a[keep], b[keep], r1[keep]
                if len(i):
                    yield pa.RecordBatch.from_pydict(
                        {"key": pa.array(key[at + x.text[i]]), "i": pa.array(x.ordinal[i].astype(np.int32)), "span": pa.array((b - a - x.k).astype(np.int32)), "r1": pa.array(signed(r1)), "r2": pa.array(_r2(x.second().of(a, b)))}
                    )

    return run


def _only_repeated(rows: DataFrame, *first: str) -> DataFrame:
    """Rows whose rank another position has too, with the least ``first`` (as a struct) of the rank.  ``rows``
    is a table, as it is read twice.  Counts are summed before the shuffle and written, so that the join reads
    two tables and adaptive execution can split a rank that very many rows share."""
    least = [F.min(F.struct(*first)).alias("first")] if first else []
    twice = rows.groupBy("r1", "r2").agg(F.count("*").alias("n"), *least).filter("n > 1").drop("n")
    return rows.join(per_key(twice, "op8twice", LISTED), ["r1", "r2"])


def doubled(ranks: DataFrame, base: int, enough: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, code), where ``i * 32 + lev`` says that the string of 2**lev steps from anchor i repeats, and the
    tables behind it, to be deleted after use."""
    raw = materialize(ranks, "op8raw")
    now = materialize(_only_repeated(raw), "op8rank")
    discard(raw)
    levels, j, tables = now.select("key", (F.col("i") * 32 + base).alias("code")), base, [now]
    while j < 30 and now.limit(1).count():
        a = now
        b = now.select("key", (F.col("i") - (1 << j)).alias("i"), F.col("span").alias("span_b"), F.col("r1").alias("s1"), F.col("r2").alias("s2"))
        # what is longer than any string that is looked up is past the threshold
        pair = a.join(b, ["key", "i"]).filter(F.col("span") + F.col("span_b") <= enough).select(
            "key", "i", (F.col("span") + F.col("span_b")).alias("span"), F.xxhash64("r1", "r2", "s1", "s2", F.lit(1)).alias("r1"), F.hash("s2", "r1", "r2", "s1", F.lit(2)).alias("r2")
        )
        j += 1
        raw = materialize(pair, "op8raw")
        now = materialize(_only_repeated(raw), "op8rank")
        discard(raw)
        tables.append(now)
        levels = levels.unionByName(now.select("key", (F.col("i") * 32 + j).alias("code")))
    return levels, tables


def _open_texts(batch, length: int):
    """(anchors, texts, other columns, keys) of the blocks of a batch."""
    for at, part in blocks(batch):
        rest = {f.name: batch.column(n).slice(at, len(part)) for n, f in enumerate(batch.schema) if f.name != "text"}
        yield Anchors(_long(part, length), length), part, rest, rest["key"].to_numpy(zero_copy_only=False)


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of a list column; a null list is empty."""
    n = np.array([len(v.values) if v.values is not None else 0 for v in col], dtype=np.int64)
    return np.repeat(np.arange(len(n)), n), np.asarray(col.flatten(), dtype=np.int64)


def _covered(length: int):
    """Repeated strings that hold all windows from an anchor to the next."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x, _, rest, key in _open_texts(batch, length):
                lo, hi, f, g = x.covering()
                if not len(f):
                    continue
                lev = x.levels(*_flat(rest["codes"]))
                j = np.floor(np.log2(np.maximum(1, g - f))).astype(np.int64)
                ok = (lev[f] >= j) & (lev[g - (1 << j)] >= j)
                lo, hi = lo[ok], hi[ok]
                t, a, b = x.owner[lo], lo, hi + length
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[t]), "lo": pa.array((lo - x.start[t]).astype(np.int32)), "hi": pa.array((hi - x.start[t]).astype(np.int32)), "r1": pa.array(signed(x.h[0].of(a, b))), "r2": pa.array(_r2(x.second().of(a, b)))})

    return run


def _within(x: Anchors, rest, chosen: bool) -> np.ndarray:
    """For each position whether a settled run of starts holds it; only a run chosen to stand for all equal
    ones, if so asked."""
    delta = np.zeros(len(x.buf) + 1, dtype=np.int32)
    (text, a), b = _flat(rest["los"]), _flat(rest["his"])[1]
    if chosen:
        keep = _flat(rest["stand"])[1] == 1
        text, a, b = text[keep], a[keep], b[keep]
    np.add.at(delta, x.start[text] + a, 1)
    np.add.at(delta, x.start[text] + b + 1, -1)
    return np.cumsum(delta)[:-1] > 0


def _shared_runs(x: Anchors, rest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor string hash, whether a start in it is unsettled) of runs of starts
    that may repeat, by the levels of the anchor string that an equal window must share."""
    none = np.zeros(0, dtype=np.int64)
    out = [(none, none, none.astype(np.uint64), none.astype(bool))]
    if not len(x.at):
        return out[0]
    lev = x.levels(*_flat(rest["codes"]))
    free = np.concatenate([[0], np.cumsum(~_within(x, rest, False), dtype=np.int32)])
    for p in x.starts():
        f, g = x.inner(p)
        j = np.floor(np.log2(np.maximum(1, g - f))).astype(np.int64)
        ok = (lev[f] >= j) & (lev[g - (1 << j)] >= j)
        p, f, g = p[ok], f[ok], g[ok]
        if len(p):
            new = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)]))
            lo, hi = p[new], p[np.concatenate([new[1:], [len(p)]]) - 1]
            out.append((lo, hi, x.h[0].of(x.at[f[new]], x.at[g[new]] + x.k), free[hi + 1] > free[lo]))
    return tuple(np.concatenate(c) for c in zip(*out))


_OPEN = np.uint64(0x5851F42D4C957F2D)


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Every value of every interval."""
    n = hi - lo + 1
    row = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _windows(length: int, filt):
    """Starts whose anchor string repeats and is that of an unsettled start somewhere: the unsettled ones,
    and of the settled ones those in one of each set of equal runs, which an unsettled one may equal."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x, _, rest, key in _open_texts(batch, length):
                lo, hi, h, _ = _shared_runs(x, rest)
                ok = sketch.repeated(filt, h)
                ok[ok] = sketch.repeated(filt, h[ok] ^ _OPEN)
                pos = _spread(lo[ok], hi[ok]) if ok.any() else lo[:0]
                pos = pos[~_within(x, rest, False)[pos] | _within(x, rest, True)[pos]]
                for s in range(0, len(pos), 200_000):
                    q = pos[s : s + 200_000]
                    t = x.owner[q]
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key[t]), "p": pa.array((q - x.start[t]).astype(np.int32)), "r1": pa.array(signed(x.h[0].of(q, q + length))), "r2": pa.array(_r2(x.second().of(q, q + length)))})

    return run


def _cut(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x, part, rest, _ in _open_texts(batch, length):
                k1, k2 = (signed(Prefix(np.frombuffer(b"".join(part), np.uint8), n).of(np.cumsum([0, *map(len, part[:-1])]), np.cumsum([len(t) for t in part]))) for n in (0, 1))
                out = {"k1": k1.tolist(), "k2": k2.tolist(), "n_removed": [], "n_spans": [], "kept": []}
                for n, t in enumerate(part):
                    delta = np.zeros(len(t) + 1, dtype=np.int32)
                    for a, b in (("los", "his"), ("one", "one")):
                        if rest[a][n].values is not None:
                            np.add.at(delta, np.asarray(rest[a][n].values), 1)
                            np.add.at(delta, np.asarray(rest[b][n].values) + length, -1)
                    gone = np.cumsum(delta)[:-1] > 0
                    out["n_removed"].append(int(gone.sum()))
                    out["n_spans"].append(int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()))
                    out["kept"].append(hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "kept" else pa.int64()) for k, v in out.items()})

    return run


def repeated_bytes_removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read): doc_id, ``n_bytes``,
    ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or
    another; strings never cross texts and are judged on the input.  A null text is empty.  A text of at
    least ``length`` bytes that occurs twice (repeated rows too) goes whole.  Null ids take part as -1 and
    come back as null.
    """
    docs = sized(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text")
    rows = materialize(docs.mapInArrow(_facts, "doc_id long, k1 long, k2 long, n_bytes long, sha string"), "op8all")
    texts, marked = without_copies(docs, rows, ["k1", "k2", "n_bytes"])
    single = not marked.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    texts = texts.filter(F.octet_length("text") >= length).select((F.col("doc_id") if single else F.xxhash64("doc_id", "text")).alias("key"), "text")
    shape = Anchors([], length)

    def keys(batch):
        for _, part in blocks(batch):
            x = Anchors(_long(part, length), length)
            yield x.h[0].of(*x.strings()[1:])

    n = rows.agg(F.sum("n_bytes")).first()[0] or 0
    filt = sketch.build(texts.select("text"), keys, sketch.bits_for(4 * n // shape.w))
    ranks = texts.mapInArrow(_first_ranks(length, filt), "key long, i int, span int, r1 long, r2 int")
    levels, tables = doubled(ranks, shape.base, length + shape.w + shape.k)
    held = materialize(levels.groupBy("key").agg(F.collect_list("code").alias("codes")), "op8held")
    for table in tables:
        discard(table)
    some = texts.join(small(held.select("key")), "key", "left_semi").join(held, "key")
    affected = materialize(some, "op8text")
    covered = materialize(affected.mapInArrow(_covered(length), "key long, lo int, hi int, r1 long, r2 int"), "op8cov")
    sure = _only_repeated(covered, "key", "lo", "hi").withColumn("stand", (F.col("first") == F.struct("key", "lo", "hi")).cast("int"))
    sure = sure.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "stand")).alias("l")).select("key", F.col("l.lo").alias("los"), F.col("l.hi").alias("his"), F.col("l.stand").alias("stand"))
    ready, n_covered = materialize(affected.join(sure, "key", "left"), "op8ready"), covered.count()
    for table in (affected, covered):
        discard(table)

    def shared(batch):
        for x, _, rest, _ in _open_texts(batch, length):
            _, _, h, open_ = _shared_runs(x, rest)
            yield h
            yield np.repeat(h[open_] ^ _OPEN, 2)

    filt2 = sketch.build(ready, shared, sketch.bits_for(4 * n_covered))
    wins = materialize(ready.mapInArrow(_windows(length, filt2), "key long, p int, r1 long, r2 int"), "op8win")
    ones = _only_repeated(wins).groupBy("key").agg(F.collect_list("p").alias("one"))
    cut = ready.join(ones, "key", "left").filter("los is not null or one is not null").select("key", "text", "los", "his", "one")
    cut = cut.mapInArrow(_cut(length), "k1 long, k2 long, n_removed long, n_spans long, kept string").dropDuplicates(["k1", "k2"])
    out = marked.join(per_key(cut, "op8cut", LISTED), ["k1", "k2"], "left")
    whole = (F.col("n_copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        F.when(F.col("doc_id") == -1, None).otherwise(F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
