"""Operator 12: the language of a text by prediction by partial matching over bytes.

For each language, counts of byte runs of up to :data:`ORDER` bytes of context and the byte that follows are
summed over all texts that may be learnt from.  They form a context tree of variable order: a run is in it
if its count reaches the least at which the tree keeps to its share of :data:`NODES`.  A byte that a context
of the tree does not know is coded by an escape and then in the context one byte shorter; the escape of a
context has the count of its distinct followers and of those that the tree left out.  Once frozen, the
statistics give each byte of a text a code length in each language, in whole units of 2**-16 bits, so the
length of a text is exact and does not depend on the order of sums.  The language of the least length wins.

The tree is a table of fixed size, so it is broadcast; scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.llm.textvec import U, blocks, mix, sized
from tenderlens.plans.staging import materialize

#: Bytes of context at most; runs that the tree holds, over all languages; numbers that it holds beside them.
ORDER, NODES, NUMBERS = 4, 1 << 20, 1 << 24
#: The languages with the most texts are learnt, so many at most.
MOST_LANGUAGES = 256
UNIT = 1 << 16
UNDECIDED = "und"
#: Distinct runs that a task sums up before it hands them on.
HELD = 1 << 20
#: A text begins as after so many zero bytes.
_PAD = b"\0" * ORDER
_RUN_BITS = 8 * (ORDER + 1)


def held_out() -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the last ORDER + 1 bytes up to each byte, as a number, text after text; bytes of each text)."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(x for t in texts for x in (_PAD, t)), np.uint8)
    n = len(buf) - ORDER
    if n <= 0:
        return np.zeros(0, np.uint64), size
    runs = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        runs = (runs << U(8)) | buf[k : k + n]
    first = np.cumsum(size + ORDER) - size - ORDER
    inside = np.ones(n + ORDER, bool)
    for k in range(ORDER):  # runs that reach into the next text
        inside[first + size + k] = False
    return runs[inside[:n]], size


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(batches):
    """(lang, run, n): sums of a task, handed on when they are many."""
    import pyarrow as pa

    langs: dict[str, int] = {}
    keys, counts, held = [], [], 0

    def out(k, n):
        names = list(langs)
        lang = pa.DictionaryArray.from_arrays(pa.array((k >> U(_RUN_BITS)).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_pydict({"lang": lang, "run": pa.array((k & U((1 << _RUN_BITS) - 1)).astype(np.int64)), "n": pa.array(n)})

    for batch in batches:
        own = batch.column(batch.schema.get_field_index("lang"))
        for at, texts in blocks(batch):
            runs, size = runs_of(texts)
            code = np.array([langs.setdefault(x, len(langs)) for x in own.slice(at, len(texts)).to_pylist()], dtype=np.uint64)
            k, n = np.unique(runs | (np.repeat(code, size) << U(_RUN_BITS)), return_counts=True)
            keys.append(k)
            counts.append(n.astype(np.int64))
            held += len(k)
            if held >= HELD:
                k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                if len(k) >= HELD // 2:
                    for s in range(0, len(k), HELD // 8):
                        yield out(k[s : s + HELD // 8], n[s : s + HELD // 8])
                    k, n = k[:0], n[:0]
                keys, counts, held = [k], [n], len(k)
    if keys:
        k, n = _summed(np.concatenate(keys), np.concatenate(counts))
        for s in range(0, len(k), HELD // 8):
            yield out(k[s : s + HELD // 8], n[s : s + HELD // 8])


def context_tree(docs: DataFrame, nodes: int = NODES, numbers: int = NUMBERS) -> DataFrame:
    """(lang, size, run, n, every, followers): the runs that the tree of each language holds, ``size`` bytes long,
    with their counts and the total count and number of distinct followers of the context, by all texts of
    ``docs`` (doc_id, text, lang) that may be learnt from."""
    learnt = sized(docs).filter("text is not null and lang is not null and doc_id is not null").filter(~held_out())
    counts = materialize(learnt.select("lang", "text").mapInArrow(_counted, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")), "ppm")
    top = counts.groupBy("lang").agg(F.sum("n").alias("bytes")).orderBy(F.desc("bytes"), "lang").limit(MOST_LANGUAGES).select("lang")
    names = [r[0] for r in top.collect()]  # at most MOST_LANGUAGES
    share = max(256, min(nodes, numbers // max(1, len(names))) // ((ORDER + 1) * max(1, len(names))))
    sizes = F.explode(F.array(*(F.struct(F.lit(k).alias("size"), F.col("run").bitwiseAND((1 << 8 * k) - 1).alias("run")) for k in range(1, ORDER + 2))))
    runs = materialize(counts.join(F.broadcast(top), "lang").select("lang", sizes.alias("r"), "n").groupBy("lang", "r.size", "r.run").agg(F.sum("n").alias("n")), "ppm")
    # the least count at which no more than the share stays, from a histogram of some hundred bands
    band = F.floor(F.log2("n") * 16).cast("int")
    above = F.sum("k").over(Window.partitionBy("lang", "size").orderBy(F.desc("band")))
    bands = runs.groupBy("lang", "size", band.alias("band")).agg(F.count("*").alias("k")).withColumn("above", above)
    least = bands.groupBy("lang", "size").agg(F.coalesce(F.min(F.when(F.col("above") <= share, F.col("band"))), F.max("band") + 1).alias("least"))
    context = F.shiftrightunsigned("run", 8)
    kept = runs.join(F.broadcast(least), ["lang", "size"]).filter(band >= F.col("least")).withColumn("context", context)
    totals = runs.withColumn("context", context).groupBy("lang", "size", "context").agg(F.sum("n").alias("every"), F.count("*").alias("followers"))
    return kept.join(totals, ["lang", "size", "context"]).select("lang", "size", "run", "n", "every", "followers")


class Table:
    """Rows of numbers by key, in open addressing."""

    EMPTY = U(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.full(1 << bits, self.EMPTY), np.zeros((1 << bits, rows.shape[1]), rows.dtype)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == self.EMPTY
            at, who = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[who]
            self.keys[at], self.rows[at] = keys[left[placed]], rows[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in ``rows``, or -1."""
        out, left, slot = np.full(len(keys), -1), np.arange(len(keys)), self._slot(keys)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = slot[hit]
            on = ~hit & (there != self.EMPTY)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


class Model:
    """Code lengths by run and by escaped context, a column for each language."""

    def __init__(self, langs: list[str], runs: dict[int, tuple[np.ndarray, ...]]):
        """``runs``: by size, arrays (language, run, n, every, followers), sorted by language and run."""
        self.langs, width = langs, len(langs)
        self.costs: dict[int, Table] = {}
        self.escapes: dict[int, Table] = {}
        for size in range(1, ORDER + 2):
            lang, run, n, every, followers = runs.get(size, (np.zeros(0, np.int64),) * 5)
            context = run >> 8
            whole = (every + followers).astype(float)
            keys, at = np.unique(run, return_inverse=True)
            there, where = np.unique(context, return_inverse=True)
            kept = np.zeros((len(there), width))
            total = np.ones((len(there), width))
            np.add.at(kept, (where, lang), n)
            total[where, lang] = whole
            escape = np.where(kept > 0, np.round(-np.log2((total - kept) / total) * UNIT), 0).astype(np.int32)
            if size == 1:
                base = (escape[0] if len(there) else np.zeros(width, np.int32)) + 8 * UNIT
                keys, at, cost = np.arange(256), run, np.tile(base, (256, 1)).astype(np.int32)
            else:
                esc = np.zeros((len(keys), width), np.int32)
                pos = np.searchsorted(there, keys >> 8)
                esc[:] = escape[pos]
                cost = esc + self._lookup(keys & ((1 << 8 * (size - 1)) - 1), size - 1)
            cost[at, lang] = np.round(-np.log2(n / whole) * UNIT).astype(np.int32)
            self.costs[size], self.escapes[size] = Table(keys.astype(np.uint64), cost), Table(there.astype(np.uint64), escape)

    def _lookup(self, runs: np.ndarray, size: int) -> np.ndarray:
        """The code length of the last byte of each run of ``size`` bytes, in each language."""
        runs = runs.astype(np.uint64)
        table = self.costs[size]
        at = table.find(runs)
        out = table.rows[at]
        left = np.flatnonzero(at < 0)
        if len(left):
            rest = self._lookup(runs[left] & U((1 << 8 * (size - 1)) - 1), size - 1)
            ctx = self.escapes[size].find(runs[left] >> U(8))
            known = np.flatnonzero(ctx >= 0)
            rest[known] += self.escapes[size].rows[ctx[known]]
            out[left] = rest
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of texts, in units, in each language."""
        runs, size = runs_of(texts)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        some = np.flatnonzero(size)
        if len(some):
            step = 1 << 16
            cost = np.concatenate([self._lookup(runs[s : s + step], ORDER + 1) for s in range(0, len(runs), step)])
            out[some] = np.add.reduceat(cost, (np.cumsum(size) - size)[some], axis=0, dtype=np.int64)
        return out


def fit(tree: DataFrame) -> Model:
    """The model of a :func:`context_tree`, whose size has a bound."""
    got = tree.toArrow()
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    index = {x: i for i, x in enumerate(langs)}
    lang = np.array([index[x] for x in names], dtype=np.int64)
    col = {c: got.column(c).to_numpy() for c in ("size", "run", "n", "every", "followers")}
    runs = {}
    for size in range(1, ORDER + 2):
        own = np.flatnonzero(col["size"] == size)
        own = own[np.lexsort((col["run"][own], lang[own]))]
        runs[size] = (lang[own], *(col[c][own].astype(np.int64) for c in ("run", "n", "every", "followers")))
    return Model(langs, runs)


def _judged(model):
    def run(batches):
        import pyarrow as pa

        m = model.value
        for batch in batches:
            rest = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"}
            best, score = [], []
            for _, texts in blocks(batch):
                bits = m.lengths(texts)
                first = bits.argmin(axis=1)
                more = (bits - bits.min(axis=1, keepdims=True)) / UNIT
                best.append(first)
                score.append(1 / np.exp2(-np.minimum(more, 1000.0)).sum(axis=1))
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
            names = pa.array(m.langs, pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_pydict(rest | {"lang": names, "p": pa.array(np.concatenate(score) if score else np.zeros(0))})

    return run


def languages(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, ``held_out``, ``lang_pred``, ``score``.

    The score is the probability of the language by the code lengths, all languages alike before.  A text
    that is null or has no letter, and any text if nothing could be learnt, is ``und`` with score 0.  Rows
    without an id are judged but not learnt from; repeated rows count each; equal lengths go to the first
    language in code-point order.  Other columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = fit(context_tree(docs))
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if not model.langs:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = sized(docs).select("doc_id", letters.alias("letters"), "text").mapInArrow(_judged(sent), f"doc_id {kind}, letters boolean, lang string, p double")
    return out.select("doc_id", held_out().alias("held_out"), F.when(F.col("letters"), F.col("lang")).otherwise(UNDECIDED).alias("lang_pred"), F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"))
