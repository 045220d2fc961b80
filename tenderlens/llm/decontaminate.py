"""Operator 9: benchmark decontamination by latent semantic retrieval.

Passages are windows of :data:`PASSAGE` words at half steps, as TF-IDF vectors over the (hashed) terms of
the benchmark: no other term can bring a passage nearer to an item.  A randomised SVD finds a latent
space: each task adds up ``A^T (A R)`` for its rows of the passage matrix A and a random R, matrices of fixed
size that Spark sums; the benchmark's own passages are stacked under A with as much weight as the corpus, so
that the space holds what is searched for.  Frequencies and space are made once, of all items; only the
search goes through the benchmark in passes, so a verdict does not depend on which items share one.  Every passage of every text is projected and compared by
cosine with every benchmark passage, in one product per block.  Candidates are then aligned word by word:
longest common subsequence with the item, share of its rare words, and its answer (the words it ends with).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.textvec import Prefix, Words, blocks, sized
from tenderlens.plans.staging import materialize, small

PASSAGE = 32
HALF = PASSAGE // 2
RANK, OVER = 96, 16
#: Slots of the term table; words of the corpus that meet a term's slot count as the term.
SLOT_BITS = 20
#: Terms in a greater share of half passages than this weigh nothing, but for items of few other terms.
COMMON, LEAST_TERMS = 0.05, 4
COSINE = 0.5
#: An item counts as leaked if this share of its words is found in order, ...
LCS_SHARE = 0.7
#: ... this share of its rare words' weight, and this share of its answer in order.
RARE_SHARE, ANSWER_SHARE, ANSWER_WORDS = 0.6, 0.5, 5
#: Benchmark items that one broadcast holds; more are searched in several passes.
ITEMS_AT_ONCE = 20_000
#: Rows of the latent basis; terms whose ids are equal modulo this share one, which only matters beyond so many terms.
FEATURES = 1 << 17
#: Bytes of a slice of the summed matrix.
_SLICES = 16

FOUND = "doc_id long, item_id long, cosine double, lcs double"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b".,;:!?")] = True


class Terms:
    """The words of a block as hashes, in ASCII lower case without one closing punctuation mark, and those
    of them that are terms (``term``, an id below the size of the vocabulary), by half passage."""

    def __init__(self, texts: list[bytes], table: np.ndarray | None = None):
        self.words = w = Words(texts)
        low = _LOWER[w.buf]
        end = w.end - (_PUNCT[low[w.end - 1]] & (w.end - w.start > 1)) if len(w.end) else w.end
        self.full = Prefix(low).of(w.start, end)
        if table is None:
            return
        halves = np.maximum(1, -(-w.count // HALF)) * (w.count > 0)
        first = np.concatenate([[0], np.cumsum(halves)])
        self.n_halves = int(first[-1])
        self.half_text = np.repeat(np.arange(len(texts)), halves)
        self.half_local = np.arange(self.n_halves) - first[self.half_text]
        term = table[(self.full >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        at = np.flatnonzero(term >= 0)
        text = w.text[at]
        self.term, self.half = term[at].astype(np.int64), first[text] + (at - w.first[text]) // HALF

    def pairs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(half passage, term, times), sorted."""
        key, n = np.unique(self.half * size + self.term, return_counts=True)
        return key // size, key % size, n


def term_table(passes: Iterator[tuple[list[int], list[bytes]]]) -> np.ndarray:
    """Slot of a hash to the id of its term, -1 for what no item holds; the ids follow the slots."""
    table = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
    for _, texts in passes:
        table[(Terms(texts).full >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = 0
    slots = np.flatnonzero(table == 0)
    table[slots] = np.arange(len(slots))
    return table


def _sum_arrays(df: DataFrame, partial, shape: tuple[int, ...], kind) -> np.ndarray:
    """Sum of one array of fixed shape a task; tasks send slices, Spark adds them up by slice."""
    total = int(np.prod(shape))
    step = -(-total // _SLICES)

    def run(batches):
        import pyarrow as pa

        acc = np.zeros(shape, dtype=np.float64)
        for batch in batches:
            partial(batch, acc)
        flat = acc.ravel()
        for s in range(0, total, step):
            part = flat[s : s + step].astype(kind)
            if part.any():
                yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "v": pa.array([part.tobytes()], pa.binary())})

    def add(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(v, dtype=kind).astype(np.float64)
                held[s] = held[s] + x if s in held else x
        for s, x in held.items():
            yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "v": pa.array([x.tobytes()], pa.binary())})

    out = np.zeros(total)
    for r in df.mapInArrow(run, "s int, v binary").repartition("s").mapInArrow(add, "s int, v binary").collect():
        v = np.frombuffer(bytes(r["v"]))
        out[r["s"] : r["s"] + len(v)] = v
    return out.reshape(shape)


def _document_frequency(table: np.ndarray, size: int):
    def run(batch, acc):
        for _, texts in blocks(batch):
            t = Terms(texts, table)
            acc[:size] += np.bincount(t.pairs(size)[1], minlength=size)
            acc[size] += t.n_halves

    return run


def _summed(rows: np.ndarray, n: int, terms: np.ndarray, x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For each of n rows the sum of its terms' matrix rows, times x; ``rows`` is sorted."""
    out = np.zeros((n, matrix.shape[1]), dtype=np.float32)
    for s in range(0, len(rows), 8192):
        e = min(len(rows), s + 8192)
        part = slice(s, e)
        first = np.flatnonzero(np.concatenate([[True], rows[part][1:] != rows[part][:-1]]))
        m = matrix[terms[part]]
        m *= x[part, None]
        out[rows[part][first]] += np.add.reduceat(m, first, axis=0)
    return out


def _range_sum(table: np.ndarray, idf: np.ndarray, rand: np.ndarray):
    """Adds ``a_i^T (a_i R)`` of the block's half passages; ``a_i`` has unit length."""

    def run(batch, acc):
        for _, texts in blocks(batch):
            t = Terms(texts, table)
            h, term, n = t.pairs(len(idf))
            keep = idf[term] > 0
            h, term, x = h[keep], term[keep], n[keep] * idf[term[keep]]
            if not len(h):
                continue
            norm = np.sqrt(np.bincount(h, x * x, t.n_halves))
            x = (x / norm[h]).astype(np.float32)
            feature = term % len(rand)
            y = _summed(h, t.n_halves, feature, x, rand)
            order = np.argsort(feature, kind="stable")
            acc += _summed(feature[order], len(rand), h[order], x[order], y)

    return run


class Items:
    """The benchmark items of one pass: their terms, and the passages that are searched for."""

    def __init__(self, ids: list[int], texts: list[bytes], table: np.ndarray):
        first = Terms(texts)
        w = first.words
        self.table = table
        slot = (first.full >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.ids, self.words, self.terms = ids, [], []
        item, offset, self.bags = [], [], []
        for n in range(len(texts)):
            a, b = w.first[n], w.first[n + 1]
            self.words.append(first.full[a:b].tolist())
            self.terms.append(self.table[slot[a:b]].astype(np.int64))
            for s in range(0, max(1, int(b - a) - HALF), HALF):
                if b > a:
                    item.append(n)
                    offset.append(s)
                    self.bags.append(self.terms[n][s : s + PASSAGE])
        self.item, self.offset = np.array(item, dtype=np.int64), np.array(offset, dtype=np.int64)

    def weigh(self, idf: np.ndarray) -> None:
        """What each word of an item weighs when a region is judged."""
        self.rare = [idf[t] for t in self.terms]
        # words by weight, the heaviest first: most passages are told apart by the first few
        self.heavy = []
        for words, rare in zip(self.words, self.rare):
            share = rare / max(1e-9, float(rare.sum()))
            self.heavy.append([(words[i], float(share[i])) for i in np.argsort(-share, kind="stable")])

    def searched_by(self, idf: np.ndarray, search: np.ndarray) -> None:
        """An item of common words only is searched by the rarest of them: raises these in ``search``."""
        common = search == 0
        for terms in self.terms:
            own = np.unique(terms)
            if (~common[own]).sum() < LEAST_TERMS:
                pick = own[np.argsort(-idf[own], kind="stable")[:LEAST_TERMS]]
                search[pick] = idf[pick]

    def matrix(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, terms and values of the unit TF-IDF vectors."""
        rows, terms, vals = [], [], []
        for n, bag in enumerate(self.bags):
            term, c = np.unique(bag, return_counts=True)
            x = c * idf[term]
            term, x = term[x > 0], x[x > 0]
            rows.append(np.full(len(term), n))
            terms.append(term)
            vals.append(x / (np.linalg.norm(x) + 1e-9))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return np.concatenate(rows), np.concatenate(terms), np.concatenate(vals)


def lcs(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def may_hold(heavy: list[tuple[int, float]], near: list[set[int]]) -> bool:
    """Whether the rare words in some sets can reach their share; stops as soon as they cannot."""
    missing = 0.0
    for w, x in heavy:
        if not any(w in s for s in near):
            missing += x
            if missing > 1 - RARE_SHARE + 1e-9:
                return False
    return True


def judge(item: list[int], rare: np.ndarray, region: list[int]) -> tuple[float, bool]:
    """(share of the item found in order, whether it counts as leaked)."""
    n = len(item)
    there = set(region)
    weight = rare / max(1e-9, float(rare.sum()))
    if sum(float(x) for w, x in zip(item, weight) if w in there) < RARE_SHARE:
        return 0.0, False
    share = lcs(item, region) / n
    answer = item[-ANSWER_WORDS:]
    return share, share >= LCS_SHARE and lcs(answer, region) >= ANSWER_SHARE * len(answer)


def _search(shared):
    def run(batches):
        import pyarrow as pa

        items, idf, basis, queries, least = shared.value
        rows = len(basis)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            found: dict[tuple, tuple[float, float]] = {}
            for at, texts in blocks(batch):
                t = Terms(texts, items.table)
                some = idf[t.term] > 0
                half, term = t.half[some], t.term[some]
                if not len(half):
                    continue
                y = _summed(half, t.n_halves, term % rows, idf[term], basis)
                own = y.copy()
                same = np.flatnonzero(t.half_text[1:] == t.half_text[:-1])
                y[same] += own[same + 1]
                y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-9
                w = t.words
                sets: dict[int, set[int]] = {}
                for s in range(0, len(y), 2048):
                    cos = y[s : s + 2048] @ queries.T
                    for h, q in zip(*np.divmod(np.flatnonzero(cos >= least), len(queries))):  # of a flat mask, which is much faster
                        half, n = s + int(h), int(items.item[q])
                        text = int(t.half_text[half])
                        key = (at + text, n)
                        if key in found and found[key][1] >= 1.0:
                            continue
                        size = len(items.words[n])
                        back = int(items.offset[q]) // HALF + 1
                        near = []
                        for k in range(max(half - back, half - int(t.half_local[half])), half - back + (size + PASSAGE) // HALF + 3):
                            if k >= t.n_halves or t.half_text[k] != text:
                                break
                            if k not in sets:
                                a = int(w.first[text]) + int(t.half_local[k]) * HALF
                                sets[k] = set(t.full[a : min(a + HALF, int(w.first[text + 1]))].tolist())
                            near.append(sets[k])
                        if not may_hold(items.heavy[n], near):
                            continue
                        start = int(t.half_local[half]) * HALF - int(items.offset[q])
                        a = w.first[text] + max(0, start - HALF)
                        b = min(int(w.first[text + 1]), int(w.first[text]) + start + size + PASSAGE)
                        share, leaked = judge(items.words[n], items.rare[n], t.full[a:b].tolist())
                        if leaked and (key not in found or found[key][1] < share):
                            found[key] = float(cos[h, q]), share
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[k[0]] for k in found], pa.int64()),
                    "item_id": pa.array([items.ids[k[1]] for k in found], pa.int64()),
                    "cosine": pa.array([v[0] for v in found.values()], pa.float64()),
                    "lcs": pa.array([v[1] for v in found.values()], pa.float64()),
                }
            )

    return run


def latent_space(docs: DataFrame, bench: Benchmark, table: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """features x rank orthonormal basis of the leading right singular space of the stacked passages."""
    rows, wide = min(len(idf), FEATURES), rank + OVER
    rand = np.random.default_rng(seed).standard_normal((rows, wide)).astype(np.float32)
    z = _sum_arrays(docs, _range_sum(table, idf, rand), (rows, wide), np.float32)
    own = np.zeros_like(z)
    for items in bench.items(table):
        at, terms, vals = items.matrix(idf)
        y = np.zeros((len(items.bags), wide))
        np.add.at(y, at, rand[terms % rows] * vals[:, None])
        np.add.at(own, terms % rows, y[at] * vals[:, None])
    z += own * (max(1.0, 4 * np.linalg.norm(z)) / (np.linalg.norm(own) + 1e-9))
    q, r = np.linalg.qr(z)
    u, _, _ = np.linalg.svd(r)
    return (q @ u[:, :rank]).astype(np.float32)


class Benchmark:
    """The items of a benchmark (item_id, text) that hold a word, in passes by id and text."""

    def __init__(self, benchmark: DataFrame, step: int):
        rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
        self.rows, self.step, self.only = rows.orderBy("item_id", "text"), step, None

    def passes(self) -> Iterator[tuple[list[int], list[bytes]]]:
        """(ids, texts) of ``step`` items at a time; a benchmark of one pass is read once."""
        if self.only is not None:
            yield from self.only
            return
        at = 0
        while True:
            rows = self.rows.offset(at).limit(self.step).collect()
            part = [([r["item_id"] for r in rows], [r["text"].encode() for r in rows])] if rows else []
            if at == 0 and len(rows) < self.step:
                self.only = part
            yield from part
            at += self.step
            if len(rows) < self.step:
                return

    def items(self, table: np.ndarray) -> Iterator[Items]:
        for ids, texts in self.passes():
            yield Items(ids, texts, table)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, lcs): the texts of ``docs`` (doc_id, text) that hold an item of
    ``benchmark`` (item_id, text), once for each item.

    Null, empty and blank texts or items match nothing; so does an empty table.  Repeated rows repeat
    their matches; a null id stays null.  Other columns are not read.  The benchmark is searched for in
    passes of :data:`ITEMS_AT_ONCE` items, sorted by id and text, whose size bounds what is broadcast; any
    number of passes gives the same rows.
    """
    docs = sized(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench, out = Benchmark(benchmark, ITEMS_AT_ONCE), docs.sparkSession.createDataFrame([], FOUND)
    table = term_table(bench.passes())
    size = int(table.max()) + 1
    if size == 0:
        return out
    count = _sum_arrays(docs.select("text"), _document_frequency(table, size), (size + 1,), np.float64)
    idf = np.log((count[-1] + 1) / (count[:-1] + 1)) + 1e-3
    search = np.where(count[:-1] > COMMON * count[-1], 0.0, idf)
    raised = search.copy()
    for items in bench.items(table):
        common = search.copy()
        items.searched_by(idf, common)
        raised = np.maximum(raised, common)
    search = raised.astype(np.float32)
    basis = latent_space(docs.select("text"), bench, table, search)
    for items in bench.items(table):
        items.weigh(idf)
        queries = np.zeros((len(items.bags), basis.shape[1]), dtype=np.float32)
        r, t, v = items.matrix(search)
        np.add.at(queries, r, basis[t % len(basis)] * v[:, None].astype(np.float32))
        queries /= np.linalg.norm(queries, axis=1, keepdims=True) + 1e-9
        shared = docs.sparkSession.sparkContext.broadcast((items, search, basis, queries, cosine))
        out = out.unionByName(docs.mapInArrow(_search(shared), FOUND))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns are kept.  Rows are named by the 64-bit
    hash of their text, so null and repeated ids are judged like any other."""
    key = F.xxhash64("text")
    found = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark)
    bad = materialize(found.select(F.col("doc_id").alias("__text")).distinct(), "op9bad")
    return docs.join(small(bad), key == F.col("__text"), "left_anti")
