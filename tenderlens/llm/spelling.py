"""Operator 13: spelling variants, by edits that Bloom filters guide to the words there are.

The vocabulary is counted over all texts.  Each of its words sends the words one edit away, as hashes
computed from its own without making the strings, through blocked Bloom filters of the vocabulary, one
filter for each word length.  What a filter may hold is joined with the vocabulary itself, and the two words are compared,
so false positives go and nothing is lost.  A pair is generated once: a replacement by the word with the
lesser letter at the place, a deletion by the longer word.

Filters together are as large as the vocabulary asks (:data:`KEY_BITS` a word), but a pass broadcasts at
most :data:`PASS_BYTES` of them; a larger vocabulary takes several passes over it, never over the texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.textvec import U, blocks, mix, signed, sized
from tenderlens.plans.staging import discard, materialize

LEAST_LETTERS, LEAST_COUNT, RATIO, SLIP = 5, 3, 2, 97
KEY_BITS, PASS_BYTES, LEAST_SLOTS = 24, 16 << 20, 1024
#: Lengths from here on share a filter, so that there are few filters whatever the words.
LONG = 64
#: Words that a task counts before it hands them on, and edits that it looks at together.
HELD, PROBES = 1 << 18, 1 << 19
#: What a lower-cased run consists of; in UTF-8 the second range is 0xC3 and a byte from 0x80 to 0xBF.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], dtype=np.uint32)
_RUN = re.compile(rb"[a-z]+(?:\xc3[\x80-\xbf][a-z]*)*|(?:\xc3[\x80-\xbf][a-z]*)+")


def _slipped(run: bytes, crc: int) -> bytes:
    """The run without the code point that ``crc`` picks."""
    s = run.decode()
    k = crc % len(s)
    return (s[:k] + s[k + 1 :]).encode()


def _counted(batches):
    """(word, n): sums of a task, handed on when they are many."""
    import pyarrow as pa

    def out(held):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    held: dict[bytes, int] = {}
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("id"))
        for at, texts in blocks(batch):
            for doc, text in zip(ids.slice(at, len(texts)).to_pylist(), texts):
                own: dict[bytes, int] = {}
                for run in _RUN.findall(text.lower()):
                    own[run] = own.get(run, 0) + 1
                start = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for run, n in own.items():
                    if start is not None and not (crc := zlib.crc32(run, start)) % SLIP:
                        run = _slipped(run, crc)
                    if len(run) >= LEAST_LETTERS:
                        held[run] = held.get(run, 0) + n
            if len(held) >= HELD:
                yield out(held)
                held = {}
    if held:
        yield out(held)


# ---- hashes: a sum over places, so that an edit changes few terms -----------------------------------------


def _place(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * U(0x9E3779B97F4A7C15) + (at.astype(np.uint64) + U(1)) * U(0xC2B2AE3D27D4EB4F))


def _final(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + U(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def _by_length(words: list[str]):
    """(indices, code points as a matrix) of the words of each length, in parts of bounded size."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    for length in np.unique(size):
        idx = np.flatnonzero(size == length)
        step = max(1, PROBES // max(len(ALPHABET), int(length)))
        for s in range(0, len(idx), step):
            part = idx[s : s + step]
            yield part, np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), int(length))


def _hashed(batches):
    """Adds the length in code points and the hash of each word."""
    import pyarrow as pa

    for batch in batches:
        words = batch.column(batch.schema.get_field_index("word")).to_pylist()
        h, size = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int32)
        for idx, codes in _by_length(words):
            n = codes.shape[1]
            h[idx], size[idx] = _final(_place(codes, np.arange(n)[None, :]).sum(axis=1, dtype=np.uint64), n), n
        yield pa.RecordBatch.from_pydict({"word": batch.column(0), "n": batch.column(1), "size": pa.array(size), "h": pa.array(signed(h))})


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n, size, h): distinct words of all texts of ``docs`` (doc_id, text) with enough letters and
    occurrences, their length and hash, as a table.  Null texts have no words; in a row without an id no run
    is changed; repeated rows count each."""
    runs = sized(docs).select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(_counted, "word string, n long")
    words = runs.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least_count) & (F.length("word") >= LEAST_LETTERS))
    return materialize(words.mapInArrow(_hashed, "word string, n long, size int, h long"), "vocabulary")


# ---- filters --------------------------------------------------------------------------------------------


class Layout:
    """Where the filter of each length lies in one row of 64-bit slots, each of which is a block of its own."""

    def __init__(self, counts: dict[int, int]):
        self.slots, self.base = np.zeros(LONG + 1, np.int64), np.zeros(LONG + 1, np.int64)
        for shard, n in counts.items():
            self.slots[shard] = max(LEAST_SLOTS, -(-n * KEY_BITS // 64))
        self.base[1:] = np.cumsum(self.slots)[:-1]
        self.total = int(self.slots.sum())

    def of(self, h: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(slot, bits) of keys; the upper half of a hash picks the slot, thirty lower bits five bits in it."""
        slot = self.base[shard] + (((h >> U(32)) * U(self.slots[shard])) >> U(32)).astype(np.int64)
        bits = np.zeros(len(h), np.uint64)
        for k in range(5):
            bits |= U(1) << ((h >> U(6 * k)) & U(63))
        return slot, bits


def _set_bits(layout: Layout, low: int, high: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy().view(np.uint64)
            shard = np.minimum(batch.column(batch.schema.get_field_index("size")).to_numpy(), LONG)
            for s in np.unique(shard):
                slot, bits = layout.of(h[shard == s], int(s))
                inside = (slot >= low) & (slot < high)
                yield pa.RecordBatch.from_pydict({"slot": pa.array(slot[inside]), "bits": pa.array(signed(bits[inside]))})

    return run


def _probe(layout: Layout, low: int, high: int, filters):
    """Edits of each word that the filters of slots from ``low`` to ``high`` may hold."""

    def run(batches):
        import pyarrow as pa

        held = filters.value
        covers = lambda shard: layout.slots[shard] and layout.base[shard] < high and layout.base[shard] + layout.slots[shard] > low
        for batch in batches:
            words, counts = batch.column(batch.schema.get_field_index("word")).to_pylist(), batch.column(batch.schema.get_field_index("n")).to_numpy()
            src, dst = [], []

            def test(who: np.ndarray, sums: np.ndarray, length: int) -> None:
                h = _final(sums, length)
                slot, bits = layout.of(h, min(length, LONG))
                if low > 0 or high < layout.total:
                    inside = np.flatnonzero((slot >= low) & (slot < high))
                    who, h, slot, bits = who[inside], h[inside], slot[inside], bits[inside]
                hit = np.flatnonzero((held[slot - low] & bits) == bits)
                src.append(who[hit])
                dst.append(h[hit])

            for idx, codes in _by_length(words):
                n = codes.shape[1]
                same, less = covers(min(n, LONG)), covers(min(n - 1, LONG))
                if not (same or less):
                    continue
                at = np.arange(n)[None, :]
                terms = _place(codes, at)
                sums = terms.sum(axis=1, dtype=np.uint64)
                if less:  # the letters after the deleted one stand a place further left
                    moved = _place(codes[:, 1:], at[:, :-1])
                    after = np.zeros_like(terms)
                    after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
                    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                    last = np.ones(codes.shape, bool)  # of equal letters in a row only the last is deleted
                    last[:, :-1] = codes[:, 1:] != codes[:, :-1]
                    r, c = np.nonzero(last)
                    test(idx[r], (before + after)[r, c], n - 1)
                if same:
                    for k in range(n):
                        new = _place(ALPHABET, np.full(len(ALPHABET), k))
                        r, c = np.nonzero(ALPHABET[None, :] > codes[:, k, None])
                        if len(r):
                            test(idx[r], (sums - terms[:, k])[r] + new[c], n)
            who = np.concatenate(src) if src else np.zeros(0, np.int64)
            h = np.concatenate(dst) if dst else np.zeros(0, np.uint64)
            for s in range(0, len(who), PROBES):
                part = who[s : s + PROBES]
                yield pa.RecordBatch.from_pydict({"a": batch.column(0).take(pa.array(part)), "na": pa.array(counts[part]), "h": pa.array(signed(h[s : s + PROBES]))})

    return run


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words of a :func:`vocabulary` that one inserted, deleted or replaced code
    point tells apart, once, with their counts."""
    spark = vocab.sparkSession
    counts = {r["shard"]: r["k"] for r in vocab.groupBy(F.least("size", F.lit(LONG)).alias("shard")).agg(F.count("*").alias("k")).collect()}  # at most LONG rows
    layout = Layout(counts)
    known = vocab.select("h", F.col("word").alias("b"), F.col("n").alias("nb"))
    step, out = PASS_BYTES // 8, None
    for low in range(0, max(layout.total, 1), step):
        high = min(low + step, layout.total)
        slots = np.zeros(max(high - low, 1), np.uint64)
        got = vocab.select("size", "h").mapInArrow(_set_bits(layout, low, high), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        slots[got.column("slot").to_numpy() - low] = got.column("bits").to_numpy().view(np.uint64)
        filters = spark.sparkContext.broadcast(slots)
        maybe = sized(vocab).select("word", "n").mapInArrow(_probe(layout, low, high, filters), "a string, na long, h long")
        found = maybe.join(known, "h").filter(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")
        out = found if out is None else out.unionByName(found)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far in each round.  Counts at
    least double along a chain, so rounds are few."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        then = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = then.filter("moved").limit(1).count()
        if not moved:
            return then.select("word", "root")
        discard(now)
        now = then.select("word", "root")


def variant_forms(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the :func:`vocabulary` of ``docs``: its near word
    of largest count (the first in code-point order among equals) if that count is at least ``ratio`` times
    its own, what forms lead to in the end, and how many near words there are.  Without texts there are no rows."""
    vocab = vocabulary(docs, least_count)
    side = lambda w, n, v, m: F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.col(v).alias("near"), F.col(m).alias("m"))
    both = near_pairs(vocab).select(F.explode(F.array(side("a", "na", "b", "nb"), side("b", "nb", "a", "na"))).alias("p")).select("p.*")
    best = F.min_by(F.struct("near", "m"), F.struct(-F.col("m"), F.col("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    fit = F.col("best.m") >= ratio * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(fit, F.col("best.near")).alias("form"), F.when(fit, F.col("best.m")).alias("form_n")), "near")
    end = roots(near.filter("form is not null"))
    out = vocab.select("word", "n").join(near, "word", "left").join(end, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
