"""A count-min sketch over a corpus that answers one question: may this key occur more than once?

Each partition keeps, for every row of the sketch, two bits a cell: seen once, seen more than once.
Saturating at two is all the question needs, and it makes partition sketches small: they are cut into
slices, compressed, shuffled by slice and merged there.  An estimate never falls below the true count, so
a key that occurs twice is always kept; how many single keys slip through depends on the load only and
costs a later exact step some work.  The merged bits come to the driver once, ``DEPTH * 2**bits / 8``
bytes, at most :data:`MOST_BITS` a row (64 MB in all) whatever the corpus holds, and are broadcast.

Such a sketch fills when a corpus has more keys than it has cells.  One whose size follows the corpus stays in
shards (:func:`answered`): cells go to their shard, are merged there, and the answers go back to the texts
that asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.textvec import blocks
from tenderlens.plans.staging import materialize

DEPTH, SLICE_BITS, LEAST_BITS, MOST_BITS = 2, 21, 16, 28
#: Keys of a shard, about, and bytes of the packs of texts that ask it.
SHARD_KEYS, PACK_BYTES = 1 << 22, 1 << 20
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def bits_for(keys: int) -> int:
    """Cells for a load of about a half, within the fixed bounds."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(2, 2 * keys))))))


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * np.uint64(_SEEDS[row])) >> np.uint64(64 - bits)).astype(np.int64)


def _set(once: np.ndarray, twice: np.ndarray, cells: np.ndarray) -> None:
    cells = np.sort(cells)
    new = np.concatenate([[True], cells[1:] != cells[:-1]])
    again = np.unique(cells[~new])
    cells = cells[new]
    for bitmap, idx in ((twice, again), (twice, cells[(once[cells >> 3] >> (cells & 7)) & 1 == 1]), (once, cells)):
        if len(idx):
            byte = idx >> 3
            at = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            bitmap[byte[at]] |= np.bitwise_or.reduceat((1 << (idx & 7)).astype(np.uint8), at)


def build(df: DataFrame, keys: Callable[..., Iterator[np.ndarray]], bits: int):
    """Sketch ``df``: ``keys(batch)`` yields arrays of 64-bit keys of an Arrow batch.  Returns a broadcast
    for :func:`repeated`."""

    def partial(batches):
        import pyarrow as pa

        size = max(1, (1 << bits) // 8)
        maps = [(np.zeros(size, np.uint8), np.zeros(size, np.uint8)) for _ in range(DEPTH)]
        for batch in batches:
            for k in keys(batch):
                for row in range(DEPTH):
                    if len(k):
                        _set(*maps[row], _cells(k, row, bits))
        step = min(size, (1 << SLICE_BITS) // 8)
        for row, (once, twice) in enumerate(maps):
            for s in range(0, size, step):
                o, t = once[s : s + step], twice[s : s + step]
                if o.any():
                    yield pa.RecordBatch.from_pydict(
                        {"row": pa.array([row], pa.int32()), "slice": pa.array([s // step], pa.int32()), "once": pa.array([pa.compress(o.tobytes(), "zstd", asbytes=True)], pa.binary()), "twice": pa.array([pa.compress(t.tobytes(), "zstd", asbytes=True)], pa.binary())}
                    )

    def merge(batches):
        import pyarrow as pa

        step = min(max(1, (1 << bits) // 8), (1 << SLICE_BITS) // 8)
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r, s, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = held.setdefault((r, s), (np.zeros(step, np.uint8), np.zeros(step, np.uint8)))
                o, t = (np.frombuffer(pa.decompress(x, step, "zstd", asbytes=True), np.uint8) for x in (o, t))
                twice |= t | (once & o)
                once |= o
        for (r, s), (_, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array([r], pa.int32()), "slice": pa.array([s], pa.int32()), "bits": pa.array([pa.compress(twice.tobytes(), "zstd", asbytes=True)], pa.binary())})

    merged = df.mapInArrow(partial, "row int, slice int, once binary, twice binary").repartition("row", "slice").mapInArrow(merge, "row int, slice int, bits binary")
    parts = [(r["row"], r["slice"], bytes(r["bits"])) for r in merged.collect()]
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, bits, parts))


_open: dict[str, tuple[int, list[np.ndarray]]] = {}


def opened(sketch) -> tuple[int, list[np.ndarray]]:
    """The broadcast bits as arrays, unpacked once in a worker."""
    import pyarrow as pa

    key, bits, parts = sketch.value
    if key not in _open:
        size = max(1, (1 << bits) // 8)
        step = min(size, (1 << SLICE_BITS) // 8)
        rows = [np.zeros(size, np.uint8) for _ in range(DEPTH)]
        for row, s, data in parts:
            rows[row][s * step : (s + 1) * step] = np.frombuffer(pa.decompress(data, step, "zstd", asbytes=True), np.uint8)
        _open.clear()
        _open[key] = bits, rows
    return _open[key]


def repeated(sketch, keys: np.ndarray) -> np.ndarray:
    """For each key whether its estimated count is two or more."""
    bits, rows = opened(sketch)
    out = np.ones(len(keys), dtype=bool)
    for row in range(DEPTH):
        c = _cells(keys[out], row, bits)
        out[out] = (rows[row][c >> 3] >> (c & 7)) & 1 == 1
    return out


def shard_bits(keys: int) -> int:
    """The leading bits of a key that name its shard."""
    return int(max(0, min(31, np.ceil(np.log2(max(1, keys) / SHARD_KEYS)))))


def addresses(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where a key is counted: its shard and one of 2**32 cells there, as one number."""
    return keys >> np.uint64(32 - bits)


def within(at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each address whether it is in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(at), dtype=bool)
    return known[np.minimum(np.searchsorted(known, at), len(known) - 1)] == at


def once_and_more(at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted addresses that one text of a pack has, and those that several have."""
    order = np.lexsort((text, at))
    at, text = at[order], text[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    found, count = np.unique(at[new], return_counts=True)
    return found[count == 1], found[count > 1]


def answered(texts: DataFrame, keys: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], n_keys: int) -> DataFrame:
    """Packs of ``texts`` (doc_id, text) with what a sharded sketch says of their keys: ``ids``, ``texts`` and
    ``known``, the addresses (:func:`addresses` with the ``shard_bits`` of ``n_keys``, packed as 64-bit
    numbers) of keys that one text of the pack has and another pack too.  Keys of several texts of a pack are
    not listed, as the pack can tell; packs without either kind are left out.

    ``keys(texts)`` gives the keys and the index of each one's text.  A pack is the partial sketch: it sends
    four bytes for each cell that it fills, once, however often a key occurs in it, so a shard holds its keys
    and at most one more cell of a hot key for each pack.  Cells of a shard are merged in one group of about
    ``4 * SHARD_KEYS`` bytes; nothing comes to the driver.  As a cell counts all keys that fall into it, a key
    that two texts have is always told, and one of a single text with a chance of ``SHARD_KEYS / 2**32``.
    """
    bits = shard_bits(n_keys)

    def pack(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, part in blocks(batch, PACK_BYTES):
                own = ids.slice(at, len(part))
                name = hashlib.blake2b(repr(own.to_pylist()).encode(), digest_size=8)
                for t in part:
                    name.update(len(t).to_bytes(8, "little") + t)
                yield pa.RecordBatch.from_pydict({"pack": pa.array([int.from_bytes(name.digest(), "little", signed=True)]), "ids": pa.array([own.to_pylist()], pa.list_(pa.int64())), "texts": pa.array([part], pa.list_(pa.binary()))})

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                k, text = keys(part.as_py())
                both = once_and_more(addresses(k, bits), text)
                shards = np.unique(np.concatenate(both) >> np.uint64(32))
                cut = [np.searchsorted(x, np.append(shards, shards[-1:] + np.uint64(1)) << np.uint64(32)) for x in both]
                low = [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32) for x in both]
                rows = [[x[c[i] : c[i + 1]].tobytes() for i in range(len(shards))] for x, c in zip(low, cut)]
                if len(shards):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(shards.astype(np.int64)), "pack": pa.array([name] * len(shards), pa.int64()), "once": pa.array(rows[0], pa.binary()), "more": pa.array(rows[1], pa.binary())})

    def merge(shard, rows):
        import pyarrow as pa

        packs = rows.column("pack").to_pylist()
        once, more = ([np.frombuffer(x, np.uint32) for x in rows.column(c).to_pylist()] for c in ("once", "more"))
        seen = np.concatenate(once)
        seen.sort()
        twice = np.union1d(seen[1:][seen[1:] == seen[:-1]], np.concatenate(more))
        high = np.uint64(shard[0].as_py()) << np.uint64(32)
        told = [(p, (o[within(o, twice)].astype(np.uint64) | high).tobytes()) for p, o, m in zip(packs, once, more) if len(m) or within(o, twice).any()]
        return pa.table({"pack": pa.array([p for p, _ in told], pa.int64()), "known": pa.array([k for _, k in told], pa.binary())})

    packs = materialize(texts.select("doc_id", "text").mapInArrow(pack, "pack long, ids array<long>, texts array<binary>"), "packs", compression="zstd")
    asked = packs.select("pack", "texts").mapInArrow(cells, "shard long, pack long, once binary, more binary")
    told = asked.groupBy("shard").applyInArrow(merge, "pack long, known binary")
    told = materialize(told.groupBy("pack").agg(F.collect_list("known").alias("known")), "told")
    return packs.join(told.hint("merge"), "pack")  # both sides grow with the corpus
