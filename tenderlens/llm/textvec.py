"""Whole-block text arithmetic with numpy: words, lines, window hashes.

A block is a list of UTF-8 byte strings, about a quarter of a megabyte together, so the arrays of a task
stay small whatever the partition or the batch holds.  Words are the runs of bytes outside 0x20 and 0x09-0x0D.  Hashes are
polynomial modulo 2**64 over prefix sums and then mixed; two of them with different bases make 128 bits
wherever equality decides a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 18
U = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEPS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = U(1)
    return np.cumprod(out, dtype=np.uint64)


#: Powers and inverse powers of a base come as a product of two of these, whatever the length of a text.
_STRIDE = 1 << 16
_LOW = [(_powers(b, _STRIDE), _powers(pow(b, -1, 1 << 64), _STRIDE)) for b in _BASES]


def _strides(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = pow(_BASES[which], _STRIDE, 1 << 64)
    return _powers(base, n // _STRIDE + 1), _powers(pow(base, -1, 1 << 64), n // _STRIDE + 1)


class Prefix:
    """Hashes of any slice of a code array in constant time."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        n = len(codes)
        self.low, (up, self.high) = _LOW[which][1], _strides(which, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        for c, s in enumerate(range(0, n, _STRIDE)):
            part = (codes[s : s + _STRIDE].astype(np.uint64) + U(1)) * _LOW[which][0][: min(_STRIDE, n - s)] * up[c]
            part[:1] += self.sums[s : s + 1]
            np.cumsum(part, out=self.sums[s + 1 : s + 1 + len(part)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end]
        out -= self.sums[start]
        out *= self.low[start & (_STRIDE - 1)]
        out *= self.high[start // _STRIDE]
        out += (end - start).astype(np.uint64)
        return mix(out)

    def grams(self, k: int) -> np.ndarray:
        """The hash of each run of ``k`` codes, in order."""
        out = self.sums[k:] - self.sums[:-k]
        for c, s in enumerate(range(0, len(out), _STRIDE)):
            part = out[s : s + _STRIDE]
            part *= self.low[: len(part)] * self.high[c]
        return mix(out + U(k))


def blocks(batch, limit: int = BLOCK_BYTES, name: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as UTF-8, null as empty) of consecutive runs of about ``limit`` bytes of a
    string column of an Arrow batch; a longer text is alone.  Only one run at a time is held as bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    end = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(end):
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + limit, side="right")))
        yield at, [b"" if x is None else x for x in col.slice(at, stop - at).to_pylist()]
        at = stop


#: Spark's own bound on the bytes of an Arrow batch; by default a batch holds 10,000 rows of any size.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def sized(df):
    """``df``, in a session whose Arrow batches have a bound in bytes: :data:`BATCH_BYTES`, unless the user
    has set another.  It bounds the buffers of the executor and of its Python workers."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "1b") == "1b":
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


class Words:
    """The words of a block: start and end in the joined buffer, and the text each is in."""

    def __init__(self, texts: list[bytes]):
        self.n_texts = len(texts)
        self.buf = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        inside = np.zeros(len(self.buf) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[self.buf]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(self.n_texts + 1))
        self.count = np.diff(self.first)
        self._hash: dict[int, np.ndarray] = {}

    def hash(self, which: int = 0) -> np.ndarray:
        if which not in self._hash:
            self._hash[which] = Prefix(self.buf, which).of(self.start, self.end)
        return self._hash[which]

    def windows(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words of one text."""
        h = self.hash(which)
        if len(h) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.text[: len(h) - n + 1] == self.text[n - 1 :])
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            out = out * U(_STEPS[which]) + h[at + k]
            out ^= out >> U(31)
        return at, mix(out)

    def whole(self, which: int = 0) -> np.ndarray:
        """For each text, a hash of its word sequence."""
        h = mix(self.hash(which))
        return Prefix(h, which).of(self.first[:-1], self.first[1:])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind):
    """An Arrow list column from flat values and the length of each list."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
