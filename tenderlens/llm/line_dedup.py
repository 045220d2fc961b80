"""Operator 10: near-equal lines by a segment-partition edit join.

How many edits two lines may be apart grows with the length of the shorter (:data:`BANDS`).  Two lines
within k edits share, by the pigeonhole principle, one of k + 1 segments of the shorter at nearly the same
place.  Each line indexes the segments of its own length and probes those of lengths down to k less, with
the k of that length, at the few starts where a match can count.  Keys that occur once leave by
a sketch.  Lines that share keys are compared in blocks of bounded size: lengths first, then character
counts (an edit moves two at most), then a banded bit-parallel edit distance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm import sketch
from tenderlens.llm.textvec import Prefix, blocks, lists, mix, signed, sized
from tenderlens.operators.components import connected_components
from tenderlens.plans.staging import materialize, per_key, small

#: (code points, edits): how many edits two lines may be apart that have at least so many code points each.
#: One edit in sixteen characters is a typo; lines under that are compared for equality only.
BANDS = ((16, 1), (40, 2), (160, 3))
#: Members of a block; a pair of blocks is compared by one task.  A set of lines that hang together is
#: compared as a whole up to WHOLE; beyond it each of its buckets is, which covers the same pairs.
BLOCK, WHOLE = 512, 2048
_LAST = 2**63 - 1
_SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint32)


def allowed(size: np.ndarray, bands) -> np.ndarray:
    """The edits that lines of these sizes may be apart."""
    return np.array([0, *(e for _, e in bands)])[np.searchsorted([n for n, _ in bands], size, side="right")]


def probe_plan(edits: int) -> list[tuple[int, int, int, bool]]:
    """(length less, segment, shift of its start, whether it is the line's own index key)."""
    out = []
    for less in range(edits + 1):
        for s in range(edits + 1):
            low, high = max(-s, less - (edits - s)), min(s, less + (edits - s))
            out += [(less, s, shift, less == 0 and shift == 0) for shift in range(low, high + 1)]
    return out


class Lines:
    """The lines of a block that hold a word, as code points."""

    def __init__(self, texts: list[bytes]):
        whole = [t.decode("utf-8", "replace") for t in texts]
        self.codes = np.frombuffer("\n".join([*whole, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        stop = np.flatnonzero(self.codes == 10)
        start = np.concatenate([[0], stop[:-1] + 1])
        n = np.array([t.count("\n") + 1 for t in whole], dtype=np.int64)
        self.per_text = n
        text = np.repeat(np.arange(len(texts)), n)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        solid = np.concatenate([[0], np.cumsum(~np.isin(self.codes, _SPACES))])
        has = solid[stop] > solid[start]
        self.start, self.end, self.text, self.number = start[has], stop[has], text[has], number[has]
        self.hashes = Prefix(self.codes, 0), Prefix(self.codes, 1)

    def keys(self, bands) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of all that lines index and probe, by line; the last bit of a key tells which."""
        size = self.end - self.start
        rows, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for _, edits in bands:
            for less, s, shift, own in probe_plan(edits):
                at = np.flatnonzero(allowed(size - less, bands) == edits)
                n = size[at] - less
                base, short = n // (edits + 1), edits + 1 - n % (edits + 1)
                first = self.start[at] + s * base + np.maximum(0, s - short) + shift
                key = mix(self.hashes[0].of(first, first + base + (s >= short)) * np.uint64(31) + (n * 16 + s).astype(np.uint64))
                rows.append(at)
                keys.append((key & ~np.uint64(1)) | np.uint64(own))
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.argsort(row, kind="stable")
        return row[order], key[order]


def within(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether the edit distance of two code arrays is at most ``edits``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    diff = np.flatnonzero(a != b[: len(a)])
    lead = int(diff[0]) if len(diff) else len(a)
    a, b = a[lead:], b[lead:]
    diff = np.flatnonzero(a[::-1] != b[::-1][: len(a)])
    tail = int(diff[0]) if len(diff) else len(a)
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    m, k = len(a), edits
    if not m:
        return len(b) <= k
    if m <= k:
        row = list(range(m + 1))
        for j, y in enumerate(b, 1):
            last, row[0] = row[0], j
            for i, x in enumerate(a, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != y))
        return row[m] <= k
    # bit t of a column j (from 1) stands for the pattern row j - k + t, t = 0 .. 2k
    width = 2 * k + 1
    mask = (1 << width) - 1
    up, down, dist, bottom = mask & (-1 << k), 0, k, 1 << (2 * k)
    for j, y in enumerate(b, 1):
        eq = 0
        for t in range(max(0, k + 1 - j), min(width, m - j + k + 1)):
            if a[j - k + t - 1] == y:
                eq |= 1 << t
        d0 = ((((eq & up) + up) ^ up) | eq | down) & mask
        hp, hn = (down | ~(d0 | up)) & mask, d0 & up
        if j <= m - k:
            dist += not d0 & bottom
        else:
            row = 1 << (m - j + k) if m - j + k >= 0 else 0
            dist += bool(hp & row) - bool(hn & row)
        if dist > 2 * k + 1:
            return False
        d1 = d0 >> 1
        up, down = (hn | ~(d1 | hp)) & mask, d1 & hp
    return dist <= k


def _facts(bands):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, content = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "content"))
            for at, texts in blocks(batch):
                x = Lines(texts)
                if not len(x.start):
                    continue
                row, keys = x.keys(bands)
                n = np.bincount(row, minlength=len(x.start))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids[at + x.text]), "content": pa.array(content[at + x.text]), "line": pa.array(x.number),
                        "h1": pa.array(signed(x.hashes[0].of(x.start, x.end))), "h2": pa.array(signed(x.hashes[1].of(x.start, x.end))),
                        "keys": lists(signed(keys), n, pa.int64()),
                    }
                )

    return run


def _key_rows(filt):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            cls = batch.column(batch.schema.get_field_index("cls")).to_numpy(zero_copy_only=False)
            keys = batch.column(batch.schema.get_field_index("keys"))
            flat, line = np.asarray(keys.flatten()), np.repeat(np.arange(len(cls)), np.asarray(pc.list_value_length(keys)))
            keep = sketch.repeated(filt, flat.view(np.uint64) & ~np.uint64(1))
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls[line[keep]]), "key": pa.array(flat[keep] & ~1), "own": pa.array(flat[keep] & 1 == 1)})

    return run


def _contents(filt):
    """Lines that may be wanted, with their code points: those whose class the sketch of the wanted knows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for at, texts in blocks(batch):
                x = Lines(texts)
                h = x.hashes[0].of(x.start, x.end)
                keep = np.flatnonzero(sketch.repeated(filt, h))
                yield pa.RecordBatch.from_pydict(
                    {"cls": pa.array(signed(h[keep])), "d": pa.array(ids[at + x.text[keep]]), "l": pa.array(x.number[keep]), "codes": pa.array([x.codes[x.start[i] : x.end[i]].astype(np.uint32).tobytes() for i in keep], pa.binary())}
                )

    return run


def _compared(bands):
    def run(pdf):
        import pandas as pd

        out = []
        for (_, bi, bj), g in pdf.groupby(["unit", "bi", "bj"], sort=False):
            if len(g) < 2:
                continue
            codes = [np.frombuffer(c, dtype=np.uint32) for c in g["codes"]]
            size, blk, cls = np.array([len(c) for c in codes]), g["blk"].to_numpy(), g["cls"].to_numpy()
            bag = np.array([np.bincount(c % 64, minlength=64) for c in codes], dtype=np.int32)
            a, b = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            most = allowed(size, bands)
            i, j = np.nonzero(np.abs(size[a][:, None] - size[b][None, :]) <= np.minimum(most[a][:, None], most[b][None, :]))
            i, j = a[i], b[j]
            if bi == bj:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 20_000):
                x, y = i[s : s + 20_000], j[s : s + 20_000]
                edits = np.minimum(most[x], most[y])
                near = np.abs(bag[x] - bag[y]).sum(axis=1) <= 2 * edits
                for p, q, k in zip(x[near], y[near], edits[near].tolist()):
                    if within(codes[p], codes[q], k):
                        out.append((cls[p], cls[q]))
        frame = pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        # the earlier neighbour is all that counts: one row a line, not one a pair
        first = dict(zip(pdf["cls"], zip(pdf["d"], pdf["l"])))
        both = pd.concat([frame, frame.rename(columns={"a": "b", "b": "a"})])
        best: dict[int, tuple[int, int]] = {}
        for p, q in zip(both["a"], both["b"]):
            best[p] = min(best.get(p, (_LAST, 0)), first[q])
        return pd.DataFrame([(c, d, n) for c, (d, n) in best.items()], columns=["cls", "d", "l"]).astype("int64")

    return run


def _rebuilt(count: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            gone = batch.column(batch.schema.get_field_index("__gone"))
            rest = {f.name: batch.column(n) for n, f in enumerate(batch.schema) if f.name not in ("text", "__gone")}
            texts, removed = [], []
            for n, t in enumerate(t for _, part in blocks(batch) for t in part):
                out = set(np.asarray(gone[n].values).tolist())
                texts.append(b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in out))
                removed.append(len(out))
            yield pa.RecordBatch.from_pydict(rest | {"text": pa.array(texts, pa.binary()).cast(pa.string()), count: pa.array(removed, pa.int64())})

    return run


def removed_lines(docs: DataFrame, bands=BANDS) -> DataFrame:
    """(doc_id, content, line): each line (from 0) that an earlier line equals or nearly equals: the edit
    distance is at most what the band of the shorter line allows.  ``content`` is the xxhash64 of the text, which
    tells texts of the same id apart.

    Earlier means a smaller doc_id, or the same and a smaller line number.  Lines without a word are never
    removed and never compared; lines under the first band must be equal.  A null text has no
    lines; null ids count as larger than any other; rows with the same id never remove the same line of
    each other.
    """
    docs = sized(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("content"), "text").filter("text is not null")
    occ = materialize(docs.mapInArrow(_facts(bands), "doc_id long, content long, line long, h1 long, h2 long, keys array<long>"), "op10occ")
    lines = occ.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"), F.max("keys").alias("keys"))
    lines = materialize(lines.select(F.col("h1").alias("cls"), "h2", F.col("first.doc_id").alias("d"), F.col("first.line").alias("l"), "n", "keys"), "op10cls")
    long_ = lines.filter("size(keys) > 0").select("cls", "keys")
    n_keys = long_.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]

    def flat(batch):
        k = np.asarray(batch.column(batch.schema.get_field_index("keys")).flatten()).view(np.uint64)
        for s in range(0, len(k), 200_000):
            yield k[s : s + 200_000] & ~np.uint64(1)

    filt = sketch.build(long_.select("keys"), flat, sketch.bits_for(2 * n_keys))
    keyed = materialize(long_.mapInArrow(_key_rows(filt), "cls long, key long, own boolean"), "op10key")
    hubs = keyed.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("cls"))).alias("hub"), F.min("cls").alias("a"), F.max("cls").alias("b"))
    hubs = per_key(hubs.filter("hub is not null and a < b").select("key", "hub"), "op10hub")
    shared = materialize(keyed.select("key", "cls").join(hubs, "key").distinct(), "op10shr")
    comps = materialize(connected_components(shared, "cls", "hub"), "op10cmp")
    placed = comps.join(per_key(comps.groupBy("component").agg(F.count("*").alias("size")), "op10size"), "component")
    units = placed.filter(F.col("size") <= WHOLE).select(F.col("node").alias("cls"), F.col("component").alias("unit"), "size")
    buckets = shared.join(placed.filter(F.col("size") > WHOLE).select(F.col("node").alias("cls")), "cls").select("cls", F.col("key").alias("unit"))
    buckets = materialize(buckets, "op10hot")
    buckets = buckets.join(per_key(buckets.groupBy("unit").agg(F.count("*").alias("size")), "op10size"), "unit").select("cls", "unit", "size")
    units = materialize(units.unionByName(buckets), "op10unit")
    n_units = units.count()
    wanted = lines.join(small(units.select("cls").distinct(), n_units), "cls", "left_semi").select("cls", "d", "l")
    wanted = materialize(wanted, "op10want")

    def twice(batch):
        yield np.repeat(np.asarray(batch.column(0)).view(np.uint64), 2)

    known = sketch.build(wanted.select("cls"), twice, sketch.bits_for(2 * n_units))
    # only lines that are compared travel, not the texts that hold them
    codes = docs.select("doc_id", "text").mapInArrow(_contents(known), "cls long, d long, l long, codes binary").join(small(wanted, n_units), ["cls", "d", "l"]).dropDuplicates(["cls"])
    codes = materialize(codes, "op10txt")
    split = units.withColumn("nb", F.ceil(F.col("size") / BLOCK)).withColumn("blk", F.expr("cast(pmod(xxhash64(cls, 7), nb) as int)"))
    split = split.withColumn("other", F.explode(F.expr("sequence(0, cast(nb as int) - 1)"))).select("cls", "unit", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "nb")
    split = split.withColumn("task", F.expr(f"case when nb = 1 then pmod(xxhash64(unit), {max(1, n_units // 256)}) else xxhash64(unit, bi, bj) end"))
    near = split.join(codes, "cls").select("task", "unit", "bi", "bj", "blk", "cls", "codes", "d", "l").groupBy("task").applyInPandas(_compared(bands), "cls long, d long, l long")
    near = near.groupBy("cls").agg(F.min(F.struct("d", "l")).alias("other"))
    first = lines.join(near, "cls", "left").select(F.col("cls").alias("h1"), "h2", "n", F.struct("d", "l").alias("own"), "other")
    first = first.withColumn("earliest", F.least("own", F.coalesce("other", "own"))).filter("n > 1 or earliest < own")
    first = per_key(first.select("h1", "h2", F.col("earliest.d").alias("first_d"), F.col("earliest.l").alias("first_l")), "op10first")
    hit = occ.select("doc_id", "content", "line", "h1", "h2").join(first, ["h1", "h2"])
    return hit.filter("doc_id > first_d or doc_id = first_d and line > first_l").select("doc_id", "content", "line").distinct()


def without_repeated_lines(docs: DataFrame, bands=BANDS, count: str = "n_removed") -> DataFrame:
    """``docs`` with the lines of :func:`removed_lines` taken out of ``text``, and their number in ``count``
    (long; a column of that name is replaced).  A null text stays null; all other columns are kept."""
    docs = docs.drop(count)
    gone = removed_lines(docs, bands).groupBy(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).agg(F.collect_list("line").alias("__gone"))
    gone = materialize(gone, "op10gone")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col("__id")) & (F.xxhash64("text") == F.col("__content"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    ids = small(gone.select("__id", "__content"))
    dirty = docs.filter("text is not null").join(ids, same, "left_semi").join(small(gone), same)
    dirty = dirty.drop("__id", "__content").mapInArrow(_rebuilt(count), f"{fields}, text string, `{count}` long")
    clean = docs.join(ids, same & F.col("text").isNotNull(), "left_anti").withColumn(count, F.lit(0).cast("long"))
    return clean.unionByName(dirty.select(clean.columns))


def digest(docs: DataFrame, bands=BANDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read): doc_id, ``n_removed``
    lines, ``kept_sha256`` of the text that is left.  A null or empty text has no lines and an empty rest;
    null ids stay null and repeated rows are rows of their own, judged as :func:`removed_lines` says."""
    out = without_repeated_lines(docs.select("doc_id", "text"), bands)
    return out.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
