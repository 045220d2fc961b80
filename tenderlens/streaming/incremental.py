"""Bundles upserted as they land: Structured Streaming over JSON files, into a table of key buckets.

A batch writes only what it brings: its rows, folded by key, as a delta of the buckets that they fall into.
Readers merge a bucket with its deltas; a bucket that has gathered some is compacted, alone.  A manifest a
batch, one row for each bucket, says which files are the table; it is written last, so a batch is there as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderlens.operators.ingest import last_non_null

#: Buckets of a table, and the deltas of a bucket that start its compaction.  Buckets are for a table's life.
BUCKETS, COMPACT_AFTER = 64, 4
MANIFEST = "bucket int, base long, deltas array<long>"


def stream_bundles(spark: SparkSession, path: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """New JSON files of a folder, with a declared schema and a bounded batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str, part: str) -> list[int]:
    """Numbers of the batches that have written a part of the table and committed it."""
    path, fs = _files(spark, root)
    base = path(f"{root}/{part}")
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return sorted(int(n[1:]) for n in names if fs.exists(path(f"{root}/{part}/{n}/_SUCCESS")))


def _at(root: str, part: str, number: int) -> str:
    return f"{root}/{part}/v{number:012d}"


def manifest(spark: SparkSession, root: str, before: int | None = None) -> list[tuple[int, int | None, list[int]]]:
    """(bucket, base, deltas) of the latest batch, or of the latest before one; a row for each bucket in use."""
    done = [n for n in _versions(spark, root, "manifest") if before is None or n < before]
    if not done:
        return []
    return [(r["bucket"], r["base"], list(r["deltas"])) for r in spark.read.schema(MANIFEST).parquet(_at(root, "manifest", done[-1])).collect()]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _merged(spark: SparkSession, root: str, schema: str, keys: list[str], rows: list[tuple[int, int | None, list[int]]]) -> DataFrame:
    """The rows of some buckets.  Those without a delta are read as they are; of the others a property is that of
    the latest batch that has one."""
    empty = spark.createDataFrame([], schema)
    parts = lambda part, number, buckets: spark.read.schema(schema).parquet(*[f"{_at(root, part, number)}/bucket={b}" for b in buckets])

    def read(part: str, wanted: list[tuple[int, int]]) -> DataFrame | None:
        out = None
        for number in sorted({n for _, n in wanted}):
            rows = parts(part, number, [b for b, n in wanted if n == number]).withColumn("__v", F.lit(number).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    still = read("base", [(b, base) for b, base, deltas in rows if base is not None and not deltas])
    old = read("base", [(b, base) for b, base, deltas in rows if base is not None and deltas])
    new = read("delta", [(b, n) for b, _, deltas in rows for n in deltas])
    out = empty if still is None else still.drop("__v")
    if new is not None:
        both = new if old is None else new.unionByName(old)
        cols = [c for c in empty.columns if c not in keys]
        out = out.unionByName(both.groupBy(*keys).agg(*(last_non_null(c, "__v").alias(c) for c in cols)).select(*empty.columns))
    return out


def current(spark: SparkSession, root: str, schema: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The table as the latest batch left it (or the latest before one).  Before the first there are no rows."""
    return _merged(spark, root, schema, keys, manifest(spark, root, before))


def _drop_unused(spark: SparkSession, root: str, number: int, keep: list[list[tuple[int, int | None, list[int]]]]) -> None:
    """Delete the buckets of versions up to ``number`` that no manifest kept needs, and older manifests."""
    used = {("base", base, b) for rows in keep for b, base, _ in rows if base is not None} | {("delta", n, b) for rows in keep for b, _, deltas in rows for n in deltas}
    path, fs = _files(spark, root)
    for part in ("base", "delta"):
        for n in _versions(spark, root, part):
            own = [s.getPath() for s in fs.listStatus(path(_at(root, part, n))) if s.getPath().getName().startswith("bucket=")] if n <= number else []
            gone = [p for p in own if (part, n, int(p.getName()[7:])) not in used]
            if own and len(gone) == len(own):
                fs.delete(path(_at(root, part, n)), True)
            else:
                for p in gone:
                    fs.delete(p, True)
    for n in _versions(spark, root, "manifest")[:-2]:
        fs.delete(path(_at(root, "manifest", n)), True)


def incremental_ingest(bundles: DataFrame, root: str, keys: list[str], checkpoint: str, seq: str = "seq", buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Upsert each micro-batch into the table under ``root``: of a property the last value that is not null wins,
    by batch and then by ``seq``.  Files are named by the batch, so one that runs again after a failure writes the
    same files from the manifest before it.  Files of the last two manifests stay, for readers under way."""
    fields = [f for f in bundles.schema if f.name != seq]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    cols = [f.name for f in fields if f.name not in keys]

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folded = batch.groupBy(*keys).agg(*(last_non_null(c, seq).alias(c) for c in cols)).withColumn("bucket", _bucket(keys, buckets))
        folded.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_at(root, "delta", number))
        path, fs = _files(spark, root)
        touched = {int(s.getPath().getName()[7:]) for s in fs.listStatus(path(_at(root, "delta", number))) if s.getPath().getName().startswith("bucket=")}
        before = manifest(spark, root, number)
        rows = {b: (base, [*deltas, number] if b in touched else deltas) for b, base, deltas in before} | {b: (None, [number]) for b in touched - {b for b, _, _ in before}}
        full = sorted(b for b, (_, deltas) in rows.items() if len(deltas) >= compact_after)
        if full:
            whole = _merged(spark, root, schema, keys, [(b, *rows[b]) for b in full]).withColumn("bucket", _bucket(keys, buckets))
            whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_at(root, "base", number))
            rows |= {b: (number, []) for b in full}
        now = [(b, base, deltas) for b, (base, deltas) in sorted(rows.items())]
        spark.createDataFrame(now, MANIFEST).coalesce(1).write.mode("overwrite").parquet(_at(root, "manifest", number))
        _drop_unused(spark, root, number, [before, now])

    return bundles.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
