"""Cutting lineage with tables in the shared folder, and joins that broadcast only what is small.

An iterative job, or one that reads an intermediate result several times, writes it as Parquet under
the folder that ``spark.checkpoint.dir`` names.  Every executor sees that folder, so a lost executor
costs a re-read, never a recomputation of the whole chain.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it was measured and takes at most so many bytes.
BROADCAST_BYTES = 64 << 20


#: Independent jobs that are submitted at a time; Spark fills idle executors with the tasks of all of them.
AT_ONCE = 4
A, B = TypeVar("A"), TypeVar("B")


def at_once(job: Callable[[A], B], of: Iterable[A]) -> list[B]:
    """``job`` of each, in order.  Iterative jobs wait for the driver between their rounds; submitted together,
    independent ones fill each other's gaps."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(job, of))


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder.  Where none is named, a local session gets a folder of its own, and a
    cluster, whose machines would not see such a folder, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tenderlens-stage-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tag: str = "t", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with ``options`` of Parquet's writer, and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, tag: str = "t") -> DataFrame:
    """``df`` as a table in the shared folder, a file for each bucket of ``key``, in its order.  Tables of as many buckets
    are joined, and grouped, by that key where they lie, without a shuffle or a sort."""
    spark = df.sparkSession
    one = uuid.uuid4().hex
    name = f"{tag}_{one}"
    out = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    out.option("path", f"{shared_dir(spark)}/{tag}-{one}").saveAsTable(name, format="parquet")
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize` that no later read needs."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = shared_dir(spark).split(":", 1)[-1].rstrip("/")
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def measured_bytes(df: DataFrame, rows: int | None = None) -> int:
    """Bytes that a broadcast table of ``df`` takes, about: 48 a row, 8 a field, and what its strings and
    lists hold.  ``rows``, if known, saves the job where all fields are of fixed size."""
    size = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StringType, T.BinaryType)):
            size.append(F.coalesce(F.aggregate(f.name, F.lit(0).cast("long"), lambda n, x: n + 48 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            width = 8 * (2 + len(f.dataType.elementType.fields)) if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) else 48
            size.append(F.greatest(F.size(f.name), F.lit(0)) * width)
    fixed = 48 + 8 * len(df.schema)
    if not size and rows is not None:
        return rows * fixed
    return df.agg(F.coalesce(F.sum(sum(size, F.lit(fixed)).cast("long")), F.lit(0))).first()[0]


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes stay within ``limit``; else ``df`` itself, which
    Spark then joins by shuffling."""
    return F.broadcast(df) if measured_bytes(df, rows) <= limit else df


def per_key(df: DataFrame, tag: str = "key", limit: int = BROADCAST_BYTES) -> DataFrame:
    """An aggregate that rows are to be joined with, as a table of its own.  Planned in one query with the
    rows, the join would read the aggregate's own partitions, and adaptive execution splits a partition of
    a join only if both of its sides are plain reads: so a hot key would stay in one task."""
    return small(materialize(df, tag), limit=limit)
