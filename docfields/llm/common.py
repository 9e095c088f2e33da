"""Helpers shared by the corpus operators: shared storage, hashing, ranks, components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Word characters of the corpus contracts: everything but space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (tests, a laptop) a temporary folder of this process is used instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    own = sc.getCheckpointDir()
    if own is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docfields-"))
        own = sc.getCheckpointDir()
    return own.rstrip("/")


def materialize(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage the way ``checkpoint()`` does, but in one pass, in columns and with
    statistics; a lost executor costs only its unfinished tasks.  Tables that are ``small``
    beside the input (links, pairs, ids) are dealt evenly to a sixteenth of the shuffle
    partitions first, so that a wide cluster does not write thousands of tiny files.
    The write's own shuffles are deleted as soon as it ends: nothing can read them again.
    """
    if small:
        df = df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan needs any more.

    Spark deletes them when the driver's JVM finds their plans unreachable, and a driver with little to
    do may not look for a long time; the executors' disks fill meanwhile.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()


def contracted(edges: DataFrame, room: int = 1 << 22) -> DataFrame:
    """(u, v): the components that edges (u, v) of one partition make by themselves, as stars around their least vertices.

    After every ``room`` edges the stars so far are what goes on, so a partition of any size fits.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def stars(parts):
            names, at = np.unique(np.concatenate(parts), return_inverse=True)
            a, b = at.reshape(-1, 2).T
            root = forest(a, b, len(names))
            out = np.flatnonzero(root != np.arange(len(names)))
            return np.stack((names[out], names[root[out]]), axis=1)

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1))
            size += len(batch)
            if size > room:
                held = [stars(held)]
                if len(held[0]) * 2 > room:  # they hold together already
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][:, k].copy()) for k in (0, 1)], names=["u", "v"])
                    held = []
                size = sum(map(len, held))
        if size:
            last = stars(held)
            yield pa.RecordBatch.from_arrays([pa.array(last[:, k].copy()) for k in (0, 1)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def forest(a, b, n: int):
    """Smallest index reachable from every index 0..n-1 by the links (a, b)."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def boxed(df: DataFrame, **own: Column) -> DataFrame:
    """``df`` as one struct column ``doc`` beside columns of our own, whose names then cannot clash with its."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("doc"), *[c.alias(name) for name, c in own.items()])


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The fields ``columns`` of ``doc``; ``new`` ones replace those of their name or follow."""
    kept = [new.get(c, F.col("doc").getField(c)).alias(c) for c in columns]
    return df.select(*kept, *[c.alias(name) for name, c in new.items() if name not in columns])


def trim() -> None:
    """Give memory that this worker process has freed back to the system; it stays around for other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def buckets_for(rows: int) -> int:
    """About the square root of ``rows``, as a power of two.

    Two-level ranks and running sums then see groups and group tables that both grow
    with the square root of the input.
    """
    return 1 << max(0, math.ceil(math.log2(max(1, rows)) / 2))


def per_process(slot: str, make, key: str = ""):
    """``make()``, kept by this Python process for further tasks, until another slot or key is asked for."""
    import sys
    import types

    kept = sys.modules.setdefault("_docfields_kept", types.ModuleType("_docfields_kept")).__dict__
    if kept.get("name") != (slot, key):
        kept["value"] = None  # freed before its successor is made
        kept["value"] = make()
        kept["name"] = (slot, key)
    return kept["value"]


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` written once, and marked for broadcasting if it has at most ``most`` rows; else joined by sorting."""
    df = materialize(df, "small", small=True)
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def bucket(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def two_level_rank(df: DataFrame, key: str, rows: int, order: list[str], name: str = "rank") -> DataFrame:
    """``name`` = 0-based rank of every row in its ``key`` group, for groups of any size.

    Rows of one key spread over hash buckets; a row's rank is the number of its key's
    rows in lower buckets plus its rank inside its own bucket, so no task ever holds a
    whole hot key.  ``order`` must be columns that also feed the bucket hash.
    """
    n = buckets_for(rows)
    df = df.withColumn("_b", bucket(n, *[F.col(c) for c in order]))
    counts = df.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(key, "_b").orderBy(*order)) - 1
    return (
        df.withColumn("_in", inside)
        .join(counts, [key, "_b"])
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_b", "_in", "_before")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component_id) per vertex that has an edge.

    ``component_id`` is the smallest reachable id.  Every partition first replaces its edges by
    the stars they make; then alternating large-star and small-star rounds, each two shuffles of the
    shrinking edge table.  Hot vertices are pre-aggregated by ``min`` and never collected, and the
    number of rounds grows with the logarithm of the component size.  Each round is written to
    the shared folder; a round that changes nothing is the last.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        few = df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))
        seen = Observation()
        new = materialize(contracted(few).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        return new, (seen.get["n"], seen.get["h"])

    cur, last = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        if not last[0]:
            break
        # large star: every larger neighbour of u links to the smallest of u and its neighbours
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        ).distinct()
        # small star: u and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        new, sign = written(small)
        drop_written(cur)
        cur = new
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )


def segments(column, limit: int = 1 << 20):
    """(first row, last row, bytes, starts, ends) of runs of whole rows of an Arrow string column, about ``limit`` bytes each.

    A null row is empty.  ``starts`` and ``ends`` count from the first byte of the segment.
    """
    import numpy as np
    import pyarrow as pa

    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    edge = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + limit, side="right")) - 1)
        yield first, last, whole[edge[first] : edge[last]], edge[first:last] - edge[first], edge[first + 1 : last + 1] - edge[first]
        first = last
