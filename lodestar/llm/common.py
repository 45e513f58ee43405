"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt anew where there are fewer partitions than cores (a few large row groups), for work in Python."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a new
    temporary folder is made and set as the checkpoint folder. On a cluster that has none this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known.rstrip("/")
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_MADE = threading.local()


def made() -> list[str]:
    """The scratch paths that this thread has asked for and not dropped."""
    if not hasattr(_MADE, "paths"):
        _MADE.paths = []
    return _MADE.paths


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    made().append(f"{shared_dir(spark)}/lodestar/{tag}-{uuid.uuid4().hex}")
    return made()[-1]


def dropped(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> None:
    """Deletes what this thread wrote to scratch paths from the ``since``th on, but for ``keep``: tables that no later result reads."""
    gone = [p for p in made()[since:] if p not in set(keep)]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)  # type: ignore[union-attr]
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        made().remove(p)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one of so many parts of all rows is heavy; there are fewer heavy keys than this.
HEAVY_PARTS = 500


def join_by_key(left: DataFrame, right: DataFrame, key: str, count: str, spread: Column, total: int) -> DataFrame:
    """``left`` joined (left outer) with ``right``, which has one row per ``key`` and how often left holds it in ``count``.

    A key that holds over ``total / HEAVY_PARTS`` of the rows would land in one task. There are at most
    ``HEAVY_PARTS`` such keys, so their rows are broadcast; every other key goes through a shuffled join, in which no key
    is heavy. Rows of heavy keys are dealt by ``spread``. Columns of ``right`` other than the key and the count follow.
    """
    values = [c for c in right.columns if c not in (key, count)]
    limit = max(1, total // HEAVY_PARTS)
    heavy = right.filter(F.col(count) > limit).select(F.col(key).alias("__hk"), F.struct(*values).alias("__hv"))
    light = right.filter(F.col(count) <= limit).select(F.col(key).alias("__lk"), F.lit("").alias("__ls"), F.struct(*values).alias("__lv"))
    out = left.join(F.broadcast(heavy), left[key] == heavy["__hk"], "left")
    out = out.withColumn("__s", F.when(F.col("__hk").isNull() & F.col(key).isNotNull(), F.lit("")).otherwise(F.concat(F.lit("~"), spread.cast("string"))))
    out = out.join(light, (out[key] == light["__lk"]) & (out["__s"] == light["__ls"]), "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(f"__lv.{v}"), F.col(f"__hv.{v}")))
    return out.drop("__hk", "__hv", "__s", "__lk", "__ls", "__lv")


def inner_by_key(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``key`` and in ``count`` how many of left's ``total`` rows hold it.

    Rows of keys with over ``total / HEAVY_PARTS`` rows (fewer than that many keys) meet right's by broadcast and stay where they are; the others
    are shuffled. ``left`` is evaluated twice, so it should be cheap or written. ``count`` is dropped.
    """
    limit = max(1, total // HEAVY_PARTS)
    heavy = F.broadcast(right.filter(F.col(count) > limit).drop(count))
    light = right.filter(F.col(count) <= limit).drop(count)
    return left.join(heavy, key).unionByName(left.join(heavy.select(key), key, "left_anti").join(light, key))


def row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with __file and __row (longs), which tell its rows apart and are the same each time it is evaluated.

    They come from the files that are scanned. Rows that don't come from files (or were changed by a shuffle) are written first.
    """
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return row_ids(written(docs, "rows"))


ROW = ["__file", "__row"]


@lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def tidy() -> None:
    """Gives memory that a task has freed back to the system, as the worker process stays for the next task."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidied(f: Callable[[Iterable], Iterator], *caches: Callable[[], None]) -> Callable[[Iterable], Iterator]:
    """A function of batches that clears ``caches`` and frees memory at the end of its task."""

    def run(batches: Iterable) -> Iterator:
        try:
            yield from f(batches)
        finally:
            for clear in caches:
                clear()
            tidy()

    return run


def text_udf(f: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], schema: str) -> Callable[[Column], Column]:
    """A function of a text column that only texts are sent to; ``f`` maps arrays of texts to arrays of results.

    Spark must not evaluate it once for a filter and again for the result, so it counts as not deterministic.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from f(batches)
        finally:
            tidy()

    kind = schema if "<" in schema or " " not in schema else f"struct<{schema}>"
    return F.arrow_udf(run, kind).asNondeterministic()


def by_chars(texts: pa.Array, at_once: int) -> Iterator[list[str]]:
    """The texts in order (null as empty) in lists that end when they hold ``at_once`` characters."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= at_once:
            yield part
            part, size = [], 0
    if part:
        yield part


def rechunked(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` (the last one may be shorter), whatever the batches were."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            for a in range(0, n - n % rows, rows):
                yield t.slice(a, rows).combine_chunks().to_batches()[0]
            t = t.slice(n - n % rows).combine_chunks()
            held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str], at_most: int | None = None) -> Iterator[pa.Table]:
    """The groups of rows that agree in ``keys``, from batches that are sorted by them.

    Groups come in order; only the group under way is held. With ``at_most`` a larger group comes in pieces of about so many rows.
    """
    held: list[pa.Table] = []
    n = 0
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last or at_most and n + i - start >= at_most:
                if i > start:
                    held.append(t.slice(start, i - start))
                if held:
                    yield pa.concat_tables(held)
                held, n, start, last = [], 0, i, row
        held.append(t.slice(start))
        n += len(held[-1])
    if held:
        yield pa.concat_tables(held)


def matched(batches: Iterable[pa.RecordBatch], keys: list[str], at_most: int) -> Iterator[tuple[pa.Table, pa.Table, bool]]:
    """(candidates, some queries, whether the candidates are new) of each group, from batches sorted by ``keys`` and ``asks``.

    A group's candidates (asks is false) are held together, its queries come ``at_most`` at a time, so that only candidates need a bound.
    """
    key, docs, table = None, [], None
    for g in grouped(batches, [*keys, "asks"], at_most):
        here = tuple(g[k][0].as_py() for k in keys)
        if here != key:
            key, docs, table = here, [], None
        if not g["asks"][0].as_py():
            docs.append(g)
        elif docs:
            fresh = table is None
            table = pa.concat_tables(docs).combine_chunks() if fresh else table
            yield table, g.combine_chunks(), fresh
