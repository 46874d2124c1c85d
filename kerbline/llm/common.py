"""Helpers that the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import kerbline
from kerbline.session import store

#: A set of ids or rows is broadcast up to this many (a few dozen MB as a hash table).
BROADCAST_IDS = 1_000_000
#: Rows, and about how many bytes, a task turns into Python values at a time.
SLICE_ROWS = 1_000
SLICE_BYTES = 8 << 20
#: Spark's limit for a batch on its way to a Python worker. Its own is ten thousand rows or far more bytes, which the JVM
#: holds outside its heap and the worker beside its slices, once per running task.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key is hot when it holds more than one in this many rows.
HOT_SHARE = 1_000


#: A table written once as Parquet below the shared folder and read back: that cuts the lineage and survives lost executors.
stored = store


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not find it by path; once per application."""
    _ship(spark.sparkContext.applicationId, spark.sparkContext)


@cache
def _ship(_application: str, context) -> None:
    top = os.path.dirname(os.path.abspath(kerbline.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="kerbline-package-"), "kerbline.zip")
    with zipfile.ZipFile(archive, "w") as package:
        for folder, _, names in os.walk(top):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                package.write(path, os.path.join("kerbline", os.path.relpath(path, top)))
    context.addPyFile(archive)


def bound_batches(spark: SparkSession) -> None:
    """Hold batches to ``SLICE_BYTES``, unless the session has a limit of its own; a longer row is a batch by itself."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(SLICE_BYTES))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch within both limits; a row beyond them is a part of its own."""
    if batch.num_rows > 1 and (batch.num_rows > SLICE_ROWS or batch.nbytes > SLICE_BYTES):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def map_arrow(
    df: DataFrame,
    inputs: list[str],
    keep: Iterable[str],
    added: list[T.StructField],
    work: Callable[[], Callable[..., list[pa.Array]]],
) -> DataFrame:
    """Columns ``keep`` of ``df`` and the columns ``added``, worked out batch by batch in tasks.

    ``work()`` runs once per task and returns a function from the arrays of ``inputs`` to the arrays of
    ``added``. Rows are neither dropped nor moved.
    """
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    keep = list(keep)
    needed = list(dict.fromkeys([*keep, *inputs]))
    schema = T.StructType([*(df.schema[name] for name in keep), *added])
    names = [field.name for field in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in (part for whole in batches for part in slices(whole)):
            made = compute(*(batch.column(needed.index(name)) for name in inputs))
            yield pa.RecordBatch.from_arrays([*(batch.column(needed.index(name)) for name in keep), *made], names=names)
        # A worker serves many tasks: what this one held must not count beside the next one's.
        pa.default_memory_pool().release_unused()

    return df.select(*(df[f"`{name}`"] for name in needed)).mapInArrow(run, schema)


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and, in ``name``, what tells its rows apart even if they are equal: the file and the place in it.

    The rows of a Parquet scan have both by themselves. Anything else is stored first, so that the same row has the
    same place whenever it is read.
    """
    if not _is_scan(docs):
        docs = stored(docs, "rows")
    place = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")))


def _is_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is a row of a Parquet file: a scan, with columns chosen or rows filtered at most."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.simpleString(1_000).lower()


def without_rows(docs: DataFrame, dropped: DataFrame, row_col: str) -> DataFrame:
    """Rows of ``docs`` (a result of ``with_row``) but those whose ``row_col`` is the column ``row`` of ``dropped``.

    ``dropped`` has to be a stored table. It is broadcast when it has at most ``BROADCAST_IDS`` rows;
    beyond that the join shuffles both sides.
    """
    gone = dropped.select(F.col("row").alias("__gone"))
    if dropped.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[row_col] == gone["__gone"], "left_anti").drop(row_col)


def join_hot(rows: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` to ``dim``, which has one row per key; keys are not null.

    Keys that hold more than one in ``HOT_SHARE`` of the rows, so at most that many, are looked up by broadcast; the
    others are shuffled. ``rows`` is read three times and has to be a stored table.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__rows"))
    total = rows.count()
    hot = counts.where(F.col("__rows") * HOT_SHARE > total).select(*keys).collect() if total > HOT_SHARE else []
    return _split_join(rows, dim, keys, hot)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int | None = None) -> DataFrame:
    """``join_hot`` where ``groups`` says itself in ``size_col`` how many of ``rows`` hold its key.

    ``total`` is the number of rows, where it is known.
    """
    if total is None:
        total = groups.agg(F.sum(size_col)).first()[0] or 0
    hot = groups.where(F.col(size_col) * HOT_SHARE > total).select(*keys).collect() if total > HOT_SHARE else []
    return _split_join(rows, groups, keys, hot)


def _split_join(rows: DataFrame, dim: DataFrame, keys: list[str], hot: list) -> DataFrame:
    """The join in two parts, told apart by the hash of the key: a key that shares its hash with a hot one counts as hot."""
    if not hot:
        return rows.join(dim, keys)
    schema = T.StructType([rows.schema[key] for key in keys])
    known = rows.sparkSession.createDataFrame(hot, schema).select(F.xxhash64(*keys).alias("hash"))
    is_hot = F.xxhash64(*keys).isin([row.hash for row in known.collect()])
    by_broadcast = rows.where(is_hot).join(F.broadcast(dim.where(is_hot)), keys)
    return by_broadcast.unionByName(rows.where(~is_hot).join(dim.where(~is_hot), keys))
