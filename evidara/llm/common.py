"""Small helpers of the pipeline operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.session import durable, shuffle_partitions

#: White space of the contracts: space and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column | str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


#: Rows of an Arrow batch whose whole texts are Python strings at once; a batch may have ten thousand.
STRINGS = 256


def in_slices(batches: Iterator, rows: int = STRINGS) -> Iterator:
    """Arrow batches or arrays, a few rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def giving_back(batches: Iterator) -> Iterator:
    """The batches; after the last, what this Python worker has freed goes back to the system.

    Spark keeps a worker for later tasks, so what it held at its peak would count through stages without any Python too.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def global_prefix(df: DataFrame, order: list[Column], size: str) -> tuple[DataFrame, int, int]:
    """Each row's global position and the sum of ``size`` before it, in ``order``.

    Rows are range-partitioned, sorted in their partition and summed as they stream by; then the partitions' totals
    (one row each, the only thing that comes to the driver) are turned into offsets. ``order`` should end in a
    tie-breaker, so that no single key fills a partition. Returns (df with ``position`` and ``before``, rows, total);
    the frame is checkpointed, since a second range sampling could cut elsewhere. Rows that are equal in ``order``
    come in some order of their own.
    """
    spark = df.sparkSession
    kept = df.columns
    # the range bounds are sampled in a pass of their own, which must not repeat the work behind df
    ordered = durable(df).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, T.StructField("local_position", T.LongType()), T.StructField("local_before", T.LongType())])

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = total = 0
        for batch in batches:
            sizes = batch[size].astype("int64")
            batch["local_position"] = range(rows, rows + len(batch))
            batch["local_before"] = total + sizes.cumsum() - sizes
            rows, total = rows + len(batch), total + int(sizes.sum())
            yield batch

    local = durable(ordered.mapInPandas(lambda batches: giving_back(running(batches)), schema))
    totals = local.groupBy("part").agg(F.count("*").alias("rows"), F.sum(size).alias("size")).orderBy("part").collect()
    offsets, rows, total = [], 0, 0
    for one in totals:
        offsets.append((one["part"], rows, total))
        rows, total = rows + one["rows"], total + one["size"]
    # from Arrow: rows given as a list would be read by Python workers of another kind, which each executor keeps beside the others
    columns = zip(*offsets, strict=True) if offsets else ([], [], [])
    names = {"part": pa.int32(), "first_position": pa.int64(), "first_before": pa.int64()}
    table = spark.createDataFrame(pa.table([pa.array(x, kind) for x, kind in zip(columns, names.values(), strict=True)], names=list(names)))
    placed = local.join(F.broadcast(table), "part").select(  # one row for each partition
        *kept, (F.col("local_position") + F.col("first_position")).alias("position"), (F.col("local_before") + F.col("first_before")).alias("before")
    )
    return placed, rows, total
