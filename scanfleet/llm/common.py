"""Helpers of the training-data operators: columns, ranks without a single task, Arrow buffers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfleet.session import scratch_path

#: The six ASCII white-space bytes that separate words, ``[^\x20\x09-\x0D]+``.
WHITE = b" \t\n\x0b\x0c\r"
#: Rows that one task may sort when a rank is split into buckets.
RANK_ROWS = 250_000


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an output column is about to replace."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so its lineage is cut."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most ``n`` rows for what is run inside, where a row may hold a whole text's worth of bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 5 (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def rank_bits(rows: int) -> int:
    return max(4, min(24, math.ceil(math.log2(max(rows, 1) / RANK_ROWS + 1)) + 3))


def rank_within(df: DataFrame, keys: Sequence[str], order: str, rows: int, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """Zero-based rank of ``order`` (a uniform 64-bit hash) inside ``keys``, whatever a key's size.

    The hash's top bits deal each key's rows into buckets that a task can sort; bucket sizes,
    summed once, give every bucket its first rank. Null keys form a group of their own.
    """
    bits = rank_bits(rows)
    keyed = df.withColumn("__bucket", F.shiftrightunsigned(F.col(order), 64 - bits))
    names = [*keys, "__bucket"]
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(*names).agg(F.count("*").alias("__n"))
    first = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    first = first.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], "__base")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]
    inner = Window.partitionBy(*names).orderBy(order, *ties)
    ranked = keyed.withColumn("__row", F.row_number().over(inner))
    joined = ranked.join(first, same, "left").withColumn(out, (F.col("__row") - 1 + F.col("__base")).cast("long"))
    return joined.drop("__bucket", "__row", "__base", *[f"__k{i}" for i in range(len(names))])


def rank_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, label: str) -> DataFrame:
    """``df`` with the zero-based rank ``out`` of each row inside ``keys`` by ``order`` (nulls first, then ascending).

    Rows are range-partitioned by keys and order and written once, so a key of any size is spread
    over many ranges; the counts of the ranges give each its first rank. Null keys form one group.
    """
    names = [*keys, "__part"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    dealt = stored(df.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), label)
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*names).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    first = sizes.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], "__base")
    inner = Window.partitionBy(*names).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = dealt.withColumn("__row", F.row_number().over(inner))
    joined = ranked.join(first, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)])
    joined = joined.withColumn(out, (F.col("__row") - 1 + F.col("__base")).cast("long"))
    return joined.drop("__part", "__row", "__base", *[f"__k{i}" for i in range(len(names))])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and ``n + 1`` offsets into them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        _, offsets, _ = sizes.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end
