"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

A uniform permutation cut into equal shards sends a random number of each partition's rows to each
shard; that matrix of counts has a multivariate hypergeometric law. Here it is drawn first (a few
numbers per partition), then every partition permutes its rows and cuts them by its row of the
matrix, rows are exchanged, and each shard permutes what it got. Sizes are exact, no row is looked
at twice, and nothing but counts passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfleet.llm import common

#: Rows of a source partition; the number of partitions follows from the row count.
PARTITION_ROWS = 200_000


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows that go from each partition to each shard; row sums are ``counts``, column sums differ by one at most."""
    total = int(counts.sum())
    left = np.full(shards, total // shards, dtype=np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        matrix[i] = left if int(n) == left.sum() else rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= matrix[i]
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Keys are hashes of all columns: the result does not depend on how Spark happens to cut the
    input, and rows equal in all columns are interchangeable. Nulls hash like any value; an empty
    table gives an empty result; input columns named ``shard`` or ``slot`` are replaced.
    """
    spark = df.sparkSession
    rows = common.without(df, "shard", "slot")
    whole = [F.col(c) for c in rows.columns]
    rows = rows.withColumns(
        {
            "__home": F.xxhash64(F.lit(f"home{seed}"), *whole),
            "__first": F.xxhash64(F.lit(f"first{seed}"), *whole),
            "__second": F.xxhash64(F.lit(f"second{seed}"), *whole),
        }
    )
    total = rows.count()
    parts = max(8, math.ceil(total / PARTITION_ROWS))
    rows = rows.withColumn("__part", F.pmod("__home", F.lit(parts)).cast("int"))
    counts = np.zeros(parts, dtype=np.int64)
    for r in rows.groupBy("__part").count().collect():  # one number per partition
        counts[r[0]] = r[1]
    cuts = _cuts(spark, communication_matrix(counts, shards, seed))
    ranked = common.rank_within(rows, ["__part"], "__first", PARTITION_ROWS, "__rank", ["__second"])
    dealt = (
        ranked.join(cuts, "__part")
        .withColumn("shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__rank"))).cast("int"))
        .drop("__cuts", "__rank", "__part", "__home")
    )
    placed = common.rank_within(dealt, ["shard"], "__second", max(1, total // shards), "slot", ["__first"])
    return placed.drop("__first", "__second")


def _cuts(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """For each partition the ranks at which the next shard begins."""
    cum = matrix.cumsum(axis=1)
    schema = T.StructType(
        [T.StructField("__part", T.IntegerType(), False), T.StructField("__cuts", T.ArrayType(T.LongType(), False), False)]
    )
    return spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(cum)], schema)


def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.documents(spark, sf)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shuffle_into_shards(rows, 40, seed=7)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
