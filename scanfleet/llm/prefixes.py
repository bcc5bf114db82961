"""Exact links between shingle sets of different groups, by prefixes of their rarest shingles.

Two sets with a Jaccard of at least ``least`` share one of the first shingles of each in any common
order: with ``m <= n`` members they have ``least / (1 + least) * (m + n)`` in common, so the smaller
can be looked up by its first ``m - ceil(2 * least / (1 + least) * m) + 1`` and the larger by its first
``n - ceil(least * n) + 1``. Rare shingles come first, so texts that share only a template, too short
to link them, hardly meet. Frequencies are counted over all sets in a table of fixed size; shingles
that fall on one place of it only share an order, which costs time and no link.

Every prefix row carries a bitmap of its whole set, where a bit is the parity of the shingles that fall
on it. Two bitmaps differ in at most as many bits as the sets do in shingles, so a pair whose bitmaps differ
too much is dropped where it meets, before any set is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the frequency table: what is broadcast is one byte for each.
PLACES_BITS = 18
#: Words of 64 bits in a set's bitmap.
MAP_WORDS = 16
MAP = [f"m{i}" for i in range(MAP_WORDS)]


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def alike(x: np.ndarray, y: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sorted sets have a Jaccard of at least the fraction ``least``, in whole numbers; empty ones are like nothing."""
    if not len(x) or not len(y) or least[1] * min(len(x), len(y)) < least[0] * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return least[1] * both >= least[0] * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose whole sets (``node, shingles``) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            keep = pa.array([alike(unpacked(x), unpacked(y), least) for x, y in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _place(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - PLACES_BITS)).astype(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """The bitmap of a set."""
    bits = np.bincount((found & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def levels(sets: DataFrame) -> np.ndarray:
    """The logarithm of how many shingles of all sets fall on each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PLACES_BITS, np.int64)
        for batch in batches:
            for raw in batch.column("shingles").to_pylist():
                np.add.at(total, _place(unpacked(raw)), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["place", "n"])

    counted = sets.select("shingles").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most one row for each place
    out = np.zeros(1 << PLACES_BITS, np.uint8)
    out[table.column("place").to_numpy()] = np.log2(table.column("n").to_numpy()) * 6 + 1
    return out


def crossing(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Distinct pairs ``a, b`` of nodes with different ``label`` that may be alike: no pair that is alike is missing.

    ``sets`` has ``node, label, shingles``. Pairs of one label are never made.
    """
    order = sets.sparkSession.sparkContext.broadcast(levels(sets))
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, label, raw in zip(*[batch.column(c).to_pylist() for c in ("node", "label", "shingles")], strict=True):
                found = unpacked(raw)
                n = len(found)
                if not n:
                    continue
                probe, index = n - -(-p * n // q) + 1, n - -(-2 * p * n // (p + q)) + 1
                first = found[np.lexsort((found, order.value[_place(found)]))[:probe]]
                at = np.arange(len(first))
                whole = [np.full(len(first), v) for v in (node, label, *parities(found))]
                out.append((first.view(np.int64), np.full(len(first), n, np.int32), at.astype(np.int32), at < index, *whole))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    names = ["shingle", "n", "at", "indexed", "node", "label", *MAP]
    rows = sets.mapInArrow(run, "shingle long, n int, at int, indexed boolean, node long, label long, " + ", ".join(f"{m} long" for m in MAP))
    mixed = rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("indexed").alias("any")).filter("lo <> hi and any").select("shingle")
    rows = rows.join(mixed, "shingle", "left_semi")
    held = ("node", "label", "n", "at", *MAP)
    x = rows.filter("indexed").select("shingle", *[F.col(c).alias(f"x_{c}") for c in held])
    y = rows.select("shingle", *[F.col(c).alias(f"y_{c}") for c in held])
    met = x.join(y, "shingle").filter(f"x_label <> y_label and x_n <= y_n and {q} * x_n >= {p} * y_n")
    # At most this many of them can still be shared, before and after the one they met at.
    most = F.least("x_at", "y_at") + 1 + F.least(F.col("x_n") - F.col("x_at") - 1, F.col("y_n") - F.col("y_at") - 1)
    met = met.filter((p + q) * most >= p * (F.col("x_n") + F.col("y_n")))
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in MAP])
    met = met.filter((p + q) * (F.col("x_n") + F.col("y_n") - apart) >= 2 * p * (F.col("x_n") + F.col("y_n")))
    return met.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()
