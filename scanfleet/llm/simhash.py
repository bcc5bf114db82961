"""SimHash near-duplicates: BK-trees over blocks of fingerprints, components over their links.

Fingerprints within ``radius`` bits agree on all but ``radius`` of any ``radius + 2`` blocks of
bits, so two whole blocks agree. Each pair of blocks deals the distinct fingerprints into buckets;
inside a bucket a BK-tree (children keyed by their Hamming distance to the parent) is searched
along the edges that the triangle inequality allows. Buckets replace a broadcast of whole trees,
which would grow with the corpus. Copies collapse to one fingerprint first. A bucket hands on one
link per fingerprint to the root of its group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfleet.llm import common
from scanfleet.session import cut

RADIUS = 3
WORDS = 3


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    digest, k = xxhash.xxh64_digest, min(words, len(tokens))
    bits = np.zeros(64, np.int64)
    n = len(tokens) - k + 1
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        part = [digest(line[a : b - 1], 42) for a, b in zip(starts[at : min(n, at + (1 << 15))], ends[at + k - 1 :], strict=False)]
        bits += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every row; null, empty and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            made = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; ``near`` follows only edges within the radius."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            node = 0
            while True:
                d = (self.values[node] ^ value).bit_count()
                if d == 0:
                    return
                after = self.children[node].get(d)
                if after is None:
                    self.children[node][d] = len(self.values)
                    break
                node = after
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[node])
            stack += [n for edge, n in self.children[node].items() if d - radius <= edge <= d + radius]
        return found


def bucket_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its group) for the groups that links within ``radius`` make of a bucket."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = BKTree()
    for v in values:
        root[v] = v
        for other in tree.near(v, radius):
            a, b = find(v), find(other)
            root[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, r) for v in values if (r := find(v)) != v]


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of ``radius + 2`` blocks that make up 64 bits."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a > b`` between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def closed() -> pa.RecordBatch | None:
            if len(held) < 2 or not (found := bucket_links(held, radius)):
                return None
            pairs = np.array(found, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            keys = zip(batch.column("which").to_pylist(), batch.column("key").to_pylist(), strict=True)
            for key, fp in zip(keys, batch.column("fp").to_numpy().view(np.uint64).tolist(), strict=True):
                if key != last:
                    if out := closed():
                        yield out
                    last, held = key, []
                held.append(fp)
        if out := closed():
            yield out

    keys = []
    for i, ((s, m), (t, k)) in enumerate(combinations(blocks(radius), 2)):
        low, high = F.shiftrightunsigned("fp", s).bitwiseAND(m), F.shiftrightunsigned("fp", t).bitwiseAND(k)
        keys.append(F.struct(F.lit(i).alias("which"), (F.shiftleft(high, 32) + low).alias("key")))
    spread = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.which", "k.key", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = spread.repartition(parts, "which", "key").sortWithinPartitions("which", "key", "fp")
    # Sorted unsigned inside a bucket does not matter: the root is the smallest unsigned value.
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each component, by large-star and small-star rounds.

    Each round groups by one end, takes the smallest neighbour with map-side minima, and relinks;
    the round's result is checkpointed. Ends when a round changes nothing (rounds grow with the
    logarithm of the component size).
    """
    now = cut(edges.select("a", "b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = cut(small)
        changed = after.exceptAll(now).limit(1).count() or now.exceptAll(after).limit(1).count()
        now = after
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` (the smallest id that links reach) for every row of ``docs``.

    Null, empty and blank texts have fingerprint 0 and link like any other; repeated rows stay
    repeated; a null id never names a component unless all of a component's ids are null. An empty
    table gives an empty result; other columns are not read.
    """
    made = common.stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp"), radius))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return made.join(label, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with the smallest ``doc_id`` of every near-duplicate group; rows without an id stay."""
    groups = near_duplicates(docs, words, radius)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.filter(F.col("doc_id").isNull()))


def op9(spark: SparkSession, sf: str) -> DataFrame:
    out = near_duplicates(common.documents(spark, sf))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
