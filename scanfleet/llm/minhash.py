"""MinHash near-duplicates: many universal hash minima, banding, verified signatures, star components.

Equal shingle sets are one node. ``BANDS`` keys of ``ROWS`` minima deal the nodes into buckets; a pair at
Jaccard 0.8 shares one with probability ``1 - (1 - 0.8 ** ROWS) ** BANDS``, all but 2 in ten million.
Every row of a bucket is paired with its smallest node, and all rows of a bucket of at most ``SMALL``
with each other. A pair goes on if its signatures (a byte of each minimum) agree as often as 0.8 makes them
at seven standard deviations below the mean, and is a link only if the whole sets say so.

A larger bucket is never paired within itself. Where its links to the smallest node do not make it one
component, its nodes go through ``prefixes.crossing``, which loses no link between different components
and makes no pair inside one. Components are found by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfleet.llm import common, prefixes, simhash

#: Words of a shingle; least Jaccard as a fraction; keys of a set and minima in each.
WORDS, LEAST, BANDS, ROWS = 2, (4, 5), 40, 5
#: Most rows of a bucket that are all paired; least equal bytes of two signatures.
SMALL, EQUAL = 12, 120
#: Rows with whole sets that a worker holds at once.
SETS = 500


def _factors(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"%d" % i, seed) for i in range(n)], np.uint64)


#: Multiply-add families: the upper half of ``a * x + b`` modulo 2 ** 64 is universal.
TIMES, PLUS = _factors(BANDS * ROWS, 11) | np.uint64(1), _factors(BANDS * ROWS, 12)
MIX, STEP, HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> HALF)) * MIX
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> HALF)


def shingles(text: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; all words are one run where there are fewer.

    ``known`` keeps word hashes between calls and is emptied by the caller. Hashes of a run are made from
    those of its words in order.
    """
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    for t in set(tokens):
        if t not in known:
            known[t] = xxhash.xxh64_intdigest(t, 42)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(tokens))
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = _mixed(out * STEP + h[i : len(h) - k + 1 + i])
    return np.unique(_mixed(out))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, 32 bits each."""
    least = np.full(len(TIMES), ~np.uint64(0))
    for at in range(0, len(found), 512):
        part = found[at : at + 512, None] * TIMES
        part += PLUS
        np.minimum(least, part.min(axis=0), out=least)
    return least >> HALF


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mixed(keys * STEP + rows[:, i])
    return keys.view(np.int64)


def shingle_sets_of(batch: pa.RecordBatch, words: int, known: dict[bytes, int]) -> list[np.ndarray]:
    """:func:`shingles` of every text of a batch; the memory of word hashes is bounded."""
    if len(known) > 200_000:
        known.clear()
    return [shingles(t, words, known) for t in batch.column("text").to_pylist()]


def described(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, digest, n_shingles, keys, signature`` of every row with words (equal sets: equal digests), nulls without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in common.small_batches(batches, "text"):
            sets = shingle_sets_of(batch, words, known)
            least = [minima(s) if len(s) else None for s in sets]
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            keys = pa.array([None if m is None else band_keys(m) for m in least], pa.list_(pa.int64()))
            signature = pa.array([None if m is None else m.astype(np.uint8).tobytes() for m in least], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), digest, pa.array([len(s) for s in sets], pa.int64()), keys, signature], names=["doc_id", "digest", "n_shingles", "keys", "signature"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "doc_id long, digest binary, n_shingles long, keys array<long>, signature binary")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, shingles`` (hashes as bytes) of ``docs``, whose ids name the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in common.small_batches(batches, "text"):
            sets = pa.array([s.tobytes() for s in shingle_sets_of(batch, words, known)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], names=["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, shingles binary").dropDuplicates()


def buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, least, n`` for the rows of buckets that hold more than one node, with their smallest and number."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(shared, "key")


def paired(dealt: DataFrame) -> DataFrame:
    """Distinct pairs ``a > b`` to test, with ``star`` true where ``b`` is the smallest node of one of their buckets."""
    stars = dealt.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"), F.lit(True).alias("star"))
    few = dealt.filter((F.col("n") > 2) & (F.col("n") <= SMALL)).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("held"))
    each = few.select("held", F.posexplode("held").alias("i", "b")).select("b", F.explode(F.slice("held", F.col("i") + 2, F.lit(SMALL))).alias("a"))
    rows = stars.unionByName(each.filter("a <> b").select("a", "b", F.lit(False).alias("star")))
    return rows.groupBy("a", "b").agg(F.max("star").alias("star"))


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` whose signatures agree in at least ``EQUAL`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            yield batch.select(["a", "b", "star"]).filter(pa.array((x == y).sum(axis=1) >= EQUAL))

    x = nodes.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "star", "x", "y").mapInArrow(run, "a long, b long, star boolean")


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each one's component so far."""
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("label"))


def asked(dealt: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id`` of the nodes whose sets a link may need."""
    crowded = dealt.filter(F.col("n") > SMALL).select(F.col("node").alias("doc_id"))
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(crowded).distinct()


def linked(nodes: DataFrame, dealt: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, root`` of the components that links between ``nodes`` make, confirmed on whole ``sets``.

    First the links to the smallest of each bucket, then those that may still join two components: other
    pairs of small buckets, and crowded buckets through ``prefixes``.
    """
    spark = nodes.sparkSession
    with common.rows_per_batch(spark, SETS):
        links = common.stored(prefixes.verified(pairs.filter("star"), sets, LEAST), "links")
    label = common.stored(labelled(nodes.select("node").distinct(), simhash.components(links)), "labels")
    a, b = (label.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
    rest = pairs.filter("not star").join(a, "a").join(b, "b").filter("of_a <> of_b")
    mixed = dealt.filter(F.col("n") > SMALL).select("key", "node").join(label, "node")
    torn = mixed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    dense = mixed.join(torn, "key", "left_semi").select("node").distinct()
    dense = common.stored(sets.join(dense, "node", "left_semi").join(label, "node"), "dense")
    with common.rows_per_batch(spark, SETS):
        rest = common.stored(rest.select("a", "b").unionByName(prefixes.crossing(dense, LEAST)).distinct(), "crossing")
        more = common.stored(prefixes.verified(rest, sets, LEAST), "links")
    return simhash.components(links.unionByName(more))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the smallest id that links reach) for every row of ``docs``.

    Null, empty and blank texts have no shingles and are linked with nothing. Copies are one node from
    the start; repeated rows stay repeated. Rows that share an id are linked as one document is. A row
    without an id takes part in no link and has no component. Very long texts are taken whole, one
    at a time. An empty table gives an empty result; columns besides ``doc_id`` and ``text`` are not read.
    """
    made = common.stored(described(docs, words), "minhash")
    known = made.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    chosen = known.join(firsts, (known["digest"] == firsts["digest"]) & (known["doc_id"] == firsts["node"]), "left_semi")
    nodes = common.stored(chosen.select(F.col("doc_id").alias("node"), "keys", "signature").dropDuplicates(["node", "signature"]), "nodes")
    dealt = common.stored(buckets(nodes), "buckets")
    pairs = common.stored(promising(paired(dealt), nodes), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked(dealt, pairs), "doc_id", "left_semi")
    sets = common.stored(shingle_sets(texts, words), "sets")
    found = linked(nodes, dealt, pairs, sets)
    label = labelled(firsts, found).distinct()
    named = known.select("doc_id", "digest").distinct().join(firsts, "digest").join(label, "node")
    named = named.groupBy("doc_id").agg(F.min("label").alias("component_id"))
    own = F.coalesce("component_id", "doc_id").alias("component_id")
    return made.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", own)


def op11(spark: SparkSession, sf: str) -> DataFrame:
    out = near_duplicates(common.documents(spark, sf))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def oracle() -> str:
    """Links of all pairs that share a shingle, and their closure, as DuckDB text."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE worded AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce({lower}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN [w[1]]
  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM worded),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id
    JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id WHERE least(p.n, q.n) * 5 >= greatest(p.n, q.n) * 4
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, k.b FROM reach r JOIN ways k ON k.a = r.b),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, f.component_id, d.doc_id = f.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN found f ON f.a = d.doc_id"""
