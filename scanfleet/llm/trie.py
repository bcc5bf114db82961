"""Prefix trie of conversations, peeled from its deepest level upwards.

Every conversation is one row: the keys and sizes of its turns in order. The peel starts at the
greatest depth. At each depth the conversations that end there meet the nodes that survive from below:
their last turn is stripped, and regrouping them by what is left gives the nodes of the next depth with
their members, children, leaves and savings summed. Each depth is one shuffle with map-side sums, and the
nodes it finds are written once. Beyond ``SINGLE`` turns few conversations go on; there a round peels as
many depths as hold a bounded number of turns, each task the conversations that agree up to the last of
them. Texts leave the first projection as digests.

The width of a row grows with the longest single conversation, and rounds with its depth or with all turns
of deep conversations; no number of conversations, and no number of members of one node, has to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfleet.llm import common, sqltext

#: Conversations whose ids differ by less share their first turns with the lowest; most turns shared, plus one.
FAMILY, SHARED = 100, 6
#: Depths that are peeled one by one; most turns of a round of several deeper ones.
SINGLE, HELD = 16, 2_000_000
SUMMED = ["n_convs", "n_children", "n_leaves", "below"]
NODES = "key binary, up binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, path array<struct<key:binary,size:bigint>>"
#: Ids that one string of a node's list holds.
LISTED = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, turn_key, size``: original turns, numbered from 0, by digest and code points.

    Null roles and texts are empty. Turns go by ``turn``, null first; equal ones by the digest of
    role and text, so repeated rows are repeated turns. Rows without a ``conv_id`` belong to no
    conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.sha2(named.cast("binary"), 256).alias("turn_key"), F.char_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    return rows.withColumn("at", F.row_number().over(order) - 1).drop("turn")


def shared_turns(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt(original: DataFrame) -> DataFrame:
    """``conv_id, path`` of every conversation; ``path`` is ``array<struct<key, size>>``, empty without turns."""
    ids = original.select("conv_id").distinct().withColumn("h", shared_turns(F.col("conv_id")))
    ids = ids.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = original.filter((F.col("at") < SHARED - 1) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.select(F.col("conv_id").alias("family"), "at", "turn_key", "size")
    taken = ids.join(heads, "family").filter("at < h").select("conv_id", "at", "turn_key", "size")
    own = original.filter(F.col("at") >= shared_turns(F.col("conv_id"))).select("conv_id", "at", "turn_key", "size")
    none = ids.select("conv_id", F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("turn_key"), F.lit(None).cast("long").alias("size"))
    turn = F.when(F.col("at").isNotNull(), F.struct("at", F.unhex("turn_key").alias("key"), "size"))
    held = F.sort_array(F.collect_list(turn))
    rows = taken.unionByName(own).unionByName(none).groupBy("conv_id").agg(held.alias("held"))
    return rows.select("conv_id", F.transform("held", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("path"))


def _prefix_key(key: Column, turn: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(key, turn), 256), 1, 32))


def keyed(rows: DataFrame) -> DataFrame:
    """``path`` with the 128-bit key of each prefix for the key of its last turn; the root's key is empty bytes."""
    first = F.array(F.struct(F.lit(b"").alias("key"), F.lit(0).cast("long").alias("size")))

    def longer(done: Column, t: Column) -> Column:
        return F.concat(done, F.array(F.struct(_prefix_key(F.element_at(done, -1)["key"], t["key"]).alias("key"), t["size"].alias("size"))))

    return rows.withColumn("path", F.aggregate("path", first, longer))


def _ranges(counts: dict[int, int]) -> list[tuple[int, int]]:
    """(lowest, highest) depths of each round, deepest first: single ones up to ``SINGLE``, then as many as hold ``HELD`` turns."""
    out, alive, hi = [], 0, max(counts)
    lo = hi
    while hi > SINGLE:
        alive += counts.get(lo, 0)
        if lo == SINGLE + 1 or (hi - lo + 2) * alive > HELD:
            out.append((lo, hi))
            hi = lo - 1
        lo -= 1
    return out + [(d, d) for d in range(min(hi, SINGLE), -1, -1)]


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth from the conversations that end there and the stripped nodes below it."""
    last = F.element_at("path", -1)
    grouped = rows.withColumn("key", last["key"]).groupBy("key").agg(
        F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMMED]
    )
    nodes = grouped.withColumns({"saved_tokens": F.col("below") + (F.col("n_convs") - 1) * last["size"], "n_leaves": F.greatest("n_leaves", F.lit(1))})
    up = F.try_element_at("path", F.lit(-2))["key"]
    cut = F.slice("path", F.lit(1), F.size("path") - 1)
    return nodes.select("key", up.alias("up"), F.lit(depth).alias("depth"), "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", cut.alias("path"))


def _deep(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """The same for all depths from ``hi`` down to ``lo``: conversations that agree up to ``lo`` are peeled in one task.

    A range holds at most ``HELD`` turns in all, so a task does too. ``path`` is kept for the nodes at ``lo`` alone.
    """
    names = ["key", "up", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ending: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("path", "conv_id", *SUMMED)], strict=True):
                ending.setdefault(len(row[0]) - 1, []).append(row)
        out, up = [], []
        for depth in range(hi, lo - 1, -1):
            nodes: dict[bytes, list] = {}
            for path, conv, *sums in [*ending.get(depth, []), *up]:
                node = nodes.setdefault(path[depth]["key"], [path, conv, 0, 0, 0, 0])
                node[1] = min(node[1], conv)
                for i, v in enumerate(sums):
                    node[2 + i] += v
            up = []
            for key, (path, conv, n, children, leaves, below) in nodes.items():
                saved, leaves = below + (n - 1) * path[depth]["size"], max(leaves, 1)
                out.append((key, path[depth - 1]["key"], depth, conv, n, children, leaves, saved, path[:depth] if depth == lo else None))
                up.append((path, conv, n, 1, leaves, saved))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    path = pa.list_(pa.struct([("key", pa.binary()), ("size", pa.int64())]))
    kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5, path]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("path", "conv_id", *SUMMED).repartition(parts, F.element_at("path", lo + 1)["key"])
    return dealt.mapInArrow(run, NODES)


def peeled(paths: DataFrame, label: str = "trie") -> list[DataFrame]:
    """Tables of nodes, deepest first, from ``conv_id, path`` with prefix keys."""
    sized = paths.withColumn("depth", F.size("path") - 1)
    counts = {r["depth"]: r["n"] for r in sized.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # a row for each length
    found: list[DataFrame] = []
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    stripped: DataFrame | None = None
    for lo, hi in _ranges(counts) if counts else []:
        rows = sized.filter(F.col("depth").between(lo, hi)).select("path", "conv_id", one.alias("n_convs"), *[none.alias(c) for c in SUMMED[1:]])
        rows = rows if stripped is None else rows.unionByName(stripped)
        nodes = common.stored(_level(rows, hi) if lo == hi else _deep(rows, lo, hi), label)
        found.append(nodes)
        stripped = nodes.filter(F.col("depth") == lo).select("path", "conv_id", "n_convs", one.alias("n_children"), "n_leaves", F.col("saved_tokens").alias("below"))
    return found


def listed(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of each node's ids, ascending and comma-joined, from ``key, conv_id``.

    Ids are sorted in ranges of (key, id), joined there to strings of at most ``LISTED`` ids, and a
    node's strings are streamed in order through one digest: the one step that a hash of a list
    leaves to a single task, which holds one string at a time.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ends.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, ids, out, seq = None, 0, [], [], 0

        def close() -> None:
            nonlocal seq
            if ids:
                out.append((last, part, seq, ",".join(map(str, ids))))
                ids.clear()
                seq += 1

        for batch in batches:
            for key, conv, p in zip(*[batch.column(c).to_pylist() for c in ("key", "conv_id", "part")], strict=True):
                if key != last or len(ids) == LISTED:
                    close()
                    last, part = key, p
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "part", "seq", "ids"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "part", "seq", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, hashlib.sha256(), []
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "ends_sha256"])
                out.clear()
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string()]
    strings = cut.mapInArrow(joined, "key binary, part int, seq int, ids string")
    return strings.repartition(parts, "key").sortWithinPartitions("key", "part", "seq").mapInArrow(digests, "key binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns are those of ``conversations`` (``conv_id, turn, role, text``; others are not read). Empty
    texts are turns of no size, repeated rows are repeated turns, very long texts count whole. A
    conversation that no turn is left of is a member of the root. An empty table has no nodes.
    """
    spark = conversations.sparkSession
    original = common.stored(turns(conversations), "turns")
    paths = common.stored(keyed(rebuilt(original)), "paths")
    levels = peeled(paths)
    ends = listed(paths.select(F.element_at("path", -1)["key"].alias("key"), "conv_id"))
    keep = ("key", "up", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    empty = spark.createDataFrame([], NODES)
    nodes = reduce(DataFrame.unionByName, [x.select(*keep) for x in levels] or [empty.select(*keep)])
    above = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, "up", "left").join(ends, "key", "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13(spark: SparkSession, sf: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf}/conversations.parquet"))


def oracle() -> str:
    """The same nodes as DuckDB text: every prefix of every conversation, grouped."""
    h = f"CAST({sqltext.crc32('CAST(conv_id AS VARCHAR)')} % {SHARED} AS BIGINT)"
    return f"""WITH orig AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS pos,
    sha256(strlen(role) || ':' || role || text) AS k, length(text) AS size
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS MATERIALIZED (SELECT conv_id, {h} AS h FROM (SELECT DISTINCT conv_id FROM orig)),
built AS MATERIALIZED (
  SELECT i.conv_id, o.pos, o.k, o.size FROM ids i JOIN orig o ON o.conv_id = i.conv_id - i.conv_id % {FAMILY} AND o.pos < i.h
  UNION ALL SELECT i.conv_id, o.pos, o.k, o.size FROM ids i JOIN orig o ON o.conv_id = i.conv_id AND o.pos >= i.h),
whole AS MATERIALIZED (SELECT i.conv_id, coalesce(list(b.k ORDER BY b.pos) FILTER (WHERE b.k IS NOT NULL), []) AS path, coalesce(list(b.size ORDER BY b.pos) FILTER (WHERE b.k IS NOT NULL), []) AS sizes
  FROM ids i LEFT JOIN built b ON b.conv_id = i.conv_id GROUP BY 1),
prefixes AS MATERIALIZED (SELECT conv_id, d, sha256(array_to_string(path[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(path[1:d - 1], ',')) END AS up,
    CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(path) AS ends FROM whole, unnest(range(len(path) + 1)) t(d)),
nodes AS MATERIALIZED (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY node),
kids AS MATERIALIZED (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY 1),
above AS MATERIALIZED (SELECT DISTINCT a.node AS top, b.node AS low FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS MATERIALIZED (SELECT top AS node, sum(own) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves FROM above JOIN nodes n ON n.node = low LEFT JOIN kids k ON k.node = low GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.up LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node"""
