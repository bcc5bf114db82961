"""Merkle manifest of a data set: one tree of runs for each source, one over the sources, proofs by pointer jumping.

Leaves are ranked by id inside their source; level by level every run of ``ARITY`` neighbours becomes
its parent's digest, whatever source it is of. A source's last node is a leaf of the top tree. Every
inner node then holds one step: the digests beside it and its parent. Repeated self-joins hand it its
ancestor's steps, so the distance doubles each time and after ``log2(height)`` joins every inner node has
its whole way to the root. A leaf joins its parent once and has its proof. Texts are never shuffled: only
digests leave the first projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfleet.llm import common, sqltext

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node's name: its tree (0: over the sources, else a source's rank + 1), its level and its place there.
NODE = ["tree", "level", "pos"]


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: dict[str, Column]) -> Column:
    return digest(*[framed(values[c]) for c in FIELDS])


def parents(nodes: DataFrame) -> DataFrame:
    """One level up: ``tree, pos, n, kids, h`` from ``tree, pos, n, h`` of trees that still have ``n`` > 1 nodes."""
    place = F.pmod("pos", F.lit(ARITY)).cast("int")
    kids = [F.max(F.when(place == i, F.col("h"))).alias(f"k{i}") for i in range(ARITY)]
    up = nodes.withColumn("up", F.floor(F.col("pos") / ARITY).cast("long"))
    rows = up.groupBy("tree", "up").agg(F.first("n").alias("n"), *kids)
    held = F.filter(F.array(*[F.col(f"k{i}") for i in range(ARITY)]), lambda k: k.isNotNull())
    rows = rows.select("tree", F.col("up").alias("pos"), F.ceil(F.col("n") / ARITY).cast("long").alias("n"), held.alias("kids"))
    return rows.withColumn("h", F.sha2(F.array_join("kids", "").cast("binary"), 256))


def grown(leaves: DataFrame, label: str) -> list[DataFrame]:
    """All levels above ``leaves`` (``tree, pos, n, h``), each written once; trees of one node stay as they are."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, now = [], leaves
    while most > 1:
        now = common.stored(parents(now.filter("n > 1").select("tree", "pos", "n", "h")), label)
        levels.append(now)
        most = -(-most // ARITY)
    return levels


def _node(tree: Column, level: Column, pos: Column, n: Column) -> Column:
    """The name of a node; a source's only node is a leaf of the top tree."""
    top = (tree > 0) & (n == 1)
    return F.struct(F.when(top, 0).otherwise(tree).cast("long").alias("tree"), F.when(top, 0).otherwise(level).cast("int").alias("level"), F.when(top, tree - 1).otherwise(pos).cast("long").alias("pos"))


def _beside(kids: Column, at: Column) -> Column:
    """Digests left and right of the kid at place ``at``."""
    left, right = F.slice(kids, F.lit(1), at), F.slice(kids, at + 2, F.lit(ARITY))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def steps(levels: list[DataFrame], spark: SparkSession) -> DataFrame:
    """``node, up, way`` for the inner nodes: its parent and the one step to it."""
    made = []
    for i, parent in enumerate(levels):
        rows = parent.select("tree", F.col("pos").alias("at"), "n", "kids", F.posexplode("kids").alias("i", "kid"))
        rows = rows.filter("tree = 0") if i == 0 else rows  # the leaves of sources join later
        up = _node(F.col("tree"), F.lit(i + 1), F.col("at"), F.col("n"))
        node = F.struct(F.col("tree").cast("long").alias("tree"), F.lit(i).cast("int").alias("level"), (F.col("at") * ARITY + F.col("i")).cast("long").alias("pos"))
        made.append(rows.select(node.alias("node"), up.alias("up"), F.array(_beside(F.col("kids"), F.col("i"))).alias("way")))
    if not made:
        kind = "struct<tree:bigint,level:int,pos:bigint>"
        return spark.createDataFrame([], f"node {kind}, up {kind}, way array<struct<left:string,right:string>>")
    return reduce(DataFrame.unionByName, made)


def jumped(ways: DataFrame, height: int) -> DataFrame:
    """``node, way`` with each node's whole way to the root: every self-join doubles the distance to ``up``."""
    now, reach = common.stored(ways, "ways"), 1
    while reach < height:
        far = now.select(F.col("node").alias("up"), F.col("up").alias("farther"), F.col("way").alias("more"))
        joined = now.join(far, "up", "left")
        way = F.when(F.col("more").isNull(), F.col("way")).otherwise(F.concat("way", "more"))
        now = common.stored(joined.select("node", F.coalesce("farther", "up").alias("up"), way.alias("way")), "ways")
        reach *= 2
    return now.select("node", "way")


def manifest(docs: DataFrame) -> DataFrame:
    """Digests and proofs of every row of ``docs`` (``doc_id, source, lang, n_chars, text``; other columns are not read).

    Rows with equal ids are leaves of their own, in the order of their digests; null ids come first
    in their source and the null source comes first of all. Empty texts are ``0:``, null ones ``-``.
    Rows whose id is null are never tampered with. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    values = {c: F.col(c) for c in FIELDS}
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = values | {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    made = docs.select("doc_id", "source", leaf(values).alias("leaf"), F.when(odd & F.contains("text", F.lit("\n")), leaf(changed)).alias("tampered"))
    placed = common.rank_in_order(made, ["source"], ["doc_id", "leaf"], "pos", "leaves")
    sources = made.groupBy("source").agg(F.count("*").alias("n"))
    sources = common.stored(common.rank_in_order(sources, [], ["source"], "rank", "sources"), "sources")
    named = sources.select(F.col("source").alias("__source"), "n", (F.col("rank") + 1).alias("tree"))
    leaves = placed.join(named, placed["source"].eqNullSafe(named["__source"])).drop("__source")
    leaves = common.stored(leaves, "leaves")
    inner = grown(leaves.select("tree", "pos", "n", F.col("leaf").alias("h")), "levels")
    single = leaves.filter("n = 1").select("tree", F.col("leaf").alias("h"))
    ends = [x.filter("n = 1").select("tree", "h") for x in inner]
    subroots = common.stored(reduce(DataFrame.unionByName, [single, *ends]), "subroots")
    count = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"), F.lit(count).cast("long").alias("n"), "h")
    top = grown(tops, "levels")
    root = (top[-1] if top else subroots).select("h").first()
    ways = jumped(steps(inner, spark).unionByName(steps(top, spark)), len(inner) + len(top))
    # Each leaf's target: the node above it, or, where it is alone, itself as a leaf of the top tree.
    first = inner[0] if inner else None
    above = subroots.join(leaves.filter("n = 1").select("tree"), "tree", "left_semi")
    above = above.select("tree", F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("n"), F.array().cast("array<string>").alias("kids"))
    if first is not None:
        above = above.unionByName(first.select("tree", F.col("pos").alias("at"), "n", "kids"))
    above = above.withColumn("node", _node(F.col("tree"), F.lit(1), F.col("at"), F.col("n"))).join(ways, "node", "left")
    above = above.join(subroots.withColumnRenamed("h", "subroot"), "tree").select("tree", "at", "kids", "way", "subroot")
    rows = leaves.withColumn("at", F.when(F.col("n") > 1, F.floor(F.col("pos") / ARITY)).otherwise(0).cast("long")).join(above, ["tree", "at"])
    own = F.when(F.col("n") > 1, F.array(_beside(F.col("kids"), F.pmod("pos", F.lit(ARITY)).cast("int")))).otherwise(F.array())
    rows = rows.withColumn("way", F.concat(own, F.coalesce("way", F.array().cast("array<struct<left:string,right:string>>"))))
    proof = F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("way", F.coalesce("tampered", "leaf"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))
    rows = rows.withColumns({"proof_sha256": F.sha2(proof.cast("binary"), 256), "folded_root": folded, "root": F.lit(root[0] if root else None).cast("string")})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(common.documents(spark, sf))


def _climb(prefix: str, source: str, levels: int) -> list[str]:
    """CTEs that climb ``source`` (``g, pos, n, h``) and join each level's runs: ``{prefix}{k}`` are nodes, ``{prefix}r{k}`` runs."""
    out = [f"{prefix}0 AS MATERIALIZED (SELECT g, pos, n, h FROM {source})"]
    for k in range(levels):
        out.append(f"{prefix}r{k} AS MATERIALIZED (SELECT g, pos // 3 AS run, list(h ORDER BY pos) AS kids, any_value(n) AS n FROM {prefix}{k} WHERE n > 1 GROUP BY 1, 2)")
        out.append(
            f"{prefix}{k + 1} AS MATERIALIZED (SELECT g, run AS pos, (n + 2) // 3 AS n, sha256(array_to_string(kids, '')) AS h FROM {prefix}r{k}"
            f" UNION ALL SELECT g, pos, n, h FROM {prefix}{k} WHERE n = 1)"
        )
    return out


def _walk(prefix: str, start: str, levels: int) -> list[str]:
    """CTEs that carry every leaf of ``start`` (``id, g, pos, proof, f``) up the levels of ``prefix``."""
    out = [f"{prefix}w0 AS MATERIALIZED (SELECT * FROM {start})"]
    for k in range(levels):
        i = "w.pos % 3"
        left, right = f"array_to_string(r.kids[1:{i}], '')", f"array_to_string(r.kids[{i} + 2:3], '')"
        out.append(
            f"{prefix}w{k + 1} AS MATERIALIZED (SELECT w.id, w.g, CASE WHEN r.kids IS NULL THEN w.pos ELSE w.pos // 3 END AS pos,"
            f" CASE WHEN r.kids IS NULL THEN w.proof ELSE w.proof || {left} || {right} END AS proof,"
            f" CASE WHEN r.kids IS NULL THEN w.f ELSE sha256({left} || w.f || {right}) END AS f"
            f" FROM {prefix}w{k} w LEFT JOIN {prefix}r{k} r ON w.g = r.g AND w.pos // 3 = r.run)"
        )
    return out


def oracle(levels: int = 12) -> str:
    """The manifest as DuckDB text, for up to ``ARITY ** levels`` leaves a source."""

    def part(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"

    def hashed(text: str) -> str:
        return f"sha256({' || '.join(part(text if c == 'text' else c) for c in FIELDS)})"

    odd = sqltext.crc32("CAST(doc_id AS VARCHAR)") + " % 2 = 0"
    plain = "replace(text, chr(10), '')"
    out = [
        f"made AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, source, {hashed('text')} AS leaf, CASE WHEN {odd} THEN {hashed(plain)} END AS bad FROM documents)",
        "ranked AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM made)",
        "leaves AS (SELECT g, pos, n, leaf AS h FROM ranked)",
        *_climb("s", "leaves", levels),
        f"subs AS MATERIALIZED (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM s{levels})",
        *_climb("t", "subs", levels),
        "starts AS (SELECT id, g, pos, '' AS proof, coalesce(bad, leaf) AS f FROM ranked)",
        *_walk("s", "starts", levels),
        f"again AS (SELECT id, 0 AS g, g AS pos, proof, f FROM sw{levels})",
        *_walk("t", "again", levels),
    ]
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT r.doc_id, r.leaf, u.h AS subroot, (SELECT h FROM t{levels}) AS root, sha256(w.proof) AS proof_sha256,"
        f" w.f AS folded_root, w.f = (SELECT h FROM t{levels}) AS verified FROM ranked r JOIN tw{levels} w ON r.id = w.id JOIN subs u ON u.pos = r.g"
    )
