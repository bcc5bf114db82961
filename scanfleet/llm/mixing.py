"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens runs down a tree of columns (domain, language, source). Each node hands its
budget to its children by weight; a child cannot take more than its documents hold over the
allowed epochs, and what it leaves goes to its siblings. As a node's own limit is the sum of its
leaves', a shortage reaches the parent's siblings only after the node is empty. A leaf then takes
whole epochs and, from the next one, a prefix of tokens in an order that a seed deals anew for
every epoch. Column expressions and integers only, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfleet.llm import common

LEVELS = ("domain", "lang", "source")
#: Production weights by level; a value that is not named weighs 1.
WEIGHTS: tuple[dict[str, int], ...] = ({"web": 5, "books": 3, "code": 2}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {"src0": 2})
SEED, EPOCHS = 7, 3
#: Rows of a leaf that one task sorts.
LEAF_ROWS = 100_000
#: Pattern of a word, the token that is counted.
WORD = r"[^\x20\x09-\x0D]+"


def _weight(column: str, weights: dict[str, int]) -> Column:
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    return F.lit(1) if named is None else F.coalesce(named[F.coalesce(F.col(column), F.lit(""))], F.lit(1))


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def budgets(leaves: DataFrame, budget: int | Column, levels: Sequence[str], weights: Sequence[dict[str, int]]) -> DataFrame:
    """``leaves`` (one row each, with its limit ``most``) with the whole tokens ``budget`` of each."""
    known = leaves.withColumn("budget", F.lit(budget).cast("long") if isinstance(budget, int) else budget)
    known = known.withColumn("budget", F.least("budget", F.sum("most").over(Window.partitionBy(F.lit(0)))))
    for depth, (level, weight) in enumerate(zip(levels, weights, strict=True)):
        parent, node = list(levels[:depth]), list(levels[: depth + 1])
        nodes = known.groupBy(*node).agg(F.sum("most").alias("cap"), F.first("budget").alias("b")).withColumn("w", _weight(level, weight).cast("long"))
        key = parent or [F.lit(0)]
        order = [F.col("cap") / F.col("w"), F.col(level).asc_nulls_first()]
        up = Window.partitionBy(*key).orderBy(*order)
        before, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumns({"below": F.coalesce(F.sum("cap").over(before), F.lit(0)), "still": F.sum("w").over(onward)})
        full = _wide(F.col("cap")) * F.col("still") <= _wide(F.col("w")) * (F.col("b") - F.col("below"))
        nodes = nodes.withColumn("full", full)
        each = Window.partitionBy(*key)
        rest = F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(each), F.lit(0))
        nodes = nodes.withColumns({"rest": rest, "open_w": F.when(F.col("full"), 0).otherwise(F.col("w"))})
        nodes = nodes.withColumns({"all_w": F.sum("open_w").over(each), "cum": F.sum("open_w").over(up.rowsBetween(Window.unboundedPreceding, 0))})
        # Shares as differences of rounded running shares: they add up to the budget exactly.
        share = F.expr("cast(cast(rest as decimal(38,0)) * cum div all_w as long) - cast(cast(rest as decimal(38,0)) * (cum - open_w) div all_w as long)")
        nodes = nodes.select(*[F.col(c).alias(f"__{c}") for c in node], F.when(F.col("full"), F.col("cap")).otherwise(share).alias("__budget"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in node]
        known = known.join(nodes, same).withColumn("budget", F.col("__budget")).drop("__budget", *[f"__{c}" for c in node])
    return known


def mix(docs: DataFrame, budget: int, levels: Sequence[str] = LEVELS, weights: Sequence[dict[str, int]] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, rows: int | None = None) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, the ``levels`` and ``tokens``) that the budget buys, once per epoch.

    Added: ``epoch`` (from 0), ``taken`` (tokens; less than ``tokens`` only for the last document of a
    prefix) and ``leaf_budget``. Null level values are nodes of their own. A document without tokens
    goes with every epoch that reaches it. Ties in the order (repeated ids) are ordered by
    ``tokens``; rows equal in both are interchangeable. An empty table gives an empty result; input
    columns named like an added one are replaced.
    """
    docs = common.without(docs, "epoch", "taken", "leaf_budget").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    rows = docs.count() if rows is None else rows
    digits = 1 + max(0, math.ceil(math.log(max(1, rows / LEAF_ROWS), 16)))
    leaves = docs.groupBy(*levels).agg(F.sum("tokens").alias("held"))
    leaves = budgets(leaves.withColumn("most", F.col("held") * epochs), budget, levels, weights)
    whole = F.expr("case when held > 0 then budget div held else 0 end").cast("int")
    leaves = leaves.select(*[F.col(c).alias(f"__{c}") for c in levels], F.col("budget").alias("leaf_budget"), whole.alias("__whole"), (F.col("budget") - whole * F.col("held")).alias("__part"))
    joined = docs.join(leaves, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels]).drop(*[f"__{c}" for c in levels])
    joined = joined.withColumn("__order", F.md5(F.concat(F.lit(f"{seed}:"), F.col("__whole"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    joined = joined.withColumn("__bucket", F.substring("__order", 1, digits))
    sums = joined.groupBy(*levels, "__bucket").agg(F.sum("tokens").alias("__sum"))
    before = Window.partitionBy(*levels).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = [*levels, "__bucket"]
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select(*[F.col(c).alias(f"__of_{c}") for c in names], "__base")
    inner = Window.partitionBy(*names).orderBy("__order", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("__in", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    placed = placed.join(sums, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in names])
    start = F.col("__base") + F.col("__in")
    last = F.when(start < F.col("__part"), F.array(F.struct(F.col("__whole").alias("epoch"), F.least(F.col("tokens"), F.col("__part") - start).alias("taken"))))
    full = F.transform(F.sequence(F.lit(0), F.col("__whole")), lambda e: F.struct(e.alias("epoch"), F.col("tokens").alias("taken")))
    takes = F.concat(F.slice(full, F.lit(1), F.col("__whole")), F.coalesce(last, F.array().cast("array<struct<epoch:int,taken:bigint>>")))
    chosen = placed.withColumn("__take", F.explode(takes))
    return chosen.select(*docs.columns, F.col("__take.epoch").alias("epoch"), F.col("__take.taken").alias("taken"), "leaf_budget")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, domain, lang, source, tokens`` of ``documents``; the domain is a fixed rule on the source's last letter."""
    code = F.ascii(F.right(F.coalesce("source", F.lit("")), F.lit(1))) % 3
    domain = F.when(code == 0, "web").when(code == 1, "books").otherwise("code")
    return docs.select("doc_id", domain.alias("domain"), "lang", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("tokens"))


def mixed(docs: DataFrame, share: tuple[int, int], epochs: int) -> DataFrame:
    """The mix that spends ``share`` of all tokens of ``documents``."""
    rows = common.stored(sized(docs), "sized")
    total = rows.agg(F.sum("tokens"), F.count("*")).first()
    return mix(rows, (total[0] or 0) * share[0] // share[1], epochs=epochs, rows=total[1])


def op1(spark: SparkSession, sf: str) -> DataFrame:
    out = mixed(common.documents(spark, sf), (7, 10), EPOCHS)
    return out.select("doc_id", "domain", "lang", "source", "epoch", "tokens", "taken", "leaf_budget")


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def oracle() -> str:
    """The production mix as DuckDB text."""
    out = [
        f"""WITH sized AS MATERIALIZED (
  SELECT doc_id, CASE ascii(right(coalesce(source, ''), 1)) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain, lang, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS held, {EPOCHS} * CAST(sum(tokens) AS HUGEINT) AS most FROM sized GROUP BY ALL),
b0 AS (SELECT *, least((SELECT CAST(sum(held) AS HUGEINT) * 7 // 10 FROM leaves), (SELECT sum(most) FROM leaves)) AS budget FROM leaves)"""
    ]
    for d, (level, weight) in enumerate(zip(LEVELS, WEIGHTS, strict=True)):
        node = ", ".join(LEVELS[: d + 1])
        part = f"PARTITION BY {', '.join(LEVELS[:d])}" if d else ""
        order = f"ORDER BY CAST(cap AS DOUBLE) / w, {level} NULLS FIRST"
        same = " AND ".join(f"k.{c} IS NOT DISTINCT FROM n.{c}" for c in LEVELS[: d + 1])
        out.append(
            f"""n{d} AS (SELECT {node}, CAST(sum(most) AS HUGEINT) AS cap, CAST(any_value(budget) AS HUGEINT) AS b, {_case(level, weight)} AS w FROM b{d} GROUP BY {node}),
f{d} AS (SELECT *, cap * sum(w) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (b - coalesce(sum(cap) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM n{d}),
o{d} AS (SELECT *, CASE WHEN is_full THEN 0 ELSE w END AS ow, CAST(b - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS HUGEINT) AS rest FROM f{d}),
c{d} AS (SELECT *, CAST(sum(ow) OVER ({part} {order} ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS cum, CAST(sum(ow) OVER ({part}) AS HUGEINT) AS aw FROM o{d}),
b{d + 1} AS (SELECT k.* EXCLUDE (budget), CASE WHEN is_full THEN cap ELSE rest * cum // aw - rest * (cum - ow) // aw END AS budget FROM b{d} k JOIN c{d} n ON {same})"""
        )
    out.append(
        f"""plan AS (SELECT domain, lang, source, CAST(budget AS BIGINT) AS leaf_budget, CASE WHEN held > 0 THEN CAST(budget // held AS INTEGER) ELSE 0 END AS whole,
  CAST(CASE WHEN held > 0 THEN budget % held ELSE 0 END AS BIGINT) AS part FROM b{len(LEVELS)}),
placed AS (SELECT s.*, p.leaf_budget, p.whole, p.part, CAST(coalesce(sum(s.tokens) OVER (PARTITION BY s.domain, s.lang, s.source
    ORDER BY md5('{SEED}:' || p.whole || ':' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN plan p ON s.domain = p.domain AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, tokens, tokens AS taken, leaf_budget FROM placed, range({EPOCHS}) r(e) WHERE e < whole
UNION ALL
SELECT doc_id, domain, lang, source, whole, tokens, least(tokens, part - start), leaf_budget FROM placed WHERE start < part"""
    )
    return ",\n".join(out[:-1]) + ",\n" + out[-1]
