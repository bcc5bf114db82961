"""Running values along each key's time order, split so that no key has to fit one task.

A plain ``Window.partitionBy(key)`` puts a whole vehicle or run into one task, which is fine only
where the key is bounded by what it is (the points of one scan). Any other key is cut into chunks
of its order column; windows run inside a chunk, one summary row per chunk carries the value across
chunk borders, and the two are combined. A key that holds a third of all rows is then spread over
as many tasks as it has chunks. Both plans give the same rows: null keys form a group of their own,
rows with a null order value come first, rows with NaN last. Building a plan starts no job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfleet.session import cut

# Rows one key may have in a single sorted window task, for operators that measure (same rows either way).
KEY_ROWS = 2_000_000
# Different values one group may have in a single sorted window task, for order statistics.
WHOLE_GROUP = 20_000
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Carry:
    """One running column.

    kinds: ``count`` (1-based position), ``total`` (rows of the key), ``sum``, ``max_before``,
    ``min_before`` (strictly earlier rows), ``last`` (non-null, this row or earlier),
    ``last_before``, ``next_after`` (non-null, strictly later), ``next``.
    """

    name: str
    kind: str
    value: Column | None = None


_BEFORE = {"max_before": "max", "min_before": "min", "last_before": "last"}


def group_key(by: Sequence[str]) -> Column:
    """The key columns as one value that is never null, so that null keys meet in an equi-join."""
    return F.struct(*by) if by else F.lit(0)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join on ``by`` in which null equals null; the key columns come from ``left``."""
    other = right.select(group_key(by).alias("_group"), *(c for c in right.columns if c not in by))
    return left.withColumn("_group", group_key(by)).join(other, "_group").drop("_group")


def chunk_of(df: DataFrame, order: str, span: float) -> Column:
    """Number of the chunk of ``order`` that a row is in; null first, NaN last."""
    number = F.floor(F.col(order) / F.lit(span)).cast("bigint")
    if df.schema[order].dataType.typeName() in ("double", "float"):
        number = F.when(F.isnan(order), _LAST).otherwise(number)
    return F.coalesce(number, F.lit(_FIRST))


def needs_split(df: DataFrame, by: Sequence[str], limit: int | None = None) -> bool:
    """True when some key has more than ``limit`` rows (one counting job)."""
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return (most or 0) > (KEY_ROWS if limit is None else limit)


def _backwards(group: Sequence[str], order: Sequence[str]) -> tuple[Window, Window]:
    """Frames of this row and later, and of later rows only, ``order`` being total.

    They run from the end, in reversed order: frames that reach to the end are computed anew for every row.
    """
    w = Window.partitionBy(*group).orderBy(*(F.col(c).desc() for c in order))
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


def _whole(df: DataFrame, by: list[str], order: list[str], carries: Sequence[Carry]) -> DataFrame:
    """Every carry as an ordinary window over the key."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    onward, after = _backwards(by, order)
    make = {
        "count": lambda v: F.row_number().over(w).cast("bigint"),
        "total": lambda v: F.count(F.lit(1)).over(Window.partitionBy(*by)),
        "sum": lambda v: F.coalesce(F.sum(v).over(upto), F.lit(0)),
        "max_before": lambda v: F.max(v).over(before),
        "min_before": lambda v: F.min(v).over(before),
        "last": lambda v: F.last(v, ignorenulls=True).over(upto),
        "last_before": lambda v: F.last(v, ignorenulls=True).over(before),
        "next": lambda v: F.last(v, ignorenulls=True).over(onward),
        "next_after": lambda v: F.last(v, ignorenulls=True).over(after),
    }
    out = df.withColumns({f"_v{i}": c.value for i, c in enumerate(carries) if c.value is not None})
    keep = [c for c in df.columns if c not in {c.name for c in carries}]
    return out.select(*keep, *(make[c.kind](F.col(f"_v{i}")).alias(c.name) for i, c in enumerate(carries)))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    span: float,
    carries: Sequence[Carry],
    split: bool = True,
    settle: bool = False,
) -> DataFrame:
    """Add every carry to ``df``. ``span`` is the chunk width in units of ``order[0]``.

    ``split`` is false only for keys that a task can always sort. ``settle`` writes the input of a
    later pass once instead of recomputing it for both sides of the chunk join.

    Pick ``span`` so that one chunk of one key fits a task (for a 100 Hz log, an hour is 360 000
    rows). ``order`` must be a total order within ``by``.
    """
    if not split:
        return _whole(df, list(by), list(order), carries)
    if settle:
        df = cut(df)
    by, order = list(by), list(order)
    values = {f"_v{i}": c.value for i, c in enumerate(carries) if c.value is not None}
    base = df.withColumns({"_key": group_key(by), "_chunk": chunk_of(df, order[0], span), **values})
    local = Window.partitionBy("_key", "_chunk").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    onward, after = _backwards(["_key", "_chunk"], order)
    chunks = Window.partitionBy("_key").orderBy("_chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    later = _backwards(["_key"], ["_chunk"])[1]
    whole = Window.partitionBy("_key")

    own, summary, across, final = {}, [], {}, {}
    place = F.struct(*order)
    for i, c in enumerate(carries):
        v, l, s, x = F.col(f"_v{i}"), f"_l{i}", f"_s{i}", f"_x{i}"
        pick = F.when(v.isNotNull(), place)
        if c.kind in ("count", "total"):
            own[l] = F.row_number().over(local).cast("bigint")
            summary.append(F.count(F.lit(1)).alias(s))
            window = earlier if c.kind == "count" else whole
            across[x] = F.coalesce(F.sum(s).over(window), F.lit(0).cast("bigint"))
            final[c.name] = F.col(l) + F.col(x) if c.kind == "count" else F.col(x)
        elif c.kind == "sum":
            own[l] = F.coalesce(F.sum(v).over(upto), F.lit(0))
            summary.append(F.sum(v).alias(s))
            across[x] = F.coalesce(F.sum(s).over(earlier), F.lit(0))
            final[c.name] = F.col(l) + F.col(x)
        elif c.kind in ("max_before", "min_before"):
            agg, both = (F.max, F.greatest) if c.kind == "max_before" else (F.min, F.least)
            own[l] = agg(v).over(before)
            summary.append(agg(v).alias(s))
            across[x] = agg(s).over(earlier)
            final[c.name] = both(F.col(l), F.col(x))
        elif c.kind in ("last", "last_before"):
            own[l] = F.last(v, ignorenulls=True).over(upto if c.kind == "last" else before)
            summary.append(F.max_by(v, pick).alias(s))
            across[x] = F.last(s, ignorenulls=True).over(earlier)
            final[c.name] = F.coalesce(F.col(l), F.col(x))
        elif c.kind in ("next", "next_after"):
            own[l] = F.last(v, ignorenulls=True).over(onward if c.kind == "next" else after)
            summary.append(F.min_by(v, pick).alias(s))
            across[x] = F.last(s, ignorenulls=True).over(later)
            final[c.name] = F.coalesce(F.col(l), F.col(x))
        else:
            raise ValueError(f"unknown carry kind {c.kind!r}")

    borders = base.groupBy("_key", "_chunk").agg(*summary)
    borders = borders.select("_key", "_chunk", *(e.alias(n) for n, e in across.items()))
    joined = base.select("*", *(e.alias(n) for n, e in own.items())).join(borders, ["_key", "_chunk"])
    keep = [c for c in df.columns if c not in final]
    return joined.select(*keep, *(e.alias(n) for n, e in final.items()))


def with_halo(
    df: DataFrame, by: Sequence[str], position: str, size: int, back: int
) -> tuple[DataFrame, list[str]]:
    """Cut each key into blocks of ``size`` positions, each with ``back`` earlier rows repeated.

    A frame of at most ``back`` preceding rows can then run per block. Rows repeated only as
    history have ``_halo`` true and must be dropped after the window. Returns the frame and the
    columns to partition the window by.
    """
    block = F.floor((F.col(position) - 1) / size).cast("bigint")
    last = F.floor((F.col(position) - 1 + back) / size).cast("bigint")
    out = df.withColumn("_own", block).withColumn("_block", F.explode(F.sequence(block, last)))
    return out.withColumn("_halo", F.col("_own") != F.col("_block")).drop("_own"), [*by, "_block"]


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str], span: float, n: int) -> DataFrame:
    """The ``n`` newest rows per key, by position from the end (no single-task sort of a key)."""
    if n < 1000:
        # A small top-n is cut per task before the shuffle, however large the key.
        w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
        return df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= n).drop("_pos")
    out = running(df, by, order, span, [Carry("_pos", "count"), Carry("_all", "total")])
    return out.filter(F.col("_pos") > F.col("_all") - n).drop("_pos", "_all")


def order_stats(
    df: DataFrame, by: Sequence[str], value: str, picks: dict[str, Column], buckets: int = 256,
    split: bool = True, whole: int = WHOLE_GROUP,
) -> DataFrame:
    """Exact order statistics per group; no group too big for a task is sorted in one.

    ``picks`` maps an output name to a 0-based rank as an expression over ``n`` (rows of the
    group). Equal values are merged first; approximate quantiles only choose bucket borders, exact
    counts per bucket locate each rank, and just the buckets that hold a wanted rank are ordered. A group
    of at most ``whole`` different values is one bucket.
    """
    by = list(by)
    if not split:
        w = Window.partitionBy(*by)
        ranked = df.filter(F.col(value).isNotNull()).select(
            *by, value, F.count(F.lit(1)).over(w).alias("n"), (F.row_number().over(w.orderBy(value)) - 1).alias("_k")
        )
        return ranked.groupBy(*by).agg(
            *(F.max(F.when(F.col("_k") == e.cast("bigint"), F.col(value))).alias(k) for k, e in picks.items())
        )
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_c")
    )
    grid = [i / buckets for i in range(1, buckets)]
    borders = counts.groupBy(*by).agg(
        F.when(F.count(F.lit(1)) > whole, F.array_distinct(F.percentile_approx(value, grid, 10 * buckets))).alias("_q"), F.sum("_c").alias("n")
    )
    placed = join_groups(counts, borders, by).withColumn(
        "_b", F.when(F.col("_q").isNull(), 0).otherwise(F.size(F.filter("_q", lambda q: q < F.col(value))))
    )
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranks = F.array(
        *(F.struct(F.lit(k).alias("k"), e.cast("bigint").alias("r")) for k, e in picks.items())
    )
    sizes = (
        placed.groupBy(*by, "_b", "n")
        .agg(F.sum("_c").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_want", F.filter(ranks, lambda p: (p["r"] >= F.col("_start")) & (p["r"] < F.col("_start") + F.col("_size"))))
        .filter(F.size("_want") > 0)
        .select(*by, "_b", "_start", "_want")
    )
    within = Window.partitionBy(*by, "_b").orderBy(value)
    hits = (
        join_groups(placed.drop("_q", "n"), sizes, [*by, "_b"])
        .withColumn("_end", F.col("_start") + F.sum("_c").over(within))
        .withColumn("_hit", F.explode("_want"))
        .filter((F.col("_hit.r") < F.col("_end")) & (F.col("_hit.r") >= F.col("_end") - F.col("_c")))
    )
    return hits.groupBy(*by).agg(
        *(F.max(F.when(F.col("_hit.k") == k, F.col(value))).alias(k) for k in picks)
    )
