"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range.

A sketch grows with its text, sketches of parts merge by union, and the share of the smaller sketch
that is in the larger estimates containment even between very unequal documents. Column expressions
only: no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfleet.llm import common

WORDS, FRACTION = 5, 1 / 8
#: Pattern of what separates words.
SPACE = r"[ \t\n\x0B\f\r]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """A 64-bit hash of every ``size`` words in a row; of all words where there are fewer; none without words."""
    last = F.greatest(F.size(words) - size, F.lit(0))
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, size)))
    return F.when(F.size(words) > 0, every).otherwise(F.array().cast("array<bigint>"))


def sketch(hashes: Column, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes below ``fraction`` of the range; the smallest hash alone where none is."""
    limit = F.lit(int(-(1 << 63) + fraction * (1 << 64)))
    low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < limit)))
    return F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(low)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return sketch(F.concat(a, b), fraction)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that is in the other, 0 to 1; two empty ones are alike, an empty and another are not."""
    small = F.least(F.size(a), F.size(b))
    share = F.size(F.array_intersect(a, b)) / small.cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(small == 0, 0.0).otherwise(share)


def printed(a: Column) -> Column:
    """Lower-case hex digits, 16 for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def fingerprint(docs: DataFrame, out: str = "sketch", text_col: str = "text") -> DataFrame:
    """``docs`` with the sketch of each whole text as ``out`` (null: no words, an empty sketch)."""
    rows = common.without(docs, out, "__words", "__hashes")
    rows = rows.withColumn("__words", words_of(F.col(text_col)))
    rows = rows.withColumn("__hashes", shingle_hashes(F.col("__words")))
    return rows.withColumn(out, sketch(F.col("__hashes"))).drop("__words", "__hashes")


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` of the row that follows in ascending ``id_col``; the first follows the last.

    Equal ids follow each other in the order of a hash of the carried columns; null ids come first.
    Ranges of ids, cut at approximate quantiles, are sorted each on its own; only the first row of
    each range goes to another.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bounds = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    place = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(id_col))), F.lit(0))
    rows = docs.withColumns({"__range": F.when(F.col(id_col).isNull(), 0).otherwise(place), "__tie": F.xxhash64(*carried)})
    both = F.struct(*carried)
    inner = Window.partitionBy("__range").orderBy(F.col(id_col).asc_nulls_first(), "__tie")
    led = rows.withColumn("__next", F.lead(both).over(inner))
    order = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col("__tie").alias("tie"))
    heads = rows.groupBy("__range").agg(F.min_by(both, order).alias("__head"))
    filled = sorted(r[0] for r in rows.select("__range").distinct().collect())  # one number per range
    after = dict(zip(filled, [*filled[1:], *filled[:1]], strict=True))
    turn = spark.createDataFrame(list(after.items()) or [(0, 0)], "__of int, __range int")
    heads = heads.join(turn, "__range").select(F.col("__of").alias("__range"), "__head")
    joined = led.join(heads, "__range").withColumn("__next", F.coalesce("__next", "__head"))
    return joined.withColumns({f"next_{c}": F.col("__next")[c] for c in carried}).drop("__next", "__head", "__range", "__tie")


def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprint(docs), "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = fingerprint(rows, "edited_sketch", "edited")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
