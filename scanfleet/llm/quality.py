"""Quality by hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs fall into hash buckets; two multinomials over the buckets, one from trusted
documents and one from all, give each bucket a log-ratio. A document's score is the mean over its
n-grams, and a fixed threshold decides, the same way for every document. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfleet.llm import common
from scanfleet.llm.fingerprints import words_of

#: Buckets of words and as many of pairs; prior count of a bucket; trusted documents at most; least mean log-ratio to keep.
BUCKETS, PRIOR, TRUSTED, THRESHOLD = 1 << 13, 1.0, 20_000, -0.1
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8


def joined(hashes: Column, apart: int) -> Column:
    """A hash of every two values that stand ``apart``; none where there are too few."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def grams_of(hashes: Column, pairs: Column) -> Column:
    """Bucket numbers of all words, then of all pairs of neighbours."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    return F.concat(single, F.transform(pairs, lambda h: (F.pmod(h, F.lit(BUCKETS)) + BUCKETS).cast("int")))


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    rows = docs.withColumn("__words", words_of(F.col(text_col)))
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    return rows.withColumn("__pairs", joined(F.col("__hashes"), 1))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``ratios``: the log-ratio of every bucket.

    Raw counts cover all of ``docs``. The target is fitted on at most ``TRUSTED`` of the ids in
    ``trusted``, dealt by a hash, so that list is small enough to send to every task.
    """
    chosen = trusted.select(id_col).dropna().distinct().orderBy(F.xxhash64(id_col), id_col).limit(TRUSTED)
    flagged = docs.select(id_col, text_col).join(F.broadcast(chosen.withColumn("__target", F.lit(1))), id_col, "left")
    grams = with_words(flagged, text_col).select(F.coalesce("__target", F.lit(0)).alias("t"), F.explode(grams_of(F.col("__hashes"), F.col("__pairs"))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    buckets = docs.sparkSession.range(2 * BUCKETS, numPartitions=1).select(F.col("id").cast("int").alias("b"))
    full = buckets.join(counts, "b", "left").na.fill(0)
    sums = full.groupBy((F.col("b") >= BUCKETS).alias("pairs")).agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    ratio = F.log((F.col("target") + PRIOR) / (F.col("all_target") + PRIOR * BUCKETS)) - F.log((F.col("raw") + PRIOR) / (F.col("all_raw") + PRIOR * BUCKETS))
    rated = full.join(sums, (F.col("b") >= BUCKETS) == F.col("pairs")).select("b", ratio.alias("r"))
    # The number of buckets is fixed, so they fit one row.
    return rated.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "r"))), lambda s: s["r"].cast("float")).alias("ratios"))


def repeated_words(n_words: Column, pairs: Column) -> Column:
    """Words in windows of eight that the text has twice or more, from the hashes of neighbouring words.

    Windows are compared by a 64-bit hash, made from pairs by way of fours. Equal windows stand together in sorted order; the sorted
    first words of those that have a twin then say how many words they cover.
    """
    windows = joined(joined(pairs, 2), 4)

    def count(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            hit = F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        return F.aggregate(
            _bind(_bind(placed, twins), lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)))),
            F.lit(0),
            lambda total, n: total + n,
        )

    distinct = _bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(count(w)))
    return F.when(n_words < REPEAT_WINDOW + 1, 0).otherwise(distinct).cast("long")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (with its words and hashes) and the base counts; null texts have no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, " \t\n\x0b\f\r", "")) > 0)
    return docs.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.size("__words"), F.col("__pairs")),
        }
    )


def judge(docs: DataFrame, ratios: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``score`` (mean log-ratio; 0 without words) and ``kept``.

    Every row is judged on its whole text by the same threshold; null and empty texts fail the base.
    Input columns named like an added one are replaced. An empty table gives an empty result.
    """
    rows = common.without(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    rows = base_counts(with_words(rows, text_col), text_col)
    grams = F.col("__grams")
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.coalesce(F.get("__ratios", g), F.lit(0.0)))
    rows = rows.withColumns({"__grams": grams_of(F.col("__hashes"), F.col("__pairs")), "__ratios": ratios.scalar()}).withColumn("score", F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & (F.col("score") >= THRESHOLD)).drop("__words", "__hashes", "__pairs", "__grams", "__ratios")


def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.documents(spark, sf).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0")
    out = judge(docs, common.stored(fit(docs, labels), "ratios"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
