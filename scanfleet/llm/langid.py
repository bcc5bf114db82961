"""Language identification by word-first backoff.

A known word scores by its frequency in each language; an unseen one falls back to its character
n-grams, the longest known first and then ever shorter ones. Scores of a whole text add up to one
log-likelihood per language.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfleet.llm import common

#: Documented bounds, each for one language, so that a rare one is learned beside frequent ones: labelled documents
#: (expected number, dealt by a hash of the id, whole texts), words that are counted, words and n-grams of a length
#: in the model that is sent to every task; longest n-gram.
SAMPLE_DOCS, COUNTED, MAX_WORDS, MAX_GRAMS, LONGEST = 2_000, 30_000, 10_000, 10_000, 4
#: Languages that are thinned to the bound of documents at most (rarer ones are taken whole).
THINNED = 10_000
UNKNOWN = "und"
#: Weights of a fallback step, of one unknown character, and words remembered per task.
STEP, FLOOR, REMEMBERED = math.log(0.4), math.log(1e-6), 300_000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]


def letters(word: str) -> str:
    """The letters of a word, lower case."""
    word = word.lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams_of(word: str, n: int) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def train(rows: Iterable[tuple[str, str, int]]) -> Model:
    """Word and n-gram log-frequencies by language from (lang, word, count) rows."""
    words: dict[str, Counter[str]] = defaultdict(Counter)
    for lang, word, count in rows:
        if w := letters(word):
            words[lang][w] += count
    languages = sorted(words)
    grams: dict[str, list[Counter[str]]] = {}
    for lang in languages:
        counts = [Counter() for _ in range(LONGEST)]
        for w, c in words[lang].items():
            for n in range(1, LONGEST + 1):
                for g in grams_of(w, n):
                    counts[n - 1][g] += c
        grams[lang] = counts

    def table(counters: list[Counter[str]], most: int, least: int) -> dict[str, np.ndarray]:
        total = np.array([sum(c.values()) for c in counters], float)
        whole: Counter[str] = Counter()
        for c in counters:
            whole.update(c)
        kept: dict[str, None] = {}
        for c in counters:
            kept |= dict.fromkeys(sorted((k for k in c if whole[k] >= least), key=lambda k: (-c[k], k))[:most])
        return {k: np.log((np.array([c[k] for c in counters]) + 0.01) / (total + 0.01 * (len(whole) + 1))) for k in kept}

    known = table([words[x] for x in languages], MAX_WORDS, 2)
    joined: dict[str, np.ndarray] = {}
    for n in range(LONGEST):
        joined |= table([grams[x][n] for x in languages], MAX_GRAMS, 2)
    return Model(languages, known, joined)


class Scorer(dict):
    """Log-likelihoods of words, remembered; a missing word is scored on first use."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.score(letters(word))
        self[word] = at
        return at

    def score(self, word: str) -> np.ndarray:
        if not word:
            return np.zeros(len(self.model.languages))
        if (found := self.model.words.get(word)) is not None:
            return found
        marked, at, out = f"^{word}$", 0, np.zeros(len(self.model.languages))
        while at < len(marked):  # the longest known n-gram that starts here, then on behind it
            for n in range(LONGEST, 0, -1):
                if (g := self.model.grams.get(marked[at : at + n])) is not None and at + n <= len(marked):
                    out = out + g + (LONGEST - n) * STEP
                    at += n
                    break
            else:
                out = out + FLOOR
                at += 1
        return out

    def text(self, text: str) -> np.ndarray | None:
        """Log-likelihood per language; None without a letter."""
        if len(self) > REMEMBERED:
            self.clear()
        at = np.fromiter(map(self.__getitem__, text.split()), np.int64)
        if not any(c.isalpha() for c in text):
            return None
        return self.rows[at].sum(axis=0)


def word_counts(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str, int]]:
    """(lang, word, count) of a hashed sample of each language's labelled rows: its most frequent words, ``COUNTED`` at most.

    Words are cut where a count, in steps of an eighth of a factor of two, would exceed that bound, so ties at the cut
    go together. A row without an id is dealt like an id of its own; rows without text or language are left out. An
    empty table gives an empty list.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), id_col, text_col)
    # Only languages with more rows than the bound are thinned, and of those the most frequent: what is broadcast is bounded.
    frequent = rows.groupBy("lang").agg(F.count("*").alias("rows")).filter(F.col("rows") > SAMPLE_DOCS).orderBy(F.desc("rows"), "lang").limit(THINNED)
    shares = F.broadcast(frequent.select("lang", (F.lit(SAMPLE_DOCS * 1_000_000) / F.col("rows")).cast("int").alias("share")))
    dealt = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1_000_000)) < F.coalesce("share", F.lit(1_000_000))
    words = rows.join(shares, "lang", "left").filter(dealt).select("lang", F.explode(F.split(text_col, r"\s+")).alias("word"))
    counts = common.stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("size", F.floor(F.log2("n") * 8).cast("int")), "words")
    above = Window.partitionBy("lang").orderBy(F.desc("size"))
    steps = counts.groupBy("lang", "size").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(above))
    cut = steps.filter(F.col("upto") <= COUNTED).groupBy("lang").agg(F.min("size").alias("least"))
    kept = counts.join(cut, "lang").filter(F.col("size") >= F.col("least")).select("lang", "word", "n").toArrow()
    return list(zip(*(kept.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``: the best language and its posterior.

    The posterior is tempered by the number of words, so that long texts do not all score 1.
    Null texts and texts without a letter are ``und`` with score 0, and so is everything under a
    model without languages. Ties go to the first language in alphabetical order. Whole texts are
    read, row by row; input columns named like the two output columns are replaced.
    """
    rows = common.without(docs, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in common.small_batches(batches, text_col):
            best, score = [], []
            for text in batch.column(text_col).to_pylist():
                found = scorer.text(text) if text and model.languages else None
                if found is None:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = np.exp((found - found.max()) / math.sqrt(1 + text.count(" ")))
                best.append(model.languages[int(found.argmax())])
                score.append(float(p.max() / p.sum()))
            made = [pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame) -> Model:
    """A model from ``documents`` outside the held-out fifth; without a labelled row, one that knows no language."""
    return train(word_counts(docs.filter(common.fold(F.col("doc_id")) != 0), "doc_id", "text", "lang"))


def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.documents(spark, sf)
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (common.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
