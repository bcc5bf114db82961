"""Best-fit packing planned on a histogram of lengths.

The plan looks at how many pieces there are of each length, not at pieces: best-fit decreasing puts
whole runs of equally long pieces into runs of equally full sequences at once, so its size depends
on the capacity only. A plan row says that pieces of one length with ranks from ``lo`` on stand at
one offset of consecutive sequences; pieces then take their slots by a join on length and rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfleet.llm import common

CAPACITY = 2048
#: Distinct words whose ids a task remembers at most before it starts anew.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks ``lo`` to ``hi`` - 1 stand at ``offset`` of ``first``, ``first`` + 1, ..."""

    length: int
    lo: int
    hi: int
    first: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Best-fit decreasing over counts; returns the runs and the number of sequences."""
    runs: list[Run] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences
    rooms: list[int] = []
    made = 0

    def put(room: int, lo: int, hi: int) -> None:
        if room > 0:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((lo, hi))

    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = -(-(count - rank) // (capacity // length))
                room, lo, hi = capacity, made, made + fit
                made += fit
            else:
                room = rooms[at]
                lo, hi = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            n = min(hi - lo, count - rank)
            runs.append(Run(length, rank, rank + n, lo, capacity - room))
            put(room - length, lo, lo + n)
            if lo + n < hi:
                put(room, lo + n, hi)
            rank += n
    return runs, made


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Every row of ``pieces`` with ``sequence_id`` and ``offset``; sequences are gapless from offset 0.

    ``length`` must be between 1 and ``capacity``; rows with a null or zero length take no place and
    keep null in both columns. Equal rows are interchangeable. Input columns named like the two
    output columns are replaced. The histogram has ``capacity`` entries at most, whatever the input.
    """
    spark = pieces.sparkSession
    rows = common.without(pieces, "sequence_id", "offset")
    sized = rows.filter(F.col(length) > 0)
    counts = {int(r[0]): int(r[1]) for r in sized.groupBy(length).count().collect()}
    runs, _ = plan(counts, capacity)
    slots = spark.createDataFrame(
        [(r.length, r.lo, r.hi, r.first, r.offset) for r in runs] or [(0, 0, 0, 0, 0)],
        "__length long, __lo long, __hi long, __sequence long, offset long",
    )
    hashed = sized.withColumn("__hash", F.xxhash64(F.lit("slot"), *[F.col(c) for c in rows.columns]))
    ranked = common.rank_within(hashed, [length], "__hash", max(counts.values(), default=1), "__rank")
    # Lengths have few plan rows each, so the rank test inside an equal length stays cheap.
    placed = ranked.join(
        F.broadcast(slots),
        (F.col(length) == F.col("__length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")),
    ).withColumn("sequence_id", F.col("__sequence") + F.col("__rank") - F.col("__lo"))
    placed = placed.select(*rows.columns, "sequence_id", "offset")
    rest = rows.filter(F.col(length).isNull() | (F.col(length) <= 0))
    return placed.unionByName(rest.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}))


class _Index(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


#: Below this code point a word is in composed form already and has plain lower-case letters.
SIMPLE = "\u0130"


class WordIds:
    """Token ids of texts, remembered per blank-separated word.

    The vocabulary drops white space, never joins across it and folds case, so a text's ids are its
    words' ids in a row; a word of simple letters and a final comma or stop has the ids of both. Words of
    simple letters skip the steps that would leave them as they are, and their last id says that a word ends, so
    no positions are kept for them. The memory is bounded: it is emptied when it holds :data:`REMEMBERED` words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.simple = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.simple.normalizer = None
        self.simple.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = self.plain.pre_tokenizer = None
        known = self.whole.get_vocab()
        self.final = np.zeros(max(known.values()) + 1, bool)
        self.final[[i for w, i in known.items() if w.endswith(self.whole.model.end_of_word_suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.cores = _Index(), _Index()
        self.parts = np.zeros((0, 2), np.int64)  # of each word: core, mark or -1
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def easy(word: str) -> bool:
        """Whether a word is of simple letters only, which the vocabulary's normaliser does no more than fold."""
        return word.isalpha() and (word.isascii() or max(word) < SIMPLE)

    def learn(self) -> None:
        """Ids of the words asked for since the last time."""
        core, easy = self.cores, self.easy
        bare = pc.match_substring_regex(pa.array(self.words.new, pa.string()), "^[A-Za-z]+$").to_numpy(zero_copy_only=False)
        parts = [
            (core[w], -1) if b else (core[w[:-1]], core[w[-1]]) if w[-1:] in (",", ".") and easy(w[:-1]) else (core[w], -1)
            for w, b in zip(self.words.new, bare.tolist(), strict=True)
        ]
        self.parts = np.concatenate([self.parts, np.array(parts, np.int64).reshape(-1, 2)])
        new = core.new
        kinds: list[list[int]] = [[], [], []]
        for i, w in enumerate(new):
            kinds[(0 if w.isascii() else 1 if max(w) < SIMPLE else 2) if w.isalpha() else 2].append(i)
        lengths, pieces = np.zeros(len(new), np.int64), []
        starts = np.zeros(len(new), np.int64)
        at = len(self.flat)
        for tokenizer, which in zip((self.plain, self.simple, self.whole), kinds, strict=True):
            if not which:
                continue
            if tokenizer is self.whole:
                found = tokenizer.encode([new[i] for i in which], is_pretokenized=True, add_special_tokens=False)
                ids = np.array(found.ids, np.uint32)
                sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(which))
            else:
                given = [new[i].lower() for i in which]
                (found,) = tokenizer.encode_batch_fast([given], is_pretokenized=True, add_special_tokens=False)
                ids = np.array(found.ids, np.uint32)
                sizes = np.diff(np.flatnonzero(self.final[ids]), prepend=-1)
            lengths[which] = sizes
            starts[which] = at + np.cumsum(sizes) - sizes
            at += len(ids)
            pieces.append(ids)
        self.flat = np.concatenate([self.flat, *pieces])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.words.new, core.new = [], []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text and a final 0."""
        if len(self.words) > REMEMBERED:
            self.forget()
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        words = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64)
        if self.words.new:
            self.learn()
        parts = self.parts[words]
        lengths = np.where(parts < 0, 0, self.lengths[parts])
        text_ends = np.append(0, np.cumsum(lengths.sum(axis=1)))[np.cumsum([0, *map(len, split)])]
        parts, lengths = parts.ravel(), lengths.ravel()
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.starts[parts] - (ends - lengths), lengths) + np.arange(total)]
        return [np.append(flat[a:b], np.uint32(0)) for a, b in zip(text_ends[:-1], text_ends[1:], strict=True)]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) of every text and its end token 0.

    A null or empty text is the end token alone. Only longer texts are cut, into pieces of ``capacity``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(vocabulary)
        for batch in common.small_batches(batches, "text"):
            doc, piece, start, length, data = [], [], [], [], []
            for key, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist()), strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    doc.append(key)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    data.append(part.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their places and the checksum of their ids."""
    pieces = token_pieces(docs, vocabulary, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(common.stored(pieces, "pieces"), capacity)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packed(common.documents(spark, sf), vocabulary_path())
