"""Language-model scores by a weighted backoff automaton.

Every token, pair and triple of the training rows is counted, and every one with ``LEAST`` occurrences
is a state or an arc, whatever the size of the corpus. Arcs carry Dirichlet-smoothed log-probabilities;
failure arcs drop the oldest token and carry the backoff weight. The model is never whole anywhere:
documents are dealt into groups of bounded text, and each group walks its texts from left to right
over an automaton of the states and arcs that they can reach.

What a group must know of the others it learns in rounds. It asks with the sorted 64-bit hashes of its
distinct n-grams and what it counted of each; hashes are dealt into buckets by their top bits, a bucket
sums what all groups have, and answers each with values in the order it asked in, so no hash travels
back. The first round counts tokens and pairs. Triples are asked for only where both of their pairs are
kept, so n-grams that occur once cross the network once, eight bytes at most each. What the arcs of a
state leave over is summed over arcs by the group that owns each (the first that has it), then asked for
by all that can reach the state. A key weighs once a group, however often it occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfleet.llm import common

#: Occurrences from which a pair or triple is kept; longest n-gram; strength of the shorter context.
LEAST, ORDER, PRIOR = 2, 3, 200.0
#: The token behind the last word; no word is empty.
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


Grams = dict[int, dict[tuple[int, ...], int]]


class Automaton:
    """States and arcs of a backoff model over word numbers 0, 1, ...; any other number is rare.

    ``grams[n]`` has the counts of the kept n-grams. ``unigram[w]`` is the log10 probability of a
    word. State 0 is the root.
    """

    def __init__(self, grams: Grams, unigram: list[float], prior: float = PRIOR) -> None:
        contexts = [g for n in sorted(grams) if n < ORDER for g in grams[n]]
        self.state: dict[tuple[int, ...], int] = {(): 0} | {g: i + 1 for i, g in enumerate(contexts)}
        self.fail, self.backoff = [0] * len(self.state), [0.0] * len(self.state)
        self.arcs: dict[int, tuple[int, float]] = {}
        self.width = len(unigram) + 1
        arcs: dict[tuple[int, ...], dict[int, float]] = {(): dict(enumerate(unigram))}
        for n in sorted(grams):
            for g in grams[n] if n > 1 else ():
                arcs.setdefault(g[:-1], {})[g[-1]] = 0.0
        for context in sorted(arcs, key=len):
            out, here = arcs[context], self.state[context]
            if context:
                self.fail[here] = self.state[context[1:]] if context[1:] in self.state else 0
                total, lower = grams[len(context)][context] + prior, context[1:]
                seen = shorter = 0.0
                for w in out:
                    p = 10 ** self._down(lower, w)
                    q = (grams[len(context) + 1][(*context, w)] + prior * p) / total
                    out[w], seen, shorter = math.log10(q), seen + q, shorter + p
                self.backoff[here] = math.log10(max(1e-12, 1 - seen) / max(1e-12, 1 - shorter))
            for w, weight in out.items():
                self.arcs[here * self.width + w] = (self._longest((*context, w)), weight)
        for g in contexts:  # contexts without an arc of their own
            if g not in arcs:
                self.fail[self.state[g]] = self._longest(g[1:])

    @classmethod
    def of(cls, arcs: dict[int, tuple[int, float]], fail: list[int], backoff: list[float], width: int) -> Automaton:
        """An automaton whose states and arcs are known already."""
        made = cls.__new__(cls)
        made.arcs, made.fail, made.backoff, made.width = arcs, fail, backoff, width
        return made

    def _longest(self, g: tuple[int, ...]) -> int:
        g = g[-(ORDER - 1) :]
        while g not in self.state:
            g = g[1:]
        return self.state[g]

    def _down(self, context: tuple[int, ...], w: int) -> float:
        """log10 of the word behind a context whose arcs exist already."""
        state, total = self._longest(context), 0.0
        while (found := self.arcs.get(state * self.width + w)) is None:
            total += self.backoff[state]
            state = self.fail[state]
        return total + found[1]

    def walk(self, words: list[int]) -> float:
        """Sum of the weights along a text; rare words (-1) add only what leads to the root."""
        arcs, fail, backoff, width = self.arcs, self.fail, self.backoff, self.width
        state, total = 0, 0.0
        for w in words:
            if w < 0:
                while state:
                    total += backoff[state]
                    state = fail[state]
                continue
            found = arcs.get(state * width + w)
            while found is None:
                total += backoff[state]
                state = fail[state]
                found = arcs.get(state * width + w)
            state, weight = found
            total += weight
        return total


#: Text bytes of a document group.
GROUP_BYTES = 8 << 20
#: Characters by which texts that begin alike are found; beginnings sent to all tasks at most (16 bytes each).
LEAD, HEAVY_ROWS = 40, 500_000
#: What rounds ask for: counts of tokens, pairs and triples; what arcs leave to states of one and of two tokens.
TOKEN, PAIR, TRIPLE, LEFT_OF_TOKEN, LEFT_OF_PAIR = range(5)
ASKED = "kind int, bucket long, group long, keys binary, s binary, t binary"
TOLD = "group long, kind int, bucket long, told binary"


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes, in order."""
    h = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in any order, and the place of each value among them."""
    found = pa.array(codes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def planes(values: np.ndarray) -> bytes:
    """Eight-byte values, compressed with all lowest bytes first: equal high bytes take no room."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def asked(kind: int, group: int, bits: int, keys: np.ndarray, s: np.ndarray, t: np.ndarray | None = None) -> list[tuple]:
    """Rows of :data:`ASKED` for sorted distinct keys: a row for each bucket that has any, keys as differences."""
    if not len(keys):
        return []
    top = keys >> np.uint64(64 - bits)
    edges = np.flatnonzero(np.diff(top, prepend=top[:1] ^ np.uint64(1)))
    rows = []
    for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True):
        own = None if t is None else planes(t[lo:hi])
        rows.append((kind, int(top[lo]), group, planes(np.diff(keys[lo:hi], prepend=np.uint64(0))), planes(s[lo:hi]), own))
    return rows


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _asked_table(rows: list[tuple]) -> pa.Table:
    return _table(rows, ["kind", "bucket", "group", "keys", "s", "t"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])


def _summed(table: pa.Table) -> tuple[list, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Rows of one bucket by group, their sizes, first places and places of the distinct keys, sums of ``s`` and ``t``."""
    rows = sorted(table.to_pylist(), key=lambda r: r["group"])
    keys = [np.cumsum(unplaned(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    s = np.bincount(place, np.concatenate([unplaned(r["s"], np.float64) for r in rows]))
    t = None
    if rows[0]["t"] is not None:
        t = np.bincount(place, np.concatenate([unplaned(r["t"], np.float64) for r in rows]))
    return rows, [len(k) for k in keys], first, place, s, t


def _answers(table: pa.Table) -> pa.Table:
    """Sums of one bucket, told to each group: counts below the least are 0, the owner's are negative."""
    rows, sizes, first, place, s, t = _summed(table)
    if t is None:
        kept = np.where(s >= (1 if rows[0]["kind"] == TOKEN else LEAST), s, 0.0)
        told = kept[place]
        told[first] = 0.0 - told[first]
    else:
        told = np.where(s > 0, np.log10(np.maximum(1e-12, 1 - s) / np.maximum(1e-12, 1 - t)), 0.0)[place]
    ends = np.cumsum(sizes)
    out = [(r["group"], r["kind"], r["bucket"], planes(told[e - n : e])) for r, n, e in zip(rows, sizes, ends, strict=True)]
    return _table(out, ["group", "kind", "bucket", "told"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])


def _size_of_bucket(table: pa.Table) -> pa.Table:
    s = _summed(table)[4]
    return pa.table({"n": pa.array([int(s.sum())], pa.int64()), "v": pa.array([int((s > 0).sum())], pa.int64())})


class Group:
    """The n-grams of a group of texts: distinct hashes in ascending order, and which of them stand where."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray) -> None:
        whole = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())  # never a slice of a batch
        words = pc.ascii_split_whitespace(pc.ascii_lower(whole))
        flat, starts = words.flatten(), words.offsets.to_numpy()
        starts = starts - starts[0]
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
        words = flat.filter(pa.array(full)).dictionary_encode()
        self.ends = np.append(0, np.cumsum(full))[starts[1:]] + np.arange(1, len(starts))
        self.sizes = np.diff(self.ends, prepend=0)
        known = pc.cast(words.dictionary, pa.large_binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [*known, END]), np.uint64, len(known) + 1)
        self.tokens, rank = np.unique(hashes, return_inverse=True)
        self.token = np.full(len(words) + len(self.ends), rank[-1])
        inside = np.ones(len(self.token), bool)
        inside[self.ends - 1] = False
        self.token[inside] = rank[words.indices.to_numpy()]

    def find_pairs(self) -> None:
        """``pair`` is -1 at the first token of a text."""
        first = np.zeros(len(self.token), bool)
        first[self.ends - self.sizes] = True
        at = np.flatnonzero(~first)
        codes, place = distinct(self.token[at - 1] * len(self.tokens) + self.token[at])
        b, c = np.divmod(codes, len(self.tokens))
        self.pairs, one, rank = np.unique(mixed(self.tokens[b], self.tokens[c]), return_index=True, return_inverse=True)
        self.b, self.c = b[one], c[one]
        self.pair = np.full(len(self.token), -1)
        self.pair[at] = rank[place]

    def learn_counts(self, told: dict[int, np.ndarray], below: float) -> None:
        self.n1, n2 = np.abs(told[TOKEN]), told.get(PAIR, np.zeros(0))
        self.own2, self.n2 = n2 < 0, np.abs(n2)
        self.p1 = (self.n1 + 0.5) / below
        self.q2 = (self.n2 + PRIOR * self.p1[self.c]) / (self.n1[self.b] + PRIOR)
        kept = np.append(self.n2 > 0, False)[self.pair]  # the last entry is that of -1
        at = np.flatnonzero(kept[1:] & kept[:-1]) + 1
        width = max(1, len(self.pairs))
        codes, place = distinct(self.pair[at - 1] * width + self.pair[at])
        ab, bc = np.divmod(codes, width)
        self.triples, one, rank = np.unique(mixed(self.pairs[ab], self.tokens[self.c[bc]]), return_index=True, return_inverse=True)
        self.ab, self.bc = ab[one], bc[one]
        self.triple_at, self.triple = at, rank[place]
        self.inner, self.outer = self.n1 >= LEAST, self.n2 > 0  # what can be a state with arcs

    def left_of_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        own, n = self.own2, len(self.tokens)
        return np.bincount(self.b[own], self.q2[own], n)[self.inner], np.bincount(self.b[own], self.p1[self.c[own]], n)[self.inner]

    def learn_triples(self, told: dict[int, np.ndarray]) -> None:
        n3 = told.get(TRIPLE, np.zeros(0))
        self.own3, self.n3 = n3 < 0, np.abs(n3)
        self.q3 = (self.n3 + PRIOR * self.q2[self.bc]) / (self.n2[self.ab] + PRIOR)
        self.f1 = np.zeros(len(self.tokens))
        self.f1[self.inner] = told.get(LEFT_OF_TOKEN, np.zeros(0))

    def left_of_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        own, n = self.own3, len(self.pairs)
        return np.bincount(self.ab[own], self.q3[own], n)[self.outer], np.bincount(self.ab[own], self.q2[self.bc[own]], n)[self.outer]

    def automaton(self, told: dict[int, np.ndarray]) -> Automaton:
        """The part of the model that these texts can reach. States: the root, then tokens, then kept pairs."""
        m = len(self.tokens)
        kept, long_ = np.flatnonzero(self.outer), np.flatnonzero(self.n3 > 0)
        state = np.zeros(len(self.pairs), np.int64)
        state[kept] = 1 + m + np.arange(len(kept))
        width = m + 1
        codes = np.concatenate([np.arange(m), (1 + self.b[kept]) * width + self.c[kept], state[self.ab[long_]] * width + self.c[self.bc[long_]]])
        to = np.concatenate([np.where(self.n1 > 0, 1 + np.arange(m), 0), state[kept], state[self.bc[long_]]])
        weight = np.log10(np.concatenate([self.p1, self.q2[kept], self.q3[long_]]))
        arcs = dict(zip(codes.tolist(), zip(to.tolist(), weight.tolist(), strict=True), strict=True))
        fail = [0] * (1 + m) + (1 + self.c[kept]).tolist()
        backoff = [0.0, *self.f1.tolist(), *told.get(LEFT_OF_PAIR, np.zeros(0)).tolist()]
        return Automaton.of(arcs, fail, backoff, width)


def _told(table: pa.Table) -> dict[int, np.ndarray]:
    """What a group was told of each kind, in the order of its hashes."""
    found: dict[int, list[np.ndarray]] = {}
    for r in sorted(table.to_pylist(), key=lambda r: (r["kind"], r["bucket"])):
        found.setdefault(r["kind"], []).append(unplaned(r["told"], np.float64))
    return {k: np.concatenate(v) for k, v in found.items()}


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with a ``group`` of about :data:`GROUP_BYTES`, and the number of groups.

    Texts that begin alike share their n-grams more often than others, so they go to one group, in
    which an n-gram is asked for once; a beginning with more text than a group holds is split by the
    rows' hash. There are fewer of those than groups. Were they more than :data:`HEAVY_ROWS`, rows
    are dealt by hash alone: scores do not depend on the groups.
    """
    lead = F.xxhash64(F.substring("text", 1, LEAD))
    sizes = common.stored(rows.groupBy(lead.alias("lead")).agg(F.sum(F.octet_length("text")).alias("bytes")), "leads")
    heavy = sizes.filter(F.col("bytes") > GROUP_BYTES).select("lead", F.ceil(2 * F.col("bytes") / GROUP_BYTES).alias("ways"))
    n_heavy, size = heavy.count(), sizes.agg(F.sum("bytes")).first()[0] or 0
    n_groups = max(1, math.ceil(size / GROUP_BYTES))
    by = F.xxhash64("doc_id", "text")
    if n_heavy > HEAVY_ROWS:
        return rows.withColumn("group", F.pmod(by, F.lit(n_groups))), n_groups
    dealt = rows.withColumn("lead", lead).join(F.broadcast(heavy), "lead", "left")
    part = F.pmod(by, F.coalesce("ways", F.lit(1)))
    return dealt.withColumn("group", F.pmod(F.xxhash64("lead", part), F.lit(n_groups))).drop("lead", "ways"), n_groups


def _size(rows: DataFrame, bits: int) -> tuple[int, int]:
    """Training tokens and distinct ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", 4 * GROUP_BYTES):
            g = Group(batch.column("text"))
            yield from _asked_table(asked(TOKEN, 0, bits, g.tokens, np.bincount(g.token).astype(float))).to_batches()

    counted = rows.filter("train").select("text").mapInArrow(run, ASKED)
    size = counted.groupBy("bucket").applyInArrow(_size_of_bucket, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return size["n"] or 0, size["v"] or 0


def score(docs: DataFrame, training: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    ``training`` says which rows of ``docs`` are learned from, or is another frame with the column
    ``text``. Null texts are empty: one end token. Without training tokens all scores are null.
    Repeated rows and rows with a null id are scored like any other. Scores are log10 probabilities,
    ``base_score`` that of single tokens with half a count added.
    """
    learned = F.coalesce(training, F.lit(False)) if isinstance(training, Column) else F.lit(False)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), learned.alias("train"), F.lit(True).alias("scored"))
    if isinstance(training, DataFrame):
        kind = rows.schema["doc_id"].dataType
        rows = rows.unionByName(training.select(F.lit(None).cast(kind).alias("doc_id"), "text", F.lit(True).alias("train"), F.lit(False).alias("scored")))
    rows, n_groups = _dealt(rows)
    bits = max(1, math.ceil(math.log2(n_groups)))
    n, v = _size(rows, bits)
    below = max(0.5, n + 0.5 * (v + 1))
    # All rounds read the texts from one shuffle: they are part of one plan.
    texts = rows.groupBy("group")

    def count(table: pa.Table) -> pa.Table:
        g = Group(table["text"])
        g.find_pairs()
        group, train = table["group"][0].as_py(), np.repeat(table["train"].to_numpy().astype(float), g.sizes)
        tokens = np.bincount(g.token, train, len(g.tokens))
        pairs = np.bincount(g.pair[g.pair >= 0], train[g.pair >= 0], len(g.pairs))
        return _asked_table([*asked(TOKEN, group, bits, g.tokens, tokens), *asked(PAIR, group, bits, g.pairs, pairs)])

    def known(table: pa.Table, told: dict[int, np.ndarray]) -> Group:
        g = Group(table["text"])
        g.find_pairs()
        g.learn_counts(told, below)
        return g

    def lengthen(table: pa.Table, answers: pa.Table) -> pa.Table:
        g = known(table, _told(answers))
        group, train = table["group"][0].as_py(), np.repeat(table["train"].to_numpy().astype(float), g.sizes)
        triples = np.bincount(g.triple, train[g.triple_at], len(g.triples))
        left = asked(LEFT_OF_TOKEN, group, bits, g.tokens[g.inner], *g.left_of_tokens())
        return _asked_table([*asked(TRIPLE, group, bits, g.triples, triples), *left])

    def close(table: pa.Table, answers: pa.Table) -> pa.Table:
        told = _told(answers)
        g = known(table, told)
        g.learn_triples(told)
        return _asked_table(asked(LEFT_OF_PAIR, table["group"][0].as_py(), bits, g.pairs[g.outer], *g.left_of_pairs()))

    def walk(table: pa.Table, answers: pa.Table) -> pa.Table:
        told = _told(answers)
        g = known(table, told)
        g.learn_triples(told)
        model, starts = g.automaton(told), g.ends - g.sizes
        token = g.token.tolist()
        scores = [model.walk(token[a:b]) for a, b in zip(starts.tolist(), g.ends.tolist(), strict=True)]
        base = np.add.reduceat(np.log10(g.p1)[g.token], starts)
        seen = np.add.reduceat((g.n1 > 0)[g.token].astype(np.int64), starts)
        out = pa.table([table["doc_id"], pa.array(g.sizes), pa.array(seen), pa.array(base), pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        return out.filter(table["scored"])

    def answered(questions: DataFrame) -> DataFrame:
        return questions.groupBy("kind", "bucket").applyInArrow(_answers, TOLD)

    told = answered(texts.applyInArrow(count, ASKED))
    told = told.unionByName(answered(texts.cogroup(told.groupBy("group")).applyInArrow(lengthen, ASKED)))
    told = told.unionByName(answered(texts.cogroup(told.groupBy("group")).applyInArrow(close, ASKED)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    walked = texts.cogroup(told.groupBy("group")).applyInArrow(walk, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    out = common.stored(walked, "scores")
    scores = ["base_score", "score"]
    if not n:
        scores = [F.lit(None).cast("double").alias(c) for c in scores]
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), *scores)


def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.documents(spark, sf)
    out = score(docs, F.coalesce(common.fold(F.col("doc_id")), F.lit(0)) != 1)
    return out.select("doc_id", (common.fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
