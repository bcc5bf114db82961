"""Removal of repeated word windows by suffix automata of reference passages.

The references are the distinct passages that documents share around one anchor (see
``repeats``); each anchor has an automaton of its own, so nothing as large as a corpus shard has to
be broadcast. Passages come in document order: each is streamed through the automaton of the
smaller documents, which yields the length of the longest match that ends at every word, and is
then added to it unless it was matched as a whole.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfleet.llm import common, repeats
from scanfleet.llm.repeats import WINDOW


class SuffixAutomaton:
    """All substrings of the sequences added to it."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, tokens: list[bytes]) -> None:
        last = 0
        for t in tokens:
            last = self._extend(last, t)

    def _extend(self, last: int, t: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(t)) is not None:  # already there, from an earlier sequence
            return q if length[q] == length[last] + 1 else self._split(last, t, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and t not in nxt[p]:
            nxt[p][t] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][t]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, t, q)
        return new

    def _split(self, p: int, t: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(t) == q:
            nxt[p][t] = copy
            p = link[p]
        return copy

    def matches(self, tokens: list[bytes]) -> list[int]:
        """Length of the longest suffix of ``tokens[:i + 1]`` that is a substring of what was added."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for t in tokens:
            while state and t not in nxt[state]:
                state = link[state]
                size = length[state]
            if (after := nxt[state].get(t)) is not None:
                state, size = after, size + 1
            out.append(size)
        return out


def repeated_windows(anchors: list[int], contents: list[bytes], firsts: list[int]) -> list[list[int]]:
    """Ranges of windows of each passage that a passage of a smaller document holds; passages of an anchor stand together in document order."""
    out: list[list[int]] = []
    for _, group in groupby(zip(anchors, firsts, contents, strict=True), lambda r: r[0]):
        automaton = SuffixAutomaton()
        for _, same in groupby(group, lambda r: r[1]):
            passages = [c.split(b" ") for _, _, c in same]
            found = [automaton.matches(p) for p in passages]
            for tokens, sizes in zip(passages, found, strict=True):
                out.append(_ranges([n >= WINDOW for n in sizes[WINDOW - 1 :]]))
                if sizes[-1] < len(tokens):
                    automaton.add(tokens)
    return out


def _ranges(flags: list[bool]) -> list[int]:
    out: list[int] = []
    for i, f in enumerate(flags):
        if f and out and out[-1] == i:
            out[-1] = i + 1
        elif f:
            out += [i, i + 1]
    return out


def _finish(text_col: str):
    def finish(docs: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        words, removed, kept = [], [], []
        for text, cut in zip(docs[text_col].to_pylist(), spans, strict=True):
            tokens = (text or "").encode().split()
            words.append(len(tokens))
            removed.append(sum(hi - lo for lo, hi in cut))
            for lo, hi in reversed(cut):
                del tokens[lo:hi]
            kept.append(b" ".join(tokens).decode())
        spans_ = pa.array([[{"lo": lo, "hi": hi} for lo, hi in c] for c in spans], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        for name, column in (("n_words", pa.array(words, pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("removed", spans_), ("kept_text", pa.array(kept, pa.string()))):
            docs = docs.append_column(name, column)
        return docs

    return finish


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_removed, removed`` (spans of word numbers) and ``kept_text``.

    A word goes if a 50-word window over it also starts in a document with a smaller id; words are
    split at ASCII white space, and kept ones are joined by one space. Null texts have no words;
    rows with a null id lose nothing and take nothing from others; rows with equal ids do not count
    against each other, repeated rows are treated alike; an empty table gives an empty result;
    input columns named like the added ones are replaced.
    """
    span = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span), T.StructField("kept_text", T.StringType())])
    return repeats.remove_repeats(docs, repeats.WORDS, repeated_windows, _finish(text_col), added, id_col, text_col)


def op8(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeated_words(common.documents(spark, sf).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
