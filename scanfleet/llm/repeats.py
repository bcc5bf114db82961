"""Windows that documents share: finding them, dealing them to indexes, removing them.

Used by the two substring operators, which differ in the unit (word or byte) and in the index. A
window is 50 units. Its anchor is the smallest hash among its short grams, so equal windows have
equal anchors wherever they stand, and a document falls into runs of windows with one anchor.

1. Every task lists the anchors of its documents (a few per window length). One shuffle tells which
   anchors two different documents have, and how often they occur.
2. Documents with such anchors hand out those runs: anchor and content. A group of documents hands
   out equal contents once, with the smallest document, so thousands of copies weigh as one a group.
3. The contents of one anchor, a bounded number, go to one index, which finds windows that also
   stand in a content of a smaller document.
4. A join brings each run what its content got, and each document loses the units covered.

An anchor that occurs more than :data:`HOT` times goes to no index: the windows of its distinct
contents are dealt and sorted by 128 bits of hash, so the prose around a common passage is spread
over all tasks. Copies of a run never get that far.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfleet.llm import common

WINDOW = 50
#: Windows in one run at most; occurrences from which an anchor is dealt by whole windows; tasks that
#: share a hot anchor's contents; text bytes of a document group.
RUN, HOT, SALTS, GROUP_BYTES = 64, 1000, 64, 8 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(29))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(30)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[s:e]`` for every pair, from prefix sums."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, n), dtype=np.uint64, out=prefix[1:])
    shift = _powers(_INVERSE, n + 1)
    return _mix((prefix[ends] - prefix[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


@dataclass
class Text:
    """Units of a few documents: their hashes, byte spans, and first unit of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Text:
    at = np.arange(len(data), dtype=np.int64)
    return Text(data, at, at + 1, offsets, _TABLE[data])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    white = np.zeros(256, bool)
    white[list(common.WHITE)] = True
    inside = ~white[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_units(data: np.ndarray, offsets: np.ndarray) -> Text:
    starts, ends = word_bounds(data, offsets)
    hashes = slice_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return Text(data, starts, ends, np.searchsorted(starts, offsets), hashes)


@dataclass(frozen=True)
class Unit:
    """What a unit is, and how many of them make a gram."""

    read: Callable[[np.ndarray, np.ndarray], Text]
    gram: int
    words: bool


#: Grams long enough that unrelated prose hardly shares one, and well below the window.
WORDS, BYTES = Unit(word_units, 8, True), Unit(byte_units, 20, False)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive units, by doubling."""
    n = len(hashes) - k + 1
    out, size, factor = hashes, 1, _BASE
    while size * 2 <= k:
        out = out[:-size] * _U(factor) + out[size:]
        size, factor = size * 2, factor * factor % (1 << 64)
    if size < k:
        out = out[:n] * _U(pow(_BASE, k - size, 1 << 64)) + out[k - size : k - size + n]
    return _mix(out)


def runs_of(text: Text, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, document, begin, end``: runs of windows (by first unit) with one anchor, ``RUN`` long at most."""
    n, first = len(text.hashes), text.first
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none.astype(np.uint64), none, none, none
    # 48 bits: two grams that fall together only share an index.
    anchor = sliding_min(gram_hashes(text.hashes, unit.gram) >> _U(16), WINDOW - unit.gram + 1)
    count = len(anchor)
    long = np.flatnonzero(np.diff(first) >= WINDOW)
    opens, closes = first[long], first[long + 1] - WINDOW + 1
    cut = np.zeros(count + 1, bool)
    cut[1:count] = anchor[1:] != anchor[:-1]
    cut[opens] = True
    cut[np.minimum(closes, count)] = True
    at = np.flatnonzero(cut)
    begin, end = at, np.append(at[1:], count)
    owner = np.searchsorted(opens, begin, "right") - 1
    inside = (owner >= 0) & (begin < closes[np.maximum(owner, 0)]) if len(opens) else np.zeros(len(begin), bool)
    begin, end, owner = begin[inside], end[inside], owner[inside]
    if len(begin) and (end - begin).max() > RUN:
        pieces = -(-(end - begin) // RUN)
        rank = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, last, owner = np.repeat(begin, pieces) + rank * RUN, np.repeat(end, pieces), np.repeat(owner, pieces)
        end = np.minimum(begin + RUN, last)
    return anchor[begin], long[owner], begin, end


#: Text bytes looked at together; a longer document stands alone.
CHUNK = 1 << 20


def chunks(column: pa.Array, unit: Unit) -> Iterator[tuple[np.ndarray, Text]]:
    """Documents a few at a time, as row numbers and their units."""
    data, offsets = common.text_buffer(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        at = offsets[row : end + 1]
        yield np.arange(row, end), unit.read(data[at[0] : at[-1]], at - at[0])
        row = end


def _batch(schema: str | pa.Schema, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)


#: ``part`` also holds the occurrences beyond the first (from bit 32); ``above`` is the largest document minus the smallest.
_ANCHORS = pa.schema([("anchor", pa.int64()), ("part", pa.int64()), ("lo", pa.int64()), ("above", pa.int64())])
_SHARED = pa.schema([("part", pa.int64()), ("anchor", pa.int64()), ("hot", pa.bool_())])
_RUNS = pa.schema(
    [("anchor", pa.int64()), ("content", pa.binary()), ("hot", pa.bool_()), ("part", pa.int64()), ("row_key", pa.int64()), ("doc", pa.int64()), ("begin", pa.int64()), ("windows", pa.int64())]
)


def _anchors(unit: Unit, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors of each document group, with the smallest and largest document and the occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, text_col, 8 << 20):
            ids = batch.column("__doc").fill_null(0).to_numpy()
            known, part = batch.column("__doc").is_valid().to_numpy(zero_copy_only=False), batch.column("__part").to_numpy()
            found = []
            for rows, text in chunks(batch.column(text_col), unit):
                anchor, doc, _, _ = runs_of(text, unit)
                doc = rows[doc]
                found.append((anchor[known[doc]], doc[known[doc]]))
            anchor = np.concatenate([f[0] for f in found])
            if not len(anchor):
                continue
            doc = np.concatenate([f[1] for f in found])
            order = np.lexsort((anchor, part[doc]))
            anchor, doc = anchor[order], doc[order]
            home = part[doc]
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (home[1:] != home[:-1])))
            low, high = np.minimum.reduceat(ids[doc], new), np.maximum.reduceat(ids[doc], new)
            extra = np.diff(np.append(new, len(anchor))) - 1
            yield _batch(_ANCHORS, anchor[new].view(np.int64), home[new] + (extra << 32), low, high - low)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor: the groups of those that two documents have, and whether they are hot."""

    def decide(table: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.append(True, table[1:, 0] != table[:-1, 0]))
        size = np.diff(np.append(new, len(table)))
        shared = np.minimum.reduceat(table[:, 2], new) < np.maximum.reduceat(table[:, 2] + table[:, 3], new)
        hot = np.add.reduceat((table[:, 1] >> 32) + 1, new) > HOT
        take = np.repeat(shared, size)
        return _batch(_SHARED, table[take, 1] & 0xFFFFFFFF, table[take, 0], np.repeat(hot, size)[take])

    carry = np.zeros((0, 4), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.concatenate([carry, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        end = int(np.searchsorted(table[:, 0], table[-1, 0]))
        if end:
            yield decide(table[:end])
        carry = table[end:]
    if len(carry):
        yield decide(carry)


_CONTENTS = pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("hot", pa.bool_()), ("first", pa.int64())])


def _contents(unit: Unit, text_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The distinct contents among the runs of a document group, with the smallest document of each."""
    runs = _runs(unit, text_col)

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        seen: dict[tuple[int, bytes], list] = {}
        for batch in runs(docs, shared).to_batches():
            for a, c, hot, d in zip(*[batch.column(k).to_pylist() for k in ("anchor", "content", "hot", "doc")], strict=True):
                if (known := seen.setdefault((a, c), [d, hot]))[0] > d:
                    known[0] = d
        columns = [[k[0] for k in seen], [k[1] for k in seen], [v[1] for v in seen.values()], [v[0] for v in seen.values()]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CONTENTS, strict=True)], schema=_CONTENTS)

    return run


def _runs(unit: Unit, text_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Runs of a document group whose anchors are shared."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        wanted = np.sort(shared["anchor"].to_numpy().view(np.uint64))
        hot = np.sort(shared["anchor"].to_numpy()[shared["hot"].to_numpy()].view(np.uint64))
        out = []
        if docs.num_rows and len(wanted):
            key, ids = docs["__key"].to_numpy(), docs["__doc"].combine_chunks()
            part, known, ids = docs["__part"][0].as_py(), ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for rows, text in chunks(docs[text_col], unit):
                anchor, doc, begin, end = runs_of(text, unit)
                take = _member(anchor, wanted) & known[rows[doc]] if len(anchor) else np.zeros(0, bool)
                anchor, doc, begin, end = anchor[take], doc[take], begin[take], end[take]
                if not len(anchor):
                    continue
                raw = text.data.tobytes()
                content = [raw[a:b] for a, b in zip(text.starts[begin].tolist(), text.ends[end + WINDOW - 2].tolist(), strict=True)]
                if unit.words:
                    content = [b" ".join(c.split()) for c in content]
                r = rows[doc]
                out.append(
                    _batch(_RUNS, anchor.view(np.int64), pa.array(content, pa.binary()), _member(anchor, hot), np.full(len(r), part), key[r], ids[r], begin - text.first[doc], end - begin)
                )
        return pa.Table.from_batches(out, _RUNS)

    return run


_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("first", pa.int64()), ("anchor", pa.int64()), ("content_hash", pa.int64()), ("at", pa.int64())])


def _windows(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """128 bits of hash for every window of a content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            batch = batch.filter(batch.column("hot"))
            if not batch.num_rows:
                continue
            a, h = batch.column("anchor").to_numpy(), batch.column("content_hash").to_numpy()
            new = np.append((a[0], h[0]) != last, (a[1:] != a[:-1]) | (h[1:] != h[:-1]))
            last = (a[-1], h[-1])
            batch = batch.filter(pa.array(new))  # the first of equal contents has the smallest document
            if not batch.num_rows:
                continue
            anchor, content_hash, first = (batch.column(c).to_numpy() for c in ("anchor", "content_hash", "first"))
            for rows, text in chunks(batch.column("content"), unit):
                size = np.diff(text.first) - WINDOW + 1
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                place, r = np.repeat(text.first[:-1], size) + at, np.repeat(rows, size)
                w1 = gram_hashes(text.hashes, WINDOW)[place].view(np.int64)
                w2 = gram_hashes(_mix(text.hashes + _U(7)), WINDOW)[place].view(np.int64)
                yield _batch(_WINDOWS, w1, w2, first[r], anchor[r], content_hash[r], at)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by window and ``first``: those that do not have their window's smallest ``first``."""
    last, least = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        w1, w2, first = (batch.column(c).to_numpy() for c in ("w1", "w2", "first"))
        new = np.append((w1[0], w2[0]) != last, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))
        starts = np.flatnonzero(np.append(True, new[1:]))
        smallest = first[starts]
        if not new[0]:
            smallest[0] = least
        smallest = np.repeat(smallest, np.diff(np.append(starts, len(w1))))
        last, least = (w1[-1], w2[-1]), smallest[-1]
        yield batch.filter(pa.array(first > smallest)).select(["anchor", "content_hash", "first", "at"])


def _member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _indexed(index: Callable[[list[int], list[bytes], list[int]], list[list[int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by anchor go to ``index`` in whole anchors, many at a time; contents without a rival and hot ones pass by."""
    schema = pa.schema([("anchor", pa.int64()), ("content_hash", pa.int64()), ("first", pa.int64()), ("ranges", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, bool]] = []
        last_content: tuple[int, int] | None = None

        def close(rows: list[tuple[int, int, int, bytes, bool]]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[0], r[2]))
            anchors = [r[0] for r in rows]
            contest = [i for i, r in enumerate(rows) if not r[4] and ((i and anchors[i - 1] == r[0]) or (i + 1 < len(rows) and anchors[i + 1] == r[0]))]
            ranges: list[list[int]] = [[] for _ in rows]
            if contest:
                for i, found in zip(contest, index([anchors[i] for i in contest], [rows[i][3] for i in contest], [rows[i][2] for i in contest]), strict=True):
                    ranges[i] = found
            return _batch(schema, pa.array(anchors), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array(ranges, pa.list_(pa.int64())))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "content_hash", "first", "content", "hot")], strict=True):
                if row[:2] != last_content:  # the first of equal contents has the smallest document
                    last_content = row[:2]
                    held.append(row)
            if len(held) >= 20_000:
                last = None if held[-1][4] else held[-1][0]  # hot contents need not stay together
                end = len(held)
                while end and held[end - 1][0] == last:
                    end -= 1
                if end:
                    yield close(held[:end])
                held = held[end:]
        if held:
            yield close(held)

    return run


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def remove_repeats(
    docs: DataFrame,
    unit: Unit,
    index: Callable[[list[int], list[bytes], list[int]], list[list[int]]],
    finish: Callable[[pa.Table, list[list[tuple[int, int]]]], pa.Table],
    added: T.StructType,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the columns ``finish`` makes of each group of rows and its spans of repeated units.

    ``index(anchors, contents, firsts)`` returns for each content the ranges ``[lo, hi, ...]`` of its
    windows that stand in a content with a smaller ``first``.
    """
    spark = docs.sparkSession
    rows = common.without(docs, *added.names)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(4 * tasks, math.ceil(size / GROUP_BYTES))
    keyed = rows.withColumns({"__doc": F.col(id_col).cast("long"), "__key": key, "__part": F.pmod(key, F.lit(groups))}).repartition(tasks, "__part")
    shared = (
        keyed.mapInArrow(_anchors(unit, text_col), "anchor long, part long, lo long, above long")
        .repartition(tasks, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_shared, "part long, anchor long, hot boolean")
    )
    runs = (
        keyed.groupBy("__part")
        .cogroup(shared.withColumnRenamed("part", "__part").repartition(tasks, "__part").groupBy("__part"))
        .applyInArrow(_runs(unit, text_col), "anchor long, content binary, hot boolean, part long, row_key long, doc long, begin long, windows long")
    )
    near = shared.withColumnRenamed("part", "__part").repartition(tasks, "__part")
    contents = (
        keyed.groupBy("__part")
        .cogroup(near.groupBy("__part"))
        .applyInArrow(_contents(unit, text_col), "anchor long, content binary, hot boolean, first long")
        .withColumn("content_hash", F.xxhash64("content"))
    )
    # Both readers take every column of the same exchange, so it is made once. A hot anchor's contents need no company.
    salt = F.when(F.col("hot"), F.pmod("content_hash", F.lit(SALTS))).otherwise(0)
    dealt = contents.withColumn("salt", salt).repartition(tasks, "anchor", "salt").sortWithinPartitions("anchor", "content_hash", "first")
    indexed = dealt.mapInArrow(_indexed(index), "anchor long, content_hash long, first long, ranges array<long>")
    later = (
        dealt.mapInArrow(_windows(unit), "w1 long, w2 long, first long, anchor long, content_hash long, at long")
        .repartition(tasks, "w1", "w2")
        .sortWithinPartitions("w1", "w2", "first")
        .mapInArrow(_later, "anchor long, content_hash long, first long, at long")
        .groupBy("anchor", "content_hash", "first")
        .agg(F.flatten(F.transform(F.collect_list("at"), lambda a: F.array(a, a + 1))).alias("ranges"))
    )
    decided = indexed.withColumn("whole", F.lit(True)).unionByName(later.withColumn("whole", F.lit(False)))
    runs = runs.select("anchor", F.xxhash64("content").alias("content_hash"), "part", "row_key", "doc", "begin", "windows")
    met = runs.join(decided, ["anchor", "content_hash"])
    met = met.filter(F.when(F.col("doc") > F.col("first"), F.col("whole")).otherwise(F.size("ranges") > 0))
    whole = F.array(F.lit(0).cast("long"), F.col("windows"))
    found = met.select(
        F.col("part").alias("__part"), "row_key", "begin",
        F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("ranges")).alias("ranges"),
    )
    out = T.StructType([*rows.schema.fields, *added.fields])

    def cut(docs_: pa.Table, spans: pa.Table) -> pa.Table:
        by_row: dict[int, list[tuple[int, int]]] = {}
        for k, begin, ranges in zip(spans["row_key"].to_pylist(), spans["begin"].to_pylist(), spans["ranges"].to_pylist(), strict=True):
            by_row.setdefault(k, []).extend((begin + lo, begin + hi + WINDOW - 1) for lo, hi in zip(ranges[::2], ranges[1::2], strict=True))
        return finish(docs_.drop_columns(["__doc", "__key", "__part"]), [covered(by_row.get(k, [])) for k in docs_["__key"].to_pylist()])

    return keyed.groupBy("__part").cogroup(found.repartition(tasks, "__part").groupBy("__part")).applyInArrow(cut, out)
