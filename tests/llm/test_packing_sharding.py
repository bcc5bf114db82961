import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
from scanfleet.llm import common, packing, sharding
from tokenizers import Tokenizer


def test_plan_places_every_piece_once_and_tightly():
    rng = random.Random(3)
    histogram = Counter(min(2048, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(4000))
    runs, made = packing.plan(histogram)
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    ranks: dict[int, list[int]] = defaultdict(list)
    for r in runs:
        for k in range(r.lo, r.hi):
            held[r.first + k - r.lo].append((r.offset, r.length))
            ranks[r.length].append(k)
    assert all(sorted(v) == list(range(histogram[n])) for n, v in ranks.items())
    assert sorted(held) == list(range(made))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert made <= 1.02 * sum(n * c for n, c in histogram.items()) / 2048 + 1


def test_op2_matches_the_tokenizer(spark, sf_dir, data):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for doc, text, *_ in data:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[(doc, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.op2(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_word_memory_equals_the_tokenizer():
    odd = ["", None, "Ab,cd. it's ’s 3.5, x,. .", "Σίσυφος ΣΑΣ. İ ǅ ªº, Ĳ ŉ.", "<|endoftext|> a<|startoftext|>b", "é É a ́b \x1cx\x85y z", "  \n\n ", "日本語。テスト", "don't. we'll, 'S", "İ. İ, a.", "J̌ǰ J̌. Á, É. T̈x, K.", "ΑΣ. ß, ẞ. ŉ, ﬁ."]
    tokenizer, memory = Tokenizer.from_file(packing.vocabulary_path()), packing.WordIds(packing.vocabulary_path())
    for _ in range(2):
        for text, ids in zip(odd, memory.encode(odd), strict=True):
            assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    memory.forget()
    assert memory.encode(["the end."])[0].tolist() == [*tokenizer.encode("the end.", add_special_tokens=False).ids, 0]


def test_word_memory_equals_the_tokenizer_on_random_strings():
    """Letters below U+0250, combining marks, marks and blanks in any order."""
    rng = random.Random(11)
    letters = [chr(c) for c in range(0x21, 0x250)] + ["\u0301", "\u030c", "\u0307", "\u0345", "Σ", "ς", "語", " ", " ", ".", ",", "\n", "a", "B"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    tokenizer, memory = Tokenizer.from_file(packing.vocabulary_path()), packing.WordIds(packing.vocabulary_path())
    for text, ids in zip(texts, memory.encode(texts), strict=True):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], ascii(text)


def test_pack_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, 0, 5), (3, 2048, 5), (4, 1, 5), (4, 1, 5)], "id int, length long, offset int")
    got = sorted((r["id"], r["sequence_id"], r["offset"]) for r in packing.pack(rows).collect())
    assert got[:2] == [(1, None, None), (2, None, None)]
    assert got[2][2] == 0 and sorted(r[2] for r in got[3:]) == [0, 1] and len({r[1] for r in got[3:]}) == 1
    assert packing.pack(rows.limit(0)).count() == 0
    assert packing.pack(rows.limit(0)).columns == ["id", "length", "sequence_id", "offset"]


def test_matrix_keeps_both_margins():
    counts = np.array([5, 0, 17, 100, 3])
    matrix = sharding.communication_matrix(counts, 7, 1)
    assert (matrix.sum(axis=1) == counts).all() and np.ptp(matrix.sum(axis=0)) <= 1


def test_op6_deals_all_rows_evenly(spark, sf_dir, data):
    got = sharding.op6(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d[0] for d in data)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
    slots = defaultdict(list)
    texts = {d[0]: (d[1] or "").encode() for d in data}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.op6(spark, sf_dir).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_odd_tables(spark, empty):
    assert sharding.shuffle_into_shards(empty, 4).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "shard int, slot string")
    got = sharding.shuffle_into_shards(df.withColumnRenamed("shard", "x"), 2)
    assert got.columns == ["x", "shard", "slot"] and got.count() == 3


def test_uniform_over_shards(spark):
    df = spark.range(20_000)
    got = sharding.shuffle_into_shards(df, 4, seed=3).toPandas()
    assert got.groupby("shard")["id"].count().tolist() == [5000] * 4
    low = got[got["id"] < 5000].groupby("shard")["id"].count()
    assert (abs(low - 1250) < 150).all()
    assert abs(np.corrcoef(got["id"], got["slot"])[0, 1]) < 0.05


def test_rank_within_is_gapless_per_key(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.col("id") % 3).alias("k"), "id").withColumn("k", F.when(F.col("k") > 0, F.col("k"))).withColumn("h", F.xxhash64("id"))
    got = common.rank_within(df, ["k"], "h", 10_000_000, "r").collect()
    by_key = defaultdict(list)
    for r in got:
        by_key[r["k"]].append((r["r"], r["h"]))
    for v in by_key.values():
        assert [r for r, _ in sorted(v)] == list(range(1000))


def test_odd_documents_tokenize(spark, empty):
    assert packing.token_pieces(empty, packing.vocabulary_path()).count() == 0
    rows = brute.frame(spark, [(None, "a b", "", "", 0), (1, "w " * 3000, "", "", 0)])
    got = packing.token_pieces(rows, packing.vocabulary_path()).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in got) == [(0, 0, 3), (1, 0, 2048), (1, 1, 953)]


def test_plain_words_are_encoded_without_positions():
    """Ids equal the whole vocabulary's; words of plain letters never take the steps that track where letters came from."""
    from scanfleet.llm.packing import WordIds, vocabulary_path

    texts = ["Over the  Quick, brown\nfox.", None, "", "Ünïcode straße, été. İst", "a,b ... x1 $$$ don't, \U00010400", "Lazy," * 3 + " , ."]
    ids = WordIds(vocabulary_path())
    for text, got in zip(texts, ids.encode(texts), strict=True):
        assert got.tolist() == [*ids.whole.encode(text or "", add_special_tokens=False).ids, 0]

    class Unused:
        def encode(self, *args, **kwargs):
            raise AssertionError("positions are tracked")

        encode_batch_fast = encode

    again = WordIds(vocabulary_path())
    want = [*again.whole.encode("Some plain words, and MORE.", add_special_tokens=False).ids, 0]
    again.simple = Unused()
    whole, again.whole = again.whole, Unused()
    again.words[","], again.words["."] = 0, 1  # marks are learned by the whole vocabulary
    again.words.new += [",", "."]
    again.whole = whole
    again.learn()
    again.whole = Unused()
    assert again.encode(["Some plain words, and MORE."])[0].tolist() == want
