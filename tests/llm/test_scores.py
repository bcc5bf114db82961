import hashlib
import math
import random
from collections import Counter
from itertools import pairwise

import brute
import pytest
import xxhash
from pyspark.sql import functions as F
from scanfleet.llm import common, fingerprints, langid, lm, quality, simhash


# --- language identification -------------------------------------------------------------------


def test_op3_predicts_the_held_out_fold(spark, sf_dir, data):
    got = {r["doc_id"]: r for r in langid.op3(spark, sf_dir).collect()}
    assert len(got) == len({r[0] for r in data})
    for doc, text, lang, *_ in data:
        r = got[doc]
        assert r["held_out"] == (brute.fold(doc) == 0) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif lang and doc % 5 and len(text) > 100:
            assert r["lang_pred"] == lang


def test_op3_accuracy_on_the_held_out_fold(spark):
    """The fold by crc32 that nothing was learned from; a language with few documents is learned too."""
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [(known[r["doc_id"]], r["lang_pred"]) for r in langid.op3(spark, sf).filter("held_out").collect() if known[r["doc_id"]]]
    assert len(got) > 150 and sum(a == b for a, b in got) >= 0.98 * len(got)


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(langid, "COUNTED", 50)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "and", "water", "house", f"n{rng.randrange(999)}"]) for _ in range(30)), "en", "s", 1) for i in range(400)]
    rows += [(1000 + i, "joki talo vesi kivi", "fi", "s", 1) for i in range(4)]
    docs = brute.frame(spark, rows)
    counted = langid.word_counts(docs, "doc_id", "text", "lang")
    assert {w for x, w, _ in counted if x == "fi"} == {"joki", "talo", "vesi", "kivi"}
    assert 0 < sum(x == "en" for x, _, _ in counted) <= 50
    found = langid.identify(brute.frame(spark, [(1, "talo kivi", None, None, 0)]), langid.train(counted)).first()
    assert found["lang_pred"] == "fi"


def test_unseen_words_fall_back_to_shorter_grams():
    model = langid.train([("en", w, 5) for w in "the thing thinking water".split()] + [("fr", w, 5) for w in "eau eaux chose été".split()])
    scorer = langid.Scorer(model)
    at = {x: i for i, x in enumerate(model.languages)}
    assert "thinks" not in model.words
    assert scorer.text("thinks")[at["en"]] > scorer.text("thinks")[at["fr"]]
    assert scorer.text("beaux")[at["fr"]] > scorer.text("beaux")[at["en"]]
    assert scorer.text("12 %%") is None and scorer.text("") is None


def test_language_of_odd_tables(spark, empty):
    model = langid.train([])
    docs = brute.frame(spark, [(None, "abc", "en", "", 0), (2, None, "en", "", 0)]).withColumnRenamed("source", "score")
    got = langid.identify(docs, model).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"], r["lang"]) for r in got} == {(None, "und", 0.0, "en"), (2, "und", 0.0, "en")}
    assert langid.identify(empty, langid.fit(empty)).count() == 0


# --- quality ----------------------------------------------------------------------------------


def test_op4_base_counts(spark, sf_dir, data):
    got = {r["doc_id"]: r for r in quality.op4(spark, sf_dir).collect()}
    for doc, text, *_ in data:
        w, r, lines = brute.words(text), got[doc], [x for x in (text or "").split("\n") if brute.words(x)]
        repeated = brute.repeated_words(text)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * repeated > 30 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def _chained(values, size=64):
    """Spark's 64-bit hash of several values: each seeds the next."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & (1 << size) - 1).to_bytes(size // 8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_quality_score_is_the_mean_log_ratio(spark, sf_dir, data):
    def grams(text):
        h = [_chained([w]) for w in brute.words(text)]
        return [x % quality.BUCKETS for x in h] + [quality.BUCKETS + _chained(p) % quality.BUCKETS for p in pairwise(h)]

    labels = {r[0] for r in data[:40] if r[0] % 2 == 1 and r[0] % 10 != 1}
    raw, target = Counter(), Counter()
    for doc, text, *_ in data:
        raw.update(grams(text))
        if doc in labels:
            target.update(grams(text))

    def ratio(g):
        same = [b for b in raw if (b >= quality.BUCKETS) == (g >= quality.BUCKETS)]
        t, r = sum(target[b] for b in same), sum(raw[b] for b in same)
        p = quality.PRIOR
        return math.log((target[g] + p) / (t + p * quality.BUCKETS)) - math.log((raw[g] + p) / (r + p * quality.BUCKETS))

    memo = {g: ratio(g) for g in raw}
    for r in quality.op4(spark, sf_dir).collect():
        g = grams(dict((d[0], d[1]) for d in data)[r["doc_id"]])
        assert r["score"] == pytest.approx(sum(memo[x] for x in g) / len(g) if g else 0.0, abs=1e-5)


def test_quality_of_an_empty_table(spark, empty):
    ratios = quality.fit(empty, empty.select("doc_id"))
    assert quality.judge(empty, common.stored(ratios, "ratios")).count() == 0


# --- language model ---------------------------------------------------------------------------


def test_op5_base_scores_and_model(spark, sf_dir, data):
    tokens = [(d[0], lm.tokens_of(d[1])) for d in data]
    counts = Counter(t for doc, ts in tokens if brute.fold(doc) != 1 for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = {doc: ts for doc, ts in tokens}
    got = lm.op5(spark, sf_dir).collect()
    assert len(got) == len(data)
    held = [0.0, 0.0]
    for r in got:
        ts = want[r["doc_id"]]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (brute.fold(r["doc_id"]) == 1, len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(base)
        if r["held_out"]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]


def _direct(grams, unigram, context, w):
    """The probability of a word by the recursion that the automaton's arcs stand for."""
    if not context:
        return 10 ** unigram[w]
    lower = context[1:]
    kept = grams.get(len(context), {}).get(context)
    if kept is None:
        return _direct(grams, unigram, lower, w)
    follow = {g[-1]: c for g, c in grams.get(len(context) + 1, {}).items() if g[:-1] == context}
    total = kept + lm.PRIOR
    p = {x: (c + lm.PRIOR * _direct(grams, unigram, lower, x)) / total for x, c in follow.items()}
    if w in p:
        return p[w]
    rest = 1 - sum(_direct(grams, unigram, lower, x) for x in follow)
    return _direct(grams, unigram, lower, w) * (1 - sum(p.values())) / rest


def test_automaton_walk_is_the_backoff_recursion():
    rng = random.Random(2)
    text = [rng.choice([0, 0, 1, 2, 3]) for _ in range(400)]
    grams = {n: {g: c for g, c in Counter(tuple(text[i : i + n]) for i in range(len(text) - n + 1)).items() if c >= 12} for n in (1, 2, 3)}
    grams[1] = {(w,): c for w, c in sorted(Counter(text).items())}
    unigram = [math.log10(c / 500) for _, c in sorted(Counter(text).items())]
    automaton = lm.Automaton(grams, unigram)
    for _ in range(50):
        walk = [rng.randrange(4) for _ in range(9)]
        want = sum(math.log10(_direct(grams, unigram, tuple(walk[max(0, i - 2) : i]), w)) for i, w in enumerate(walk))
        assert automaton.walk(walk) == pytest.approx(want, abs=1e-9)
    total = sum(10 ** automaton.walk([1, 0, w]) for w in range(4)) / 10 ** automaton.walk([1, 0])
    assert total == pytest.approx(sum(10**u for u in unigram), abs=0.2)


def _automaton_score(texts, scored):
    """Scores by the automaton in memory over all n-grams that occur twice."""
    tokens = [lm.tokens_of(t) for t in texts]
    counts = Counter(w for t in tokens for w in t)
    number = {w: i for i, w in enumerate(sorted(counts))}
    ids = [[number[w] for w in t] for t in tokens]
    grams = {n: {g: c for g, c in Counter(tuple(t[i : i + n]) for t in ids for i in range(len(t) - n + 1)).items() if n == 1 or c >= 2} for n in (1, 2, 3)}
    below = sum(counts.values()) + 0.5 * (len(counts) + 1)
    automaton = lm.Automaton(grams, [math.log10((counts[w] + 0.5) / below) for w in sorted(counts)])
    out = []
    for t in scored:
        at = [number.get(w, -1) for w in lm.tokens_of(t)]
        out.append(automaton.walk(at) + sum(x < 0 for x in at) * math.log10(0.5 / below))
    return out


def test_table_walk_is_the_automaton_walk(spark, data):
    training = [d[1] for d in data if brute.fold(d[0]) != 1]
    docs = spark.createDataFrame([(i, d[1]) for i, d in enumerate(data)], "doc_id long, text string")
    got = lm.score(docs, spark.createDataFrame([(t,) for t in training], "text string"))
    want = _automaton_score(training, [d[1] for d in data])
    for r in got.collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6)


def test_scores_do_not_depend_on_the_groups(spark, docs, monkeypatch):
    """One group of all texts, or groups of a few rows each that ask about one another's n-grams."""
    rows = docs.select("doc_id", "text")
    learned = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    whole = sorted(lm.score(rows, learned).collect(), key=repr)
    monkeypatch.setattr(lm, "GROUP_BYTES", 700)
    parts = sorted(lm.score(rows, learned).collect(), key=repr)
    assert len(whole) == len(parts) == docs.count()
    by_row = [sorted(((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in x)) for x in (whole, parts)]
    for a, b in zip(*by_row, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-9)


def test_states_do_not_depend_on_the_size_of_the_corpus(spark):
    rare = "x y z"  # twice in over two million tokens
    filler = " ".join(["p q r s"] * 10_000)
    texts = [filler] * 55 + [rare, rare]
    got = lm.score(spark.createDataFrame([(1, rare)], "doc_id long, text string"), spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)).first()
    assert got["train_tokens"] > 2_200_000
    below = got["train_tokens"] + 0.5 * (8 + 1)
    one = 2.5 / below
    pair = (2 + lm.PRIOR * one) / (2 + lm.PRIOR)
    triple = (2 + lm.PRIOR * pair) / (2 + lm.PRIOR)
    end = 57.5 / below
    last = (2 + lm.PRIOR * (2 + lm.PRIOR * end) / (2 + lm.PRIOR)) / (2 + lm.PRIOR)
    assert got["score"] == pytest.approx(math.log10(one) + math.log10(pair) + math.log10(triple) + math.log10(last), abs=1e-9)


def test_scores_of_odd_tables(spark, empty):
    assert lm.score(empty, empty).count() == 0
    docs = brute.frame(spark, [(None, "A b", "", "", 0), (3, None, "", "", 0)])
    got = {r["doc_id"]: r for r in lm.score(docs, empty).collect()}
    assert got[None]["n_tokens"] == 3 and got[3]["n_tokens"] == 1 and got[3]["score"] is None


# --- sketches ---------------------------------------------------------------------------------


def _sketch(text):
    w = brute.words(text)
    h = {_chained(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {x for x in h if x < -(1 << 63) + fingerprints.FRACTION * (1 << 64)}
    return sorted(low or ({min(h)} if h else set()))


def _near(a, b):
    if not a and not b:
        return 1.0
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def test_op7_matches_brute_force(spark, sf_dir, data):
    ordered = sorted(((d[0], d[1] or "") for d in data), key=lambda d: d[0])
    got = fingerprints.op7(spark, sf_dir).collect()
    assert len(got) == len(data)
    want = Counter()
    for (doc, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b = _sketch(text), _sketch(edited)
        printed = "".join(f"{x & (1 << 64) - 1:016x}" for x in a)
        want[(doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed, round(_near(a, b), 9), round(_near(a, _sketch(after)), 9))] += 1
    found = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    assert found == want


def test_sketches_merge(spark):
    df = spark.createDataFrame([(" ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(40)))], "a string, b string")
    df = fingerprints.fingerprint(fingerprints.fingerprint(df, "sa", "a"), "sb", "b")
    row = df.select("sa", "sb", fingerprints.merged(F.col("sa"), F.col("sb")).alias("m"), fingerprints.containment(F.col("sb"), fingerprints.merged(F.col("sa"), F.col("sb"))).alias("c")).first()
    assert set(row["m"]) == set(row["sa"]) | set(row["sb"]) and row["c"] == 1.0


def test_sketches_of_odd_tables(spark, empty):
    assert fingerprints.fingerprint(empty).count() == 0
    assert fingerprints.with_next(empty, "doc_id", ["text"]).count() == 0
    rows = brute.frame(spark, [(None, "a", "", "", 0), (5, "b", "", "", 0), (5, "b", "", "", 0)])
    got = fingerprints.with_next(rows, "doc_id", ["text"]).collect()
    assert sorted((r["doc_id"] or 0, r["next_text"]) for r in got) == [(0, "b"), (5, "a"), (5, "b")]


# --- SimHash ----------------------------------------------------------------------------------


def test_op9_matches_all_pairs(spark, sf_dir, data):
    def finger(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d[0]: finger(d[1]) for d in data}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = simhash.op9(spark, sf_dir).collect()
    assert len(got) == len(data)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(d, f"{p:016x}", find(d)) for d, p in prints.items()}


def test_bucket_links_span_all_near_pairs(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(30)]
    for v in list(values):
        for _ in range(4):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            values.append(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    group = {i: i for i in range(len(values))}
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = {k: b if g == a else g for k, g in group.items()}
    for i in range(len(values)):
        for j in range(i):
            a, b = signed[i][0], signed[j][0]
            assert (group[i] == group[j]) == (a == b or got.get(a, a) == got.get(b, b))


def test_tree_search_is_exact():
    rng = random.Random(4)
    tree, values = simhash.BKTree(), [rng.getrandbits(10) for _ in range(200)]
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.near(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_near_duplicates_of_odd_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    docs = brute.frame(spark, [(None, "a b c", "", "", 0), (4, "a b c", "", "", 0), (4, "a b c", "", "", 0), (6, None, "", "", 0), (7, " ", "", "", 0)])
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == {(None, 4): 1, (4, 4): 2, (6, 6): 1, (7, 6): 1}
    assert sorted((r["doc_id"] or 0) for r in simhash.one_of_each(docs).collect()) == [0, 4, 6]
