import math
import random
from collections import Counter

import brute
import corpus_pipeline
import duckdb
from scanfleet.llm import catalog, langid, mixing


def test_op1_matches_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet/*.parquet'")
    columns = ["doc_id", "domain", "lang", "source", "epoch", "tokens", "taken", "leaf_budget"]
    want = Counter(con.sql(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL['op1_hierarchical_mix']})").fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in mixing.op1(spark, sf_dir).collect()) == want


def _split(budget, children):
    """Shares of (cap, weight) children by filling the tightest first; real numbers."""
    out, left = {}, dict(children)
    while left:
        level = budget / sum(w for _, w in left.values())
        tight = {k: c for k, (c, w) in left.items() if c <= level * w}
        if not tight:
            return out | {k: level * w for k, (_, w) in left.items()}
        out |= tight
        budget -= sum(tight.values())
        left = {k: v for k, v in left.items() if k not in tight}
    return out


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", 10), ("a", "y", 500), ("b", "x", 5), ("b", "y", 8), (None, "x", 1000)]
    df = spark.createDataFrame(leaves, "top string, low string, most long")
    got = {(r["top"], r["low"]): r["budget"] for r in mixing.budgets(df, 300, ["top", "low"], [{"a": 2}, {"y": 3}]).collect()}
    tops = _split(300, {"a": (510, 2), "b": (13, 1), None: (1000, 1)})
    for top, total in tops.items():
        want = _split(total, {low: (m, 3 if low == "y" else 1) for t, low, m in leaves if t == top})
        for low, share in want.items():
            assert abs(got[(top, low)] - share) <= 1
    assert sum(got.values()) == 300
    assert got[("a", "x")] == 10 and got[("b", "y")] == 8


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, domain string, lang string, source string, tokens long, taken string"
    rows = [(None, "d", None, None, 10, "z"), (1, "d", None, None, None, "z"), (2, "d", "en", "s", 4, "z"), (2, "d", "en", "s", 4, "z")]
    got = mixing.mix(spark.createDataFrame(rows, schema), 1000, epochs=2).collect()
    assert Counter((r["doc_id"], r["epoch"], r["taken"]) for r in got) == {(None, 0, 10): 1, (None, 1, 10): 1, (1, 0, 0): 1, (1, 1, 0): 1, (2, 0, 4): 2, (2, 1, 4): 2}
    assert mixing.mix(spark.createDataFrame([], schema), 10).count() == 0


def test_prefix_is_seeded_and_exact(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'d' as domain", "'en' as lang", "'s' as source", "id % 7 as tokens")
    a = mixing.mix(docs, 700, seed=1).collect()
    assert sum(r["taken"] for r in a) == 700
    assert sum(r["taken"] < r["tokens"] for r in a) <= 1
    assert {r["doc_id"] for r in a} != {r["doc_id"] for r in mixing.mix(docs, 700, seed=2).collect()}


def test_pipeline_stages(spark, sf_dir, data):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["language_id", "simhash_near_dedup", "substring_dedup", "source_mix", "best_fit_packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != names[-1]:
            assert out.schema == docs.schema
        kept[name] = out.collect()
        docs = out
    texts = {r[0]: r[1] for r in data}
    first = {r["doc_id"] for r in kept["language_id"]}
    assert first == {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    second = [r["doc_id"] for r in kept["simhash_near_dedup"]]
    assert len(second) == len(set(second)) and 3 in second and 7 not in second
    shared = " ".join(f"shared{i}" for i in range(70))
    third = {r["doc_id"]: r["text"] for r in kept["substring_dedup"]}
    assert set(third) == set(second)
    assert sum(shared in t for t in third.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substring_dedup"])
    words = {d: len(brute.words(t)) for d, t in third.items()}
    fourth = {r["doc_id"]: r["text"] for r in kept["source_mix"]}
    assert fourth.items() <= third.items()
    assert sum(words[d] for d in fourth) >= math.floor(0.5 * sum(words.values()))
    last = kept["best_fit_packing"]
    assert {r["doc_id"] for r in last} == set(fourth)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(last)


def test_every_operator_is_registered_once():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert langid.UNKNOWN == "und"


def _shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_stage_finds_four_fifths(spark):
    rng = random.Random(5)
    texts = []
    for edits, pairs in ((6, 60), (3, 20), (2, 20), (8, 20)):  # likeness 0.82, 0.90, 0.93; 0.76 stays
        for _ in range(pairs):
            words = [f"w{rng.randrange(4000)}" for _ in range(300)]
            texts.append(" ".join(words))
            for i in range(edits):
                words[10 + 30 * i] += "x"
            texts.append(" ".join(words))
    template = [f"t{i}" for i in range(200)]
    for i in range(700):  # one dense group, wider than a window
        copy = list(template)
        copy[rng.randrange(5, 195)] = f"e{i}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "one two", "one two", "one three"]
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if find(i) != find(j) and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = brute.frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)])
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=lambda d: -1 if d is None else d) == [None, *sorted({find(i) for i in root})]
    assert len(got) == 1 + 100 + 2 * 20 + 1 + 2


def test_near_dedup_stage_loses_no_link_among_texts_of_one_template(spark):
    """Pairs at 0.82 in a corpus whose other texts have a likeness of 0.75 to each of them."""
    rng, fresh = random.Random(9), iter(range(10**9))
    template = [f"t{i}" for i in range(244)]
    texts = []
    for i in range(300):
        words = template + [f"u{next(fresh)}" for _ in range(40)]
        texts.append(words)
        if i < 40:
            texts.append([*words[:-28], *[f"u{next(fresh)}" for _ in range(28)]])
    sets = [_shingles(" ".join(t)) for t in texts]
    likeness = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert likeness(0, 1) >= 0.8 and 0.7 < likeness(0, 2) < 0.8
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, brute.frame(spark, rows), "").collect()}
    assert kept == {i for i in range(len(texts)) if i >= 80 or i % 2 == 0}


def test_near_dedup_stage_of_an_empty_table(spark, empty):
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0


def test_near_dedup_stage_links_what_its_simhash_finds(spark, monkeypatch):
    """Copies with one word in 2,000 changed are candidates by SimHash alone: here no bucket of minima pairs anything."""
    from scanfleet.llm import minhash

    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(9000)}" for _ in range(2000)]
        texts += [" ".join(words), " ".join([*words[:-1], "changed"])]
    texts += ["", None, "one two"]
    monkeypatch.setattr(minhash, "paired", lambda dealt: dealt.selectExpr("node AS a", "least AS b", "true AS star").limit(0))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, brute.frame(spark, rows), "").collect()}
    assert kept == {*range(0, 24, 2), 24, 26}
