import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from scanfleet.llm import catalog, manifest, minhash, prefixes, trie

EMPTY = hashlib.sha256(b"").hexdigest()


def _sql(name, table, df, tmp_path):
    folder = str(tmp_path / table)
    df.write.parquet(folder)
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/*.parquet'")
    rel = con.sql(catalog.ORACLE_SQL[name])
    return rel.columns, Counter(rel.fetchall())


# --- MinHash ----------------------------------------------------------------------------------


def _shingles(text, n=2):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in brute.words(text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _components(data, n=2):
    sets = defaultdict(list)
    for d, text, *_ in data:
        if d is not None:
            sets[d].append(_shingles(text, n))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def _near_rows(seed):
    """Chains, boundaries at exactly four fifths, copies, one-word texts, repeated and null rows."""
    rng = random.Random(seed)
    out = brute.rows(seed, 30)
    for i in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 40))]
        for j in range(rng.randrange(1, 5)):
            changed = list(base)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(len(changed))] = f"z{rng.randrange(400)}"
            out.append((1000 + 10 * i + j, " ".join(changed).upper() if j % 2 else " ".join(changed), "en", "s", 1))
    out += [(2000, "a b c d e f g h i j", "en", "s", 1), (2001, "a b c d e f g h i", "en", "s", 1), (2002, "x", None, None, None), (2003, "X", None, None, None), (2004, "x y", None, None, None)]
    return [*out, out[-1], (None, "x", None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_components_equal_brute_force(spark, seed):
    data = _near_rows(seed)
    got = minhash.near_duplicates(brute.frame(spark, data).withColumnRenamed("lang", "node").withColumnRenamed("source", "label")).collect()
    want = _components(data)
    assert len(got) == len(data)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    sizes = {(d, len(_shingles(t))) for d, t, *_ in data}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_op11_and_its_sql(spark, tmp_path):
    data = [r for r in _near_rows(3) if r[0] is not None]
    columns, want = _sql("op11_minhash_components", "documents", brute.frame(spark, list(dict.fromkeys(data))), tmp_path)
    folder = str(tmp_path / "in")
    brute.frame(spark, list(dict.fromkeys(data))).write.parquet(f"{folder}/documents.parquet")
    assert Counter(tuple(r[c] for c in columns) for r in minhash.op11(spark, folder).collect()) == want


def test_minhash_of_an_empty_table(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("shared", [0.75, 0.68, 0.57])
def test_no_link_is_lost_among_texts_of_one_template(spark, shared):
    """Pairs just over the threshold, in a corpus whose other texts all share a long template with them."""
    rng = random.Random(7)
    fresh = iter(range(10**9))
    template = [next(fresh) for _ in range(240)]
    own = round(240 * (1 / shared - 1) / 2)  # so that two texts have a Jaccard of ``shared``
    sets, planted = [], []
    for i in range(500):
        mine = [next(fresh) for _ in range(own)]
        sets.append(template + mine)
        if i < 60:
            n = 240 + own
            swap = n // 10  # Jaccard (n - s) / (n + s) of about 0.818
            twin = [*(template + mine)[: n - swap], *[next(fresh) for _ in range(swap)]]
            planted.append((2 * i, 2 * i + 1))
            sets[-1:] = [sets[-1], twin]
            assert len(set(sets[-1]) & set(sets[-2])) / len(set(sets[-1]) | set(sets[-2])) >= 0.8
        else:
            sets.append([*template, *[next(fresh) for _ in range(own)]])
    rows = [(i, " ".join(f"{v}" for v in s), None, None, None) for i, s in enumerate(sets)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(brute.frame(spark, rows), words=1).collect()}
    assert all(got[a] == got[b] for a, b in planted)


def test_prefixes_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    rows = []
    for i in range(120):
        kept = base[rng.random(len(base)) < 0.93]
        rows.append((i, i, np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)]))))
    frame = spark.createDataFrame([(a, b, bytearray(s.tobytes())) for a, b, s in rows], "node long, label long, shingles binary")
    met = {(r["a"], r["b"]) for r in prefixes.crossing(frame, (4, 5)).collect()}
    want = {(a, b) for a, _, x in rows for b, _, y in rows if a > b and prefixes.alike(x, y, (4, 5))}
    assert want and want <= met
    links = prefixes.verified(spark.createDataFrame(sorted(met), "a long, b long"), frame, (4, 5))
    assert {(r["a"], r["b"]) for r in links.collect()} == want
    one = frame.selectExpr("node", "1L as label", "shingles")
    assert prefixes.crossing(one, (4, 5)).count() == 0


# --- Merkle manifest --------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    doc, text, lang, source, n = row
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def _tree(hashes):
    """Root and, for each leaf, its list of (left, right) sibling digests."""
    nodes, ways = [(h, [i]) for i, h in enumerate(hashes)], [[] for _ in hashes]
    while len(nodes) > 1:
        up = []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for i, (_, under) in enumerate(run):
                for x in under:
                    ways[x].append(("".join(h for h, _ in run[:i]), "".join(h for h, _ in run[i + 1 :])))
            up.append((_h(*[h for h, _ in run]), [x for _, under in run for x in under]))
        nodes = up
    return nodes[0][0], ways


def _manifest(data):
    by = defaultdict(list)
    for r in data:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        rows = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[s] = (rows, *_tree([_leaf(r) for r in rows]))
    root, tops = _tree([trees[s][1] for s in order])
    out = Counter()
    for s, top in zip(order, tops, strict=True):
        rows, subroot, ways = trees[s]
        for r, way in zip(rows, ways, strict=True):
            bad = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[1] is None else (r[0], r[1].replace("\n", ""), *r[2:])
            folded = _leaf(bad)
            for left, right in way + top:
                folded = _h(left, folded, right)
            out[(r[0], _leaf(r), subroot, root, _h(*[a + b for a, b in way + top]), folded, folded == root)] += 1
    return out


@pytest.mark.parametrize("n", [1, 2, 10, 60])
def test_manifest_equals_a_tree_built_by_hand(spark, n):
    data = [*brute.rows(2, 60)[:n], (None, "a\nb", None, "src9", None), (None, "a\nb", None, "src9", None)]
    data = data if n > 1 else data[:1]
    frame = brute.frame(spark, data).selectExpr("*", "1 as leaf", "2 as tree", "3 as pos", "4 as h")
    got = manifest.manifest(frame)
    assert Counter(tuple(r) for r in got.collect()) == _manifest(data)


def test_op12_and_its_sql(spark, sf_dir, tmp_path, docs):
    columns, want = _sql("op12_merkle_manifest", "documents", docs, tmp_path)
    assert Counter(tuple(r[c] for c in columns) for r in manifest.op12(spark, sf_dir).collect()) == want


def test_manifest_of_an_empty_table(spark, empty):
    assert manifest.manifest(empty).count() == 0


# --- Conversation trie ------------------------------------------------------------------------

KIND = "conv_id long, turn long, role string, text string, depth string, path int"


def _conversations(seed):
    rng, out = random.Random(seed), []
    for c in [*range(0, 25), 100, 103, 107, 205, 206, 900]:
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é" * 5, "", None, "x" * 3000]), "d", 1))
    out += [(30 + i, t, "user", f"same {t}", None, None) for i in range(12) for t in range(4)]
    out += [(60, None, "user", "first", None, None), (60, 1, "user", "b", None, None), (60, 1, "user", "a", None, None), (60, 1, "user", "a", None, None), (None, 1, "user", "nobody", None, None)]
    rng.shuffle(out)
    return out


def _trie(data):
    orig = defaultdict(list)
    for c, t, role, text, *_ in data:
        if c is not None:
            role, text = role or "", text or ""
            orig[c].append((t is not None, t or 0, _h(f"{len(role.encode())}:", role, text), text))
    orig = {c: [(k, text) for *_, k, text in sorted(v)] for c, v in orig.items()}
    built = {}
    for c, own in orig.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = orig.get(c - c % 100, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in sorted(built.items()):
        for d in range(len(path) + 1):
            members[tuple(k for k, _ in path[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved, out = Counter(), Counter(), Counter()
    for p, of in members.items():
        size = len(built[of[0]][len(p) - 1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(of) - 1) * size
    for p, of in members.items():
        ends = ",".join(str(c) for c in of if len(built[c]) == len(p))
        out[(of[0], len(p), members[p[:-1]][0] if p else None, len(of), kids[p], leaves[p], saved[p], _h(ends))] += 1
    return out


@pytest.mark.parametrize(("seed", "single", "held"), [(1, 16, 10**6), (2, 2, 10**6), (3, 0, 40)])
def test_trie_equals_brute_force_and_sql(spark, seed, single, held, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "LISTED", 3)  # so that nodes have several strings of ids
    monkeypatch.setattr(trie, "SINGLE", single)
    monkeypatch.setattr(trie, "HELD", held)
    data = _conversations(seed)
    frame = spark.createDataFrame(data, KIND).repartition(3)
    want = _trie(data)
    assert Counter(tuple(r) for r in trie.trie(frame).collect()) == want
    columns, sql = _sql("op13_prefix_trie", "conversations", frame, tmp_path)
    assert columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sql == want


def test_trie_of_odd_tables(spark):
    assert trie.trie(spark.createDataFrame([], KIND)).count() == 0
    # 105 takes five turns of a conversation that is not there and has fewer of its own: a member of the root.
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = trie.trie(spark.createDataFrame([(alone, 0, "user", "x", None, None)], KIND)).collect()
    assert [tuple(r) for r in got] == [(alone, 0, None, 1, 0, 1, 0, _h(str(alone)))]
    assert EMPTY == _h("")
