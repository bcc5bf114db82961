import random

import brute
import pytest
from scanfleet.llm import automata, columnwise, repeats


def _found(rows, as_bytes):
    return {r[0]: (r[1], r[2], r[3]) for r in rows} if as_bytes else {r[0]: (r[1], r[2]) for r in rows}


@pytest.mark.parametrize("hot", [1000, 1])
def test_op8_matches_brute_force(spark, sf_dir, data, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = automata.op8(spark, sf_dir).collect()
    want = brute.repeats(data, False)
    assert len(got) == len(data)
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == {d: (w[0], w[1], w[3]) for d, w in want.items()}
    assert sum(w[1] for w in want.values()) > 500


@pytest.mark.parametrize("hot", [1000, 1])
def test_op10_matches_brute_force(spark, sf_dir, data, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = columnwise.op10(spark, sf_dir).collect()
    assert len(got) == len(data)
    assert {r[0]: tuple(r)[1:] for r in got} == brute.repeats(data, True)


def test_null_ids_clashing_columns_and_empty_tables(spark, empty):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, passage, "x", "s", 1), (1, passage, "x", "s", 1), (2, passage + " tail", "x", "s", 1)]
    docs = brute.frame(spark, rows).withColumnRenamed("lang", "n_removed").withColumnRenamed("source", "part")
    got = {r["doc_id"]: r for r in automata.remove_repeated_words(docs).collect()}
    assert {k: r["n_removed"] for k, r in got.items()} == {None: 0, 1: 0, 2: 60}
    assert got[2]["kept_text"] == "tail" and got[2]["part"] == "s"
    assert automata.remove_repeated_words(empty).count() == 0
    assert columnwise.remove_repeated_bytes(empty).count() == 0


def test_whole_characters_stay_whole(spark):
    text = "é" * 40
    docs = brute.frame(spark, [(1, "x" + text, "", "", 0), (2, "y" + text + "z", "", "", 0)])
    got = {r["doc_id"]: r for r in columnwise.remove_repeated_bytes(docs, characters=True).collect()}
    assert bytes(got[2]["kept_bytes"]).decode() == "yz"


def test_automaton_matching_statistics():
    rng = random.Random(5)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        automaton = automata.SuffixAutomaton()
        for t in texts[:3]:
            automaton.add(t)
        subs = {tuple(t[i:j]) for t in texts[:3] for i in range(len(t)) for j in range(i, len(t) + 1)}
        want = [max(n for n in range(i + 2) if tuple(texts[3][i + 1 - n : i + 1]) in subs) for i in range(len(texts[3]))]
        assert automaton.matches(texts[3]) == want


def test_column_wise_order_is_the_sorted_order(tmp_path):
    rng = random.Random(6)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(5)]
        columns = columnwise.Columns(str(tmp_path))
        columnwise.suffix_order(texts, columns)
        owner, size, lcp = columns.read("owner").tolist(), columns.read("size").tolist(), columns.read("lcp").tolist()
        got = [(texts[o][len(texts[o]) - n :], o) for o, n in zip(owner, size, strict=True)]
        assert got == sorted(got)
        assert len(got) == sum(len(t) + 1 for t in texts)
        for (a, _), (b, _), n in zip(got, got[1:], lcp[1:], strict=False):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
