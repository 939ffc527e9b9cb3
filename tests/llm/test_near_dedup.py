import random

import numpy as np
import pytest

from parcelyard.llm import near_dedup as nd

SCHEMA = "doc_id bigint, text string, component_id string, keys int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def brute(rows, width=5):
    """Components by comparing all pairs of sets of whole shingles."""

    def shingles(text):
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    out, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 9)):
            own = list(base)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = word()
            out.append((k, " ".join(own)))
            k += 1
    return out


def test_same_as_brute_force(spark):
    rows = corpus() + [(1000, ""), (1001, "   \n"), (1002, "One two"), (1003, "one TWO"), (1004, "one two three"), (1005, "É ß x y z w")]
    want, sizes = brute(rows)
    got = {r["doc_id"]: r for r in nd.near_duplicates(docs(spark, rows)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    rows = corpus(5)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)[0]


def test_odd_rows(spark):
    long = " ".join(str(k) for k in range(60))
    rows = [(5, long), (5, long), (5, "another text of some words"), (7, long), (None, long), (None, None), (8, None), (9, "")]
    got = nd.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 7)} == {5}
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] == 0 and r["doc_id"]} == {(8, 8), (9, 9)}
    kept = nd.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "component_id", "keys"]
    # Both texts of id 5 stay: they differ, though one near_duplicates node stands for the id.
    assert sorted(str((r["doc_id"], (r["text"] or "")[:7])) for r in kept.collect()) == sorted(map(str, [(5, "0 1 2 3"), (5, "another"), (8, ""), (9, ""), (None, "0 1 2 3"), (None, "")]))


def test_keep_one_of_repeated_ids_and_unordered_columns(spark):
    long, other = " ".join(str(k) for k in range(60)), " ".join(str(k) for k in range(100, 160))
    rows = [(1, long, {"a": 1}), (1, other, {"a": 2}), (1, other, {"a": 3}), (2, long + " x", {}), (3, other + " x", None), (None, long, {"b": 1}), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row_id map<string,int>")
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert len(got) == 4 and got[0] == (0, long) and (4, "") in got
    assert sum(t.startswith("0 1 2") for i, t in got if i) == 1 and sum(t.startswith("100") for _, t in got) == 1


def test_bucket_with_one_large_component(spark, monkeypatch):
    """One large group of near copies and texts of other groups that share its passages: the large group's blocks meet the others only."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    r = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = list(base)
        own[r.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(own)))
    for k in range(60, 84):
        own = base[: r.randint(40, 56)] + [f"y{k % 6}z{j}" for j in range(r.randint(4, 24))]
        rows.append((k, " ".join(own)))
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in nd.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)[0]


def test_sets_are_bounded_in_bytes():
    sets = nd.Sets(5, limit=2000)
    for k in range(40):
        sets(k, b" ".join(b"%d" % (j + k) for j in range(50)))
    assert sets.size <= 2000 and len(sets.held) >= 2


def test_empty_table(spark):
    assert nd.near_duplicates(docs(spark, [])).count() == 0 and nd.keep_one(docs(spark, [])).count() == 0


def test_estimate_is_unbiased():
    r = np.random.RandomState(0)
    a = np.unique(r.randint(0, 2**63, 900).astype(np.uint64))
    shared = a[:600]
    b = np.concatenate([shared, r.randint(0, 2**63, 300).astype(np.uint64)])
    sa, sb = nd.sketch(a)[1].view(np.uint64), nd.sketch(b)[1].view(np.uint64)
    z = sa ^ sb
    z |= z >> np.uint64(1)
    z |= z >> np.uint64(2)
    same = nd.K - int(np.bitwise_count(z & np.uint64(0x1111111111111111)).sum())
    assert nd.corrected(same) == pytest.approx(600 / 1200, abs=0.12)
    assert nd.fewest_matches(0.75) < nd.K * 0.75


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(200, 100)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in nd.components(links).collect()}
    assert all(got[k] == 0 for k in range(51)) and got[200] == 100
