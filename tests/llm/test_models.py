"""Language-model scores and nearest neighbours against plain versions."""

import gc
import math
import random
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest

from parcelyard.llm import ann, lm_scoring


def texts(n=220, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(120)]
    pick = lambda: words[min(int(r.expovariate(0.06)), 119)]
    return [" ".join(pick() for _ in range(r.randint(1, 60))) + r.choice(["", ".", "\n"]) for _ in range(n)]


def test_scores(spark):
    rows = [*enumerate(texts()), (900, None), (901, ""), (901, ""), (None, "no id here"), (902, "A\tB  \n\n c")]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id bigint, text string, bucket string, score double")
    got = lm_scoring.scores(docs, bucket_bytes=4000, part_bytes=6000).collect()
    assert len(got) == len(rows)
    split = {i: (t or "").lower().split() for i, t in rows}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in [*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    for r in got:
        own = [*split[r["doc_id"]], None]
        assert r["held_out"] == out(r["doc_id"]) and r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(c[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0
        size = len((dict(rows)[r["doc_id"]] or "").encode())
        assert r["bits_per_byte"] == (pytest.approx(-r["score"] / math.log10(2) / size) if size else None)
    assert len({r["score"] for r in got if r["doc_id"] == 901}) == 1


def test_held_out_texts_beat_the_base_score(spark):
    """Words that follow one of three others: what the word before tells is worth some digits a token."""
    r = random.Random(4)
    words = ["".join(r.choice("aeioulnrst") for _ in range(5)) for _ in range(150)]
    after = {w: [r.choice(words) for _ in range(3)] for w in words}
    rows = []
    for k in range(400):
        own = [r.choice(words)]
        while len(own) < 60:
            own.append(r.choice(after[own[-1]]))
        rows.append((k, " ".join(own)))
    got = [x for x in lm_scoring.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if x["held_out"]]
    assert len(got) > 30 and all(x["score"] > x["base_score"] for x in got)
    assert sum(x["score"] for x in got) > 0.5 * sum(x["base_score"] for x in got)


def test_tables_summed_in_steps(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(80))), "doc_id bigint, text string")
    once = {r["doc_id"]: r["score"] for r in lm_scoring.scores(docs, bucket_bytes=1500, part_bytes=1500).collect()}
    monkeypatch.setattr(lm_scoring, "MOST_SENDERS", 1)
    assert {r["doc_id"]: r["score"] for r in lm_scoring.scores(docs, bucket_bytes=1500, part_bytes=1500).collect()} == pytest.approx(once)


def test_scores_of_an_empty_table(spark):
    assert lm_scoring.scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_scores_without_training_rows(spark):
    i = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = lm_scoring.scores(spark.createDataFrame([(i, "some text")], "doc_id bigint, text string")).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0


def test_order_of_words_and_other_copies_count(spark):
    r = random.Random(9)
    words = ["".join(r.choice("aeioulnrst") for _ in range(5)) for _ in range(60)]
    once = [" ".join(r.choice(words) for _ in range(80)) for _ in range(60)]
    shuffled = " ".join(sorted(once[0].split(), key=lambda w: r.random()))
    rows = [*enumerate(once), (100, once[0]), (101, shuffled), (102, once[0])]
    got = {x["doc_id"]: x["score"] for x in lm_scoring.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    single = [got[k] for k in range(1, 60)]
    assert min(got[0], got[100], got[102]) > max(single) + 30 and got[101] < max(single) + 20


def model_of(train, others):
    """token_scores of ``others`` (text, trained) after counting ``train``; weights as they start."""
    counts = Counter(w for t in train for w in [*lm_scoring.split(t), lm_scoring.END])
    tables = np.zeros((len(lm_scoring.ORDERS), 2, 1 << lm_scoring.SLOT_BITS), np.float32)
    lm_scoring.count_spelling(sorted(counts), tables)
    seen = lm_scoring.Bucket(train, np.ones(len(train), bool), 1)
    cells = np.bincount((seen.hash[seen.type] >> np.uint64(64 - lm_scoring.PATH - lm_scoring.CELL)).astype(np.int64), minlength=2 ** (lm_scoring.PATH + lm_scoring.CELL))
    pairs = np.bincount(lm_scoring.pair_codes(seen.hash[seen.type], seen.before), minlength=2 ** (lm_scoring.BEFORE + lm_scoring.PATH))
    totals = lm_scoring.Totals(sum(counts.values()), len(counts), sum(n == 1 for n in counts.values()), cells, pairs)
    asks = lm_scoring.Bucket([t for t, _ in others], np.array([y for _, y in others]), 1)
    plain = lm_scoring.Bucket([t for t, _ in others], np.zeros(len(others), bool), 1)
    requests = [next(x[1:] for x in b.sent(1)) for b in (seen, plain)]
    answers = list(np.frombuffer(lm_scoring.unsqueeze(lm_scoring.answered(requests)[1]), np.uint8).reshape(lm_scoring.PATH + 2, -1))
    own = np.array([counts[w] for w in asks.types])
    tables = lm_scoring.SpellingTables(tables)
    log = lm_scoring.token_scores(asks, answers, own, totals, tables, np.zeros(0, np.int64))
    return [log[asks.doc == d] for d in range(len(others))], totals, tables


def test_a_text_is_left_out_of_its_own_counts():
    """Scored as a training text, it gets what it gets from counts without it."""
    train = [t.encode() for t in texts(40)]
    one, totals, tables = model_of(train, [(train[3], True)])
    rest = train[:3] + train[4:]
    counts = Counter(w for t in rest for w in [*lm_scoring.split(t), lm_scoring.END])
    two, *_ = model_of(rest, [(train[3], False)])
    known = np.array([counts[w] > 0 for w in [*lm_scoring.split(train[3]), lm_scoring.END]])
    # Totals of the hash's cells are those of the whole corpus in both: of 40 texts one matters little.
    assert np.abs(one[0] - two[0])[known].mean() < 0.05
    assert one[0].sum() == pytest.approx(two[0].sum(), rel=0.03)
    kept, *_ = model_of(train, [(train[3], False)])
    assert kept[0].sum() > one[0].sum() + 2


def test_probabilities_of_all_words_sum_to_one():
    train = [t.encode() for t in texts(60)]
    words = sorted({w for t in train for w in lm_scoring.split(t)})
    two = lm_scoring.split(train[0])[:2]
    asked = [(b" ".join([*two, w]), False) for w in words] + [(b" ".join([*two, b"zzqqy"]), False), (b" ".join(two), False)]
    logs, totals, tables = model_of(train, asked)
    known = sum(10 ** log[2] for log in logs[:-2]) + 10 ** logs[-1][2]
    new = 10 ** (logs[-2][2] - lm_scoring.Spelling(tables).log10([b"zzqqy"], np.zeros(1, np.int64))[0])
    assert 0.95 < known + new <= 1.0 + 1e-6  # paths that no word has hold the rest
    first = lm_scoring.Nodes([bytes([b]) for b in range(256)])
    spelling = lm_scoring.Spelling(tables)
    log = sum(spelling.mixer.log10(x, gate, bit) for x, gate, bit in spelling.decisions(first, 0))
    assert (10 ** first.per_word(log)).sum() == pytest.approx(1.0)


def test_counts_along_paths():
    r = np.random.RandomState(3)
    context, cell, n = r.randint(0, 9, 500), r.randint(0, 2**20, 500) & 0b11000011000000000011, r.randint(0, 50, 500)
    keys = (context.astype(np.uint64) << np.uint64(20)) | cell.astype(np.uint64)
    halves = [(lm_scoring.squeeze_numbers(u), lm_scoring.squeeze(np.bincount(at, c).astype(np.uint32).tobytes()), u) for k, c in ((keys[:250], n[:250]), (keys[250:], n[250:])) for u, at in [np.unique(k, return_inverse=True)]]
    given = lm_scoring.answered([h[:2] for h in halves])
    for (_, _, own), g in zip(halves, given, strict=True):
        got = np.frombuffer(lm_scoring.unsqueeze(g), np.uint8).reshape(lm_scoring.PATH + 2, -1)
        for at, k in enumerate(own.tolist()):
            for place, shift in enumerate([*range(20, 11, -1), 0]):
                true = sum(c for key, c in zip(keys.tolist(), n.tolist(), strict=True) if key >> shift == k >> shift)
                assert lm_scoring._VALUES[got[place, at]] == (true if true <= 32 else pytest.approx(true, rel=0.09))


def exact(ids, vectors, k):
    out = {}
    for q, v in zip(ids, vectors, strict=True):
        if q % 20 == 0:
            s = [(-float(np.dot(v, w)), i) for i, w in zip(ids, vectors, strict=True) if i != q]
            out[q] = [i for _, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize(("relax", "least"), [(1.0, 1.0), (1.6, 0.9)])
def test_neighbours(spark, relax, least):
    r = np.random.RandomState(2)
    v = r.randn(400, 12) * r.uniform(0.5, 2, (400, 1))
    v[100:130] = v[100]
    rows = spark.createDataFrame([(k, x.tolist(), "c") for k, x in enumerate(v)], "vec_id bigint, embedding array<double>, rank string")
    got = {}
    for x in ann.nearest(rows, lambda c: c % 20 == 0, k=10, relax=relax, shard_rows=90).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    want = exact(range(400), v, 10)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= least
    if relax == 1.0:
        assert got == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [1.0, None]), (4, [1.0, 2.0, 3.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, lambda c: c % 20 == 0, k=5).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 2, 0.5)]
    assert ann.nearest(df.where("false"), lambda c: c % 20 == 0).count() == 0


def test_each_length_and_each_row_of_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0]), (40, [1.0, 1.0, 1.0]), (3, [2.0, 0.0, 0.0]), (60, [5.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, embedding array<double>, row string, length int")
    got = sorted(tuple(r) for r in ann.nearest(df, lambda c: c % 20 == 0, k=5, shard_rows=2).collect())
    assert got == sorted([(20, 1, 1, 3.0), (20, 2, 2, 1.0), (20, 1, 2, 2.0), (20, 2, 1, 1.0), (40, 1, 3, 2.0)])


def test_weights_are_fitted_on_every_training_text(spark, monkeypatch, tmp_path):
    """Each bucket names what it fits on: together all training texts, none of the others."""
    plain, folder = lm_scoring.token_scores, str(tmp_path)

    def noted(bucket, answers, counts, totals, tables, learn_docs, *rest):
        with open(f"{folder}/{random.getrandbits(64)}", "w") as f:
            f.write(f"{len(learn_docs)} {int(bucket.trained.sum())} {int(bucket.trained[learn_docs].sum())}")
        return plain(bucket, answers, counts, totals, tables, learn_docs, *rest)

    monkeypatch.setattr(lm_scoring, "token_scores", noted)
    rows = [(i, f"text {i} of some words and {i * i} more") for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    lm_scoring.scores(documents, bucket_bytes=2500, part_bytes=2500).collect()
    got = [[int(x) for x in p.read_text().split()] for p in tmp_path.iterdir()]
    assert sum(g[0] for g in got) == sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(200))
    assert all(a == b == c for a, b, c in got)


def test_tokens_equal_plain_splitting():
    r = random.Random(6)
    odd = [None, b"", b" \n", b"A\tB\x0b\x0cc\r\nA", "Ä     a\x1cb\x85 Z".encode(), b"\xff a \xff\xff", b"\x00 \x00", b"x"]
    for some in [odd, [], [None], *([b"".join(r.choice([b"a", b"B", b" ", b"\n", b"\xc3\xa9", b"\x00"]) for _ in range(r.randint(0, 30))) for _ in range(9)] for _ in range(50))]:
        words, numbers, tokens = lm_scoring.tokenised(some)
        want = [[*lm_scoring.split(t), lm_scoring.END] for t in some]
        assert [words[k] for k in numbers.tolist()] == [w for t in want for w in t] and tokens.tolist() == [len(t) for t in want]
        assert words == list(dict.fromkeys(w for t in want for w in t))


def test_a_token_is_looked_up_once(monkeypatch):
    """What is fitted on is scored from the same lookups, which are the plain counts of the other documents, and go as the call ends."""
    train = [t.encode() for t in texts(30)] + [b"some words thatcomeonce " + b"a b a b c " * 3]
    others = [(t, True) for t in train] + [(t.encode(), False) for t in texts(8, seed=2)] + [(b"a b a b unknown", False)]
    spelt, pieces, alive, plain, nodes, piece = [], [], [], lm_scoring.token_scores, lm_scoring.Nodes, lm_scoring.Piece

    class Noted(piece):
        def __init__(self, which, known, bucket, *rest):
            super().__init__(which, known, bucket, *rest)
            pieces.append((which, self.alive, self.two_words, self.two_level, [self.inputs(d) for d in range(lm_scoring.PATH)], [self.gate(d) for d in range(lm_scoring.PATH)]))
            alive.append(weakref.ref(self))

    def noted(words):
        spelt.extend(words)
        return nodes(words)

    def fitted(bucket, *rest):
        spelt.clear()  # of what counts the training texts
        monkeypatch.setattr(lm_scoring, "Nodes", noted)
        return plain(bucket, *rest[:-1], np.flatnonzero(bucket.trained))

    monkeypatch.setattr(lm_scoring, "Piece", Noted)
    monkeypatch.setattr(lm_scoring, "token_scores", fitted)
    gc.disable()
    try:
        logs, *_ = model_of(train, others)
        assert not any(r() for r in alive)
    finally:
        gc.enable()
    assert b"thatcomeonce " in spelt and b"unknown " in spelt and len(spelt) == len(set(spelt))

    one, two, documents = Counter(), Counter(), []
    start, path, before = int(lm_scoring.START), 64 - lm_scoring.PATH, 64 - lm_scoring.BEFORE
    for t, trained in others:
        hashes = [start, start, *lm_scoring.word_hashes([*lm_scoring.split(t), lm_scoring.END]).tolist()]
        own_one, own_two, tokens = Counter(), Counter(), []
        for a, b, c in zip(hashes, hashes[1:], hashes[2:], strict=False):
            keys = [((b >> before, d, c >> path + lm_scoring.PATH - d), (a, b, d, c >> path + lm_scoring.PATH - d)) for d in range(lm_scoring.PATH + 1)]
            tokens.append(keys)
            if trained:
                own_one.update(k for k, _ in keys)
                own_two.update(k for _, k in keys)
        one += own_one
        two += own_two
        documents += [(keys, own_two, trained) for keys in tokens]
    assert sorted(k for which, *_ in pieces for k in which.tolist()) == list(range(len(documents)))
    for which, alive_at, two_words, two_level, inputs, gates in pieces:
        place = {k: n for n, k in enumerate(alive_at.tolist())}
        for n, k in enumerate(which.tolist()):
            keys, own_two, trained = documents[k]
            ones, twos = [one[a] - trained for a, _ in keys], [two[b] - own_two[b] for _, b in keys]
            assert n in place or twos[0] == 0
            for d in range(lm_scoring.PATH):
                bit, sign = keys[d + 1][0][2] & 1, 1 if keys[d + 1][0][2] & 1 else -1
                x, bits = inputs[d]
                assert bits[n] == bit and gates[d][n] == 8 * lm_scoring.level(np.array(ones))[d] + lm_scoring.level(np.array(twos))[d]
                for got, c in ((x[1, n], ones), (x[2, n], twos)):
                    assert got == pytest.approx(sign * math.log((c[d + 1] + 0.15) / (c[d] - c[d + 1] + 0.15)), abs=1e-4)
    assert all(np.isfinite(log).all() for log in logs)
