import random
import re
from collections import defaultdict

import pytest
from test_near_dedup import brute
from test_simple_ops import ASSIGN, WORDS, direct

import corpus_pipeline
from parcelyard.llm import common, queries, secrets, toxicity
from parcelyard.llm.common import cut, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        counts.append((name, docs.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    n = dict(counts)
    assert n["toxicity"] < table(spark, sf_dir, "documents").count() and n["near_dedup"] <= n["toxicity"] and n["secrets"] == n["near_dedup"] and n["packing"] >= n["secrets"]


def test_a_query_each():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def written(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{path}/documents.parquet")
    marks = [(k, int("zork" in (r[1] or ""))) for k, r in ((r[0], r) for r in rows) if k is not None]
    spark.createDataFrame([(k, 0, y) for k, y in marks], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows = []
    for k in range(90):
        sentences = [[word() for _ in range(r.randint(4, 9))] for _ in range(r.randint(2, 6))]
        if k % 4 == 0:
            sentences[-1][1] = r.choice(["zorking", "zorkish", "zork"])
        rows.append((k, ". ".join(map(" ".join, sentences)) + "."))
    for k in range(90, 100):  # copies, exact and near
        text = rows[k - 80 + 1][1]
        rows.append((k, text if k % 2 else text + " tail"))
    rows += [(200, "key password = Zx8Qw2Lm9Rt4 é token: copied00copied"), (201, "see Zx8Qw2Lm9Rt4 again"), *((202 + k, f"{word()} {word()} token: copied00copied") for k in range(6))]
    rows += [(300, None), (301, ""), (302, " \n"), (None, "no id at all"), (300, "the same id with a text of its own")]
    return [(k, t, "en", f"own{(k or 0) % 97}/r", None if t is None else len(t)) for k, t in rows]


def plainly_masked(rows):
    """Live-looking spans replaced, by loops over whole matches."""
    found, owners, named = defaultdict(list), defaultdict(set), set()
    for n, (_, text, _, source, _) in enumerate(rows):
        text = text or ""
        base = [(m.start(), m.end(), m[2], True) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        base += [(m.start(), m.end(), m[0], True) for m in re.finditer("AKIA[A-Z0-9]{12,}", text)] + [(m.start(), m.end(), m[0], True) for m in re.finditer("[0-9a-f]{32,}", text)]
        bare = [(m.start(), m.end(), m[0], False) for m in re.finditer(secrets.BARE, text, re.A) if len(m[0]) >= 8]
        for _, _, value, is_base in base + bare:
            owners[value].add(source.split("/")[0])
            named |= {value} if is_base else set()
        found[n] = base + [b for b in bare if not any(s < b[1] and b[0] < e for s, e, _, _ in base)]
    out = []
    for n, row in enumerate(rows):
        spans = []
        for start, end, value, is_base in found[n]:
            mixed = len(value) >= 24 and all(re.search(p, value) for p in ("[A-Z]", "[a-z]", "[0-9]"))
            if len(owners[value]) <= 3 and (is_base or value in named or mixed):
                spans.append((start, end))
        text, at, made = row[1], 0, ""
        for start, end in sorted(spans):
            if start >= at:
                made += text[at:start] + "[secret]"
            at = max(at, end)
        out.append((row[0], made + text[at:] if spans else text))
    return out


def test_run_equals_a_plain_version(spark, tmp_path):
    rows = corpus()
    path = written(spark, tmp_path, rows)
    model = toxicity.fit(table(spark, path, "documents"), table(spark, path, "labels"))
    clean = [r for r in rows if model.read(r[1], 0.5)[0] < 0.7]
    assert 10 < len(rows) - len(clean) < 40
    # Ids of their own for the comparison: a row without one, or with one that another row has, is a node by itself.
    order = sorted(range(len(clean)), key=lambda n: (clean[n][0] is None, clean[n][0] or 0, clean[n][1] or ""))
    groups, _ = brute([(n, clean[i][1]) for n, i in enumerate(order)])
    kept = [clean[i] for n, i in enumerate(order) if groups[n] == n or clean[i][0] is None]
    assert len(clean) - len(kept) >= 5
    want = []
    for doc_id, text in plainly_masked(kept):
        ids = direct(text or "")
        want.append((str(doc_id), len(ids)))
    before = common.written()
    got = corpus_pipeline.run(spark, path)
    assert common.written() == before + 1
    pieces = got.toPandas()
    assert sorted((str(int(d)) if d == d and d is not None else "None", int(n)) for d, n in zip(pieces["doc_id"], pieces["length"], strict=True)) == sorted(want)
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 4096 and g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
    assert WORDS


def test_stages_take_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang map<string,int>, source string, n_chars bigint, row_id int, scan_row string, toxicity double"
    rows = [(1, "a text of some words here", {"a": 1}, None, 5, 1, "x", 0.1), (1, "a text of some words here", {"a": 1}, None, 5, 1, "x", 0.1), (None, None, None, "s/x", None, 2, None, None), (2, "", {}, "s", 0, 3, "y", None), (3, "w " * 30_000, {}, "s", 60_000, 4, "z", 1.0)]
    path = written(spark, tmp_path, rows, schema)
    for given in (table(spark, path, "documents"), table(spark, path, "documents").where("false")):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, path))
            assert docs.count() == 0 if given.isEmpty() else docs.count() >= 4
            if name != "packing":
                assert docs.columns == given.columns


@pytest.mark.parametrize("seed", range(3))
def test_noisy_or_and_its_gradient(seed):
    """A document's score is the plain noisy-or of its sentences, and a fitted model is at a minimum: its loss rises with any weight that is moved."""
    import math

    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(2, 5)))
    texts = [". ".join(" ".join([word() for _ in range(4)] + (["badword"] if k % 3 == 0 and s == 0 else [])) for s in range(3)) for k in range(60)]
    toxic = [int(k % 3 == 0) for k in range(60)]
    model = toxicity.fit_bags(texts, toxic, steps=200)

    def plain(text, weights, bias):
        none = 1.0
        for sentence in re.split("[.!?\n]+", text):
            if sentence:
                z = bias + sum(sum(weights.get(f, 0.0) for f in toxicity.features(w)) for w in re.findall(r"[^\W\d_]+", sentence.lower()))
                none *= 1 - 1 / (1 + math.exp(-z))
        return 1 - none

    for t in texts[:20]:
        assert model.read(t, 0.5)[0] == pytest.approx(plain(t, model.weights, model.bias), abs=1e-9)
    assert all((model.read(t, 0.5)[0] >= 0.5) == bool(y) for t, y in zip(texts, toxic, strict=True))


def test_shards_of_a_table_are_the_published_ones(spark):
    from pyspark.sql import functions as F
    from test_simple_ops import plain_jump

    from parcelyard.llm import sharding

    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    keys = {x["doc_id"]: x["h"] % 2**64 for x in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for x in sharding.sharded(rows, 40).collect():
        assert x["shard"] == plain_jump(keys[x["doc_id"]], 40) and x["grown_shard"] == plain_jump(keys[x["doc_id"]], 41)
