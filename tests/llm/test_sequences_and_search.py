"""Arrow sequence files against the tokenizers library; ranked search against a plain version."""

import math
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelyard.llm import lexical, queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = [(1, "Some text. More  of it!"), (1, "Some text. More  of it!"), (1, "another"), (2, None), (3, ""), (None, "no id"), (4, " \n\t "), (5, "it's long " * 3000), (6, "é ß 日本 🙂 <|endoftext|> x")]
CLASH = "doc_id bigint, text string, crc string, row int, shard string, file string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "t", "u") for i, t in rows], CLASH)


def plain_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def plain_documents(rows):
    """In order of id (null first), then the text's CRC."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = plain_ids(t)
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return token_files.PieceEncoder(f.read(), remembered=3000)


def test_ids_are_the_librarys(encoder):
    r = random.Random(5)
    bits = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'t", "'ll", "'", "''", "3", "½", "²", "_", "-", ".", "α", "日", "́", "​", "﻿", "᠎", " ", "\x85", "\xa0", "\x1c", "\x1f", "<|endoftext|>", "ª", "×", "÷", "word", "Ω", "😀", "’s", "\xad", "\r\n", "\x00", "I'm", "ǅ", "ʰ", "ɐ"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(4000)]
    for at in range(0, 4000, 100):
        some = texts[at : at + 100]
        wanted = [array("H", TOKENIZER.encode(t, add_special_tokens=False).ids).tobytes() for t in some]
        assert encoder.encode_all(some) == wanted and [encoder.encode(t) for t in some] == wanted


def test_documents_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_sequences(table(spark, ODD).repartition(3), path, PATH, length=16, rows=8, batch_rows=3, shard_bytes=4000)
    got = [tuple(r) for r in token_files.read_documents(spark, path).orderBy("start").collect()]
    assert got == plain_documents(ODD)  # the long text fills many files
    assert len(list((tmp_path / "files").glob("*.txt"))) > 20


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op11_arrow_sequences(spark, sf_dir).collect())) == plain_documents(rows)


def test_files_are_arrow_files_with_views_of_their_bytes(spark, tmp_path):
    rows = [(k, "some words here " * (k % 7)) for k in range(60)]
    token_files.write_sequences(table(spark, rows), f"{tmp_path}/files", PATH, length=32, rows=64, batch_rows=4)
    whole = [x for i, t in rows for x in plain_ids(t)]
    seen, docs = [], {}
    for name in sorted((tmp_path / "files").glob("*.txt")):
        data = name.read_bytes()
        assert data[:6] == data[-6:] == b"ARROW1"
        mapped = pa.memory_map(str(name))
        low = mapped.read_buffer(mapped.size()).address
        reader = token_files.opened(str(name))
        tokens = int(reader.schema.metadata[b"tokens"])
        for k in range(-(-tokens // 32)):
            ids, mask, parts = token_files.sequence(reader, k)
            at = ids.__array_interface__["data"][0]
            assert len(ids) == len(mask) == 32 and not ids.flags.owndata and pa.total_allocated_bytes() >= 0 and at != low
            n = mask.to_numpy(zero_copy_only=False).sum()
            assert n == min(32, tokens - 32 * k) and not ids[n:].any()
            seen += ids[:n].tolist()
            for p in parts.to_pylist():
                docs[p["doc_id"]] = docs.get(p["doc_id"], []) + ids[p["begin"] : p["begin"] + p["length"]].tolist()
        before = pa.total_allocated_bytes()
        reader.get_batch(0).column("ids").flatten().to_numpy(zero_copy_only=True)
        assert pa.total_allocated_bytes() == before  # nothing was copied
    assert seen == whole and docs == {i: plain_ids(t) for i, t in rows}
    again = token_files.read_sequences(spark, f"{tmp_path}/files").orderBy("shard", "place").collect()
    assert [x for r in again for x, m in zip(r["ids"], r["mask"], strict=True) if m] == whole


def test_nothing_to_write(spark, tmp_path):
    token_files.write_sequences(table(spark, []), f"{tmp_path}/files", PATH)
    assert token_files.read_documents(spark, f"{tmp_path}/files").count() == 0


def test_crcs_are_joined():
    r = random.Random(2)
    for _ in range(50):
        a, b = (r.randbytes(r.randint(0, 300)) for _ in range(2))
        assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# Search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(items, documents, k):
    docs = [(i, plain_terms(t)) for i, t in documents]
    docs = [d for d in docs if d[1]]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    out = []
    for item, text in items:
        found = []
        for i, terms in docs:
            m = 100 - 50 + (50 * len(terms) * n_docs) // n_terms
            score = 0
            for t in set(plain_terms(text)):
                if tf := terms.count(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in docs) + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search_tables(spark, items, documents):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int"), spark.createDataFrame([(i, t, 1, 2, "x") for i, t in documents], "doc_id bigint, text string, score int, row int, term string")


@pytest.mark.parametrize(("block", "item_bytes", "fan"), [(2_000_000, 8 << 20, 256), (7, 40, 2)])
def test_search_equals_the_plain_version(spark, block, item_bytes, fan):
    r = random.Random(3)
    words = ["the", "The", "of", "x1", "é", "É", "naïve", "日本", "a-b", "don't", "\x00z", "🙂", "w7", "w8", "w9"]
    documents = [(k // 2, " ".join(r.choices(words, k=r.randint(0, 12)))) for k in range(90)] + [(500, None), (501, ""), (502, " .,"), (None, "the of"), (503, "w7 " * 4000)] + [(600 + k, "of of x1") for k in range(8)]
    items = [(k, " ".join(r.choices(words, k=4))) for k in range(6)] + [(6, None), (7, ""), (8, "unknown words"), (0, "x1 of"), (None, "the 🙂")]
    got = lexical.ranked(*search_tables(spark, items, documents), k=5, block=block, item_bytes=item_bytes, fan=fan)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(items, documents, 5)


def test_search_of_nothing(spark):
    some = [(1, "a b")]
    assert lexical.ranked(*search_tables(spark, some, [])).count() == 0
    assert lexical.ranked(*search_tables(spark, [], some)).count() == 0
    assert lexical.ranked(*search_tables(spark, some, [(1, None)])).count() == 0


def test_search_keeps_less_than_k_whole(spark):
    items, documents = search_tables(spark, [(1, "w")], [(k, "w" + " v" * (k % 3)) for k in range(30)])
    assert lexical.ranked(items, documents).agg(F.count("*"), F.countDistinct("rank")).first() == (30, 30)


def test_radix_order_is_a_stable_sort():
    r = np.random.default_rng(1)
    for top in (5, 1 << 17, 1 << 40):
        key = r.integers(0, top, 5000)
        assert (lexical.radix_order(key) == np.argsort(key, kind="stable")).all()
    assert len(lexical.radix_order(np.zeros(0, np.int64))) == 0


def test_best_takes_ties_by_document():
    item, score, doc = np.array([0] * 6 + [1] * 2), np.array([5, 7, 7, 7, 1, 7, 3, 2]), np.array([1, 9, 4, 6, 0, 2, 8, 7])
    assert sorted(lexical.best(item, score, doc, 3).tolist()) == [2, 3, 5, 6, 7]
