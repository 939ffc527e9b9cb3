"""Ranked lexical search of all documents for a set of query items, by sort-based accumulation.

Terms are maximal runs of ASCII letters and figures and of all characters beyond ASCII; only A-Z are lowered. One pass over the texts
gives each document's terms that some item asks for, with their counts (a posting row, written once); document frequencies, the number
of documents and of terms follow from these rows. A second pass weighs the postings.

Postings are dealt by ranges of document rows, so a document's score is made in one task. A task takes documents in blocks of about
``block`` matches, concatenates the items' and documents' numbers and impacts of all matches, packs item and document into one key,
sorts the keys by 16-bit digits (numpy's stable sort of 16-bit integers is a radix sort), sums impacts by ``reduceat`` where the key
changes, and keeps each item's best ``k`` of a block and of the task by selection. The tasks' best meet in rounds of at most ``fan`` tasks.

Items are taken in blocks of about ``item_bytes`` of text, whose terms are what is broadcast; documents are read once for each block.

Weights: w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 100 - 50 + (50 n N) div L and a term that occurs tf
times in it adds w * ((10**9 tf) div (1000 tf + 20 m)), all in 64-bit integers.

Defined results: null and empty texts have no terms, are not counted and never found; an item without terms finds nothing; rows that
share an item id are ranked apart; equal documents are found apart, equal scores by document id, null ids last; empty tables give no
rows; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    if not text:
        return []
    return TERM.findall(text.lower() if text.isascii() else text.translate(LOWER))


class Vocabulary:
    """The terms of a block of items by number, and which items ask for each: ``items[begins[t]:begins[t + 1]]``."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[str, int] = {}
        pairs = [(self.number.setdefault(t, len(self.number)), k) for k, text in enumerate(texts) for t in dict.fromkeys(terms_of(text))]
        term, item = np.array(pairs, np.int64).reshape(-1, 2).T
        self.items = item[np.argsort(term, kind="stable")].astype(np.int32)
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.number)))]).astype(np.int64)


def posting_rows(documents: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts): a document's terms in all, and the asked-for ones by number with their counts. Documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.number
        asked = number.keys()
        for batch in batches:
            ids, n, ends, terms, counts = [], [], [0], [], []
            for k, value in enumerate(batch.column(1)):
                found = terms_of(value.as_py())
                if found:
                    own = Counter(filter(asked.__contains__, found))
                    terms += map(number.__getitem__, own)
                    counts += own.values()
                    ids.append(k)
                    n.append(len(found))
                    ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of non-negative 64-bit keys, digit by digit of 16 bits from the lowest."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    shift, top = 16, int(key.max(initial=0))
    while top >> shift:
        order = order[np.argsort(((key >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Rows of each item's ``k`` highest scores, equal ones by document; items in ascending order in, in any order out."""
    if not len(item):
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    ends, kept = np.append(begins[1:], len(item)), []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a > k:
            least = np.partition(score[a:b], b - a - k)[b - a - k]  # the k-th highest
            some = a + np.flatnonzero(score[a:b] >= least)
            some = some[np.lexsort((doc[some], -score[some]))[:k]]
            kept.append(some)
        else:
            kept.append(np.arange(a, b))
    return np.concatenate(kept)


def accumulated(term: np.ndarray, count: np.ndarray, doc: np.ndarray, m: np.ndarray, vocabulary: Vocabulary, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) in order of item and doc. ``term``, ``count``, ``doc``: postings; ``m``: by document."""
    impact = weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc]))
    spread = vocabulary.begins[term + 1] - vocabulary.begins[term]
    of = np.repeat(np.arange(len(term)), spread)
    at = np.arange(len(of)) - np.repeat(np.cumsum(spread) - spread, spread) + vocabulary.begins[term][of]
    key = vocabulary.items[at].astype(np.int64) * len(m) + doc[of]
    order = radix_order(key)
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    score = np.add.reduceat(impact[of][order], begins) if len(begins) else np.zeros(0, np.int64)
    return key[begins] // max(len(m), 1), key[begins] % max(len(m), 1), score


def ranked(items: DataFrame, documents: DataFrame, k: int = 50, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text", block: int = 2_000_000, item_bytes: int = 8 << 20, fan: int = 256) -> DataFrame:
    """item_id, rank, doc_id, score: each item row's ``k`` best documents with a score above 0."""
    spark = documents.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("row"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))
    parts = [one_block(asked.where(F.col("block") == b), documents, k, doc_id, text, block, fan) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def one_block(asked: DataFrame, documents: DataFrame, k: int, doc_id: str, text: str, block: int, fan: int) -> DataFrame:
    """(row, rank, doc_id, score) for the items of one block, about ``item_bytes`` of text: these come to the driver, their terms go to the tasks."""
    spark = documents.sparkSession
    own = asked.select("row", "text").collect()
    rows = np.array([r["row"] for r in own], np.int64)
    vocabulary = spark.sparkContext.broadcast(Vocabulary([r["text"] for r in own]))
    with small_batches(spark):
        postings = cut(posting_rows(documents, vocabulary, doc_id, text))
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary.value.number), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # one row a term of the block's items
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    weights = spark.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = vocabulary.value, weights.value
        many = known.begins[1:] - known.begins[:-1]
        held = [np.zeros(0, np.int64)] * 3  # item, score, doc: a document's null id is the highest number

        def flush(item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
            item, score, doc = (np.concatenate(p) for p in zip(held, (item, score, doc), strict=True))
            order = np.argsort(item, kind="stable")
            item, score, doc = item[order], score[order], doc[order]
            some = np.sort(best(item, score, doc, k))
            held[:] = item[some], score[some], doc[some]

        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            n = batch.column(1).to_numpy()
            begins = batch.column(2).offsets.to_numpy().astype(np.int64)
            begins -= begins[0]
            term, count = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            matches = np.concatenate([[0], np.cumsum(many[term])])[begins]
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(matches, matches[a] + block, "right")) - 1)
                own = slice(begins[a], begins[b])
                doc = np.repeat(np.arange(b - a), np.diff(begins[a : b + 1]))
                item, at, score = accumulated(term[own], count[own], doc, 100 - 50 + (50 * n[a:b] * n_docs) // n_terms, known, weight)
                some = np.sort(best(item, score, ids[a:b][at], k))
                some = some[score[some] > 0]
                flush(item[some], score[some], ids[a:b][at[some]])
                a = b
        item, score, doc = held
        task = np.full(len(item), TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows[item]), pa.array(task), pa.array(doc, mask=doc == np.iinfo(np.int64).max), pa.array(score)], ["row", "task", "doc_id", "score"])

    found = postings.mapInArrow(run, "row bigint, task bigint, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    groups = postings.rdd.getNumPartitions()
    while groups > fan:  # no task sees more than ``fan`` tasks' rows of an item
        groups = -(-groups // fan)
        found = found.withColumn("task", F.pmod("task", F.lit(groups)))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "task").orderBy(*order))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k).select("row", "rank", "doc_id", "score")
