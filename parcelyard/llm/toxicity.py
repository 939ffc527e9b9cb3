"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has probability ``s = sigmoid(b + sum of its words' weights)``; the document's is the
noisy-or ``1 - prod(1 - s)``. Only documents carry labels, so the weights are fitted through the noisy-or (full-batch Adam on the
bag's log-loss), and the sentence probabilities then say where a document offends.

Limits, as parameters: the fit takes at most ``train_docs`` labelled documents of each class (those with the least hash of the id);
a word, or a piece of one, that fewer than ``min_docs`` toxic ones
hold has no weight. Scoring covers every document and every sentence.

Defined results: a null or empty text has no sentence and scores 0; a document without id is scored like any other but never trained
on; conflicting labels of one id count as toxic; of several texts under one id the least trains; without labels of both classes every score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, id_bucket

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
RESULT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
    ]
)


def features(word: str) -> list[str]:
    """The word itself, and its runs of four, five and six letters with a mark for where it begins: inflected forms of an offensive stem share those."""
    marked = "^" + word
    return ["=" + word, *{marked[k : k + n] for n in (4, 5, 6) for k in range(len(marked) - n + 1)}]


class WordWeights(dict):
    """Weight of each word seen, filled in as they come; emptied when it gets long."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.of_features = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= 300_000:
            self.clear()
        get = self.of_features.get
        if len(word) >= 200:  # read like any other, but not remembered, and of its features only those with a weight are held
            marked = "^" + word
            held = {f for n in (4, 5, 6) for k in range(len(marked) - n + 1) if (f := marked[k : k + n]) in self.of_features}
            return get("=" + word, 0.0) + sum(map(get, held))
        self[word] = w = sum(get(f, 0.0) for f in features(word))
        return w

    def __reduce__(self):
        return WordWeights, (self.of_features,)


@dataclass
class ToxicityModel:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    prior: float | None = None

    def __post_init__(self):
        self.words = WordWeights(self.weights)

    def read(self, text: str | None, sentence_threshold: float) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and the sentences from ``sentence_threshold`` on: (start, end, probability), in code points."""
        if self.prior is not None:
            return (self.prior if text else 0.0), []
        log_none, found, weight_of = 0.0, [], self.words.__getitem__
        quiet = -math.log1p(math.exp(self.bias))  # log(1 - s) of a sentence whose words weigh nothing
        for m in SENTENCE.finditer(text or ""):
            weight = sum(map(weight_of, WORD.findall(m[0].lower())))
            if not weight:
                log_none += quiet
                continue
            z = min(self.bias + weight, 500.0)
            log_none -= math.log1p(math.exp(z))
            if (s := 1.0 / (1.0 + math.exp(-z))) >= sentence_threshold:
                found.append((m.start(), m.end(), s))
        return -math.expm1(log_none), found


def fit_bags(texts: list[str], toxic: list[int], min_docs: int = 4, lift: float = 3.0, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> ToxicityModel:
    """Fit weights from whole documents' labels. A feature takes part if ``min_docs`` toxic documents hold it, and at least ``lift`` times the share of clean ones; weights are not negative, so that clean words cannot hide an offence."""
    y = np.asarray(toxic, bool)
    if y.all() or not y.any():
        return ToxicityModel(prior=float(y.mean()) if len(y) else 0.0)
    bags = [[set(WORD.findall(s.lower())) for s in SENTENCE.findall(t or "")] for t in texts]
    in_docs = {True: Counter(), False: Counter()}
    for bag, kind in zip(bags, y.tolist(), strict=True):
        in_docs[kind].update({f for w in set().union(*bag) for f in features(w)})
    share = lambda f, k: (in_docs[k][f] + 0.5) / (np.sum(y == k) + 1)
    chosen = {f: k for k, f in enumerate(sorted(f for f, n in in_docs[True].items() if n >= min_docs and share(f, True) >= lift * share(f, False)))}
    word_id: dict[str, int] = {}
    word_of, feature_of, words, sentence_of, bag_of = [], [], [], [], []
    for d, bag in enumerate(bags):
        for sentence in bag:
            for w in sorted(sentence):
                if w not in word_id:
                    own = [chosen[f] for f in features(w) if f in chosen]
                    word_id[w] = k = (word_of[-1] + 1 if word_of else 0) if own else -1
                    word_of += [k] * len(own)
                    feature_of += own
                if word_id[w] >= 0:
                    words.append(word_id[w])
                    sentence_of.append(len(bag_of))
            bag_of.append(d)
    word_of, feature_of, words, sentence_of, bag_of = (np.array(x, np.int64) for x in (word_of, feature_of, words, sentence_of, bag_of))
    n_words = int(word_of[-1]) + 1 if len(word_of) else 0
    per_class = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        by_word = np.bincount(word_of, theta[feature_of], n_words)
        z = np.bincount(sentence_of, by_word[words], len(bag_of)) + theta[-1]
        log_none = np.bincount(bag_of, -np.logaddexp(0.0, z), len(y))
        p = np.clip(-np.expm1(log_none), 1e-12, 1.0)
        toward = np.where(y, -np.exp(log_none) / p, 1.0) * per_class
        slope = toward[bag_of] / (1.0 + np.exp(-np.clip(z, -50, 50)))
        grad = np.empty_like(theta)
        grad[:-1] = np.bincount(feature_of, np.bincount(words, slope[sentence_of], n_words)[word_of], len(chosen)) + ridge * theta[:-1]
        grad[-1] = slope.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        theta[:-1] = np.maximum(theta[:-1], 0.0)
    return ToxicityModel(bias=float(theta[-1]), weights={f: float(theta[k]) for f, k in chosen.items() if theta[k] >= 0.01})


def fit(documents: DataFrame, labels: DataFrame, train_docs: int = 1500, **options) -> ToxicityModel:
    """``documents(doc_id, text)``, ``labels(doc_id, toxic)``. Rows with crc32(doc_id as text) mod 3 = 1 are held out.

    The ids to train on are picked first, from the labels alone; they are at most ``2 * train_docs``, so they are broadcast.
    """
    marked = labels.where(F.col("toxic").isNotNull() & (id_bucket(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = None
    for k in (0, 1):
        part = marked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(train_docs)
        picked = part if picked is None else picked.union(part)
    # One text an id, however often the id is there.
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toPandas()
    return fit_bags(rows["text"].tolist(), rows["toxic"].tolist(), **options)


def score(documents: DataFrame, model: ToxicityModel, text: str = "text", result: str = "toxicity", sentence_threshold: float = 0.5) -> DataFrame:
    """``documents`` with a struct column ``result``: score, and offending sentences with their places and scores."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the words of the training sample

    @F.pandas_udf(RESULT)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for texts in batches:
            got = [held.read(t, sentence_threshold) for t in texts]
            yield pd.DataFrame({"score": [g[0] for g in got], "offending": [[{"start": a, "end": b, "score": s} for a, b, s in g[1]] for g in got]})

    return documents.withColumn(free_name(documents, result), read(F.col(text)))
