"""Byte-level BPE encoding and decoding by rank files.

Merging a pre-token takes, again and again, the leftmost pair of the least rank. Pairs wait in a rank queue: one bucket a rank holds the
positions (in a linked list of parts) where that rank's pair begins, and a bitmap of two levels (256-bit words, and a word that marks
which of them aren't 0) marks the ranks whose bucket isn't empty, so finding the next rank is two find-first-set steps. A merge changes
two neighbouring pairs; their old entries are left in place and skipped as stale when they come up. A pre-token of n bytes costs
O(n log n) at worst (positions within a bucket are kept in order), which holds for very long ones.

Pre-tokens repeat, so a worker remembers the ids of those it has met, up to a bound.

Defined results: a null text is empty; an empty text has no ids; decoding what was encoded gives the same bytes; other columns stay.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class BytePairCodec:
    """Encodes and decodes by ``ranks``; ``pattern`` parts a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 1_000_000):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        codec = self

        class Remembered(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(codec.merge(piece.encode()), np.uint32).tobytes()
                if len(piece) <= 64:
                    if len(self) >= remembered:
                        self.clear()
                    self[piece] = ids
                return ids

        self.known = Remembered()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue's steps stand in the loop, where a call would cost as much as the step."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [get(piece[k : k + 2]) for k in range(n - 1)]
        pair.append(None)
        top, words, buckets = 0, self.words, {}  # all words are 0 between calls
        for k, rank in enumerate(pair):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(k)
            else:
                buckets[rank] = [k]
                words[rank >> 8] |= 1 << (rank & 255)
                top |= 1 << (rank >> 8)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = (w << 8) | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                k = heappop(bucket)
            else:
                k = bucket[0]
                del buckets[rank]
                words[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[k] != rank:
                continue  # stale
            gone = after[k]
            end = after[k] = after[gone]
            pair[gone] = None
            if end < n:
                before[end] = k
                pair[k] = new = get(piece[k : after[end]])
                changed = ((new, k),) if new is not None else ()
            else:
                pair[k] = None
                changed = ()
            p = before[k]
            if p >= 0:
                pair[p] = new = get(piece[p:end])
                if new is not None:
                    changed += ((new, p),)
            for new, at in changed:
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    words[new >> 8] |= 1 << (new & 255)
                    top |= 1 << (new >> 8)
        ids, k, ranks = [], 0, self.ranks
        while k < n:
            ids.append(ranks[piece[k : after[k]]])
            k = after[k]
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.find(text or ""))), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec_of(lines: bytes, path: str, pattern: str) -> BytePairCodec:
    """The worker's codec of that file: built once a process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(read_ranks(lines), pattern)
    return _codecs[path, pattern]


def map_encoded(documents: DataFrame, ranks_path: str, pattern: str, make: Callable[[BytePairCodec, np.ndarray], tuple], added: T.StructType, text: str = "text") -> DataFrame:
    """``documents`` without the text, and the columns ``added``, which ``make(codec, ids)`` gives for each row's ids.

    The rank file is read where the query is planned and sent along (under 1 MB), so executors need no copy of it.
    """
    with open(ranks_path, "rb") as f:
        lines = documents.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in documents.columns if c != text]
    fields = [T.StructField(free_name(documents, f.name), f.dataType) for f in added]
    schema = T.StructType([*documents.select(*others).schema.fields, *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(lines.value, ranks_path, pattern)
        for batch in batches:
            made = [make(codec, codec.encode(t.as_py())) for t in batch.column(len(others))]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *columns], names=schema.names)

    return documents.select(*others, text).mapInArrow(run, schema)


def encoded(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``documents`` with ``ids`` in place of the text."""
    return map_encoded(documents, ranks_path, pattern, lambda codec, ids: (ids,), T.StructType([T.StructField("ids", T.ArrayType(T.LongType()))]), text)
