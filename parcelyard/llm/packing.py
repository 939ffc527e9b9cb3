"""Packing documents into token sequences: best fit decreasing, then a swap-based local search.

A document's tokens are its ids and one closing id. Only a document longer than a sequence is cut, into full pieces and a rest. Pieces
are dealt by hash into groups of about ``group_rows``, whose number grows with the input, and each group is packed by itself; a group
wastes less than a bin beyond what its own pieces force, so larger inputs lose no more in proportion.

In a group, best fit decreasing fills bins; then, among the bins that aren't full, the emptiest gives to fuller ones: it moves a piece,
exchanges one for one or two for one, whichever raises the other's fill most. Every step raises the sum of squared fills, so the search
ends; a bin that has given all is gone. It ends at the least number of bins the total allows, or when no bin can give anything.

Tokens come from a tokenizer that drops white space, so a text's ids are its words' ids in a row; a worker remembers words it has met.

Defined results: null texts are empty; an empty document is its closing id alone; rows with one doc_id, or none, are packed apart;
other columns don't matter.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY, CLOSING = 4096, 1
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A normalizer, a pre-tokenizer and a post-processor that do nothing to a word of small ASCII letters.
LETTERS_AS_THEY_ARE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
)


class WordTokenizer(dict):
    """Ids of texts, as little-endian 32-bit bytes, by a tokenizer that treats what blanks part on its own. The dict remembers words, up to a bound.

    Only words of plain letters (one capital, one small letter, nothing composed: all under U+0250 but the dotted capital I) are lowered and
    parted here; others go to the library as they are, and so does a whole text that holds a special token's name.
    """

    def __init__(self, definition: str, remembered: int = 1_200_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        model = self.tokenizer.model
        # Where what comes before the model leaves a word of small ASCII letters as it is, the model alone gives its ids.
        asis = (parts.get("normalizer"), parts.get("pre_tokenizer"), parts.get("post_processor")) == LETTERS_AS_THEY_ARE and not parts["model"].get("dropout")
        if hasattr(model, "_resize_cache"):  # it would hold the words a second time
            model._resize_cache(0)
            self.tokenizer.model = model
        self.model = model if asis else None

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() or (max(word) < "\u0250" and "\u0130" not in word)
        stem = word.rstrip(PUNCTUATION)
        if plain and len(stem) < len(word) and stem[-1:].isalpha():  # what follows a letter is a token of its own
            met = stem in self
            ids = self[stem] + self[word[len(stem) :]]
            if not met:
                return ids
        elif plain and (small := word.lower()) != word:  # the tokenizer lowers letters too
            ids = self[small]
        elif self.model is not None and word.isascii() and word.isalpha():
            ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        else:
            ids = self.direct(word)
        if len(word) <= 64:
            if len(self) >= self.remembered:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if any(name in text for name in self.special):
            return self.direct(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids (little-endian bytes) if asked for. The definition is read where the query is planned and sent along (under 2 MB)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = documents.sparkSession.sparkContext.broadcast(f.read())
    end = int(closing).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(definition.value)
        encode = _tokenizers[tokenizer_path].encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, number, length, crc, own = [], [], [], [], []
                for k, text in enumerate(part.column(1)):
                    ids = encode(text.as_py()) + end
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        some = ids[start : start + 4 * capacity]
                        row.append(k)
                        number.append(n)
                        length.append(len(some) // 4)
                        crc.append(zlib.crc32(some))
                        own.append(some if with_ids else None)
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array([n * capacity for n in number], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(own, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int]]]:
    """Bins of (length, item), by best fit decreasing. A bitmap over the room left finds the tightest bin."""
    bins: list[list[tuple[int, int]]] = []
    open_at: dict[int, list[int]] = {}
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append((n, item))
        if room > n:
            if not open_at.setdefault(room - n, []):
                rooms |= 1 << (room - n)
            open_at[room - n].append(k)
    return bins


def _sums(giver: list[tuple[int, int]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that one piece, and one piece or two, of ``giver`` come to within 0, 1, ... ``capacity``. At most two pieces of a length matter, so there are few pairs however many pieces."""
    lengths = np.array([n for n, _ in giver], np.int64)
    kinds, times = np.unique(lengths, return_counts=True)
    one = np.zeros(capacity + 1, np.int64)
    one[kinds] = kinds
    two = one.copy()
    pairs = (kinds[:, None] + kinds)[np.triu(np.ones((len(kinds),) * 2, bool), 1) | np.diag(times > 1)]
    two[pairs] = pairs
    return np.maximum.accumulate(one), np.maximum.accumulate(two)


def _given(giver: list[tuple[int, int]], total: int) -> tuple[tuple[int, int], ...]:
    """One piece of ``giver``, or two, of length ``total`` together."""
    of: dict[int, tuple[int, int]] = {}
    for x in giver:
        if x[0] == total:
            return (x,)
        of.setdefault(x[0], x)
    seen: dict[int, tuple[int, int]] = {}
    for x in giver:
        if total - x[0] in seen:
            return (seen[total - x[0]], x)
        seen.setdefault(x[0], x)
    raise AssertionError(total)


def local_search(bins: list[list[tuple[int, int]]], capacity: int) -> list[list[tuple[int, int]]]:
    """Fewer bins by moves and exchanges, until the total allows no fewer or no bin has anything to give: emptiest first, each gives as long as it can, and all are tried again after any change."""
    fill = np.array([sum(n for n, _ in b) for b in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    alive = len(bins)
    partial = np.nonzero(fill < capacity)[0]
    pieces = [(n, item, k) for k in partial.tolist() for n, item in bins[k]]
    length, held = np.array([p[0] for p in pieces], np.int64), np.array([p[2] for p in pieces], np.int64)
    place = {p[1]: at for at, p in enumerate(pieces)}
    changed = True
    while changed and alive > least:
        changed = False
        for g in partial[np.lexsort((partial, fill[partial]))].tolist():
            gave = True
            while gave and bins[g] and alive > least:  # passes over the takers
                gave = False
                takers = partial[(partial != g) & (fill[partial] >= fill[g]) & (fill[partial] < capacity)]
                rank = np.full(len(fill), len(fill), np.int64)
                rank[takers[np.lexsort((takers, -fill[takers]))]] = np.arange(len(takers))
                order, fresh, passed = rank[held], True, -1
                while bins[g]:
                    if fresh:
                        one, two = _sums(bins[g], capacity)
                        fresh = False
                    # What raises each taker: a piece moved, or one or two for one of its own. Pieces of no taker are out of reach.
                    room = capacity - fill
                    reach = (order > passed) & (order < len(fill)) & (held != g)
                    swap = np.where(reach, two[np.where(reach, length + room[held], 0)] - length, 0)
                    moved = np.where(reach, one[room[held]], 0)
                    able = (swap > 0) | (moved > 0)
                    if not able.any():
                        break
                    passed = int(order[able].min())
                    own = np.nonzero(order == passed)[0]
                    own = own[held[own] != g]
                    t = int(held[own[0]])
                    best = own[np.argmax(swap[own])]
                    gain, back = int(moved[own[0]]), None
                    total = gain
                    if swap[best] > gain:
                        gain, back = int(swap[best]), int(best)
                        total = gain + int(length[back])
                    for x in _given(bins[g], total):
                        bins[g].remove(x)
                        bins[t].append(x)
                        held[place[x[1]]], order[place[x[1]]] = t, rank[t]
                    if back is not None:
                        x = (int(length[back]), pieces[back][1])
                        bins[t].remove(x)
                        bins[g].append(x)
                        held[back], order[back] = g, len(fill)
                    fill[t] += gain
                    fill[g] -= gain
                    gave = changed = fresh = True
                if not bins[g]:
                    alive -= 1
            if alive <= least:
                break
        partial = np.array([k for k in partial.tolist() if bins[k] and fill[k] < capacity], np.int64)
        kept = np.isin(held, partial)
        length, held, pieces = length[kept], held[kept], [p for p, ok in zip(pieces, kept.tolist(), strict=True) if ok]
        place = {p[1]: at for at, p in enumerate(pieces)}
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length."""
    bins = local_search(best_fit(lengths, capacity), capacity)
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for n, item in b:
            number[item], offset[item] = k, at
            at += n
    return number, offset


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 8192) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset. It reads them twice, so give it a written table."""
    groups = max(1, -(-cut_pieces.count() // group_rows))
    dealt = cut_pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id bigint, offset bigint"

    def run(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        order = np.lexsort([table.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "ids_crc32", "length")])
        table = table.take(pa.array(order)).drop_columns(["_group"])
        number, offset = pack(table.column("length").to_numpy(), capacity)
        return table.append_column("sequence_id", pa.array((group << 32) + number)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    return packed(cut(pieces(documents, tokenizer_path, capacity, closing)), capacity)
