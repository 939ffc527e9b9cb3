"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens, the ones that the base score counts: its words, A-Z in lower case, and one end. A token is coded in binary
decisions. The first says whether its word is new. A known word's hash is coded bit by bit: each of the first ``PATH`` bits is predicted
by several predictors, one a context: none, the previous word, the previous two words. A predictor is the counts of zeros and ones that
its context has seen at this place of the path, taken from a table at the context's hash: of the previous word ``BEFORE`` bits, so that
its table has a fixed size and frequent words have entries of their own; the table of the previous two grows with the corpus. A new word is spelled, bit by bit, by
predictors whose contexts are its last 1, 2, 3 and 5 bytes. Predictions are stretched to the logistic domain and summed with weights;
the weight set is gated by how much the longer contexts have seen. What comes out is refined by an adaptive map, gated likewise, from the
mixed probability to what was seen of it. What the path leaves open, ``CELL`` more bits and the word itself, is shared out by the counts
of the two previous words and of all. A text's score is the sum of its decisions' log10 probabilities: a probability of its tokens,
spelling included.

A training text is scored by what was learnt from the others: its own occurrences are taken out of the counts of words and of word
pairs, and every token's from what follows its previous word. So a text that occurs
once is told from one that occurs again, and training and held-out texts are scored alike.

Counts come from all training documents and grow with them: words are dealt in parts by their hash, pairs of words by theirs. Documents are
dealt in buckets of about ``bucket_bytes``, by hash. A bucket sends each (context, path) that it holds once to the part of the context,
as sorted keys; the part adds up and answers with the counts along the path. Every bucket then fits weights and maps online on all of its own
training documents and scores all of its documents. Broadcast are tables of fixed size: bits of
spelling (4 * 2**SLOT_BITS slots), how often each cell of the hash occurs, and each path behind each previous word (2**20 each).

Limits, as parameters: a context is known by 28 bits of its hash beside its part; counts along paths are exact up to 32, and within 9 %
above. Spelling counts each known word once.

Base score: add-one smoothed unigrams of the same tokens, over the same training documents.

Defined results: a null text is empty: one end; a row without doc_id is trained on; rows with one doc_id, equal or not, are texts of
their own; equal rows have equal scores; without training documents every decision is even or spelled so; other columns don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, id_bucket

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\xff"  # a byte that UTF-8 never holds
CUT = b"\xfe"
ORDERS = (1, 2, 3, 5)  # bytes of context in spelling
SLOT_BITS = 19
PATH, CELL, CONTEXT = 8, 12, 28  # bits of a word's hash that are predicted and that are counted, and of a context's hash
BEFORE = 12  # bits of the previous word's hash
START = np.uint64(0x5EED)
_ZSTD = pa.Codec("zstd", compression_level=1)


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def tokenised(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens in the order of their first places, the number of every token, one text after another, and how many tokens each text has."""
    gap = b" " + END + b" "
    raw = np.frombuffer(gap.join([*(t or b"" for t in texts), b""]).translate(LOWER), np.uint8)
    black = np.zeros(len(raw) + 2, bool)
    black[1:-1] = ~_SPACE[raw]
    flips = np.flatnonzero(black[1:] != black[:-1])
    begin, end = flips[0::2], flips[1::2]
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    array = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[black[1:-1]])])
    array = pc.dictionary_encode(array, memory_pool=pa.system_memory_pool())  # its buffers are large: nothing of them is to be kept
    last = np.cumsum([len(t or b"") + len(gap) for t in texts], dtype=np.int64) - 2
    return array.dictionary.to_numpy(zero_copy_only=False).tolist(), array.indices.to_numpy(), np.diff(np.searchsorted(begin, last), prepend=-1)


def by_part(words: list[bytes], parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has some of the words, and their numbers."""
    part = np.fromiter(map(xxhash.xxh3_64_intdigest, words, itertools.repeat(1)), np.uint64, len(words)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    begin = runs(part[order])
    for own in np.split(order, begin[1:]) if len(words) else []:
        yield int(part[own[0]]), own


def joined(words: list[bytes], which: np.ndarray) -> bytes:
    return squeeze(CUT.join([words[k] for k in which.tolist()]))


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def squeeze_numbers(numbers: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: differences, all first bytes, all second bytes, ..."""
    gaps = np.diff(numbers, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# Counts as one byte: exact to 32, then eight steps an octave.
_VALUES = np.concatenate([np.arange(33), np.rint(32 * 2.0 ** (np.arange(1, 224) / 8))]).astype(np.float32)


def quantised(counts: np.ndarray) -> np.ndarray:
    out = np.minimum(counts, 32).astype(np.uint8)
    high = np.flatnonzero(counts > 32)
    out[high] = np.minimum(32 + np.rint(8 * np.log2(counts[high] / 32)), 255)
    return out


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where one of each stands, of each key its number, and how often each occurs."""
    order = np.argsort(keys)
    in_order = keys[order]
    begin = runs(in_order)
    times = np.diff(np.append(begin, len(keys)))
    number = np.empty(len(keys), np.int32)
    number[order] = np.repeat(np.arange(len(begin), dtype=np.int32), times)
    return in_order[begin], order[begin], number, times


def path_counts(keys: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """For sorted keys (context, path, cell): how often the context is followed by the path's first 0, 1, ... ``PATH`` bits, and by the whole cell."""
    for bits in (*range(PATH + CELL, CELL - 1, -1), 0):
        begin = runs(keys >> np.uint64(bits))
        total = np.add.reduceat(counts, begin) if len(begin) else counts
        yield np.repeat(total, np.diff(np.append(begin, len(keys))))


class Bucket:
    """Tokens of some texts, in arrays: types, documents, cells of the previous words, and the sorted keys of the contexts of two words."""

    def __init__(self, texts: list[bytes | None], trained: np.ndarray, parts: int):
        self.trained = trained
        self.types, self.type, self.tokens = tokenised(texts)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.tokens)
        self.hash = word_hashes(self.types)
        one = previous(self.hash[self.type], self.tokens)
        self.before = (one >> np.uint64(64 - BEFORE)).astype(np.int32)
        context = _mix(_mix(one) * np.uint64(3) + _mix(previous(one, self.tokens) + np.uint64(2)))
        del one
        part = (context >> np.uint64(CONTEXT)) % np.uint64(parts)
        key = (part << np.uint64(CONTEXT + PATH + CELL)) | ((context & np.uint64(2**CONTEXT - 1)) << np.uint64(PATH + CELL)) | (self.hash[self.type] >> np.uint64(64 - PATH - CELL))
        del part, context
        self.keys, _, self.at, _ = distinct(key)
        self.counts = np.bincount(self.at[self.trained[self.doc]], minlength=len(self.keys)).astype(np.uint32)

    def sent(self, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, keys, their counts in training texts)."""
        shift = np.uint64(CONTEXT + PATH + CELL)
        bounds = np.searchsorted(self.keys, np.arange(parts + 1, dtype=np.uint64) << shift)
        for part in np.nonzero(np.diff(bounds))[0].tolist():
            own = slice(bounds[part], bounds[part + 1])
            yield part, squeeze_numbers(self.keys[own] & np.uint64(2 ** int(shift) - 1)), squeeze(self.counts[own].tobytes())


def word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def previous(hashes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Of each token what stands at the one before it in its text; at a text's first token the start's."""
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[np.cumsum(tokens) - tokens] = START
    return out


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def answered(requests: list[tuple[bytes, bytes]]) -> list[bytes]:
    """To the keys and counts of each bucket: counts along their paths over all buckets, one byte each, place by place."""
    keys = [unsqueeze_numbers(k) for k, _ in requests]
    ends = np.cumsum([len(k) for k in keys])
    known, _, at, _ = distinct(np.concatenate(keys))
    sizes = [len(k) for k in keys]
    del keys
    total = np.bincount(at, np.concatenate([np.frombuffer(unsqueeze(c), np.uint32) for _, c in requests]), len(known)).astype(np.int64)
    # Behind most contexts stands one key: its count holds all along the path.
    begin = runs(known >> np.uint64(PATH + CELL))
    times = np.diff(np.append(begin, len(known)))
    several = np.flatnonzero(np.repeat(times > 1, times))
    alone = quantised(total)
    coded = []
    for c in path_counts(known[several], total[several]):
        coded.append(alone.copy())
        coded[-1][several] = quantised(c)
    return [squeeze(b"".join(c[at[e - n : e]].tobytes() for c in coded)) for n, e in zip(sizes, ends, strict=True)]


class Nodes:
    """Distinct (bytes so far, next byte) of a list of words: each byte is spelled once however many words share it."""

    def __init__(self, words: list[bytes]):
        joined = np.frombuffer(b"".join(words), np.uint8)
        self.length = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.length) - self.length
        place = np.arange(len(joined)) - np.repeat(self.starts, self.length)
        before = []  # the byte 1, 2, ... places back, and 1; 0 where the word has none
        for back in range(1, ORDERS[-1] + 1):
            b = np.zeros(len(joined), np.uint64)
            b[back:] = joined[:-back]
            b += np.uint64(1)
            b[place < back] = 0
            before.append(b)

        def context(order: int, at: slice | np.ndarray) -> np.ndarray:
            c = np.uint64(order)
            for b in before[:order]:
                c = c * np.uint64(257) + b[at]
            return _mix(c * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order))

        # The longest context and the byte settle all others.
        _, first, self.of, _ = distinct(context(ORDERS[-1], slice(None)) * np.uint64(257) + joined)
        self.byte, self.contexts = joined[first], [context(order, first) for order in ORDERS]

    def bits(self) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """(the nodes' bits, their slots in each table) for the eight bits, high first."""
        partial = np.ones(len(self.byte), np.uint64)
        for place in range(8):
            bit = (self.byte >> (7 - place)) & 1
            yield bit, [((c ^ (partial * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for c in self.contexts]
            partial = partial * np.uint64(2) + bit

    def per_node(self, of_word: np.ndarray) -> np.ndarray:
        """Sum over the words that pass each node."""
        return np.bincount(self.of, np.repeat(of_word, self.length), len(self.byte))

    def per_word(self, of_node: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_node[self.of], self.starts) if len(self.starts) else np.zeros(0)


def spelled(word: bytes) -> bytes:
    return word if word == END else word + b" "


def count_spelling(words: list[bytes], tables: np.ndarray) -> None:
    """Add the words' bits, each word once, to ``tables[order, ones or all, slot]``."""
    for at in range(0, len(words), 32768):
        nodes = Nodes([spelled(w) for w in words[at : at + 32768]])
        times = nodes.per_node(np.ones(len(nodes.length)))
        bits, slots = zip(*nodes.bits(), strict=True)
        ones, all_ = np.concatenate([times * bit for bit in bits]), np.tile(times, len(bits))
        for k, of_order in enumerate(zip(*slots, strict=True)):
            s = np.concatenate(of_order)
            tables[k, 0] += np.bincount(s, ones, 1 << SLOT_BITS).astype(np.float32)
            tables[k, 1] += np.bincount(s, all_, 1 << SLOT_BITS).astype(np.float32)


class Mixer:
    """Weights of each gate, learnt online, and the map that refines what they give."""

    STEPS, REACH = 33, 16.0

    def __init__(self, gates: int, start: list[float]):
        self.gates = gates
        self.weights = np.tile(np.array(start, np.float32)[:, None], gates)
        self.seen = np.zeros((2, gates * self.STEPS), np.float32)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """x[input, decision]: stretched predictions."""
        z = x[0] * self.weights[0].take(gate, mode="clip")
        for of_input, w in zip(x[1:], self.weights[1:], strict=True):
            z += of_input * w.take(gate, mode="clip")
        np.maximum(z, -self.REACH, out=z)
        return np.minimum(z, self.REACH, out=z)

    def near(self, z: np.ndarray) -> np.ndarray:
        return np.rint((z + self.REACH) * ((self.STEPS - 1) / (2 * self.REACH))).astype(np.int64)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one: half the mixed one, half what was seen of its like."""
        p = 1 / (1 + np.exp(-z))
        code = gate * self.STEPS + self.near(z)
        ones, all_ = self.seen[0][code], self.seen[1][code]
        return np.clip((p + (ones + 64 * p) / (all_ + 64)) / 2, 1e-7, 1 - 1e-7)

    def log10(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        p = self.refined(self.mixed(x, gate), gate)
        return np.log10(np.where(bit > 0, p, 1 - p))

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None, rate: float = 0.02, batch: int = 2048) -> None:
        """A batch of decisions is predicted, then what it shows is learnt. ``times``: how often each counts; once if left out."""
        batches = -(-len(bit) // batch)
        total = np.bincount(np.arange(len(bit)) // batch * self.gates + gate, times, batches * self.gates).reshape(batches, self.gates)
        pull = np.minimum(total, 64) / np.maximum(total, 1e-9) * rate
        bit = bit.astype(np.float64)
        for k in range(batches):
            some = slice(k * batch, (k + 1) * batch)
            g = gate[some]
            z = self.mixed(x[:, some], g)
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            miss = bit[some] - np.divide(1, z, out=z)
            if times is not None:
                miss *= times[some]
            for of_input, w in zip(x, self.weights, strict=True):
                w += pull[k] * np.bincount(g, of_input[some] * miss, self.gates)

    def watch(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        code = gate * self.STEPS + self.near(self.mixed(x, gate))
        for k, w in enumerate((bit if times is None else times * bit, times)):
            self.seen[k] += np.bincount(code, w, self.seen.shape[1]).astype(np.float32)


LEVELS = 8
_LEVEL = np.array([0, *(min(math.ceil(math.log2(n)) + 1, LEVELS - 1) for n in range(1, 2**LEVELS))], np.uint8)


def level(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, 3-4, 5-8, ...: how much a context has seen."""
    return _LEVEL[np.minimum(counts, len(_LEVEL) - 1).astype(np.int32)]


def stretched(ones: np.ndarray, all_: np.ndarray, least: float) -> np.ndarray:
    return np.log((ones + least) / (np.maximum(all_ - ones, 0) + least)).astype(np.float32)


def signed(here: np.ndarray, further: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Stretched prediction of a one, of contexts that were seen ``here`` times, ``further`` of them with this bit."""
    to = np.log((further + np.float32(0.15)) / (here - further + np.float32(0.15)))
    return np.where(bit > 0, to, -to)


class SpellingTables:
    """What ``count_spelling`` counted, and, worked out once, what predictors give: for words that aren't in the counts, and for those that are and are left out of their own."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.views = counts, None

    def __reduce__(self):
        return SpellingTables, (self.counts,)

    def given(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For held = 0 and 1: stretched predictions [order, 2 * slot + bit], and levels [2 * slot + bit] of the longest context."""
        if self.views is None:
            bit = np.array([0, 1], np.float32)
            self.views = []
            for held in (0, 1):
                predictions = np.empty((len(self.counts), 2 * self.counts.shape[-1]), np.float32)
                for of_order, (ones, all_) in zip(predictions, self.counts[..., None], strict=True):
                    rest = np.maximum(all_ - held, 0) + 0 * bit
                    of_order[:] = stretched(np.clip(ones - held * bit, 0, rest), rest, 0.2).ravel()
                self.views.append((predictions, level(rest).ravel()))
        return self.views


class Spelling:
    """Probability of a new word's bytes."""

    def __init__(self, tables: SpellingTables):
        self.tables = tables
        self.mixer = Mixer(LEVELS * 8, [0.3] * len(ORDERS))

    def decisions(self, nodes: Nodes, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(inputs, gates, bits) place by place. ``held``: whether the words are in the counts, and are predicted without themselves."""
        predictions, levels = self.tables.given()[held]
        for place, (bit, slots) in enumerate(nodes.bits()):
            x = np.empty((len(ORDERS), len(bit)), np.float32)
            for k, s in enumerate(slots):
                at = 2 * s + bit
                np.take(predictions[k], at, out=x[k], mode="clip")
            yield x, place * LEVELS + levels[at].astype(np.int64), bit

    def parts(self, words: list[bytes], counted: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, Nodes, int]]:
        """Words of one kind, in the counts or not, ``size`` at most at a time: (their numbers, nodes, kind)."""
        for held in (0, 1):
            which = np.nonzero(counted == held)[0]
            for at in range(0, len(which), size):
                some = which[at : at + size]
                yield some, Nodes([spelled(words[k]) for k in some.tolist()]), held

    def learn(self, words: list[bytes], counted: np.ndarray) -> list[tuple[np.ndarray, Nodes, int]]:
        """What ``scored`` takes: the words' nodes, so that they are found once."""
        found = list(self.parts(words, counted, 4096))
        for _, nodes, held in found:
            passing = nodes.per_node(np.ones(len(nodes.length)))
            for x, gate, bit in self.decisions(nodes, held):
                self.mixer.learn(x, gate, bit, passing)
                self.mixer.watch(x, gate, bit, passing)
        return found

    def scored(self, found: Iterable[tuple[np.ndarray, Nodes, int]], n: int) -> np.ndarray:
        out = np.zeros(n)
        for some, nodes, held in found:
            out[some] = nodes.per_word(sum(self.mixer.log10(x, gate, bit) for x, gate, bit in self.decisions(nodes, held)))
        return out

    def log10(self, words: list[bytes], counted: np.ndarray) -> np.ndarray:
        return self.scored(self.parts(words, counted, 32768), len(words))


class Totals:
    """What all training texts hold: tokens, distinct ones, those that come once, how often each cell of the hash occurs, and each path behind each cell of the previous word."""

    def __init__(self, tokens: int, distinct: int, once: int, cells: np.ndarray, pairs: np.ndarray):
        self.tokens, self.distinct, self.once, self.cells = tokens, distinct, once, cells
        self.nodes = [cells.reshape(2**d, -1).sum(1) for d in range(PATH + 1)]
        self.pairs, self.views = pairs.astype(np.float32), None

    def __getstate__(self):
        return self.__dict__ | {"views": None}

    def alone(self) -> list[np.ndarray]:
        """Stretched predictions of a one, of the path so far alone."""
        return [stretched(further[1::2], here, 0.5) for here, further in itertools.pairwise(self.nodes)]

    def after(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each cell of the previous word, bit by bit of the path, worked out once: the stretched prediction [cell and path so far and bit] of a one, and
        the level [cell and path so far] of what was seen. The second half of each is for a token that is in the counts and is left out of them."""
        if self.views is None:
            counts = [self.pairs.reshape(2 ** (BEFORE + d), -1).sum(1) for d in range(PATH + 1)]
            counts = [np.concatenate([c, np.maximum(c - 1, 0)]) for c in counts]
            self.views = [signed(np.repeat(here, 2), further, np.arange(len(further)) & 1) for here, further in itertools.pairwise(counts)], [level(c) for c in counts[:PATH]]
        return self.views


def pair_codes(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (before.astype(np.int64) << PATH) | (hashes >> np.uint64(64 - PATH)).astype(np.int64)


class Piece:
    """What the tokens ``which`` (whole documents) have behind them: ``code``: whether they are in the counts, the previous word's cell and the path;
    of the ``alive``, those whose two words were seen in other documents, what is seen of these without the document's own."""

    def __init__(self, which: np.ndarray, known: np.ndarray, bucket: Bucket, answers: list[np.ndarray], contexts: np.ndarray, totals: Totals):
        """``contexts``: numbers of those of the bucket's keys."""
        self.which, self.known, self.totals = which, known, totals
        trained = bucket.trained[bucket.doc[which]]
        path = (bucket.hash >> np.uint64(64 - PATH)).astype(np.int32)[bucket.type[which]]
        self.code = ((trained.astype(np.int32) << BEFORE | bucket.before[which]) << PATH) | path
        # A context that was seen once, or as often as the document holds it, was seen nowhere else.
        self.alive = np.flatnonzero(answers[0][bucket.at[which]] > trained).astype(np.int32)
        which, path, once = which[self.alive], path[self.alive], trained[self.alive].astype(np.float32)
        key_at = bucket.at[which]
        left_over = [_VALUES[a[key_at]] - once for a in answers]
        # Most pairs of words occur once in a document: it then passed every place of the path once. For the others, contexts by their numbers
        # are short enough to stand behind a document's number.
        composite = ((bucket.doc[which] - bucket.doc[self.which[0]]).astype(np.uint64) << np.uint64(24)) | contexts[key_at]
        composite = (composite << np.uint64(PATH + CELL)) | (bucket.keys[key_at] & np.uint64(2 ** (PATH + CELL) - 1))
        order = np.argsort(composite)
        in_order = composite[order]
        begin = runs(in_order >> np.uint64(PATH + CELL))
        times = np.diff(np.append(begin, len(in_order)))
        several = np.flatnonzero(np.repeat(times > 1, times))
        again = order[several]
        for rest, m in zip(left_over, path_counts(in_order[several], np.ones(len(several), np.int64)), strict=True):
            rest[again] -= (m - 1) * once[again]
            np.maximum(rest, 0, out=rest)
        for further, here in zip(left_over[-1:0:-1], left_over[-2::-1], strict=True):  # counts above 32 are rounded: what is further along isn't more
            np.maximum(here, further, out=here)
        self.two_words = [signed(here, further, (path >> (PATH - 1 - d)) & 1) for d, (here, further) in enumerate(zip(left_over[:PATH], left_over[1:], strict=False))]
        self.two_level = [level(c) for c in left_over[:PATH]]
        self.in_path, self.in_cell = left_over[PATH:]

    def whole(self, of_alive: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.which), of_alive.dtype)
        out[self.alive] = of_alive
        return out

    def gate(self, depth: int) -> np.ndarray:
        """How much each context has seen; 0 if none has."""
        gate = self.totals.after()[1][depth][self.code >> (PATH - depth)] * LEVELS
        gate[self.alive] += self.two_level[depth]
        return gate.astype(np.int64)

    def inputs(self, depth: int, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Predictions and bits, of the tokens ``use`` or of all."""
        two = self.whole(self.two_words[depth])
        code, two = (self.code, two) if use is None else (self.code[use], two[use])
        further = code >> (PATH - 1 - depth)
        x = np.empty((3, len(code)), np.float32)
        np.take(self.totals.alone()[depth], (further >> 1) & (2**depth - 1), out=x[0], mode="clip")
        np.take(self.totals.after()[0][depth], further, out=x[1], mode="clip")
        x[2] = two
        return x, further & 1


def token_scores(bucket: Bucket, answers: list[np.ndarray], counts: np.ndarray, totals: Totals, tables: SpellingTables, learn_docs: np.ndarray, batch: int = 200_000) -> np.ndarray:
    """log10 probability of every token of ``bucket``. ``answers[place]``: counts, as bytes, of each of its keys; ``counts``: of its types in all training texts; ``learn_docs``: documents on which weights are fitted."""
    n = len(bucket.type)
    out = np.zeros(n)
    if not n:
        return out
    words = bucket.types
    word_mixer, fresh = Mixer(LEVELS * LEVELS, [0.9, 0.1, 0.3]), np.zeros((LEVELS * LEVELS, 2))
    spelling = Spelling(tables)
    odds_of_new = (totals.once + 0.5) / (totals.tokens + 1)

    # A document's own occurrences: of its types, and along its contexts' paths.
    _, _, at, own_count = distinct(bucket.doc.astype(np.int64) * len(words) + bucket.type)
    own = np.where(bucket.trained[bucket.doc], own_count.astype(np.int32)[at], np.int32(0))
    left = np.maximum(counts[bucket.type] - own, 0)
    del at, own_count
    begin = runs(bucket.keys >> np.uint64(PATH + CELL))
    contexts = np.repeat(np.arange(len(begin), dtype=np.uint32), np.diff(np.append(begin, len(bucket.keys))))
    del begin
    piece_of = lambda which: Piece(which, left[which] > 0, bucket, answers, contexts, totals)
    ends = np.cumsum(bucket.tokens)

    def pieces(docs: np.ndarray) -> Iterator[np.ndarray]:
        """Tokens of the documents, some whole documents at a time."""
        group: list[int] = []
        size = 0
        for d in docs.tolist():
            if group and (size + bucket.tokens[d] > batch or d - group[0] >= 4096):
                yield np.concatenate([np.arange(ends[g] - bucket.tokens[g], ends[g], dtype=np.int32) for g in group])
                group, size = [], 0
            group.append(d)
            size += int(bucket.tokens[d])
        if group:
            yield np.concatenate([np.arange(ends[g] - bucket.tokens[g], ends[g], dtype=np.int32) for g in group])

    def new_words(which: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        kinds, back = np.unique(bucket.type[which] * 2 + (counts[bucket.type[which]] > 0), return_inverse=True)
        return [words[k] for k in (kinds // 2).tolist()], kinds % 2, back.reshape(-1)

    fitted = []
    for which in pieces(learn_docs):
        piece, found, back = piece_of(which), [], None
        gate = piece.gate(0)
        fresh[:, 0] += np.bincount(gate[~piece.known], minlength=len(fresh))
        fresh[:, 1] += np.bincount(gate, minlength=len(fresh))
        for depth in range(PATH):
            gate = piece.gate(depth)
            use = np.flatnonzero(piece.known & (gate > 0))
            x, bit = piece.inputs(depth, use)
            word_mixer.learn(x, gate[use], bit)
            word_mixer.watch(x, gate[use], bit)
        if not piece.known.all():
            some, counted, back = new_words(which[~piece.known])
            found = spelling.learn(some, counted)
        fitted.append((piece, found, back))
    odds = (fresh[:, 0] + 16 * odds_of_new) / (fresh[:, 1] + 16)
    # Where no context has been seen, a word's path depends on the path alone.
    word_mixer.weights[:, 0] = (1, 0, 0)
    every = np.arange(2**PATH)
    alone = np.zeros((PATH, len(every)))
    for depth in range(PATH):
        x = np.zeros((3, len(every)), np.float32)
        x[0] = totals.alone()[depth][every >> (PATH - depth)]
        alone[depth] = word_mixer.log10(x, np.zeros(len(every), np.int64), (every >> (PATH - 1 - depth)) & 1)

    def asked() -> Iterator[tuple[Piece, list, np.ndarray | None]]:
        """What has been fitted on, then the other documents."""
        while fitted:
            yield fitted.pop()
        for which in pieces(np.setdiff1d(np.arange(len(bucket.tokens)), learn_docs)):
            piece, found, back = piece_of(which), [], None
            if not piece.known.all():
                some, counted, back = new_words(which[~piece.known])
                found = list(spelling.parts(some, counted, 32768))
            yield piece, found, back

    for piece, found, back in asked():
        which, known = piece.which, piece.known
        path = piece.code & (2**PATH - 1)
        p_new = odds[piece.gate(0)]
        log = np.log10(np.where(known, 1 - p_new, p_new))
        for depth in range(PATH):
            gate = piece.gate(depth)
            bare = np.flatnonzero(known & (gate == 0))
            log[bare] += alone[depth][path[bare]]
            use = known & (gate > 0)
            if use.mean() > 0.5:  # then picking them out costs more than the others
                x, bit = piece.inputs(depth)
                log += np.where(use, word_mixer.log10(x, gate, bit), 0.0)
                continue
            use = np.flatnonzero(use)
            x, bit = piece.inputs(depth, use)
            log[use] += word_mixer.log10(x, gate[use], bit)
        use = np.flatnonzero(known)
        own_here = own[which][use]
        cell = (bucket.hash[bucket.type[which][use]] >> np.uint64(64 - PATH - CELL)).astype(np.int64)
        in_cell = np.maximum(totals.cells[cell] - own_here, left[which][use])
        in_path = np.maximum(totals.nodes[PATH][path[use]] - own_here, in_cell)
        seen_cell, seen_path = piece.whole(piece.in_cell)[use], piece.whole(piece.in_path)[use]
        log[use] += np.log10((seen_cell + 0.3 * in_cell / in_path) / (seen_path + 0.3)) + np.log10(left[which][use] / in_cell)
        if back is not None:
            log[~known] += spelling.scored(found, sum(len(some) for some, _, _ in found))[back]
        out[which] = log
    return out


BLOCK_BITS = 14
MOST_SENDERS = 64
TABLES = len(ORDERS) * 2 << SLOT_BITS  # then the cells, then the pairs
PAIRS = (TABLES + 2 ** (PATH + CELL)) >> BLOCK_BITS


def scores(documents: DataFrame, bucket_bytes: int = 8_000_000, part_bytes: int = 16_000_000) -> DataFrame:
    """``documents(doc_id, text, ...)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = documents.sparkSession
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 7) == 2, F.lit(False))
    rows = documents.select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.lit(0))).first()[0]
    buckets, parts = max(1, -(-size // bucket_bytes)), max(1, -(-size // part_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(buckets)).cast("int"))

    # 1. Words with their counts, from every task's texts, dealt by hash; and what follows which cell.
    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(2 ** (BEFORE + PATH))
        types: dict[bytes, int] = _Numbers()
        counts, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def rows(part: list, block: list, words: list, numbers: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(words, pa.binary()), pa.array(numbers, pa.binary())], ["part", "block", "words", "counts"])

        def dealt() -> pa.RecordBatch:
            words = list(types)
            own = list(by_part(words, parts))
            return rows([p for p, _ in own], [None] * len(own), [joined(words, at) for _, at in own], [squeeze(counts[at].astype(np.uint32).tobytes()) for _, at in own])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                words, ids, tokens = tokenised([t.as_py() for t in batch.column(0).slice(at, 1024)])
                ids = np.fromiter(map(types.__getitem__, words), np.int32, len(words))[ids]
                hashes = np.concatenate([hashes, word_hashes(list(itertools.islice(types, len(hashes), None)))])
                here = hashes[ids]
                pairs += np.bincount(pair_codes(here, previous(here, tokens) >> np.uint64(64 - BEFORE)), minlength=len(pairs))
                more = np.bincount(ids, minlength=len(types))
                more[: len(counts)] += counts
                counts = more
                if len(types) > 300_000:
                    yield dealt()
                    types.clear()
                    counts, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if types:
            yield dealt()
        blocks = [(k, b) for k, b in enumerate(pairs.reshape(-1, 1 << BLOCK_BITS)) if b.any()]
        if blocks:
            yield rows([-1] * len(blocks), [PAIRS + k for k, _ in blocks], [None] * len(blocks), [squeeze(b.tobytes()) for _, b in blocks])

    sent = cut(rows.where(~F.col("held_out")).select("text").mapInArrow(send_words, "part int, block bigint, words binary, counts binary"))

    # 2. A part's words: their spelling and cells are counted, and their counts kept for whoever asks.
    def train(group: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for words, counts in zip(group.column("words"), group.column("counts"), strict=True):
            for w, c in zip(unsqueeze(words.as_py()).split(CUT), np.frombuffer(unsqueeze(counts.as_py()), np.uint32).tolist(), strict=True):
                total[w] += c
        words = sorted(total)
        counts = np.array([total[w] for w in words], np.int64)
        tables = np.zeros((len(ORDERS), 2, 1 << SLOT_BITS), np.float32)
        count_spelling(words, tables)
        cells = np.bincount((word_hashes(words) >> np.uint64(64 - PATH - CELL)).astype(np.int64), counts, 2 ** (PATH + CELL))
        flat = np.concatenate([tables.ravel().astype(np.float64), cells])
        block, payload = [], []
        for at in range(0, len(flat), 1 << BLOCK_BITS):
            some = flat[at : at + (1 << BLOCK_BITS)]
            if some.any():
                block.append(at >> BLOCK_BITS)
                payload.append(squeeze(some.tobytes()))
        sums = np.array([counts.sum(), len(words), (counts == 1).sum()], np.int64)
        block += [-1, -2]
        payload += [squeeze(CUT.join(words)), sums.tobytes()]
        numbers = [None] * (len(block) - 2) + [squeeze(counts.tobytes()), None]
        part = group.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(block), pa.int32()), "block": pa.array(block, pa.int64()), "payload": pa.array(payload, pa.binary()), "counts": pa.array(numbers, pa.binary())})

    trained = cut(sent.where("part >= 0").groupBy("part").applyInArrow(train, "part int, block bigint, payload binary, counts binary"))

    def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of equal blocks, which come one after another; one block is held at a time."""
        here, total = None, None
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some = np.frombuffer(unsqueeze(payload.as_py()), np.float64)
                if block != here and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([squeeze(total.tobytes())], pa.binary())], ["block", "payload"])
                here, total = block, some if block != here else total + some
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([squeeze(total.tobytes())], pa.binary())], ["block", "payload"])

    def added(blocks: DataFrame, *salt: str) -> DataFrame:
        return blocks.repartition("block", *salt).sortWithinPartitions("block").select("block", "payload").mapInArrow(add_blocks, "block bigint, payload binary")

    tasks = sent.where("part < 0").groupBy("block").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks, senders = trained.where("block >= 0").select("block", "payload").unionByName(sent.where("part < 0").select("block", F.col("counts").alias("payload"))), max(parts, tasks)
    while senders > MOST_SENDERS:  # many parts' tables are summed in steps, so that no task reads all of a block's
        blocks = added(blocks.withColumn("salt", F.pmod(F.crc32("payload"), F.lit(-(-senders // 32)))), "salt")
        senders = -(-senders // 32)
    # A bounded result: TABLES + 2**(PATH + CELL) + 2**(BEFORE + PATH) numbers, whatever the input's size.
    flat = np.zeros(TABLES + 2 ** (PATH + CELL) + 2 ** (BEFORE + PATH))
    for r in added(blocks).toLocalIterator():
        flat[r["block"] << BLOCK_BITS :][: 1 << BLOCK_BITS] = np.frombuffer(unsqueeze(bytes(r["payload"])), np.float64)
    sums = trained.where("block = -2").select("payload").mapInArrow(_summed, "tokens bigint, distinct bigint, once bigint").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "once"))).first()
    drop_table(sent)
    totals = Totals(*map(int, sums), flat[TABLES:][: 2 ** (PATH + CELL)], flat[PAIRS << BLOCK_BITS :])
    shared = spark.sparkContext.broadcast((totals, SpellingTables(flat[:TABLES].astype(np.float32).reshape(len(ORDERS), 2, -1))))
    del flat

    # 3. Every bucket asks: its words, and the keys of its contexts.
    def ordered(group: pa.Table) -> pa.Table:
        """The same order however the rows came."""
        group = group.combine_chunks()
        key = [(-1 if i is None else 0, i or 0, xxhash.xxh3_64_intdigest(t.as_py() or b"")) for i, t in zip(group.column("doc_id").to_pylist(), group.column("text"), strict=True)]
        return group.take(pa.array(sorted(range(len(key)), key=key.__getitem__), pa.int64()))

    def opened(group: pa.Table) -> Bucket:
        return Bucket([t.as_py() for t in group.column("text")], ~group.column("held_out").to_numpy(zero_copy_only=False).astype(bool), parts)

    def ask(group: pa.Table) -> pa.Table:
        number = group.column("bucket")[0].as_py()
        bucket = opened(ordered(group))
        asked = [(0, part, joined(bucket.types, at), None) for part, at in by_part(bucket.types, parts)]
        asked += [(1, *x) for x in bucket.sent(parts)]
        kind, part, keys, counts = zip(*asked, strict=True)
        return pa.table({"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()), "bucket": pa.array([number] * len(asked), pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    requests = rows.groupBy("bucket").applyInArrow(ask, "kind int, part int, bucket int, keys binary, counts binary")
    vocabulary = trained.where("block = -1").select(F.lit(0).alias("kind"), "part", F.lit(-1).alias("bucket"), F.col("payload").alias("keys"), "counts")

    def answer(group: pa.Table) -> pa.Table:
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        buckets = group.column("bucket").to_pylist()
        if kind:
            given = answered([(k.as_py(), c.as_py()) for k, c in zip(group.column("keys"), group.column("counts"), strict=True)])
        else:
            known: dict[bytes, int] = {}
            for b, keys, counts in zip(buckets, group.column("keys"), group.column("counts"), strict=True):
                if b < 0:
                    known = dict(zip(unsqueeze(keys.as_py()).split(CUT), np.frombuffer(unsqueeze(counts.as_py()), np.int64).tolist(), strict=True))
            given = [squeeze(np.array([known.get(w, 0) for w in unsqueeze(keys.as_py()).split(CUT)] if b >= 0 else [], np.int64).tobytes()) for b, keys in zip(buckets, group.column("keys"), strict=True)]
        use = [k for k, b in enumerate(buckets) if b >= 0]
        return pa.table({"bucket": pa.array([buckets[k] for k in use], pa.int32()), "kind": pa.array([kind] * len(use), pa.int32()), "part": pa.array([part] * len(use), pa.int32()), "given": pa.array([given[k] for k in use], pa.binary())})

    answers = requests.unionByName(vocabulary).groupBy("kind", "part").applyInArrow(answer, "bucket int, kind int, part int, given binary")

    # 4. Scores.
    def score(group: pa.Table, got: pa.Table) -> pa.Table:
        totals, tables = shared.value
        group = ordered(group)
        bucket = opened(group)
        given = {(k, p): g for k, p, g in zip(got.column("kind").to_pylist(), got.column("part").to_pylist(), got.column("given"), strict=True)}
        counts = np.zeros(len(bucket.types), np.int64)
        for part, at in by_part(bucket.types, parts):
            counts[at] = np.frombuffer(unsqueeze(given[0, part].as_py()), np.int64)
        own = [np.frombuffer(unsqueeze(given[1, p].as_py()), np.uint8).reshape(PATH + 2, -1) for p in range(parts) if (1, p) in given]
        paths = list(np.concatenate(own, 1))
        del given, got, own
        ids = group.column("doc_id").to_pylist()
        log = token_scores(bucket, paths, counts, totals, tables, np.flatnonzero(bucket.trained))
        base = np.log10(counts + 1.0) - math.log10(totals.tokens + totals.distinct + 1)
        total = lambda per_token: np.bincount(bucket.doc, per_token, len(ids))
        points = total(log)
        text = [t.as_py() for t in group.column("text")]
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "held_out": group.column("held_out"),
                "n_tokens": pa.array(bucket.tokens, pa.int64()),
                "n_known": pa.array(total(counts[bucket.type] > 0).astype(np.int64), pa.int64()),
                "train_tokens": pa.array([totals.tokens] * len(ids), pa.int64()),
                "base_score": pa.array(total(base[bucket.type]), pa.float64()),
                "score": pa.array(points, pa.float64()),
                "bits_per_byte": pa.array([-s / math.log10(2) / len(t) if t else None for s, t in zip(points.tolist(), text, strict=True)], pa.float64()),
            }
        )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = np.array([np.frombuffer(p.as_py(), np.int64) for p in batch.column(0)], np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(sums[:, k], pa.int64()) for k in range(3)], ["tokens", "distinct", "once"])
