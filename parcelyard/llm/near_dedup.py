"""Near-duplicate groups by b-bit MinHash.

A text is the set of its distinct shingles of five words. Equal sets are one class; what follows works on one text of each class.

1. ``sketch``: ``BANDS * ROWS`` minima a text. Five minima make a band key; of every minimum the low four bits are packed, 16 to a long.
2. Texts that share a band key are candidates. Each is first paired with its bucket's least id (a star, so a bucket of n texts gives
   n - 1 pairs), the pair's similarity is estimated from the packed bits - matching fields, corrected for the 1/16 that match by
   chance - and what lies clearly under the threshold goes.
3. What is left is confirmed on the full sets, and confirmed links make components.
4. A bucket that holds texts of several components may hold links that its star missed. Its texts are dealt in blocks bounded in texts
   and in shingles, those of its largest component apart from the rest, and every pair of blocks but those of the largest component
   itself is estimated by bit counts; pairs of different components that may reach the threshold are confirmed on the spot.

A pair at similarity 0.75 shares no band with probability 7e-6, and lies under the estimate's cut with probability 1e-6.

Defined results: texts without words (null, empty, white space) have no shingle and stand alone; rows with one doc_id are one node, so
they share a component; rows without doc_id stand alone, with a null component, and are kept; other columns don't matter.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_table, free_name

WIDTH, ROWS, BANDS, BITS = 5, 5, 45, 4
BLOCK, BLOCK_SHINGLES = 256, 400_000
K = 240  # minima; the bands use the first 225, the signature all
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.RandomState(20240501)
_XOR = _rng.randint(0, 2**32, (K, 1), dtype=np.int64).astype(np.uint32)
_MUL = _rng.randint(0, 2**31, (K, 1), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_MUL = _rng.randint(0, 2**63, (BANDS, ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.randint(0, 2**63, WIDTH, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.zeros(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The text's distinct shingles, as sorted 64-bit hashes. Words: what space and the characters 9 to 13 part; A-Z in lower case."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return _EMPTY
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n = len(words) - width + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, width):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mix(total))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits of the minima) of a set that isn't empty."""
    low, short = np.full(K, 2**32 - 1, np.uint32), shingles.astype(np.uint32)
    for at in range(0, len(short), 1024):
        part = short[None, at : at + 1024] ^ _XOR
        part *= _MUL
        np.minimum(low, part.min(1), out=low)
    low = _mix(low.astype(np.uint64) + (np.arange(K, dtype=np.uint64) << np.uint64(32)))
    keys = _mix((low[: BANDS * ROWS].reshape(BANDS, ROWS) * _BAND_MUL).sum(1) + np.arange(BANDS, dtype=np.uint64))
    fields = (low & np.uint64(2**BITS - 1)).reshape(-1, 64 // BITS)
    packed = (fields << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def corrected(matches, total: int = K):
    """Similarity from the number of equal fields: 1 in 2**BITS is equal by chance."""
    return (matches / total - 2.0**-BITS) / (1 - 2.0**-BITS)


def fewest_matches(threshold: float, sigmas: float = 5.0) -> int:
    """Equal fields from which a pair may reach ``threshold``, that many standard deviations under what is expected."""
    share = threshold + (1 - threshold) * 2.0**-BITS
    return int(K * share - sigmas * (K * share * (1 - share)) ** 0.5)


def matching(a: Column, b: Column) -> Column:
    """Number of equal fields of two signatures: a bit count of the fields in which they differ, folded to one bit each."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(K) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)


def sketches(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes of the whole set; null if empty), keys, signature. One row a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, set_keys, keys, signatures = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                k, g = sketch(s) if len(s) else (None, None)
                set_keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(k)
                signatures.append(g)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(set_keys, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "keys", "signature"],
            )

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, keys array<bigint>, signature array<bigint>")


def may_hold(documents: DataFrame, ids: DataFrame, log2_bits: int = 23, inside: bool = True) -> DataFrame:
    """``documents`` without most rows whose doc_id isn't in ``ids`` (or, not ``inside``, the others): a bitmap of 2**log2_bits bits, whatever the input's size, is broadcast (1 MB), so that the others' texts needn't be shuffled."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(2**log2_bits))
    maps = ids.select(bit(F.col(ids.columns[0])).alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("_block")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("_map"))
    at = F.pmod("_bit", F.lit(32768))
    byte = F.conv(F.hex(F.expr("substring(_map, int(pmod(_bit, 32768) div 8) + 1, 1)")), 16, 10).cast("int")
    marked = documents.withColumn("_bit", bit(F.col("doc_id"))).withColumn("_block", (F.col("_bit") / 32768).cast("int"))
    held = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2.0), F.pmod(at, F.lit(8))).cast("int")) != 0, F.lit(False))
    return marked.join(F.broadcast(maps), "_block", "inner" if inside else "left").where(held if inside else ~held).drop("_bit", "_block", "_map")


def plain_texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text, as bytes, of about the rows with one of ``ids``; of equal rows one."""
    texts = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"))
    return may_hold(texts, ids).dropDuplicates()


def confirm(pairs: DataFrame, documents: DataFrame, threshold: float, width: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets have at least ``threshold``: 100 * intersection >= 100 * threshold * union.

    Texts travel, not sets: they are smaller. A pair is checked where ``b``'s text meets ``a``'s, by a plain join, so that a text with
    many pairs can be split over tasks.
    """
    percent = round(100 * threshold)
    texts = plain_texts(documents, pairs.select("a").union(pairs.select("b")))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_a = None, _EMPTY
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column(2), batch.column(3), strict=True):
                text_a = text_a.as_py()
                if text_a != last:  # rows come in the order of a
                    last, set_a = text_a, shingle_set(text_a, width)
                set_b = shingle_set(text_b.as_py(), width)
                union = len(np.union1d(set_a, set_b))
                keep.append(100 * (len(set_a) + len(set_b) - union) >= percent * union > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint").distinct()


def _root(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _blocks(texts: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(texts / F.lit(BLOCK), shingles / F.lit(BLOCK_SHINGLES))).cast("int")


class Sets:
    """Shingle sets by node, as many of the latest as take ``limit`` bytes."""

    def __init__(self, width: int, limit: int = 24_000_000):
        self.width, self.limit, self.held, self.size = width, limit, OrderedDict(), 0

    def __call__(self, node: int, text: bytes) -> np.ndarray:
        found = self.held.pop(node, None)
        if found is None:
            found = shingle_set(text, self.width)
            self.size += found.nbytes
        self.held[node] = found
        while self.size > self.limit and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return found


def in_blocks(members: DataFrame) -> DataFrame:
    """``members(key, node, component, n_shingles)`` dealt for comparison: (key, lo, hi, own, node, component).

    A bucket's texts are dealt in blocks of about ``BLOCK`` texts and ``BLOCK_SHINGLES`` shingles, and each pair of blocks is one piece of
    work, so none holds more than two blocks. The blocks of the bucket's largest component meet those of the rest only, so a bucket of n
    texts of which r are outside that component takes r * n comparisons. A bucket that fits in one block is one.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    largest = F.struct("n", "component")
    whole = sizes.groupBy("key").agg(F.max(largest).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max_by("w", largest).alias("w_major"))
    one = _blocks(F.col("n"), F.col("w")) == 1
    whole = whole.select(
        "key",
        F.col("m.component").alias("major"),
        F.when(one, 0).otherwise(_blocks(F.col("m.n"), F.col("w_major"))).alias("majors"),
        F.when(one, 1).otherwise(_blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("w_major"))).alias("rests"),
    )
    at = F.xxhash64("node")
    numbers = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    below = F.transform(numbers("majors"), lambda x: -1 - x)
    return (
        members.join(whole, "key")
        .withColumn("own", F.when((F.col("component") == F.col("major")) & (F.col("majors") > 0), -1 - F.pmod(at, F.col("majors"))).otherwise(F.pmod(at, F.col("rests"))).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("own") < 0, numbers("rests")).otherwise(F.concat(numbers("rests"), below))))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component")
    )


def likely_pairs(own: np.ndarray, lo: int, hi: int, comp: np.ndarray, sig: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(equal fields, one row, other row) of the block pair's rows that may reach the threshold and whose components differ."""
    first, second = np.nonzero(own == lo)[0], np.nonzero(own == hi)[0]
    for at in range(0, len(first) if len(second) else 0, 64):
        some = first[at : at + 64]
        z = sig[some, None, :] ^ sig[None, second, :]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        same = K - np.bitwise_count(z & np.uint64(0x1111111111111111)).sum(2, dtype=np.int32)
        i, j = np.nonzero((same >= least) & (comp[some, None] != comp[None, second]) & ((lo < hi) | (some[:, None] > second[None, :])))
        yield same[i, j], some[i], second[j]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (key, lo, hi), which come one after another."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[:3]):
        yield list(group)


def across(members: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links (a, b) between components within buckets that hold several, confirmed on full sets.

    ``members(key, node, component, n_shingles)``, ``texts(node, keys, signature, text)``. Texts come to the rows once they are dealt, so
    they are shuffled once for the join and once to their blocks. A pair that shares several buckets is looked at in the first only. Likely pairs come first, and a pair whose components have met meanwhile needs no look, so at most one link less
    than there are texts leaves a block pair, and no pair that may link is left out.
    """
    percent, least = round(100 * threshold), fewest_matches(threshold)
    dealt = in_blocks(members).join(texts, "node").where(F.array_contains("keys", F.col("key"))).select("key", "lo", "hi", "own", "node", "component", "keys", "signature", "text")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def links(group: list[tuple], set_of: Callable[[int, bytes], np.ndarray]) -> Iterator[tuple[int, int]]:
        key, lo, hi = group[0][:3]
        own, node, comp = (np.array([g[k] for g in group]) for k in (3, 4, 5))
        keys, sig = np.array([g[6] for g in group]), np.array([g[7] for g in group]).view(np.uint64)
        band = int(np.nonzero(keys[0] == key)[0][0])
        found = [np.zeros((0, 3), np.int64)]
        for same, one, two in likely_pairs(own, lo, hi, comp, sig, least):
            met_first = (keys[one, :band] != keys[two, :band]).all(1)
            found.append(np.stack([same, one, two], 1)[met_first])
        parent: dict = {}
        found = np.concatenate(found)
        for i, j in found[np.argsort(-found[:, 0], kind="stable"), 1:].tolist():
            x, y = _root(parent, comp[i]), _root(parent, comp[j])
            if x == y:
                continue
            one, two = (set_of(group[k][4], group[k][8]) for k in (i, j))
            union = len(np.union1d(one, two))
            if 100 * (len(one) + len(two) - union) >= percent * union:
                parent[x] = y
                yield int(node[j]), int(node[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = Sets(width)
        for group in grouped(batches):
            found = list(links(group, set_of))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component: the least node that can be reached.

    Each round hooks every root on its least neighbouring root, shortens the chains of roots to their ends and contracts the links; at
    most half of the roots of a component are left each time. No node's links are ever gathered.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    labels = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
    work = cut(links)
    while not work.isEmpty():
        hooks = cut(work.groupBy("a").agg(F.min("b").alias("to")))  # a's larger root goes to its least neighbour
        while True:
            step = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.a"), "left")
            longer = cut(step.select(F.col("x.a").alias("a"), F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")))
            drop_table(hooks)
            hooks = longer
            if hooks.where("moved").isEmpty():
                break
        hooks = hooks.select("a", "to")
        moved = lambda df, col: df.join(hooks.select(F.col("a").alias(col), F.col("to").alias("_to")), col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")
        old_labels, old_work = labels, work
        labels = cut(moved(labels, "component"))
        work = cut(moved(moved(work, "a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        drop_table(old_labels)
        drop_table(old_work)
        drop_table(hooks)
    return labels


def near_duplicates(documents: DataFrame, threshold: float = 0.75, width: int = WIDTH) -> DataFrame:
    """One row a row of ``documents(doc_id, text, ...)``: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    sketched = cut(sketches(documents, width))
    classes = cut(sketched.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node")))
    # One row of each class; rows of one doc_id with several sets are several classes and one node.
    texts = sketched.join(classes, (F.col("doc_id") == F.col("node")) & (sketched["set_key"] == classes["set_key"])).select("node", sketched["set_key"], "n_shingles", "keys", "signature")
    texts = cut(texts.dropDuplicates(["node", "set_key"]))
    banded = texts.select("node", F.explode("keys").alias("key"))
    buckets = cut(banded.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"))

    stars = banded.join(buckets.select("key", "a"), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    signatures = texts.select("node", "signature")
    estimated = stars.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("sig_b")), "b").join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("sig_a")), "a")
    likely = cut(estimated.where(matching(F.col("sig_a"), F.col("sig_b")) >= fewest_matches(threshold)).select("a", "b").distinct())
    links = cut(confirm(likely, documents, threshold, width))
    labels = components(links)

    # What the stars can't tell: buckets of three and more with texts of several components.
    wide = banded.join(buckets.where("n > 2").select("key"), "key").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    wide = cut(wide)
    mixed = wide.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    sizes = texts.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    members = cut(wide.join(mixed, "key").distinct().join(sizes, "node"))
    full = plain_texts(documents, members.select("node")).select(F.col("doc_id").alias("node"), "text")
    more = cut(across(members, texts.select("node", "keys", "signature").join(full, "node"), threshold, width))
    if not more.isEmpty():
        labels = components(links.union(more))
    for done in (texts, buckets, likely, links, wide, members, more):
        drop_table(done)

    named = classes.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    rows = sketched.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def parted(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of ``ids``, and those that can't have; by the bitmap of ``may_hold``, without a shuffle of texts. Rows without doc_id can't."""
    sound = documents.where(F.col("doc_id").isNotNull())
    return may_hold(sound, ids), may_hold(sound, ids, inside=False).unionByName(documents.where(F.col("doc_id").isNull()))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one row of each near-duplicate group: that of the least doc_id.

    Rows without doc_id stay. Rows that share a doc_id and differ in their text are compared like any others: all but the one of the
    least text hash go by an id that is made of both. Of rows that share both, one stays. Only rows that may go are shuffled.
    """
    name, whole = free_name(documents, "row_id"), free_name(documents, "row")
    mark = F.xxhash64(F.lit("text"), "text")
    again = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(mark).alias("least"), F.max(mark).alias("most")).where("n > 1")
    again = cut(again)
    rows = documents.withColumn(name, F.col("doc_id"))
    if not again.isEmpty():
        some, rest = parted(documents, again.select("doc_id"))
        least = again.select(F.col("doc_id").alias(name), "least")
        some = some.join(least.withColumnRenamed("least", whole), F.col("doc_id") == F.col(name), "left")
        some = some.withColumn(name, F.when(F.coalesce(F.col(whole) == mark, F.lit(True)), F.col("doc_id")).otherwise(F.xxhash64("doc_id", mark))).drop(whole)
        some = some.groupBy(name).agg(F.first(F.struct(*documents.columns)).alias(whole)).select(f"{whole}.*", name)
        rows = cut(some.unionByName(rest.withColumn(name, F.col("doc_id"))))
    keyed = rows.select(F.col(name).alias("doc_id"), "text")
    gone = cut(near_duplicates(keyed, **options).where("not kept").select("doc_id").distinct())
    some, rest = parted(rows.withColumnRenamed("doc_id", whole).withColumnRenamed(name, "doc_id"), gone)
    return some.join(gone, "doc_id", "left_anti").unionByName(rest).drop("doc_id").withColumnRenamed(whole, "doc_id").select(*documents.columns)
