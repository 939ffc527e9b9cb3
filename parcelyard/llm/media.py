"""Near-copies of images by local descriptors.

On every level of a small pyramid, Harris corners are picked; around each, the intensity centroid gives an orientation, and 128
comparisons of smoothed brightness at places turned by it give a binary descriptor. Descriptors are cut into four words of 32 bits; every
word, every two and the whole have a table of their own, so two that differ in at most three bits meet. Images that share wide keys are matched with the bucket's least
image, so a bucket of n gives n - 1 matches; the matches of two images vote for a similarity transform (scale, turn, shift), and
``inliers`` matches that agree make a link. Links make components, in which a cropped, brightened or otherwise edited copy meets its
original. Equal files are one image from the start, however many there are.

What the stars miss is searched then: images are dealt in blocks, and in every pair of blocks all descriptors of different components
that share a word are matched and vote. So stars are made of the wider keys only: the block pairs look at all that share one word.

Limits, as parameters: ``corners``, the strongest taken on each level of every 64 by 64 pixels of the image, so that they grow with its
area. The number of block pairs grows with the square of the number of descriptors; each holds two blocks, whatever the input.

Defined results: images that are null or can't be decoded (binary PGM and PPM are read) have no descriptor and stand alone, as do flat
ones; rows with one media_id are one image; rows without it have a null component and are kept; other columns don't matter.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .near_dedup import components

RADIUS, TESTS = 7, 128
TILE = 64
_rng = np.random.RandomState(77)
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -RADIUS + 1, RADIUS - 1)
HEADER = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM file; None if it is neither."""
    m = HEADER.match(data or b"")
    if not m or int(m[4]) != 255:
        return None
    colours, w, h = (1 if m[1] == b"5" else 3), int(m[2]), int(m[3])
    body = np.frombuffer(data, np.uint8, offset=m.end())
    if len(body) < w * h * colours or not w * h:
        return None
    return body[: w * h * colours].reshape(h, w, colours).mean(2).astype(np.float32)


def encode(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of 2r + 1, of a stack of images."""
    p = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1).cumsum(2)
    k = 2 * r + 1
    return (p[:, k:, k:] - p[:, :-k, k:] - p[:, k:, :-k] + p[:, :-k, :-k]) / (k * k)


def describe(stack: np.ndarray, corners: int = 24, levels: int = 2) -> tuple[np.ndarray, ...]:
    """Of a stack of equal-sized images: (image, x, y, level, angle, words[4]) of every descriptor."""
    found = []
    down, along = (max(1, round(n / TILE)) for n in stack.shape[1:])  # corners are picked in each tile, so that any crop has some
    for level in range(levels):
        if level:
            h, w = stack.shape[1] // 2 * 2, stack.shape[2] // 2 * 2
            stack = (stack[:, :h:2, :w:2] + stack[:, 1:h:2, :w:2] + stack[:, :h:2, 1:w:2] + stack[:, 1:h:2, 1:w:2]) / 4
        n, h, w = stack.shape
        edge = RADIUS + 2
        if h <= 2 * edge + 2 or w <= 2 * edge + 2:
            break
        x = stack.astype(np.float64)
        gx, gy = np.zeros_like(x), np.zeros_like(x)
        gx[:, :, 1:-1] = x[:, :, 2:] - x[:, :, :-2]
        gy[:, 1:-1] = x[:, 2:] - x[:, :-2]
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        best = response.copy()
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dy or dx:
                    np.maximum(best, np.roll(response, (dy, dx), (1, 2)), out=best)
        ok = (response >= best) & (response > 1.0)
        ok[:, :edge] = ok[:, -edge:] = False
        ok[:, :, :edge] = ok[:, :, -edge:] = False
        strength = np.where(ok, response, 0)
        picked = []
        for top, bottom in itertools.pairwise(np.arange(down + 1) * h // down):
            for left, right in itertools.pairwise(np.arange(along + 1) * w // along):
                flat = strength[:, top:bottom, left:right].reshape(n, -1)
                k = min(corners, flat.shape[1])
                at = np.argpartition(-flat, k - 1, axis=1)[:, :k]
                image, col = np.nonzero(np.take_along_axis(flat, at, 1) > 0)
                at = at[image, col]
                picked.append((image, at // (right - left) + top, at % (right - left) + left))
        image, cy, cx = (np.concatenate(c) for c in zip(*picked, strict=True))
        smooth = _box(x, 1)
        oy, ox = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
        disc = oy**2 + ox**2 <= RADIUS**2
        oy, ox = oy[disc], ox[disc]
        patch = smooth[image[:, None], cy[:, None] + oy, cx[:, None] + ox]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2((patch * oy).sum(1), (patch * ox).sum(1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(cos * _PAIRS[None, :, :, 0] - sin * _PAIRS[None, :, :, 1]).astype(np.int64)
        py = np.rint(sin * _PAIRS[None, :, :, 0] + cos * _PAIRS[None, :, :, 1]).astype(np.int64)
        side = RADIUS + 1
        px, py = np.clip(px, -side, side), np.clip(py, -side, side)
        value = smooth[image[:, None, None], cy[:, None, None] + py, cx[:, None, None] + px]
        bits = value[:, :, 0] < value[:, :, 1]
        words = np.packbits(bits, axis=1).view(">u4").astype(np.int64)
        found.append((image, cx * 2**level, cy * 2**level, np.full(len(image), level), angle, words))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0), np.zeros((0, 4), np.int64))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(6))


LISTS = ["x", "y", "level", "angle", "words"]


def descriptors(media: DataFrame, corners: int, image: str = "image", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, and lists of x, y, level, angle and words: one row an image that can be decoded."""
    keep = keep or ["media_id"]
    kinds = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_shape: dict[tuple, list] = {}
            for row, data in enumerate(batch.column(len(keep))):
                grey = decode(data.as_py())
                if grey is not None:
                    by_shape.setdefault(grey.shape, []).append((row, grey))
            for shape, images in by_shape.items():
                each = max(1, 200_000 // (shape[0] * shape[1]))  # images worked on at once: some tens of MB
                for at in range(0, len(images), each):
                    some = images[at : at + each]
                    of, *columns = describe(np.stack([g for _, g in some]), corners)
                    order = np.argsort(of, kind="stable")
                    ends = np.searchsorted(of[order], np.arange(len(some) + 1))
                    lists = [pa.array([list(c[order[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)], kind) for c, kind in zip(columns, kinds, strict=True)]
                    rows = pa.array([r for r, _ in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(keep))), *lists], [*keep, *LISTS])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keep).schema)
    return media.select(*keep, image).mapInArrow(run, kept + ", x array<int>, y array<int>, level array<int>, angle array<double>, words array<array<bigint>>")


def _linked(one: dict, other: dict, most_bits: int, inliers: int) -> np.ndarray:
    """Pairs (a, b) of rows of ``one`` and ``other``, descriptors by image, whose components differ and of whose matches ``inliers`` agree. Matches are all descriptors that share a word and differ in at most ``most_bits``. A row is matched with later ones only."""
    packed = [(d["words"][:, ::2].astype(np.uint64) << np.uint64(32)) | d["words"][:, 1::2].astype(np.uint64) for d in (one, other)]
    matched = [np.zeros((0, 2), np.int64)]
    for w in range(4):
        order, there = other["sorted"][w]
        start = np.searchsorted(there, one["words"][:, w], "left")
        count = np.searchsorted(there, one["words"][:, w], "right") - start
        ends = np.cumsum(count)
        at = 0
        while at < len(count):  # some pairs at once: tens of MB
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 300_000, "right")))
            i = np.repeat(np.arange(at, upto), count[at:upto])
            j = order[np.arange(len(i)) - np.repeat(ends[at:upto] - count[at:upto] - (ends[at - 1] if at else 0), count[at:upto]) + np.repeat(start[at:upto], count[at:upto])]
            at = upto
            use = (one["component"][i] != other["component"][j]) & (one["row"][i] < other["row"][j])
            i, j = i[use], j[use]
            for earlier in range(w):  # a pair that shares several words is taken at the first
                use = one["words"][i, earlier] != other["words"][j, earlier]
                i, j = i[use], j[use]
            use = np.bitwise_count(packed[0][i] ^ packed[1][j]).sum(1, dtype=np.int64) <= most_bits
            matched.append(np.stack([i[use], j[use]], 1))
    i, j = np.concatenate(matched).T
    # Few pairs of images have as many matches of one turn and scale as a link takes; the others needn't vote.
    swap = one["media_id"][i] > other["media_id"][j]
    of = {c: (np.where(swap, other[c][j], one[c][i]), np.where(swap, one[c][i], other[c][j])) for c in ("x", "y", "level", "angle")}
    theta = of["angle"][1] - of["angle"][0]
    turn, scale = np.rint(theta / (np.pi / 6)).astype(np.int64) % 12, of["level"][1] - of["level"][0]
    key = np.stack([one["row"][i], other["row"][j], turn, scale], 1)
    code = ((key[:, 0] * (other["row"].max(initial=0) + 1) + key[:, 1]) * 12 + turn) * 64 + scale + 32
    _, of_code, times = np.unique(code, return_inverse=True, return_counts=True)
    use = times[of_code] >= inliers
    key, theta = key[use], theta[use]
    (ax, bx), (ay, by), (_, level) = ((p[use], q[use]) for p, q in (of[c] for c in ("x", "y", "level")))
    size = 2.0 ** key[:, 3]
    shift_x = bx - size * (np.cos(theta) * ax - np.sin(theta) * ay)
    shift_y = by - size * (np.sin(theta) * ax + np.cos(theta) * ay)
    links = [np.zeros((0, 2), np.int64)]
    for dx in (0, 4):
        for dy in (0, 4):
            cells = np.column_stack([key, np.floor((shift_x + dx) / 8).astype(np.int64), np.floor((shift_y + dy) / 8).astype(np.int64)])
            votes = np.unique(np.column_stack([cells, bx, by, level]), axis=0)
            agreed, times = np.unique(votes[:, :6], axis=0, return_counts=True)
            links.append(agreed[times >= inliers, :2])
    return np.unique(np.concatenate(links), axis=0)


PACKED = ["ids", "components", "counts", *LISTS]


def packed(images: DataFrame, blocks: int) -> DataFrame:
    """One row a block of ``images(media_id, component, x, y, level, angle, words)``: own, and lists of its images' ids, components and numbers of descriptors and of all descriptors' values."""
    kinds = [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 4 + [pa.list_(pa.float64()), pa.list_(pa.int64())]

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        columns = {c: group.column(c).combine_chunks() for c in ("media_id", "component", *LISTS)}
        flat = [columns["media_id"], columns["component"], columns["x"].value_lengths(), *(columns[c].flatten() for c in LISTS[:4]), columns["words"].flatten().flatten()]
        lists = [pa.array([v.to_numpy(zero_copy_only=False)], kind) for v, kind in zip(flat, kinds, strict=True)]
        return pa.Table.from_arrays([group.column("own").slice(0, 1), *lists], ["own", *PACKED])

    own = images.select(F.pmod(F.xxhash64("media_id"), F.lit(blocks)).cast("int").alias("own"), "media_id", "component", *LISTS)
    kind = "own int, ids array<bigint>, components array<bigint>, counts array<int>, x array<int>, y array<int>, level array<int>, angle array<double>, words array<bigint>"
    return own.repartition(blocks, "own").groupBy("own").applyInArrow(run, kind)


def _opened(batch: pa.RecordBatch, at: int, side: str, before: int) -> dict:
    """Of the block on one side of a pair: its descriptors by row, the images' ids and where their descriptors begin. Rows count from ``before``."""
    d = {c: batch.column(f"{side}_{c}")[at].values.to_numpy(zero_copy_only=False) for c in PACKED}
    n = d.pop("counts").astype(np.int64)
    ids, components = d.pop("ids"), d.pop("components")
    d = {c: v if c == "angle" else v.astype(np.int64, copy=False) for c, v in d.items()}
    d["words"] = d["words"].reshape(-1, 4)
    d |= {"row": np.repeat(np.arange(len(ids)) + before, n), "media_id": np.repeat(ids, n), "component": np.repeat(components, n)}
    return {"ids": ids, "begins": np.append(0, np.cumsum(n)), "descriptors": d}


def across(images: DataFrame, blocks: int, most_bits: int, inliers: int) -> DataFrame:
    """Links (a, b) between components of ``images(media_id, component, x, y, level, angle, words)``, one row an image. Images are dealt in ``blocks``; each pair of blocks is one piece of work, and no pair of descriptors that share a word is left out.

    Blocks are written once, and a task reads the two of each of its pairs: what is shuffled and written grows with the images, not with the pairs.
    """
    some = 256  # images of one block that are compared with the other at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                same = batch.column("lo_own")[at].as_py() == batch.column("hi_own")[at].as_py()
                one = _opened(batch, at, "lo", 0)
                other = one if same else _opened(batch, at, "hi", len(one["ids"]))
                ids = one["ids"] if same else np.concatenate([one["ids"], other["ids"]])
                words = other["descriptors"]["words"]
                orders = [np.argsort(words[:, w], kind="stable") for w in range(4)]
                whole = other["descriptors"] | {"sorted": [(order, words[order, w]) for w, order in enumerate(orders)]}
                for first in range(0, len(one["ids"]), some):
                    begin, end = one["begins"][first], one["begins"][min(first + some, len(one["ids"]))]
                    links = ids[_linked({c: v[begin:end] for c, v in one["descriptors"].items()}, whole, most_bits, inliers)]
                    if len(links):
                        yield pa.RecordBatch.from_arrays([pa.array(links.min(1)), pa.array(links.max(1))], ["a", "b"])

    block = cut(packed(images, blocks))
    lo, hi = (block.select(*(F.col(c).alias(f"{side}_{c}") for c in ["own", *PACKED])) for side in ("lo", "hi"))
    pairs = lo.hint("shuffle_replicate_nl").join(hi, F.col("lo_own") <= F.col("hi_own"))  # reads the written blocks; nothing is broadcast or shuffled
    return pairs.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def near_copies(media: DataFrame, corners: int = 24, inliers: int = 8, most_bits: int = 16, image: str = "image", block: int = 250_000) -> DataFrame:
    """media_id, n_descriptors, component_id (least media_id reachable), kept: one row a row of ``media(media_id, image)``."""
    rows = media.select("media_id", F.sha2(F.col(image).cast("binary"), 256).alias("file"), F.col(image).cast("binary").alias("image"))
    files = rows.where("media_id is not null and file is not null").groupBy("file").agg(F.min("media_id").alias("node"))
    # Images are described where they are read; of equal files one's descriptors stay. No image is shuffled.
    described = descriptors(rows, corners, keep=["media_id", "file"]).where("media_id is not null")
    firsts = described.join(files, "file").where("media_id = node").dropDuplicates(["file"])
    images = cut(firsts.select("media_id", *LISTS))
    found = images.select("media_id", F.posexplode(F.arrays_zip(*LISTS)).alias("n", "d")).select("media_id", "n", *(f"d.{c}" for c in LISTS))
    # The wider the key, the likelier its bucket's least image is a copy. Only ids are dealt by key. Single words are left to ``across``.
    keys = [(a, b) for a in range(4) for b in range(a)] + [(0, 1, 2, 3)]
    table_keys = F.array(*(F.xxhash64(F.lit(k), *(F.element_at("words", w + 1) for w in key)) for k, key in enumerate(keys)))
    words = found.select("media_id", "n", F.explode(table_keys).alias("word"))
    first = words.groupBy("word").agg(F.min(F.struct("media_id", "n")).alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = words.join(first, "word").where(F.col("media_id") != F.col("a.media_id")).select("media_id", "n", F.col("a.media_id").alias("a_id"), F.col("a.n").alias("a_n")).distinct()
    whole = F.struct("media_id", "x", "y", "level", "angle", "words").alias("a")
    match = met.join(found, ["media_id", "n"]).join(found.select(F.col("media_id").alias("a_id"), F.col("n").alias("a_n"), whole), ["a_id", "a_n"])
    differ = F.aggregate(F.zip_with("words", "a.words", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, b: s + b)
    match = match.where(differ <= most_bits)
    turn = F.round((F.col("angle") - F.col("a.angle")) / (3.141592653589793 / 6)).cast("int")
    scale = F.col("level") - F.col("a.level")
    # Where the match would put the other image's origin: equal for all matches of one transform, up to the cell.
    theta = F.col("angle") - F.col("a.angle")
    size = F.pow(F.lit(2.0), scale)
    shift_x = F.col("x") - size * (F.cos(theta) * F.col("a.x") - F.sin(theta) * F.col("a.y"))
    shift_y = F.col("y") - size * (F.sin(theta) * F.col("a.x") + F.cos(theta) * F.col("a.y"))
    votes = match.select(
        F.col("a.media_id").alias("a"), F.col("media_id").alias("b"), F.pmod(turn, F.lit(12)).alias("turn"), scale.alias("scale"),
        F.explode(F.array(*(F.struct(F.floor((shift_x + dx) / 8).alias("cx"), F.floor((shift_y + dy) / 8).alias("cy"), F.lit(2 * (dx > 0) + (dy > 0)).alias("grid")) for dx in (0, 4) for dy in (0, 4)))).alias("cell"), "x", "y", "level",
    )
    agreed = votes.distinct().groupBy("a", "b", "turn", "scale", "cell").count().where(F.col("count") >= inliers)
    links = cut(agreed.select("a", "b").distinct())
    labels = components(links)
    described_images = images.join(labels.withColumnRenamed("node", "media_id"), "media_id", "left").withColumn("component", F.coalesce("component", "media_id"))
    blocks = max(1, -(-(images.agg(F.sum(F.size("x"))).first()[0] or 0) // block))
    more = cut(across(described_images, blocks, most_bits, inliers))
    if not more.isEmpty():
        labels = components(links.union(more))
    counts = found.groupBy(F.col("media_id").alias("node")).agg(F.count("*").alias("n_descriptors"))
    named = files.join(counts, "node", "left").join(labels, "node", "left").select("file", "n_descriptors", F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("media_id").isNotNull(), F.coalesce("component", "media_id"))
    return rows.select("media_id", "file").join(named, "file", "left").select("media_id", F.coalesce("n_descriptors", F.lit(0)).alias("n_descriptors"), component.alias("component_id"), F.coalesce(F.col("media_id") == component, F.lit(True)).alias("kept"))


EDITED = 1_000_000_000


def rendered(vectors: DataFrame, side: int = 64, edited_every: int = 50) -> DataFrame:
    """Stand-in media, as no table holds any: each vector drawn as a texture of waves, one a component; of every ``edited_every``-th id also a cropped and brightened copy, under its id plus ``EDITED``."""
    r = np.random.RandomState(3)
    yy, xx = np.mgrid[:side, :side]

    def waves(n: int) -> np.ndarray:
        r.seed(3)
        length, way, phase = r.uniform(5, 18, n), r.uniform(0, np.pi, n), r.uniform(0, 2 * np.pi, n)
        return np.stack([np.cos(2 * np.pi / a * (np.cos(b) * xx + np.sin(b) * yy) + c) for a, b, c in zip(length, way, phase, strict=True)]).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, images = [], []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = None if v is None else np.nan_to_num(np.array(v, np.float64))
                if v is None or not len(v) or not np.abs(v).max():
                    ids.append(vec_id)
                    images.append(None)
                    continue
                if len(v) not in known:
                    known[len(v)] = waves(len(v))
                grey = (v @ known[len(v)]).reshape(side, side)
                grey = 128 + 100 * grey / np.abs(grey).max()
                ids.append(vec_id)
                images.append(encode(grey))
                if vec_id is not None and vec_id % edited_every == 0:
                    dy, dx = vec_id // edited_every % 7, vec_id // edited_every % 11
                    ids.append(vec_id + EDITED)
                    images.append(encode(grey[dy : dy + side - 12, dx : dx + side - 12] * 0.85 + 30))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["media_id", "image"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "media_id bigint, image binary")
