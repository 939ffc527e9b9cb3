"""Token ids as Arrow files of equal-length sequences, in ascending order of documents.

Documents are dealt by ranges of their id into shards. A shard's ids, each document's followed by an end id, run on without gaps and are
laid into rows of ``length`` ids; only a shard's last row is padded. A file is in the Arrow IPC file format and holds one stretch of a
shard in record batches of ``batch_rows`` rows:

    ids   fixed_size_list<uint16 or uint32>[length]   by the size of the vocabulary
    mask  fixed_size_list<bool>[length]               true for an id, false for padding
    docs  list<struct<doc_id, start, begin, length>>  the documents in the row: the document's first place in the shard, its first place
                                                      in the row, and how many of its ids the row holds

so the row of any number is found by division, and ``sequence`` returns views of a mapped file without copying. What a shard, a file's
number in it, its first place and its ids are stands in the schema's metadata ("shard", "part", "first", "tokens", "end").

Spark's text writer writes the files, one row a file: the bytes of an Arrow file end with the magic ``ARROW1``, which is what the writer is
told to put at a line's end. So files go wherever Spark can write, and through its commit protocol. ``binaryFile`` reads them back.

Ids are the tokenizers library's. A text is cut where its pattern always parts tokens (before a blank that a character follows; where a
run of letters ends), and a worker remembers the pieces' ids, up to a bound. Texts with a special token's name go to the library whole.

Defined results: null texts are empty; an empty document is its end id alone; null ids come first; rows that share an id follow each
other by their text's CRC and stay apart; equal rows are dealt to shards apart; an empty table gives no file and no rows; other columns
don't matter. A document of any length may fill many files; the CRCs of its stretches are combined.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

MAGIC = b"ARROW1"
LENGTH, END = 2048, 2


class PieceEncoder(dict):
    """Ids of texts as bytes. The dict remembers what follows a blank; ``bare`` what doesn't; both up to a bound."""

    PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Letters under U+0250; below it there are no others, so a run of them ends where the pattern's run of letters ends.
    LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    #: A run of letters with the blank before it; or what stands between, with the letters that an apostrophe may draw to it.
    PIECES = re.compile(rf" ?[{LETTERS}]+|(?:[^ {LETTERS}]+| +(?![{LETTERS}]))+(?:(?<=')[{LETTERS}]+)?")
    #: A blank that no character follows, or one that might be taken for white space.
    SPREAD = re.compile("[ ](?:[\\s\u180e\u200b\u2060\ufeff]|$)")
    #: A blank that a character follows for sure: a token starts there whatever stands before it.
    SAFE = re.compile("[ ](?=[^\\s\u180e\u200b\u2060\ufeff])")
    #: What ``PIECES`` doesn't part rightly: other letters, and white space whose last character is a token of its own.
    HARD = re.compile("[^\x00-\u024f]|\\s[^\\S ]")

    def __init__(self, definition: str, remembered: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t["content"] for t in json.loads(definition).get("added_tokens") or []]
        self.remembered, self.bare = remembered, {}
        self[""] = b""
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):  # it would hold the pieces a second time
            model._resize_cache(0)
            self.tokenizer.model = model
        # The model alone, for many pieces in one text: bytes are spelled as the vocabulary spells them, a line end parts the pieces.
        letters = {b: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0][-1] for b in range(128)}
        high = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for b in range(128, 256):  # a byte stands last in the spelling of some character of two bytes, or first
            at = -1 if b < 192 else 0
            whole = (bytes([0xC2, b]) if b < 192 else bytes([b, 0x80])).decode("utf-8", "ignore")
            if whole:
                letters[b] = high.pre_tokenize_str(whole)[0][0][at]
        self.letters = letters
        self.line = letters[10]
        self.model = Tokenizer(model)
        self.model.pre_tokenizer = pre_tokenizers.Split(self.line, "isolated")
        self.line_id = self.tokenizer.token_to_id(self.line)

    def direct(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def piece(self, p: str) -> bytes:
        if p[0] == " " and len(p) > 1:
            return self[p[1:]]
        ids = self.bare.get(p)
        if ids is None:
            ids = self.direct(p)
            if len(p) <= 32 and len(self.bare) < self.remembered // 4:
                self.bare[p] = ids
        return ids

    def parted(self, text: str) -> bytes | None:
        """The ids of what ``PIECES`` finds in a short text, if that is more than one piece."""
        if len(text) > 256 or self.HARD.search(text):
            return None
        found = self.PIECES.findall(text)
        return b"".join(map(self.piece, found)) if len(found) > 1 else None

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(self.PUNCTUATION)
        if stem and len(stem) < len(word) and stem[-1] < "\u0250" and stem[-1].isalnum():  # a token ends with a letter or figure before a mark
            return self[stem] + self.piece(word[len(stem) :])
        ids = self.parted(" " + word)
        if ids is None:
            ids = self.direct(" " + word)
            if len(word) <= 32 and len(self) < self.remembered:
                self[word] = ids
        return ids

    def many(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of words that follow a blank. Marks at a word's end are parted from a letter or figure before them; all runs of letters that the dict hasn't are encoded in one call."""
        stems = pc.utf8_rtrim(words, characters=self.PUNCTUATION)
        stems = pc.if_else(pc.match_substring_regex(stems, f"[0-9{self.LETTERS}]$"), stems, words)
        tails = pc.subtract(pc.utf8_length(words), pc.utf8_length(stems)).to_numpy()
        coded = stems.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = list(map(self.get, distinct))
        late = [k for k, x in enumerate(ids) if x is None]
        inner: set[str] = set()
        for k in late:
            stem = distinct[k]
            if stem.isalpha():
                inner.add(stem)
            elif len(stem) <= 256 and not self.HARD.search(stem):
                inner.update(p[1:] for p in self.PIECES.findall(" " + stem) if p[0] == " ")
        new = self.spelled_out([s for s in inner if s not in self and len(s) <= 32 and (s.isascii() or not self.HARD.search(s)) and s.isalpha()])
        if len(self) < self.remembered:  # frequent words come early, so those beyond the bound are encoded when they are met
            self.update(new)
        for k in late:
            ids[k] = new.get(distinct[k]) or self[distinct[k]]
        whole = pa.array(ids, pa.large_binary()).take(coded.indices)
        marked = np.flatnonzero(tails)
        if not len(marked):
            return whole
        ends: list[bytes] = [b""] * len(words)
        for k, n, word in zip(marked.tolist(), tails[marked].tolist(), words.take(pa.array(marked)).to_pylist(), strict=True):
            ends[k] = self.bare.get(word[-n:]) or self.piece(word[-n:])
        return pc.binary_join_element_wise(whole, pa.array(ends, pa.large_binary()), pa.scalar(b"", pa.large_binary()))

    def spelled_out(self, words: list[str]) -> dict[str, bytes]:
        """Ids of runs of letters after a blank, by the model alone: all in one text, a line end between two."""
        if not words or self.line_id is None:
            return {}
        text = "\n".join([" " + w for w in words]).encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        whole, size = ids.tobytes(), ids.itemsize
        ends = [*(np.flatnonzero(np.frombuffer(whole, f"<u{size}") == self.line_id) * size).tolist(), len(whole)]
        begins = [0, *(e + size for e in ends[:-1])]
        return {w: whole[a:b] for w, a, b in zip(words, begins, ends, strict=True)}

    def encode(self, text: str) -> bytes:
        """One text, piece by piece."""
        if any(name in text for name in self.special):
            return self.direct(text)
        at, out = 0, []
        for m in self.SAFE.finditer(text):
            out.append(self.stretch(text[at : m.start()]))
            at = m.start()
        return b"".join([*out, self.stretch(text[at:])])

    def stretch(self, s: str) -> bytes:
        if s[:1] == " " and len(s) > 1 and not self.SPREAD.search(s):
            return self[s[1:]]
        return self.direct(s) if s else b""

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same of many texts: each distinct word once, then the ids of all by their numbers."""
        out = [self.encode(t) if self.SPREAD.search(t) or any(name in t for name in self.special) else None for t in texts]
        at = [k for k, ids in enumerate(out) if ids is None]
        words = pc.split_pattern(pa.array([texts[k] for k in at], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        ids = self.many(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data, begin = memoryview(ids.buffers()[2] or b""), words.offsets.to_numpy()
        for k, lo, hi in zip(at, ends[np.minimum(begin[:-1] + 1, len(ids))].tolist(), ends[begin[1:]].tolist(), strict=True):
            first = texts[k].partition(" ")[0]  # nothing stands before it
            own = self.parted(first) if first else b""
            out[k] = (self.direct(first) if own is None else own) + data[lo:hi]
        return out


class FileBuilder:
    """Bytes of Arrow files, as documents come. ``take`` returns those that are full; ``last`` the rest."""

    def __init__(self, shard: int, length: int, rows: int, batch_rows: int, size: int, end: int):
        self.shard, self.length, self.rows, self.batch_rows, self.size, self.end = shard, length, rows, batch_rows, size, end
        self.held, self.first, self.part = bytearray(), 0, 0
        self.docs: list[tuple] = []  # (id, first place in the shard, ids)

    def take(self, doc_id, ids: bytes) -> list[bytes]:
        self.docs.append((doc_id, self.first + len(self.held) // self.size, len(ids) // self.size))
        self.held += ids
        full, out = self.length * self.rows, []
        while len(self.held) >= full * self.size:
            out.append(self.file(full))
        return out

    def last(self) -> list[bytes]:
        return [self.file(len(self.held) // self.size)] if self.held else []

    def file(self, tokens: int) -> bytes:
        rows = -(-tokens // self.length)
        ids = np.zeros(rows * self.length, f"<u{self.size}")
        ids[:tokens] = np.frombuffer(memoryview(self.held)[: tokens * self.size], f"<u{self.size}")
        mask = np.arange(rows * self.length) < tokens
        start, n = (np.array([d[k] for d in self.docs], np.int64) for k in (1, 2))
        begin, stop = np.maximum(start - self.first, 0), np.minimum(start + n - self.first, tokens)
        row = begin // self.length
        spread = np.where(stop > begin, (stop - 1) // self.length - row + 1, 0)
        of = np.repeat(np.arange(len(spread)), spread)
        row = row[of] + np.arange(len(of)) - np.repeat(np.cumsum(spread) - spread, spread)
        own_begin = np.maximum(begin[of], row * self.length)
        own_length = np.minimum(stop[of], (row + 1) * self.length) - own_begin
        struct = pa.StructArray.from_arrays([pa.array([d[0] for d in self.docs]).take(pa.array(of)), pa.array(start[of]), pa.array((own_begin - row * self.length).astype(np.int32)), pa.array(own_length.astype(np.int32))], names=["doc_id", "start", "begin", "length"])
        docs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), struct)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length), docs]
        about = {"shard": self.shard, "part": self.part, "first": self.first, "tokens": tokens, "end": self.end}
        whole = pa.RecordBatch.from_arrays(columns, names=["ids", "mask", "docs"]).replace_schema_metadata({k: str(v) for k, v in about.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, whole.schema) as out:
            for at in range(0, rows, self.batch_rows):
                out.write_batch(whole.slice(at, self.batch_rows))
        del self.held[: tokens * self.size]
        self.first, self.part = self.first + tokens, self.part + 1
        self.docs = [d for d in self.docs[-1:] if d[1] + d[2] > self.first]
        return sink.getvalue().to_pybytes()


_encoders: dict[str, PieceEncoder] = {}


def write_sequences(documents: DataFrame, path: str, tokenizer_path: str, length: int = LENGTH, end: int = END, rows: int = 2048, batch_rows: int = 256, shard_bytes: int = 32 << 20) -> None:
    """Write ``documents`` (doc_id, text) as files of at most ``rows`` sequences; shards take about ``shard_bytes`` of text each.

    The tokenizer's definition is read where the query is planned and sent along (under 5 MB). Documents are sorted by ranges; a task holds one file.
    """
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows_in = documents.select("doc_id", "text")
    size = rows_in.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    keyed = rows_in.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(shards, "doc_id", "crc", "row").sortWithinPartitions("doc_id", "crc", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = PieceEncoder(definition.value)
        encoder = _encoders[tokenizer_path]
        closing = array(encoder.code, [end]).tobytes()
        builder = FileBuilder(TaskContext.get().partitionId(), length, rows, batch_rows, len(closing), end)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                for done in builder.take(doc_id, ids + closing):
                    yield pa.RecordBatch.from_arrays([pa.array([done[: -len(MAGIC)]], pa.binary())], ["file"])
        for done in builder.last():
            yield pa.RecordBatch.from_arrays([pa.array([done[: -len(MAGIC)]], pa.binary())], ["file"])

    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    with small_batches(spark):
        files.write.option("lineSep", MAGIC.decode()).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def opened(source) -> pa.ipc.RecordBatchFileReader:
    """A reader over a buffer, or over a mapped file given by its local name."""
    return pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source))


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(ids, mask, docs) of the row ``number``: views of the file's bytes, not copies."""
    a_batch = reader.get_batch(0).num_rows
    batch, row = reader.get_batch(number // a_batch), number % a_batch
    length = batch.schema.field("ids").type.list_size
    ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
    return ids[row * length : (row + 1) * length], batch.column("mask").flatten().slice(row * length, length), batch.column("docs").slice(row, 1).flatten()


def files(spark: SparkSession, path: str) -> DataFrame:
    """The written files as rows with their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(shard, place, ids, mask) of every row; ``place`` is that of its first id in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = opened(content.as_buffer())
                place, shard = int(reader.schema.metadata[b"first"]), int(reader.schema.metadata[b"shard"])
                for k in range(reader.num_record_batches):
                    own = reader.get_batch(k)
                    length, n = own.schema.field("ids").type.list_size, own.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, shard, np.int32)), pa.array(place + length * np.arange(n)), own.column("ids").cast(pa.list_(pa.int32())), own.column("mask").cast(pa.list_(pa.bool_()))],
                        ["shard", "place", "ids", "mask"],
                    )
                    place += length * n

    return files(spark, path).mapInArrow(run, "shard int, place bigint, ids array<int>, mask array<boolean>")


def crc32_joined(first: int, second: int, n: int) -> int:
    """CRC-32 of a + b, from those of a and of b, and the ``n`` bytes of b: the first is carried through n zero bytes, as a polynomial times x**(8n)."""
    poly = 0xEDB88320

    def times(a: int, b: int) -> int:  # bits reflected: the highest is x**0
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (poly if b & 1 else 0)
        return out

    power, square, e = 1 << 31, 1 << 30, 8 * n
    while e:
        if e & 1:
            power = times(power, square)
        square, e = times(square, square), e >> 1
    return times(first, power) ^ second


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = opened(content.as_buffer())
                about = {k: int(v) for k, v in reader.schema.metadata.items()}
                place, whole = about[b"first"], reader.read_all()
                length = whole.schema.field("ids").type.list_size
                ids = np.concatenate([c.flatten().to_numpy(zero_copy_only=True) for c in whole.column("ids").chunks])[: about[b"tokens"]].astype("<u4")
                docs = whole.column("docs").combine_chunks()
                parts = docs.flatten()
                row = np.repeat(np.arange(len(docs)), np.diff(docs.offsets.to_numpy()))
                start, begin, own = (parts.field(k).to_numpy() for k in (1, 2, 3))
                new = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]])) if len(start) else np.zeros(0, np.int64)
                at, n = (row * length + begin)[new], np.add.reduceat(own, new, dtype=np.int64) if len(new) else np.zeros(0, np.int64)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                # A stretch is whole unless the file ends or starts inside the document; one that ends with the file may go on in the next.
                inner = (start[new] >= place) & (at + n < about[b"tokens"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(new), about[b"shard"], np.int32)), parts.field(0).take(pa.array(new)).cast(pa.int64()), pa.array(start[new]), pa.array(place + at), pa.array(n), pa.array(crc, pa.int64()), pa.array(inner)],
                    ["shard", "doc_id", "start", "place", "n_tokens", "ids_crc32", "inner"],
                )

    with small_batches(spark):
        found = cut(files(spark, path).mapInArrow(run, "shard int, doc_id bigint, start bigint, place bigint, n_tokens bigint, ids_crc32 bigint, inner boolean"))

    def joined(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("place")
        crc = 0
        for c, n in zip(some["ids_crc32"].tolist(), some["n_tokens"].tolist(), strict=True):
            crc = crc32_joined(crc, c, 4 * n)
        return some.iloc[:1].assign(n_tokens=some["n_tokens"].sum(), ids_crc32=crc)[columns]

    columns = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
    # At most one document a file and side: a group is one document's stretches, a few numbers for each file that it fills.
    open_ended = found.where("not inner").select(*columns, "place").groupBy("shard", "start").applyInPandas(joined, "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    rows = found.where("inner").select(*columns).unionByName(open_ended)
    # One row a shard, of some ten MB of text.
    before = found.groupBy("shard").agg(F.sum("n_tokens").alias("own")).select("shard", (F.sum("own").over(Window.orderBy("shard")) - F.col("own")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
