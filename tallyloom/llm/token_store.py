"""Token ids in binary shards: one shared zstandard dictionary, one frame per document, an offset index.

A shard is one file:

    bytes 0-7     magic "TLTOK001"
    bytes 8-39    sha256 of the dictionary (zeros: none)
    bytes 40-71   four little-endian int64: range, sequence, documents n, ids in all
    bytes 72-79   int64: bytes per id (2 or 4)
    then          n int64 document ids, n int8 marks of null ids, n int64 id counts, n+1 int64 frame offsets,
                  the frames: each document's ids as little-endian unsigned integers, compressed alone
    last byte     a line feed, which Spark's text writer adds

so that one document is read with its frame and the dictionary only. Shards are written and read by Spark
itself (text writer, binaryFile reader), so they can lie in any store that Spark reaches, and Spark's commit
protocol makes a repeated task harmless. (range, sequence) orders the shards by document id.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyloom.llm import _bytes as B
from tallyloom.llm._store import Workspace

MAGIC = b"TLTOK001"
END_ID = 2
TRAIN_DOCS = 600  # documents of the dictionary's sample, those with the lowest hash of their id
TRAIN_CHARS = 6 << 20
DICTIONARY_BYTES = 64 << 10
SHARD_IDS = 1 << 20
CACHE_BITS = 20  # a worker remembers the ids of up to three quarters of so many chunks
LEVEL = 3

_CHUNK = re.compile(r"\s*\S+|\s+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizer
_WORD = re.compile("([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@[-`{-~]*)").fullmatch
#: Bytes of white space other than space and line feed, and first bytes of characters that may be such.
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The characters by which a byte-level BPE writes bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkTable:
    """Ids of chunks by the chunk's 64-bit hash: open addressing in arrays, looked up many at a time."""

    def __init__(self, bits: int, kind: np.dtype):
        self.size = 1 << bits
        self.keys, self.slot = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32)
        self.begin, self.length, self.entries = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.pool, self.used = np.zeros(1 << 18, kind), 0

    def has_room(self, n: int) -> bool:
        return self.entries + n <= self.size * 3 // 4

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash; -1: unknown."""
        at = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        out = self.slot[at]
        other = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(other):
            at[other] = (at[other] + 1) & (self.size - 1)
            out[other] = found = self.slot[at[other]]
            other = other[(found >= 0) & (self.keys[at[other]] != hashes[other])]
        return out

    def add(self, hashes: np.ndarray, ids: list) -> None:
        """Distinct, unknown hashes and the ids of each."""
        n, first = len(hashes), self.entries
        lengths = np.array([len(x) for x in ids], np.int64)
        total = int(lengths.sum())
        while first + n > len(self.begin):
            self.begin, self.length = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.length, np.zeros_like(self.length))
        while self.used + total > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.begin[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.used, self.entries = self.used + total, first + n
        at, todo = (hashes & np.uint64(self.size - 1)).astype(np.int64), np.arange(n)
        while len(todo):
            lead = np.zeros(len(todo), bool)  # of several that want one place, one takes it
            lead[np.unique(at[todo], return_index=True)[1]] = True
            got = todo[lead & (self.slot[at[todo]] < 0)]
            self.slot[at[got]], self.keys[at[got]] = first + got, hashes[got]
            todo = todo[hashes[todo] != self.keys[at[todo]]]
            at[todo] = (at[todo] + 1) & (self.size - 1)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries, one after another, and where each entry's begin (one more than entries)."""
        lengths = self.length[entries].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[np.repeat(self.begin[entries] - edges[:-1], lengths) + np.arange(edges[-1])], edges


class Encoder:
    """Ids of whole texts. A byte-level BPE never joins white space to what stands before it, so the ids of a text
    are those of its chunks: of its words with the single space or line feed before each, or, where several spaces
    or others stand together, of its runs "white space, then other characters". Chunks are found and hashed for many
    texts at once, and each is encoded once. A word of Latin letters and the signs after it are two pieces; such a word
    goes to the tokenizer's model at once. Texts that hold an added token's content (`<|endoftext|>`) are encoded whole,
    as the library splits at these first. Tokenizers of other kinds encode whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        splitter = str(self.tokenizer.pre_tokenizer)
        self.byte_level = self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in splitter and "use_regex=True" in splitter
        self.letters = _byte_letters()
        self.marks: dict[str, array] = {}
        self.chunks: dict[str, np.ndarray] = {}  # of texts with other white space
        self.table = ChunkTable(CACHE_BITS if self.byte_level else 4, self.kind)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without the end id; null counts as empty."""
        out: list[np.ndarray] = []
        for a, b, raw, at in B.in_slices(column):
            if self.byte_level:
                out += self._slice(raw, at)
            else:
                out += self._ids([t or "" for t in column.slice(a, b - a).to_pylist()])
        return out

    def _slice(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        n, texts = len(raw), len(at) - 1
        if not n:
            return [np.zeros(0, self.kind)] * texts
        space = (raw == 0x20) | (raw == 0x0A)
        edge = B.starts_of(at, n)
        bad = _ODD_BYTE[raw]
        bad[1:] |= space[1:] & (space[:-1] | edge[1:n])
        bad[0] |= space[0]
        bad |= space & edge[1:]
        body = raw.tobytes()
        added = self._with_added(body, at)
        odd = np.union1d(np.searchsorted(at, np.flatnonzero(bad), "right") - 1, np.array(sorted(added), np.int64))
        start = np.flatnonzero(space | edge[:n])
        end = np.append(start[1:], n)
        owner = np.searchsorted(at, start, "right") - 1
        if len(odd):
            plain = np.ones(texts, bool)
            plain[odd] = False
            plain = plain[owner]
            start, end, owner = start[plain], end[plain], owner[plain]
        hashes = B.Hasher(raw).spans(start, end)
        entries = self.table.find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            if not self.table.has_room(len(new)):
                self.table = ChunkTable(max(CACHE_BITS, int(len(hashes) * 2).bit_length()), self.kind)
                new, first = np.unique(hashes, return_index=True)
            self.table.add(new, self._learn([body[x:y].decode() for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]))
            entries = self.table.find(hashes)
        ids, begin = self.table.gather(entries)
        cuts = begin[np.searchsorted(owner, np.arange(texts + 1))].tolist()
        out = [ids[cuts[i] : cuts[i + 1]] for i in range(texts)]
        for i in odd.tolist():
            text = body[at[i] : at[i + 1]].decode()
            out[i] = self._ids([text])[0] if i in added or _ODD_SPACE.search(text) else self._by_chunks(_CHUNK.findall(text))
        return out

    def _with_added(self, body: bytes, at: np.ndarray) -> set[int]:
        """The texts that hold the content of an added token."""
        out = set()
        for content in self.added:
            place = body.find(content)
            while place >= 0:
                i = int(np.searchsorted(at, place, "right")) - 1
                if place + len(content) <= at[i + 1]:
                    out.add(i)
                    place = body.find(content, int(at[i + 1]))
                else:
                    place = body.find(content, place + 1)
        return out

    def _learn(self, chunks: list[str]) -> list:
        """The ids of each chunk."""
        tokenize, pack_, marks = self.tokenizer.model.tokenize, "I" if self.wide else "H", self.marks
        out: list = [None] * len(chunks)
        stems: dict[str, array] = {}
        hard = []
        for k, chunk in enumerate(chunks):
            m = _WORD(chunk)
            if m is None:
                hard.append(k)
                continue
            lead, stem, mark = m.groups()
            ids = stems.get(lead + stem)
            if ids is None:
                body = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
                ids = array(pack_, [t.id for t in tokenize("\u0120" + body if lead == " " else body)])
                if lead == "\n":
                    ids = self._mark("\n") + ids
                stems[lead + stem] = ids
            if mark:
                ids = ids + (marks.get(mark) or self._mark(mark))
            out[k] = ids
        for first in range(0, len(hard), 20_000):
            part = hard[first : first + 20_000]
            for k, ids in zip(part, self._ids([chunks[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _mark(self, mark: str) -> array:
        ids = self.marks.get(mark)
        if ids is None:
            ids = array("I" if self.wide else "H", self._ids([mark])[0].tolist())
            if len(self.marks) < 10_000:
                self.marks[mark] = ids
        return ids

    def _by_chunks(self, own: list[str]) -> np.ndarray:
        if len(self.chunks) > 100_000:
            self.chunks.clear()
        new = list({c for c in own if c not in self.chunks})
        if new:
            self.chunks.update(zip(new, self._ids(new), strict=True))
        return np.concatenate([self.chunks[c] for c in own]) if own else np.zeros(0, self.kind)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sample: int = TRAIN_DOCS, sample_chars: int = TRAIN_CHARS) -> bytes:
    """A zstandard dictionary of DICTIONARY_BYTES for serialized ids, trained by one task.

    The sample is bounded by two parameters: the whole texts of the `sample` ids with the lowest hash, as many of them, in
    that order, until they hold `sample_chars` characters. A dictionary can't hold more than a small part of it, so that a
    larger one gains nothing; it decides sizes only, never ids. Where the sample's ids hold less than 8 dictionaries
    (small corpora), none is trained: the result is empty and frames are compressed without one. To train elsewhere,
    give `write` a dictionary.
    """
    ids = docs.select(F.col(doc_id).alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").join(F.broadcast(ids), "i")

    def run(batches):
        import zstandard

        texts, size = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if size <= sample_chars:
                    texts.append(t)
                    size += len(t)
        samples = [x.tobytes() for x in encoder(tokenizer).encode(pa.array(texts, pa.string())) if len(x) >= 4]
        data = b""
        if sum(map(len, samples)) >= 8 * DICTIONARY_BYTES and len(samples) >= 16:
            try:
                data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
            except zstandard.ZstdError:
                data = b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["dictionary"])

    one = rows.groupBy("i").agg(F.min("t").alias("t")).repartition(1).sortWithinPartitions(F.xxhash64("i"), "i").select("t")
    got = one.mapInArrow(B.lean(run), "dictionary binary").first()
    return bytes(got.dictionary) if got else b""


def pack(dictionary: bytes, range_: int, sequence: int, ids: list, frames: list[bytes], counts: list[int], width: int) -> bytes:
    n = len(ids)
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    head = np.array([range_, sequence, n, sum(counts), width], "<i8").tobytes()
    keys = np.array([0 if i is None else i for i in ids], "<i8").tobytes()
    nulls = np.array([i is None for i in ids], "<i1").tobytes()
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8").tobytes()
    return b"".join([MAGIC, digest, head, keys, nulls, np.array(counts, "<i8").tobytes(), offsets, *frames])


class Shard:
    """One file, opened. Documents are decompressed only when asked for."""

    def __init__(self, data, dictionary: bytes):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.digest = bytes(data[8:40])
        if self.digest != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError("the shard was written with another dictionary")
        self.range, self.sequence, n, self.total, self.width = (int(x) for x in np.frombuffer(data, "<i8", 5, 40))
        at = 80
        self.ids = np.frombuffer(data, "<i8", n, at)
        self.nulls = np.frombuffer(data, "<i1", n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(data, "<i8", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<i8", n + 1, at + 17 * n)
        self.frames = data[at + 17 * n + 8 * (n + 1) :]
        self.open = _decompressor(dictionary)

    def __len__(self):
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        frame = self.frames[self.offsets[i] : self.offsets[i + 1]]
        raw = self.open.decompress(frame, max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
          shard_ids: int = SHARD_IDS, dictionary: bytes | None = None, order: list[str] | None = None) -> bytes:
    """Writes the shards of all documents and the dictionary below `folder`; returns the dictionary.

    Documents lie in ascending order of id, null ids first, rows of one id by text; or in that of the columns `order`. A null text is empty and
    has the end id alone. Repeated rows are written as often as they occur. An empty table gives no shard.
    """
    spark = docs.sparkSession
    Workspace(spark, "tokens")
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer, doc_id, text)
    by = [f"o{n}" for n in range(len(order or []))]
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), *[F.col(c).alias(b) for b, c in zip(by, order or [], strict=True)])
    ordered = rows.repartitionByRange(*(by or ["i"])).sortWithinPartitions(*(by or ["i", "t"])).select("i", "t")

    def shards(batches, dictionary=dictionary):
        from pyspark import TaskContext

        enc, zip_ = encoder(tokenizer), _compressor(dictionary)
        end = np.array([end_id], enc.kind).tobytes()
        width, part, sequence = enc.kind.itemsize, TaskContext.get().partitionId(), 0
        ids, frames, counts, total = [], [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([pack(dictionary, part, sequence, ids, frames, counts, width)], pa.binary())], names=["data"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, last, _, _ in B.in_slices(batch.column(1)):
                for k, own in enumerate(enc.encode(batch.column(1).slice(first, last - first))):
                    raw = own.tobytes() + end
                    ids.append(keys[first + k])
                    frames.append(zip_.compress(raw))
                    counts.append(len(raw) // width)
                    total += counts[-1]
                    if total >= shard_ids:
                        yield full()
                        sequence += 1
                        ids, frames, counts, total = [], [], [], 0
        if ids:
            yield full()

    ordered.mapInArrow(B.lean(shards), "data binary").select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{folder}/shards")
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")
    return dictionary


def in_file_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str] | None]:
    """doc_id and text, and the columns that give the order of the rows in the files that they are read from (None: they are not read from files)."""
    try:
        at = docs.select(doc_id, text, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs, None
    return at, ["file", "row"]


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.schema("dictionary binary, sha256 string").parquet(f"{folder}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.sha256:
        raise ValueError("the dictionary is damaged")
    return data


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards").select("content")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: range, sequence, place (in the shard), doc_id, first (ids before it in the shard), n_tokens, ids, ids_crc32."""
    dictionary = read_dictionary(spark, folder)

    def documents(batches):
        for batch in batches:
            for value in batch.column(0):
                shard = Shard(value.as_buffer(), dictionary)
                first = np.cumsum(shard.counts) - shard.counts
                for a in range(0, len(shard), 500):
                    b = min(len(shard), a + 500)
                    ids = [shard.document(i) for i in range(a, b)]
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(b - a, shard.range)), pa.array(np.full(b - a, shard.sequence)), pa.array(np.arange(a, b)), pa.array(shard.ids[a:b], mask=shard.nulls[a:b]),
                        pa.array(first[a:b]), pa.array(shard.counts[a:b]), lists, pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ], names=["range", "sequence", "place", "doc_id", "first", "n_tokens", "ids", "ids_crc32"])

    return _files(spark, folder).mapInArrow(B.lean(documents), "range long, sequence long, place long, doc_id long, first long, n_tokens long, ids array<int>, ids_crc32 long")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, made from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    dictionary = read_dictionary(spark, folder)

    def documents(batches):
        for batch in batches:
            for value in batch.column(0):
                shard = Shard(value.as_buffer(), dictionary)
                n = len(shard)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, shard.range)), pa.array(np.full(n, shard.sequence)), pa.array(shard.ids, mask=shard.nulls),
                    pa.array(np.cumsum(shard.counts) - shard.counts), pa.array(shard.counts), pa.array([zlib.crc32(shard.document(i).tobytes()) for i in range(n)], pa.int64()),
                ], names=["range", "sequence", "doc_id", "first", "n_tokens", "ids_crc32"])

    space = Workspace(spark, "token-index")
    rows = space.table(_files(spark, folder).mapInArrow(B.lean(documents), "range long, sequence long, doc_id long, first long, n_tokens long, ids_crc32 long"), "rows")
    shards = rows.groupBy("range", "sequence").agg(F.sum("n_tokens").alias("n"))
    # Two steps, so that no task orders all shards: ranges first, then the shards of each range.
    ranges = shards.groupBy("range").agg(F.sum("n").alias("n")).select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("base"))
    within = shards.select("range", "sequence", (F.sum("n").over(W.partitionBy("range").orderBy("sequence")) - F.col("n")).alias("inner"))
    starts = within.join(ranges, "range").select("range", "sequence", (F.col("base") + F.col("inner")).alias("base"))
    return rows.join(starts, ["range", "sequence"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
