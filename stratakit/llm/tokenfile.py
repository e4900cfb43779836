"""Token ids in patched frame-of-reference files.

A shard file holds whole documents. Its ids lie in blocks of 256: each block stores its minimum, then all
differences at one bit width that fits a given share of them; the rest go to an exception list. Arrays of block
starts let a reader open any block. Files are written by executors into a shared folder under final names that
depend on the data alone: a task that runs twice writes the same file again.

Layout, little-endian: magic, block size, documents, values, blocks, packed words, exceptions (7 x u64); doc ids
(i64), null marks (u8), values of each document (u64); block minimum (u32), width (u8), first packed word (u64),
first exception (u64); packed words (u64); exception places (u8), exception values (u32).
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C
from .tokens import ODD, PIECE, byte_symbols

MAGIC, BLOCK = 0x31524F4650, 256
SHARD_VALUES = 4_000_000


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """rows: (n, 256) values under 2**width. (n, 4 * width) words of 64 bits."""
    lanes = np.ascontiguousarray(rows.reshape(-1, 64).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(rows), 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, width).T) if width else np.zeros((0, len(words) * 4), dtype=np.uint64)
    out, mask = np.zeros((64, len(words) * 4), dtype=np.uint64), np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[j] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            out[j] |= lanes[word + 1] << np.uint64(64 - shift)
        out[j] &= mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK).astype(np.uint32)


def _encode_blocks(rows: np.ndarray, percentile: float):
    """rows: (n, 256). Minimum, width, packed words, exceptions a block, their places and values."""
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    width = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.uint8)
    over = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    block, place = np.nonzero(over)
    values = rest[over]
    rest[over] = 0
    first = np.r_[0, np.cumsum(4 * width.astype(np.int64))]
    packed = np.zeros(first[-1], dtype=np.uint64)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        if w:
            packed[(first[mine][:, None] + np.arange(4 * int(w))).ravel()] = _pack(rest[mine], int(w)).ravel()
    return low, width, packed, np.bincount(block, minlength=len(rows)), place.astype(np.uint8), values


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, percentile: float = 95) -> bytes:
    """ids: of all documents, one after the other (uint32); sizes: how many each has."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    parts = []
    for i in range(0, blocks, 2048):
        some = ids[i * BLOCK : (i + 2048) * BLOCK]
        if len(some) % BLOCK:
            some = np.r_[some, np.full(-len(some) % BLOCK, some[-1], dtype=np.uint32)]
        parts.append(_encode_blocks(some.astype(np.uint32).reshape(-1, BLOCK), percentile))
    low, width, packed, many, place, values = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.uint8),) * 6
    first, exceptions = np.r_[0, np.cumsum(4 * width.astype(np.int64))], np.r_[0, np.cumsum(many)]
    head = np.array([MAGIC, BLOCK, len(doc_ids), n, blocks, len(packed), len(values)], dtype="<u8")
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    sections = [head, np.array([d or 0 for d in doc_ids], dtype="<i8"), null, np.asarray(sizes, dtype="<u8"), low.astype("<u4"), width.astype(np.uint8), first[:-1].astype("<u8"), exceptions[:-1].astype("<u8"), packed.astype("<u8"), place.astype(np.uint8), values.astype("<u4")]
    return b"".join(x.tobytes() for x in sections)


def decode_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, how many ids each document has, and all ids."""
    head = np.frombuffer(data, dtype="<u8", count=7)
    if head[0] != MAGIC or head[1] != BLOCK:
        raise ValueError("not a token shard")
    docs, n, blocks, words, more = (int(x) for x in head[2:])
    at, parts = head.nbytes, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks), ("u1", blocks), ("<u8", blocks), ("<u8", blocks), ("<u8", words), ("u1", more), ("<u4", more)):
        parts.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
        at += parts[-1].nbytes
    doc_ids, null, sizes, low, width, first, exceptions, packed, place, values = parts
    out = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        if w:
            out[mine] = _unpack(packed[(first[mine].astype(np.int64)[:, None] + np.arange(4 * int(w)))], int(w))
    block = np.repeat(np.arange(blocks), np.diff(np.r_[exceptions.astype(np.int64), more]))
    out[block, place] = values
    out += low[:, None]
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], sizes.astype(np.int64), out.ravel()[:n]


def put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all; from an executor, in any store that pyarrow reaches. Each attempt writes under a
    name of its own first."""
    url, attempt = urlparse(path), f"{uuid.uuid4().hex}.tmp"
    if url.scheme in ("", "file"):
        aside = f"{url.path}.{attempt}"
        os.makedirs(posixpath.dirname(url.path), exist_ok=True)
        with open(aside, "wb") as f:
            f.write(data)
        os.replace(aside, url.path)
        return
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_output_stream(f"{place}.{attempt}") as f:
        f.write(data)
    store.move(f"{place}.{attempt}", place)


class _Known(dict):
    """Pieces to their ids; a piece that isn't known stands for itself and is noted."""

    def __init__(self):
        self.new: set[str] = set()

    def __missing__(self, piece: str) -> str:
        self.new.add(piece)
        return piece


class Encoder:
    """Ids by the tokenizers library. Pieces between which no token reaches are encoded once; the first ``most`` are
    remembered, the common ones among them.

    New pieces go to the library in one string: those that don't begin with white space after a line break of their
    own; texts that aren't cut, and white space at the ends of texts, by themselves.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most, self.known = Tokenizer.from_file(path), most, _Known()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte_of = {s: b for b, s in byte_symbols().items()}
        vocabulary = self.library.get_vocab()
        # of each token how many bytes of text it stands for; 0 for special ones
        self.bytes = np.zeros(1 + max(vocabulary.values()), dtype=np.int64)
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.bytes[i] = len(token)
        self.bytes[[vocabulary[s] for s in self.specials]] = 0
        self.line = len(self._alone(["\n"])[0])

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Of pieces that end in other characters than white space."""
        joined = [p if p[0] in " \n\t" or p[0].isspace() else "\n" + p for p in pieces]
        text = "".join(joined)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        chars = np.fromiter(map(len, joined), np.int64, len(joined))
        # where each character begins, and so each piece ends, in bytes
        begin = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = 4 * (np.searchsorted(np.cumsum(self.bytes[ids]), begin[np.cumsum(chars)]) + 1)
        starts = np.r_[0, ends[:-1]] + self.line * (chars > np.fromiter(map(len, pieces), np.int64, len(pieces)))
        out = ids.tobytes()
        return [out[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        known, alone = self.known, set()
        get, new, found = known.__getitem__, known.new, []
        new.clear()
        for t in texts:
            if ODD.search(t) or any(s in t for s in self.specials):
                alone.add(t)
                found.append([get(t)])
                continue
            c = PIECE.findall(t)
            if c and c[-1][-1].isspace():
                alone.add(c[-1])
            found.append(list(map(get, c)))
        apart = [p for p in new if p in alone]
        rest = [p for p in new if p not in alone] if apart else list(new)
        fresh = dict(zip(apart, self._alone(apart), strict=True)) if apart else {}
        for i in range(0, len(rest), 20_000):
            fresh.update(zip(rest[i : i + 20_000], self._together(rest[i : i + 20_000]), strict=True))
        out = [b"".join([fresh[x] if x.__class__ is str else x for x in parts]) for parts in found]
        for p in fresh:
            if len(known) >= self.most:
                break
            if len(p) <= 60:
                known[p] = fresh[p]
        return out


def encoder(path: str) -> Encoder:
    return C.held(("encoder", path), lambda: Encoder(path))


def write(docs: DataFrame, path: str, folder: str, end: int = 2, partitions: int | None = None, shard_values: int = SHARD_VALUES) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) and ``end`` after each, in ascending doc_id order, nulls first.

    Rows of one doc_id, null among them, are ordered by a hash of their texts, then by these, and may lie in several
    shards. Repeated rows are written each; an empty table gives no files. A null text is empty: ``end`` alone. Returns the written manifest: shard (its
    file's name; names sort as the documents do), n_docs, n_values.
    """
    spark = docs.sparkSession
    C.batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    rows = C.pick(docs, doc_id="long", text="string").repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def run(batches):
        encode, part = encoder(path), TaskContext.get().partitionId()
        tail = np.array([end], dtype="<u4").tobytes()
        held, ids, size, k = [], [], 0, 0

        def flush():
            name = f"part-{part:06d}-{k:06d}.pfor"
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            put(f"{folder}/{name}", encode_shard(np.frombuffer(b"".join(ids), dtype="<u4"), held, sizes))
            return pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(held)], "n_values": [int(sizes.sum())]})

        for batch in batches:
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                held.append(doc_id)
                ids.append(got + tail)
                size += len(got) // 4 + 1
                if size >= shard_values:
                    yield flush()
                    held, ids, size, k = [], [], 0, k + 1
        if held:
            yield flush()

    return C.written(rows.mapInArrow(run, "shard string, n_docs long, n_values long"), "manifest")[0]


def read(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    unsigned 32-bit little-endian integers); ``with_ids`` adds ids. No files: no rows."""
    C.batches(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not manifest.take(1):
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                doc_ids, sizes, ids = decode_shard(data.as_buffer())
                stop = np.cumsum(sizes)
                raw = np.ascontiguousarray(ids, dtype="<u4")
                cols = {
                    "shard": pa.array([posixpath.basename(path)] * len(doc_ids), pa.string()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "within": pa.array(stop - sizes, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[b - s : b].tobytes()) for b, s in zip(stop.tolist(), sizes.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, stop], pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(cols)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "shard string, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    before = manifest.select("shard", (F.sum("n_values").over(Window.orderBy("shard")) - F.col("n_values")).alias("before"))
    if manifest.count() <= 50_000:  # a row for each file, some 60 bytes; beyond that the join shuffles
        before = F.broadcast(before)
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op9(docs: DataFrame, path: str) -> DataFrame:
    """Writes all documents into a new folder beside the checkpoints, and reads the files back."""
    folder = C.fresh_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, folder, write(docs, path, folder))
