"""Token ids in a binary format: blocks of ids, transposed into byte or bit planes, each plane compressed.

A segment is one byte string, complete in itself::

    magic "BPL1", kind (1 byte planes, 8 bit planes), block size, number of blocks, documents, ids
    the document table, compressed: ids as int64, a null flag each, lengths as uint32
    the chunk index: for each block its number of ids, and the length of each of its planes (0: all zero)
    the planes of all blocks, each compressed with zstandard

The index gives the place of any block, so a reader decodes only those it needs. Segments are the rows of a
Parquet table (shard, segment, begin, n_ids, n_docs, segment): Spark's committer makes a lost executor harmless,
any file system will do, and a shard's segments are read in parallel.

Defined results: a special token's string in a text is that token, as the library takes it unless told otherwise; a
null text counts as empty and gets the end id alone; documents ascend by doc_id, null ids first,
equal ids by a hash of the text (rows equal in both follow each other, as they may); an empty table writes no
segment; a document of any length stays in one segment, which then is as long as the document.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import WordPieces, fresh_path, fresh_worker, groups, kept, no_cycles, small_batches, text_or_empty

_HEAD = struct.Struct("<4sBIIII")
_MAGIC = b"BPL1"
#: ids of a block, and of a segment (whole documents, so the last one may exceed it)
BLOCK, SEGMENT = 1 << 15, 1 << 18


# -- the format ---------------------------------------------------------------------------------------------
def _planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() if raw[:, k].any() else b"" for k in range(4)]
    table = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(table[:, k]).tobytes() if table[:, k].any() else b"" for k in range(32)]


def _ids_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.view("<u4").ravel()
    table = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p:
            table[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
    return np.packbits(table, axis=1, bitorder="little").view("<u4").ravel()


def encode_segment(ids: np.ndarray, doc_ids: list, lengths: list[int], bits: bool = False, block: int = BLOCK) -> bytes:
    press, depth = zstandard.ZstdCompressor(level=3), 32 if bits else 4
    table = press.compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + bytes(d is None for d in doc_ids)
        + np.array(lengths, "<u4").tobytes()
    )
    index, bodies = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [press.compress(p) if p else b"" for p in _planes(part, bits)]
        index.append(struct.pack(f"<{1 + depth}I", len(part), *map(len, planes)))
        bodies += planes
    head = _HEAD.pack(_MAGIC, 8 if bits else 1, block, len(index), len(doc_ids), len(table))
    return b"".join([head, table, *index, *bodies])


class Segment:
    """Read access to one segment."""

    def __init__(self, data: bytes):
        magic, kind, self.block, blocks, docs, table = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a segment of bit planes")
        self.data, self.bits, self._open = data, kind == 8, zstandard.ZstdDecompressor()
        raw = self._open.decompress(data[_HEAD.size : _HEAD.size + table])
        nulls = raw[8 * docs : 9 * docs]
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(raw[: 8 * docs], "<i8"), nulls)]
        self.lengths = np.frombuffer(raw[9 * docs :], "<u4").astype(np.int64)
        depth, at = 32 if self.bits else 4, _HEAD.size + table
        self.index = np.frombuffer(data, "<u4", blocks * (1 + depth), at).reshape(blocks, 1 + depth).astype(np.int64)
        self._begin = at + 4 * blocks * (1 + depth)
        self._places = self._begin + np.concatenate([[0], np.cumsum(self.index[:, 1:].sum(1))])

    def read_block(self, k: int) -> np.ndarray:
        at, planes = int(self._places[k]), []
        for n in self.index[k, 1:]:
            planes.append(self._open.decompress(self.data[at : at + int(n)]) if n else b"")
            at += int(n)
        return _ids_of(planes, int(self.index[k, 0]), self.bits)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.read_block(k) for k in range(len(self.index))] or [np.zeros(0, np.uint32)])


# -- writing and reading ------------------------------------------------------------------------------------
def _encoder(path: str) -> WordPieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    # how many bytes a token stands for: its string has a character for each
    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        sizes[i] = len(token)

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def compute(parts: list[str]) -> list[bytes]:
        """Parts that begin with a blank and end with another character are encoded as one text, then told apart."""
        out: list = [None] * len(parts)
        joint = [i for i, p in enumerate(parts) if p[0] == " " and not p[-1].isspace()]
        if joint:
            ids = ids_of("".join([parts[i] for i in joint]))
            ends = np.cumsum(sizes[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(parts[i].encode()) for i in joint])) + 1
            if int(cuts[-1]) != len(ids):
                raise ValueError("the tokens don't add up to the text")
            data, begin = ids.tobytes(), 0
            for i, end in zip(joint, (4 * cuts).tolist()):
                out[i], begin = data[begin:end], end
        for i, p in enumerate(parts):
            if out[i] is None:
                out[i] = ids_of(p).tobytes()
        return out

    tokenizer.model._resize_cache(0)  # what comes here is new, or was forgotten: the cache is in front
    return WordPieces(compute, 500_000)


_TABLE = "shard int, segment int, begin long, n_ids long, n_docs int, data binary"
_TABLE_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("begin", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("data", pa.binary())])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, bits: bool = False) -> None:
    """Encode docs (doc_id, text) with a tokenizer file, in ascending doc_id order, to a table of segments at path."""
    small_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    ordered = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, begin = TaskContext.get().partitionId(), 0, 0
        pieces, end = kept(tokenizer, lambda: _encoder(tokenizer)), np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        names: list = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            data = encode_segment(ids, names, lengths, bits)
            row = [[shard], [segment], [begin], [len(ids)], [len(names)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _TABLE_ARROW)], schema=_TABLE_ARROW)

        size = 0
        for batch in batches:
            docs, at = batch.column(0).to_pylist(), 0
            for group in groups(batch.column(1).to_pylist()):
                with no_cycles():
                    encoded = [b"".join([*map(b"".join, found), end]) for found in pieces.get_all(group)]
                for own in encoded:
                    held.append(own)
                    names.append(docs[at])
                    lengths.append(len(own) // 4)
                    size, at = size + len(own) // 4, at + 1
                    if size >= SEGMENT:
                        yield flush()
                        segment, begin, size = segment + 1, begin + size, 0
                        held, names, lengths = [], [], []
        if names:
            yield flush()

    ordered.mapInArrow(run, _TABLE).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """The documents of a table of segments: doc_id, start, n_tokens, and ids (array of int) or ids_crc32."""
    table = spark.read.schema(_TABLE).parquet(path)
    # as many rows as the writer had partitions
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for shard, begin, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                segment = Segment(data)
                ids, ends = segment.ids().astype("<u4", copy=False), np.cumsum(segment.lengths)
                starts = ends - segment.lengths
                if digest_only:
                    last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64())
                else:
                    last = pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, ends)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(ends), pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(starts + begin, pa.int64()), pa.array(segment.lengths, pa.int64()), last],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"],
                )

    kind = "ids_crc32 long" if digest_only else "ids array<int>"
    found = table.select("shard", "begin", "data").mapInArrow(run, f"shard int, doc_id long, start long, n_tokens long, {kind}")
    return found.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", kind.split()[0])


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids of docs in the shared folder and return the digests read back from there."""
    spark = docs.sparkSession
    path = fresh_path(spark, "ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(spark, path, digest_only=True)
