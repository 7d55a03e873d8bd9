"""Token ids of documents in a binary container: frames under a shared zstandard dictionary, with an offset index.

The container is a folder: ``blocks``, Parquet rows of some MB each, and ``dictionary``. A block holds the hash of
the dictionary, a payload of one frame for each document, and for each its id, its number of ids and its frame's
offset; so one document is read by one block's row and one frame. Spark's committer writes it, so a lost executor
leaves no half file.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.storage import new_path
from parlance.llm.text import buffers
from parlance.llm.tokenizing import SLICE_BYTES, Pieces, held, load

BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 20_000
#: The dictionary is trained on so many documents at most, and of each on one stretch of so many bytes of ids at most.
SAMPLE_DOCS, SAMPLE_BYTES = 512, 32 << 10
DICT_BYTES = 64 << 10

_BLOCKS = "part int, block int, ahead long, low long, high long, dict_hash string, width int, ids array<long>, counts array<long>, offsets array<long>, payload binary"


class Encoder:
    """Ids of texts as little-endian bytes, ``width`` each, with ``end_id`` appended."""

    def __init__(self, path: str, end_id: int):
        assert sys.byteorder == "little"
        tokenizer = load(path)
        self.width = 2 if tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end_id], self.kind).tobytes()
        code = {2: "H", 4: "I"}[self.width]
        self.pieces = Pieces(tokenizer, lambda ids: array(code, ids).tobytes())

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x for _, raw, off in buffers(pa.array([t.encode() for t in texts], pa.binary())) for x in self.encode_slice(raw, off)]

    def encode_slice(self, raw: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
        """Of each text of a slice: the ids of all its pieces, taken from those of the slice's different pieces at once."""
        found, place, bounds = self.pieces.of_slice(raw, off)
        pool = np.frombuffer(b"".join(found), self.kind)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        begins = np.cumsum(lengths) - lengths
        each = lengths[place]
        through = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.arange(through[-1]) + np.repeat(begins[place] - through[:-1], each)].tobytes()
        ends = (through[bounds] * self.width).tolist()
        return (ids[a:b] + self.end for a, b in zip(ends[:-1], ends[1:], strict=True))


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; of too few samples, their bytes as they are; of none, empty."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _stretch(data: bytes, width: int, seed: int) -> bytes:
    """``data`` whole, or SAMPLE_BYTES of it from a seeded place, at an id."""
    room = len(data) - SAMPLE_BYTES
    at = int(np.random.default_rng(seed).integers(room // width + 1)) * width if room > 0 else 0
    return data[at : at + SAMPLE_BYTES]


def _sampled(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("ids", path, end_id), lambda: Encoder(path, end_id))
        for batch in batches:
            for at, raw, off in buffers(batch.column(1), SLICE_BYTES):
                seeds = batch.column(0).slice(at, len(off) - 1).to_pylist()
                found = [_stretch(data, encoder.width, seed & (2**63 - 1)) for seed, data in zip(seeds, encoder.encode_slice(raw, off), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    return run


def _encode(path: str, end_id: int, dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("ids", path, end_id), lambda: Encoder(path, end_id))
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=False, write_content_size=True)
        mark, part = hashlib.sha256(dictionary).hexdigest(), TaskContext.get().partitionId()
        ids, counts, frames = [], [], []
        block = ahead = size = 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ahead", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("dict_hash", pa.string()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])

        def close() -> pa.RecordBatch:
            known = [x for x in ids if x is not None]
            offsets = np.cumsum([0, *map(len, frames)])
            row = [part, block, ahead, min(known, default=None), max(known, default=None), mark, encoder.width, ids, counts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for at, raw, off in buffers(batch.column(1), SLICE_BYTES):
                names = batch.column(0).slice(at, len(off) - 1).to_pylist()
                for name, data in zip(names, encoder.encode_slice(raw, off), strict=True):
                    frames.append(packer.compress(data))
                    ids.append(name)
                    counts.append(len(data) // encoder.width)
                    size += len(frames[-1])
                    if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield close()
                        block, ahead, size = block + 1, ahead + sum(counts), 0
                        ids, counts, frames = [], [], []
        if ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> str:
    """Encodes every text of ``docs``, appends ``end_id``, and writes the container; returns its path.

    Documents go in ascending order of id, null first; rows that repeat an id in the order of a text hash. Null text:
    as empty, the end id alone. Empty table: a container without blocks. The dictionary is trained on a bounded sample:
    SAMPLE_DOCS documents of the least hash, of any length, each encoded whole, and of long ones SAMPLE_BYTES of ids from a
    seeded place. Every document is written.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    h = F.xxhash64("id")
    last = texts.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]  # hashes first, so that no task sends texts that are not drawn
    drawn = texts.filter(h <= F.lit(last)).select(h.alias("h"), "text").limit(SAMPLE_DOCS)
    sample = sorted(bytes(x.ids) for x in drawn.mapInArrow(_sampled(tokenizer_path, end_id), "ids binary").collect())
    dictionary = train_dictionary(sample) if sample else b""
    mark = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(mark, bytearray(dictionary))], "dict_hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    order = [F.col("id"), F.xxhash64("text")]  # both, as one id, or null, may be of very many rows
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_encode(tokenizer_path, end_id, dictionary, level), _BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def _decoded(dictionary: bytes, with_ids: bool):
    mark = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("part", "ahead", "dict_hash", "width", "ids", "offsets")}
                if row["dict_hash"] != mark:
                    raise ValueError("a block names another dictionary")
                payload = memoryview(batch.column("payload")[i].as_buffer())
                counts, sums, tokens = [], [], []
                for a, b in zip(row["offsets"][:-1], row["offsets"][1:], strict=True):
                    ids = np.frombuffer(unpacker.decompress(payload[a:b]), f"<u{row['width']}")
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4")))
                    if with_ids:
                        tokens.append(ids.astype(np.int32))
                n = len(counts)
                ahead = row["ahead"] + np.cumsum([0, *counts[:-1]])
                cols = [pa.array([row["part"]] * n, pa.int32()), pa.array(ahead, pa.int64()), pa.array(row["ids"], pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                names = ["part", "ahead", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("token_ids")
                for k in range(0, n, 1000):
                    yield pa.RecordBatch.from_arrays([c.slice(k, 1000) for c in cols], names=names)

    return run


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return blocks, bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decompressed frame.

    ``start``: ids of all documents before it, by sums of blocks and of parts; a part is a row to the last sum.
    """
    blocks, dictionary = _read(spark, path)
    docs = blocks.mapInArrow(_decoded(dictionary, False), "part int, ahead long, doc_id long, n_tokens long, ids_crc32 long")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    parts = blocks.select("part", total.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return docs.join(starts, "part").select("doc_id", (F.col("before") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(doc_id, token_ids) of the documents with ids from ``low`` to ``high``: only blocks that hold such are read."""
    blocks, dictionary = _read(spark, path)
    rows = blocks.filter((F.col("low") <= high) & (F.col("high") >= low)).mapInArrow(_decoded(dictionary, True), "part int, ahead long, doc_id long, n_tokens long, ids_crc32 long, token_ids array<int>")
    return rows.filter(F.col("doc_id").between(low, high)).select("doc_id", "token_ids")
