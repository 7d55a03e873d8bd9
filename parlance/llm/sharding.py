"""Shuffled shards by a two-pass external shuffle.

Pass 1 scatters rows by a seeded hash into buckets that fit a task's memory; pass 2 gives each bucket a seeded
Fisher-Yates shuffle and writes it. Buckets in order are one random order of all rows, cut into equal shards. The
hash takes in where a row is stored, so that equal rows part like any others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.storage import new_path, written

#: So many offsets are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
#: Tasks of the second pass, at most; of more buckets a task has several, one after the other in its memory.
MAX_TASKS = 100_000
#: In a path: of a part file what follows its number, the random ending of a stored table, the application.
_MARKS = r"(?<=/part-\d{5,10})-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?<=-)[0-9a-f]{32}(?=/)|(?<=/)(?:local-\d+|app-\d+-\d+|application_\d+_\d+)(?=/)"


def file_position(root: str | None = None) -> Column:
    """Where a row is stored, for a DataFrame that reads files: its file's path and its place there.

    Of the path counts what is below the first folder named ``root`` (or the file of that name), so a table that is
    moved keeps its positions; without ``root``, all of it. Marks of a task, run or application are left out: two rows
    have one position only where tables are read together whose paths differ in such marks alone.
    """
    path = F.col("_metadata.file_path")
    if root is not None:
        path = F.regexp_replace(path, f"^.*?/{re.escape(root)}(?=/|$)", "")
    path = F.regexp_replace(path, _MARKS, "")
    return F.xxhash64(path, "_metadata.row_index")


def _shuffled(seed: int, total: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket: (bucket, ahead, row) -> (shard, slot, row)."""

        def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            n, bucket, ahead = len(table), table["bucket"][0].as_py(), table["ahead"][0].as_py()
            order = np.random.default_rng([seed, bucket]).permutation(n)  # Fisher-Yates
            g = ahead + np.arange(n, dtype=np.int64)
            shard = ((g + 1) * shards - 1) // total
            slot = g - shard * total // shards
            out = pa.table([pa.array(shard.astype(np.int32)), pa.array(slot), table["doc"].take(order)], names=["shard", "slot", "doc"])
            yield from out.to_batches(max_chunksize=2000)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            marks = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and a < b and held[0].column(0)[0].as_py() != marks[a]:
                    yield from close(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from close(held)

    return run


def write_shards(docs: DataFrame, shards: int = 8, seed: int = 5, bucket_bytes: int = 16 << 20, path: str | None = None, row_key: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` shuffled into ``shards`` Parquet folders under ``path``; returns what was written, read again.

    Columns: ``doc``, a struct of all columns of the row; ``shard`` from 0; ``slot``, the place in the shard, gapless
    from 0. Counts of shards differ by one at most. ``path`` is by default new, in the shared folder.

    ``row_key`` is of ``docs`` and tells equal rows apart, the same whenever it is computed; with file_position() the
    rows are read where they are. Without, ``docs`` is written first and the places there are the keys.

    Rows are sorted by id and hash before a bucket's shuffle, so reruns over the same files agree. Null id
    or text: rows like others. Repeated rows: each has a slot, and they part as any two rows do. Fewer rows than
    shards: some shards have none. Columns of any name stay, within ``doc``. Empty table: no rows.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    if row_key is None:
        docs, row_key = written(docs, "rows"), file_position()
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 64
    h = F.xxhash64(F.col(id_col), F.col(text_col), row_key, F.lit(seed))
    keys = written(docs.select(h.alias("h"), size.alias("size")), "keys")  # texts are read here and by the scatter
    rows, total_bytes = keys.select(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.ceil(total_bytes / bucket_bytes))
    where = F.pmod(h, F.lit(buckets)).cast("int")
    counts = keys.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).groupBy("bucket").count()
    ahead = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    dealt = docs.select(where.alias("bucket"), h.alias("h"), F.struct(*docs.columns).alias("doc")).join(offsets, "bucket")
    tasks = min(buckets, MAX_TASKS)
    task = F.floor(F.col("bucket") * F.lit(tasks).cast("long") / buckets).cast("int")
    dealt = dealt.select("bucket", "ahead", "doc", "h").repartitionById(tasks, task)
    dealt = dealt.sortWithinPartitions("bucket", f"doc.{id_col}", "h").select("bucket", "ahead", "doc")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), dealt.schema["doc"]])
    out = dealt.mapInArrow(_shuffled(seed, max(rows, 1), shards), schema).sortWithinPartitions("shard", "slot")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    if not rows:
        return spark.createDataFrame([], schema)
    read = T.StructType([schema["slot"], schema["doc"], schema["shard"]])
    return spark.read.schema(read).parquet(path)
