"""WARC archives with an index: an offset, length, URL and digest per record, and reads of selected records by ranges.

Writers are tasks over the rows as they lie: each record is a gzip member of its own, so that any record can be read
from its offset alone. The index is a Parquet table, and only its rows name files: what a lost or repeated task wrote
besides is removed after the index is there. Readers sort the selected records by file and offset, and read
neighbours by one request.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.sharding import file_position
from parlance.llm.storage import new_path, written

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
#: A file is closed beyond so many bytes.
FILE_BYTES = 1 << 30
#: Neighbours are read together over gaps of up to GAP_BYTES, up to SPAN_BYTES at once; a task reads about TASK_BYTES.
GAP_BYTES, SPAN_BYTES, TASK_BYTES = 64 << 10, 8 << 20, 32 << 20
#: So many rows (below 200 bytes each) are broadcast; more are joined by a shuffle, each key in SALTS parts.
BROADCAST_ROWS, SALTS = 50_000, 32
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, record_id string, page_id long, url string, payload_digest string, payload_bytes long, record_type string"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to_record string, stated_digest string, stated_bytes long, payload binary"


def with_match(rows: DataFrame, side: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` left-joined to ``side``, a stored table of different ``key``s. A key may be that of most rows: ``spread`` parts them."""
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, "left")
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(salted, [key, "salt"], "left").drop("salt")


def _block(headers: list[tuple[str, object]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in headers if v is not None), "", ""]).encode()


def _one_line(url: str | None) -> str | None:
    """A URL as a header's value: blanks and control characters as %XX."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, record_id: str, payload: bytes, digest: str, date: str, page_id: int | None = None, url: str | None = None, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """One record as it stands in an archive, before compression. A revisit has the HTTP head only."""
    http = _block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    body = http + payload if kind == "response" else http
    revisit = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers_to}>"), ("WARC-Refers-To-Target-URI", _one_line(refers_url))] if kind == "revisit" else []
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), *revisit, ("Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    return _block(head, VERSION) + body + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])


def parsed(data: bytes) -> tuple:
    """RECORDS of one record; an error where it is not one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(VERSION.encode()):
        raise ValueError("no record begins here")
    of = _headers(head)
    size = int(of["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {of['WARC-Record-ID']} is not as long as it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    page, refers = of.get("Page-ID"), of.get("WARC-Refers-To")
    uid = lambda x: x and x.removeprefix("<urn:uuid:").removesuffix(">")
    kind = of["WARC-Type"]
    return uid(of["WARC-Record-ID"]), page and int(page), of.get("WARC-Target-URI"), kind, uid(refers), of["WARC-Payload-Digest"].removeprefix("sha256:"), int(_headers(http)["Content-Length"]), payload if kind == "response" else None


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str, date: str, level: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        part, k, out, at, name = TaskContext.get().partitionId(), 0, None, 0, ""
        attempt = uuid.uuid4().hex[:12]
        try:
            for batch in batches:
                rows = []
                for page_id, url, record_id, digest, first_record, first_url, payload in (x for i in range(0, batch.num_rows, 64) for x in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns), strict=True)):
                    if out is None:
                        name, at = f"part-{part:05d}-{k:03d}-{attempt}.warc.gz", 0
                        out, k = fs.open_output_stream(f"{root}/{name}", compression=None), k + 1
                        info = _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", 18)], VERSION)
                        at += out.write(_member(info + b"format: WARC 1.1\r\n\r\n\r\n", level))
                    kind = "revisit" if first_record is not None else "response"
                    data = _member(record(kind, record_id, payload, digest, date, page_id, url, first_record, first_url), level)
                    out.write(data)
                    rows.append((name, at, len(data), record_id, page_id, url, digest, len(payload), kind))
                    at += len(data)
                    if at >= file_bytes:
                        out.close()
                        out = None
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, path: str | None = None, date: str = "2000-01-01T00:00:00Z", row_key: Column | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", level: int = 6, file_bytes: int = FILE_BYTES) -> str:
    """Writes a record for each row of ``pages`` to ``path``/archive and the index to ``path``/index; returns ``path``.

    The payload is the text in UTF-8, empty for null. Of rows with equal payloads of LEAST_REVISIT bytes or more, that
    of the least id is a response (null ids last; of a repeated id, one of its rows), and the others are revisits of it; smaller payloads are all responses. Null URL or id: the record lacks that header. A URL's blanks
    and control characters are written as %XX; the index has it as it was. Empty table: an index without rows. Other
    columns are ignored.

    ``row_key`` is of ``pages`` and tells rows apart, the same whenever it is computed, such as file_position(); without
    it, ``pages`` is written first. ``path`` is a URI that workers open through Arrow (a mounted folder or a store).
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    if row_key is None:
        pages, row_key = written(pages.select(id_col, url_col, text_col), "pages"), file_position()
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.md5(F.concat_ws(":", F.col(id_col).cast("string"), row_key.cast("string"))).alias("record_id"),
        F.sha2(payload, 256).alias("digest"),
        payload.alias("payload"),
    )
    first = F.min_by(F.struct("record_id", "url"), F.struct(F.col("page_id").isNull(), "page_id", "record_id"))
    shared = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
    firsts = written(shared.filter("n > 1").select("digest", F.col("first.record_id").alias("first_record"), F.col("first.url").alias("first_url")), "firsts")
    marked = with_match(rows, firsts, "digest", "record_id")
    own = F.col("first_record") != F.col("record_id")
    marked = marked.select("page_id", "url", _dashed("record_id").alias("record_id"), "digest", F.when(own, _dashed("first_record")).alias("first_record"), F.when(own, F.col("first_url")).alias("first_url"), "payload")
    fs, root = pyarrow.fs.FileSystem.from_uri(f"{path}/archive")
    fs.create_dir(root, recursive=True)
    marked.mapInArrow(_write(f"{path}/archive", date, level, file_bytes), INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    _sweep(spark, path)
    return path


def _dashed(name: str) -> Column:
    return F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _sweep(spark: SparkSession, path: str) -> None:
    """Removes files of ``path``/archive that no row of the index names; the list is one name for about FILE_BYTES or a task."""
    fs, root = pyarrow.fs.FileSystem.from_uri(f"{path}/archive")
    named = {r[0] for r in read_index(spark, path).select("file").distinct().collect()}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if info.base_name not in named:
            fs.delete_file(info.path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX of the archives in ``path``, to select records from."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def spans(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = SPAN_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of ``rows`` (file, offset, length), sorted, that one request reads: close neighbours, ``most`` bytes together."""
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[at][0] or rows[i][1] - rows[i - 1][1] - rows[i - 1][2] > gap or rows[i][1] + rows[i][2] - rows[at][1] > most:
            yield at, i
            at = i


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))
            for a, b in spans(rows):
                begin = rows[a][1]
                with fs.open_input_file(f"{root}/{rows[a][0]}") as f:
                    data = f.read_at(rows[b - 1][1] + rows[b - 1][2] - begin, begin)
                found = [parsed(zlib.decompress(data[at - begin : at - begin + n], 31)) for _, at, n in rows[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return run


def read_records(spark: SparkSession, path: str, selected: DataFrame | None = None) -> DataFrame:
    """RECORDS of the archives in ``path`` that ``selected`` rows of the index name, by default all.

    ``stated_digest`` and ``stated_bytes`` are what the record says of its payload; ``payload`` is null in a revisit, and
    ``refers_to_record`` in a response. A row that is selected twice is read twice. No row selected: none read. URLs are
    as written; null URLs and ids are null again. A damaged record ends the job with an error.
    """
    index = (read_index(spark, path) if selected is None else selected).select("file", "offset", "length")
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    piece = F.floor(F.col("offset") / SPAN_BYTES)
    dealt = index.repartition(max(1, math.ceil(total / TASK_BYTES)), "file", piece).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(f"{path}/archive"), RECORDS)


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from the archives read back.

    Size and digest are of the full payload, for a revisit that of the response which it names; ``refers_to`` is that
    response's id, null in a response. An error ends the job where a payload is not what its record states, or a
    revisit names no response. Repeated and null ids: a row for each record.
    """
    payload = F.coalesce("payload", F.lit(b""))
    fits = (F.col("record_type") == "revisit") | ((F.sha2(payload, 256) == F.col("stated_digest")) & (F.octet_length(payload) == F.col("stated_bytes")))
    digest = F.when(fits, F.col("stated_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs in record "), F.col("record_id"))))
    records = written(read_records(spark, path).select("record_id", "page_id", "record_type", "refers_to_record", digest.alias("digest"), F.col("stated_bytes").alias("bytes")), "records")
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'")
    named = responses.join(revisits.select(F.col("refers_to_record").alias("record_id")).distinct(), "record_id", "left_semi")
    named = written(named.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("digest").alias("full_digest"), F.col("bytes").alias("full_bytes")), "named")
    same = (F.col("full_digest") == F.col("digest")) & (F.col("full_bytes") == F.col("bytes"))
    found = F.when(same, F.col("full_digest")).otherwise(F.raise_error(F.concat(F.lit("no such response for record "), F.col("record_id"))))
    full = with_match(revisits, named, "refers_to_record", "record_id")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    full = full.select("page_id", F.col("full_bytes").alias("payload_bytes"), found.alias("payload_digest"), "record_type", "refers_to")
    plain = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.select(*columns).union(full.select(*columns))
