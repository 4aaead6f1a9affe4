"""WARC archives as a Python data source.

Writing: each task writes its own files, one gzip member per record, and hands their list to the
driver, which publishes it as a manifest; files of failed attempts are not in it. Reading: the
manifest gives record-aligned parts with their record types, from which partitions are planned;
pushed filters on header fields drop parts and records; a record's headers are inflated first, and
an unwanted record or payload is passed over by its member's length without being inflated.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

from evitrace.session import cut_lineage, require_checkpoint_dir, ship_package

MANIFEST = "_manifest.json"
SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, "
          "payload_length bigint, refers_to string, headers map<string, string>, payload binary")
#: Header behind each column that filters are pushed down for.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes after which a part ends, and a file.
PART_BYTES, FILE_BYTES = 16 << 20, 1 << 30
#: Records and payload bytes of a batch that a reader hands over.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or local path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def member(block: bytes) -> bytes:
    """A gzip member whose header tells its length, so that readers can pass over it."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    size = 10 + 2 + 8 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HccHI", 8, b"W", b"L", 4, size) + body
            + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF))


def record(row: dict) -> bytes:
    """The record of a row; a revisit keeps the HTTP header and leaves the payload out."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    length = row["payload_length"] if revisit else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"] or DATE,
              "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": row["payload_digest"]}
    if revisit:
        fields |= {"WARC-Refers-To": row["refers_to"], "WARC-Profile": PROFILE}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(payload))}
    # A header value is one line.
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields.items() if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + http + payload + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        disk, folder = store(self.path)
        files, out = [], None
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                    if out is None:
                        disk.create_dir(folder, recursive=True)
                        files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "bytes": 0, "parts": []})
                        out = disk.open_output_stream(f"{folder}/{files[-1]['name']}", compression=None)
                    file = files[-1]
                    if not file["parts"] or file["bytes"] - file["parts"][-1]["start"] >= PART_BYTES:
                        file["parts"].append({"start": file["bytes"], "types": Counter()})
                    made = member(record({"date": None} | row))
                    out.write(made)
                    file["bytes"] += len(made)
                    file["parts"][-1]["types"][row["record_type"]] += 1
                    if file["bytes"] >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        disk, folder = store(self.path)
        files = [] if self.overwrite else manifest(disk, folder) or []
        files += [f for m in messages if m for f in m.files]
        disk.create_dir(folder, recursive=True)
        with disk.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps(files).encode())
        disk.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        disk, folder = store(self.path)
        for m in messages:
            for f in m.files if m else []:
                disk.delete_file(f"{folder}/{f['name']}")


def manifest(disk: fs.FileSystem, folder: str) -> list[dict] | None:
    if disk.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.File:
        return None
    with disk.open_input_stream(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.read())


@dataclass
class Part(InputPartition):
    name: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify = path, payload, verify
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Takes equality, membership and prefixes of header columns; all else stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        """A partition per part that can hold a wanted record. Without a manifest, one per file."""
        disk, folder = store(self.path)
        types = [set(v) for c, kind, v in self.tests if c == "record_type" and kind == "in"]
        listed = manifest(disk, folder)
        if listed is None:
            found = disk.get_file_info(fs.FileSelector(folder))
            return [Part(f.base_name, 0, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))]
        made = []
        for f in listed:
            ends = [p["start"] for p in f["parts"][1:]] + [f["bytes"]]
            made += [Part(f["name"], p["start"], end) for p, end in zip(f["parts"], ends) if all(t & p["types"].keys() for t in types)]
        return made

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, values in self.tests:
            value = headers.get(HEADERS[column].lower())
            if value is None or not (value in values if kind == "in" else value.startswith(values)):
                return False
        return True

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        disk, folder = store(self.path)
        schema = pa.schema([
            *[(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "payload_digest")], ("payload_length", pa.int64()),
            ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, size = [], 0
        with disk.open_input_file(f"{folder}/{partition.name}") as file:
            for headers, length, payload in records(file, partition, self._wanted, self.payload):
                if self.verify and payload is not None and headers.get("warc-type") == "response":
                    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest != headers.get("warc-payload-digest"):
                        raise ValueError(f"payload of {headers.get('warc-record-id')} does not have its digest")
                row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                rows.append(row | {"payload_length": length, "headers": list(headers.items()), "payload": payload})
                size += len(payload or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _fields(block: bytes) -> dict[str, str]:
    """Header fields by their names in small letters; of a repeated one the last."""
    made = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip():
            made[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return made


class _Plain:
    """Records as they lie in a file without compression; what is not asked for is not read."""

    def __init__(self, file, start: int):
        self.file, self.at = file, start
        self.file.seek(start)

    def head(self) -> bytes:
        data = b""
        while (cut := data.find(b"\r\n\r\n")) < 0:
            more = self.file.read(4096)
            if not more:
                return b""
            data += more
        self.at += cut + 4
        self.file.seek(self.at)
        return data[:cut]

    def body(self, size: int) -> bytes:
        self.file.seek(self.at)
        return self.file.read(size)

    def skip(self, length: int) -> None:
        self.at += length + 4
        self.file.seek(self.at)


class _Gzip:
    """Records as gzip members, inflated only as far as asked for."""

    def __init__(self, file, start: int):
        self.file, self.at = file, start

    def head(self) -> bytes:
        self.file.seek(self.at)
        first = self.file.read(4096)
        if not first:
            return b""
        self.size = None
        if first[3] & 4 and first[12:14] == b"WL":
            self.size = struct.unpack("<I", first[16:20])[0]
        self.inflate, self.rest, self.data, self.used = zlib.decompressobj(31), first, b"", 0
        while (cut := self.data.find(b"\r\n\r\n")) < 0:
            if not self._more(4096):
                return b""
        made, self.data = self.data[:cut], self.data[cut + 4:]
        return made

    def _more(self, most: int) -> bool:
        if self.inflate.eof:
            return False
        if not self.rest:
            self.rest = self.file.read(1 << 16)
            if not self.rest:
                return False
        before = len(self.rest)
        self.data += self.inflate.decompress(self.rest, most)
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.used += before - len(self.rest)
        return True

    def body(self, size: int) -> bytes:
        while len(self.data) < size and self._more(max(size - len(self.data), 1)):
            pass
        return self.data[:size]

    def skip(self, length: int) -> None:
        if self.size is None:  # written by others: the member's end is only known when inflated
            while not self.inflate.eof and self._more(1 << 16):
                self.data = b""
            self.size = self.used
        self.at += self.size


def records(file, part: Part, wanted, payload: bool) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, payload length, payload) of the wanted records of a part.

    A response's payload is what follows its HTTP header. The payload is None if not asked for,
    and for revisits, whose length is the one their HTTP header tells.
    """
    source = (_Gzip if part.name.endswith(".gz") else _Plain)(file, part.start)
    while source.at < part.end:
        head = source.head()
        if not head.strip():
            return
        headers = _fields(head)
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            kind, http = headers.get("warc-type"), headers.get("content-type", "").startswith("application/http")
            if kind == "revisit" or http and not payload:
                size = min(length, 1 << 12)
                while b"\r\n\r\n" not in (block := source.body(size)) and size < length:
                    size = min(length, 4 * size)
                told = _fields(block.partition(b"\r\n\r\n")[0]).get("content-length") if http else None
                yield headers, int(told) if told and told.isdigit() else None, None
            elif payload:
                block = source.body(length)
                body = block.partition(b"\r\n\r\n")[2] if http else block
                yield headers, len(body), body
            else:
                yield headers, length, None
        source.skip(length)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(path)`` and
    ``df.write.format("warc").mode("append").save(path)``; option ``verify`` compares digests."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true") == "true", self.options.get("verify", "false") == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark push filters down to it."""
    ship_package(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Writes a record per row to ``path``.

    Of records with equal payloads of at least ``least`` bytes the one with the largest id is the
    response and the others are revisits of it; all others are responses. Null payloads are empty;
    a null id is smaller than all others, and equal ids are responses together. Payloads are
    compared by SHA-256 and length; only the digests that occur more than once are joined back, so
    payloads are shuffled only if those are too many to broadcast, and then in parts if skewed.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    keyed = base.withColumn("_key", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    groups = keyed.filter(F.col("payload_length") >= least).groupBy(F.col("_key").alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_first")).filter("_n > 1").select("_k", "_first")
    groups = cut_lineage(groups)
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))

    def urn(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    joined = keyed.join(groups, F.col("_key") == F.col("_k"), "left")
    rows = joined.select(
        urn(F.col("_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        base32(F.sha1("payload")).alias("payload_digest"), "payload_length",
        F.when(revisit, urn(F.col("_first"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))
    rows.write.format("warc").mode("append").save(path)


def base32(digest):
    """``sha1:`` and the base32 form of a hexadecimal SHA-1: five digits are four characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(F.lit("sha1:"), *parts)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages in the shared folder and reads the archives back, a row per record.

    Responses are read with their payloads, which must have their digests; revisits are read
    without decoding any payload. An empty table gives no rows; repeated rows are records each for
    itself; other columns are ignored whatever their names.
    """
    spark = pages.sparkSession
    register(spark)
    path = f"{require_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive(pages, path)
    read = spark.read.format("warc")
    full = read.option("verify", "true").load(path).filter(F.col("record_type") == "response")
    full = full.withColumn("payload_length", F.octet_length("payload").cast("long"))
    bare = spark.read.format("warc").option("payload", "false").load(path).filter(F.col("record_type") == "revisit")

    def page(c):
        return F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")

    columns = (page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
               F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return full.select(*columns).unionByName(bare.select(*columns))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
"""
