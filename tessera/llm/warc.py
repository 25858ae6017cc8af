"""WARC archives as a Python data source.

Writing.  One record per row; a task rolls to a new file at ``max_bytes``.  Each
record is two gzip members (its headers, its payload), and the first names the
record's compressed size in an extra field, so a reader can pass a payload
without inflating it; any gzip reader sees one plain stream.  Files become part
of the archive when the job commits: the driver then writes a manifest of them,
and what failed or doubled attempts have left behind is never read.

Reading.  Partitions are planned by file (small files together).  Filters on
record_type, page_id, url and payload_digest are pushed down and applied to the
parsed headers; payloads of records that don't pass are skipped, as are all
payloads with option payload = skip.  ``payload = digest`` decodes payloads
and returns their size and digest only, checked against the header.

Edge cases: null html is an empty payload; a null url is left out of the record
and read as null; control characters in a url are percent-encoded; a null
page_id has the record id "null"; rows repeating a page_id and payload that own
the payload are responses all; an empty table gives an archive without records;
extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from tessera.llm.common import bound_arrow, scratch, table

SCHEMA = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "_manifest-"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -------------------------------------------------------------------- writing


def _member(data: bytes, level: int, extra: bytes = b"") -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08" + (b"\x04" if extra else b"\0") + b"\0\0\0\0\0\xff" + (struct.pack("<H", len(extra)) + extra if extra else b"") + z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> bytes:
    """The compressed bytes of a record; a revisit leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n" + http
    tail = _member(body + b"\r\n\r\n", level)
    first = len(_member(head, level, b"TS\x08\0" + bytes(8)))
    return _member(head, level, b"TS\x08\0" + struct.pack("<II", first, first + len(tail))) + tail


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.max_bytes = options["path"].rstrip("/"), int(options.get("max_bytes", 64 << 20))

    def write(self, iterator) -> _Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        out, files, size, name = None, [], 0, ""
        for batch in iterator:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")]
            for page_id, url, html, refers_to, revisit in zip(*cols, strict=True):
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                raw = record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"", refers_to.as_py(), bool(revisit.as_py()))
                out.write(raw)
                size += len(raw)
                if size >= self.max_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{_MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                fs.delete_file(f"{root}/{name}")


# -------------------------------------------------------------------- reading


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        super().__init__(None)
        self.names = names


def _inflate(raw: bytes, at: int = 0) -> tuple[bytes, int]:
    """The member at ``at`` and where the next one begins."""
    z = zlib.decompressobj(31)
    data = z.decompress(raw[at:]) + z.flush()
    if not z.eof:
        raise ValueError("a gzip member is cut short")
    return data, len(raw) - len(z.unused_data)


def headers(head: bytes) -> dict[str, str]:
    """Fields of a block of header lines, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(value: str | None):
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _passes(row: dict, tests) -> bool:
    for name, kind, value in tests:
        x = row[name]
        if kind == "notnull":
            if x is None:
                return False
        elif x is None or not {"=": lambda: x == value, "in": lambda: x in value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value}[kind]():
            return False
    return True


class _Reader(DataSourceReader):
    COLUMNS = ("record_type", "page_id", "url", "payload_digest")
    KINDS = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "notnull"}

    def __init__(self, options: dict) -> None:
        self.path, self.payload, self.tests = options["path"].rstrip("/"), options.get("payload", "keep"), []
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in self.KINDS and len(f.attribute) == 1 and f.attribute[0] in self.COLUMNS:
                self.tests.append((f.attribute[0], self.KINDS[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = _fs(self.path)
        files = []
        for x in fs.get_file_info(pafs.FileSelector(root)):
            if x.base_name.startswith(_MANIFEST):
                with fs.open_input_stream(x.path) as f:
                    files += json.loads(f.read())
        parts, names, size = [], [], 0
        for name, n in sorted(files):
            if names and size + n > self.partition_bytes:
                parts.append(_Files(names))
                names, size = [], 0
            names.append(name)
            size += n
        return [*parts, _Files(names)]

    def read(self, partition):
        fs, root = _fs(self.path)
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(f"{root}/{name}") as f:
                for row in self._records(f):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def _records(self, f):
        """Headers first; a payload only where it is wanted."""
        end, at, base, held = f.size(), 0, 0, b""

        def need(start: int, n: int) -> bytes:
            nonlocal base, held
            if start < base or start + n > base + len(held):
                f.seek(start)
                base, held = start, f.read(max(n, min(1 << 20, end - start)))
            if start + n > base + len(held):
                raise ValueError("the archive is cut short")
            return held[start - base : start - base + n]

        while at < end:
            fixed = need(at, 24)
            if fixed[:4] != b"\x1f\x8b\x08\x04" or fixed[12:16] != b"TS\x08\0":
                raise ValueError("a record without its sizes")
            first, whole = struct.unpack("<II", fixed[16:24])
            head, _ = _inflate(need(at, first))
            warc, _, http = head.partition(b"\r\n\r\n")
            h = headers(warc)
            row = {"page_id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "refers_to": _page(h.get("warc-refers-to")), "payload_bytes": int(headers(http)["content-length"]), "payload": None}
            if _passes(row, self.tests):
                if self.payload != "skip" and row["record_type"] == "response":
                    payload = _inflate(need(at + first, whole - first))[0][:-4]
                    if self.payload == "digest":
                        if row["payload_digest"] != digest(payload):
                            raise ValueError("a payload doesn't match its digest")
                        row["payload_bytes"] = len(payload)
                    else:
                        row["payload"] = payload
                yield row
            at += whole


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bound_arrow(spark)


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive pages (page_id, url, html).  Of rows with equal payloads of at least
    ``least`` bytes, that of the largest page_id is the response; the others
    revisit it.  Owners are pre-aggregated by digest; a hot digest is a skewed
    join, which AQE splits."""
    register(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("sha1"))
    owner = own.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = own.join(owner, "sha1", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    rows.select("page_id", "url", "html", F.when(revisit, F.col("owner")).alias("refers_to"), revisit.alias("revisit")).write.format("tessera_warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: str = "keep") -> DataFrame:
    """The records under path; payload: keep, digest or skip."""
    register(spark)
    return spark.read.format("tessera_warc").option("payload", payload).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: archive all pages, read the archives back, with payloads checked."""
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHARS = " || ".join(f"substr('{_ALPHABET}', CAST((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {s}) & 31 AS INTEGER) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p JOIN o USING (h)
"""
