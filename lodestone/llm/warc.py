"""WARC archives: written by Spark's text sink, read by a Python data source.

Writer: one record per row, payload digests and revisits decided from digests.  A text row is a whole record; the line
separator of the sink is the record terminator of the format.  Groups of equal payloads are broadcast up to a checked
number; beyond it rows are joined with them by a shuffle, in which Spark splits a digest that many rows share.
Reader: one partition per group of files, record-type and header predicates pushed down; headers are parsed first and
the bytes of unwanted payloads are skipped by seeking, neither read nor decoded.  Members of gzip files have to be inflated
to be skipped, but are not kept.  Paths may have the schemes that pyarrow knows, s3a and s3n count as s3, and others go to
fsspec where it is installed.

Null html is the empty payload.  Rows that repeat the smallest id of a payload are all responses (and share a record id, as
ids name pages).  A null id counts as the largest.  An empty table gives an archive without records.  Payloads of any
length are written and read whole; payloads and headers that are not UTF-8 are read with replacement characters, digests
and sizes being of the bytes.  Only the id, url and html columns are written, so others may have any name.  Records of
other writers are read too: page_id and refers_to are null where the record id names no page, record_id has it as it is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import fresh_path

EOL, END = "\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
BROADCAST_GROUPS = 500_000
PARTITION_BYTES = 64 << 20
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string, record_id string"
FIRST_READ = 2048


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1, from hex five digits (four base-32 digits) at a time."""
    hexed = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest and refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html.cast("binary")).alias("payload_digest"))
    groups = (
        known.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1 and first_id is not null")
        .drop("copies")
    )
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    later = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    return known.join(groups, ["payload_digest", "payload_bytes"], "left").withColumn("refers_to", F.when(later, F.col("first_id"))).drop("first_id")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One column, value: the text of a record without its terminator."""
    df = with_revisits(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    parts = [
        F.lit("WARC/1.0" + EOL + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(EOL + "WARC-Record-ID: "),
        named(F.col("page_id")),
        F.lit(EOL + "WARC-Date: " + DATE),
        F.when(url.isNotNull(), F.concat(F.lit(EOL + "WARC-Target-URI: "), url)).otherwise(""),
        F.lit(EOL + "WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(EOL + "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + EOL + "WARC-Refers-To: "), named(F.col("refers_to")))).otherwise(""),
        F.lit(EOL + "Content-Type: application/http; msgtype=response" + EOL + "Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    ]
    return df.select(F.concat(*parts).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    records(slim, min_bytes).write.option("lineSep", END).text(path)
    return path


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    """Columns are those of SCHEMA.  Option payload=false leaves payloads out, verify=true checks digests."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.size = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        #: Column to the values that are wanted; records with others are skipped unread.
        self.wanted: dict[str, set] = {k: set(v) for k, v in json.loads(options.get("where", "{}")).items()}

    def _store(self):
        from pyarrow import fs

        uri = re.sub(r"^s3[an]:", "s3:", self.path) if re.match(r"\w+:", self.path) else f"file://{self.path}"
        try:
            return fs.FileSystem.from_uri(uri)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            import fsspec

            store, base = fsspec.core.url_to_fs(self.path)
            return fs.PyFileSystem(fs.FSSpecHandler(store)), base

    def partitions(self):
        from pyarrow import fs

        store, base = self._store()
        infos = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=False))
        groups, room = [[]], self.size
        for i in sorted((x for x in infos if x.is_file and x.size and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            if groups[-1] and i.size > room:
                groups.append([])
                room = self.size
            groups[-1].append(i.path)
            room -= i.size
        return [_Files(g) for g in groups if g] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = self._store()
        for name in partition.files:
            with store.open_input_file(name) as f:
                packed = f.read(2) == b"\x1f\x8b"
                yield from self._members(f) if packed else self._records(f)

    def _records(self, f) -> Iterator[tuple]:
        """Records of an open file.  Of unwanted ones only what holds the header is read."""
        at, end = 0, f.size()
        while at < end:
            chunk, want = b"", FIRST_READ
            while (cut := chunk.find(b"\r\n\r\n")) < 0:
                if at + len(chunk) >= end:
                    if not chunk.strip():
                        return
                    raise ValueError(f"record at byte {at} has no end of header")
                f.seek(at + len(chunk))
                chunk += f.read(want)
                want *= 2
            head = self._head(chunk[:cut], at)
            body, length = at + cut + 4, int(head["content-length"])

            def block(upto: int, body: int = body, length: int = length, have: bytes = chunk[cut + 4 :]) -> bytes:
                """The first bytes of the record's block; what was read with the header is not read again."""
                upto = min(upto, length)
                if upto <= len(have):
                    return have[:upto]
                f.seek(body + len(have))
                return have + f.read(upto - len(have))

            yield from self._wanted(head, block, length, body)
            at = body + length + 4

    def _members(self, f) -> Iterator[tuple]:
        """Records of a gzip file, one to a member: inflated as far as needed, then to its end without being kept."""
        f.seek(0)
        left = b""
        while left or (left := f.read(1 << 16)):
            inflate = zlib.decompressobj(31)
            data = b""

            def grow(upto: int) -> None:
                """Inflate until data has so many bytes, or the member ends."""
                nonlocal data, left
                while len(data) < upto and not inflate.eof:
                    if not left and not (left := f.read(1 << 16)):
                        raise ValueError("a gzip member has no end")
                    data += inflate.decompress(left, 1 << 16)
                    left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail

            while (cut := data.find(b"\r\n\r\n")) < 0 and not inflate.eof:
                grow(len(data) + FIRST_READ)
            if cut >= 0:
                head, length = self._head(data[:cut], 0), None
                length = int(head["content-length"])

                def block(upto: int, cut: int = cut, length: int = length) -> bytes:
                    grow(cut + 4 + min(upto, length))
                    return data[cut + 4 : cut + 4 + min(upto, length)]

                yield from self._wanted(head, block, length, 0)
            while not inflate.eof:
                data = b""
                grow(1 << 16)

    @staticmethod
    def _head(raw: bytes, at: int) -> dict:
        lines = raw.decode("utf-8", "replace").lstrip(EOL).split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head, key = {}, ""
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and key:  # a folded header
                head[key] = f"{head[key]} {line.strip()}".strip()
                continue
            key, _, value = line.partition(":")
            key = key.strip().lower()
            head[key] = value.strip()
        return head

    def _wanted(self, head: dict, block: Callable[[int], bytes], length: int, at: int) -> Iterator[tuple]:
        """The record's row, if its header passes the predicates."""
        row = self._row(head)
        if not all(row[k] in v for k, v in self.wanted.items()):
            return
        text, size = None, None
        data, http, upto = b"", -1, FIRST_READ
        if head.get("content-type", "").startswith("application/http"):
            while http < 0 and len(data) < min(length, upto):  # an HTTP header of any length
                data = block(upto)
                http = data.find(b"\r\n\r\n")
                upto *= 4
            if m := re.search(rb"(?im)^content-length:\s*(\d+)", data[: max(http, 0)]):
                size = int(m[1])
            http += 4 if http >= 0 else 1
        else:
            http, size = 0, length
        if row["record_type"] != "revisit" and (self.payload or self.verify):
            data = block(length)[http:]
            size = len(data)
            if self.verify and row["payload_digest"] and base64.b32encode(hashlib.sha1(data).digest()).decode() != row["payload_digest"]:
                raise ValueError(f"digest of the payload at byte {at} differs")
            text = data.decode("utf-8", "replace") if self.payload else None
        yield (row["page_id"], row["url"], row["record_type"], size, row["payload_digest"], row["refers_to"], text, head.get("warc-record-id"))

    @staticmethod
    def _row(head: dict) -> dict:
        def number(urn: str | None) -> int | None:
            m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
            return int(m[1]) if m else None

        return {"page_id": number(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": number(head.get("warc-refers-to"))}


class PushingReader(WarcReader):
    """Takes equality and membership filters of the query too.

    Spark keeps what was pushed with the DataFrame that was read, and a later query of the same DataFrame without filters
    would see it; so this reader is for DataFrames that serve one query, and has to be asked for (pushdown=true).
    """

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("record_type", "page_id", "url", "payload_digest"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return (PushingReader if str(self.options.get("pushdown", "false")).lower() == "true" else WarcReader)(self.options)


def read_warc(spark: SparkSession, path: str, where: dict[str, list] | None = None, **options) -> DataFrame:
    """Records of an archive.  where: wanted values of record_type, page_id, url or payload_digest, applied to headers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("path", path).option("where", json.dumps(where or {}))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower())
    return reader.load()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write an archive of pages into the shared folder and read it back: responses with their digests checked, revisits by headers alone.

    Both are read by pushed predicates on the record type, so the payloads of responses are skipped where revisits are read.
    """
    path = write_warc(pages, fresh_path(pages.sparkSession, "warc"), min_bytes)
    full = read_warc(pages.sparkSession, path, {"record_type": ["response"]}, payload=False, verify=True)
    again = read_warc(pages.sparkSession, path, {"record_type": ["revisit"]}, payload=False)
    return full.union(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
