"""WARC archives: written from pages, read back by a sequential reader.

Writing: one gzip member per record, files rolled at a bounded size. Of records with equal payloads
the one with the largest page id is a ``response``; the others are ``revisit`` records that name it
and carry its digest and the header block, without the payload. A task writes under a name of its own
try, and only names that reach the committed manifest (a Parquet table) count, so a lost or repeated
task leaves at most a file that nothing reads.

Reading: a file is read front to back in pieces of some kilobytes. zlib inflates one member after the
other; inside a record the header ends at the blank line, and ``Content-Length`` frames the block,
which is hashed as it arrives. A reader holds one header and one piece, whatever the payload's size,
unless payloads are asked for. Every record is verified: framing, block digest, and payload digest
and length (of revisits: those that it repeats). A record that fails is an error.

Null html is an empty payload; a null page id stays null and counts as the smallest; a null url gives
a record without target. Blanks and control characters of urls are percent-encoded. Rows that repeat a
page id with its payload are one capture, written as often as they occur, of one type and, as
responses, with one record id. An empty table gives an empty manifest and no rows. Extra columns are not read. Payloads count as equal where length and SHA-256 agree. Files are opened
through ``pyarrow.fs``, which knows local paths and the common remote ones.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import scratch_path

from .common import bounded, col, ship_package, written

FILE_BYTES = 256 << 20
PIECE = 64 << 10
SALTS = 16
MOST_TASKS = 20_000

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
END = b"\r\n\r\n"


def base32_sha1(data) -> str:
    return base64.b32encode(data.digest() if hasattr(data, "digest") else hashlib.sha1(data).digest()).decode()


# -- writing -----------------------------------------------------------------------


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return fs, path


def _safe(value: str) -> str:
    """A header value on one line, without blanks that a reader would trim."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _header(kind: str, fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}"]
    lines += [f"{k}: {v}" for k, v in fields if v is not None]
    lines += [f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def member(kind: str, fields: list[tuple[str, str | None]], block: tuple[bytes, ...]) -> bytes:
    """One record as one gzip member; block and block digest included."""
    digest = hashlib.sha1()
    for part in block:
        digest.update(part)
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(digest)}")]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = [pack.compress(_header(kind, fields, sum(map(len, block))))]
    out += [pack.compress(part) for part in block]
    out += [pack.compress(END), pack.flush()]
    return b"".join(out)


def record(row: dict, date: str) -> bytes:
    """A page's record: ``page_id``, ``url``, ``payload``, ``key`` (hex digest), and the response that it
    repeats, ``first_id`` and ``first_url`` where ``repeats``."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    # A payload has one capture as response, so its digest names that record.
    response = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row['key'])}>"
    url = None if row["url"] is None else _safe(row["url"])
    shared = [("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", HTTP), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
              ("X-Page-ID", row["page_id"])]
    if not row["repeats"]:
        return member("response", [("WARC-Record-ID", response), *shared], (http, payload))
    first = None if row["first_url"] is None else _safe(row["first_url"])
    refers = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Profile", REVISIT), ("WARC-Refers-To", response),
              ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", row["first_id"])]
    return member("revisit", [*refers, *shared], (http,))


def _writer(root: str, date: str, file_bytes: int):
    def run(batches):
        fs, folder = _opened(root)
        fs.create_dir(folder, recursive=True)
        manifest = []
        out = name = None
        size = records = 0

        def close():
            out.close()
            manifest.append((name, records, size))

        for batch in batches:
            # One row at a time is turned into Python objects.
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    info = member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                               ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                                  (b"software: lectern\r\nformat: WARC File Format 1.1\r\n",))
                    out.write(info)
                    size, records = len(info), 0
                data = record(row, date)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        parts = list(zip(*manifest, strict=True)) if manifest else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.int64())], ["file", "records", "bytes"]
        )

    return run


def with_first(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Page id (as text), url, payload, its digest ``key``, whether the row ``repeats`` a response, and that
    response's id and url.

    Only payloads with several page ids are joined, and a payload of many rows meets its entry under
    several salts. The join takes the few columns of the entries to the pages, by broadcast while
    their counted size allows it.
    """
    rows = pages.select(
        col("page_id").cast("string").alias("page_id"),
        col("page_id").alias("order_id"),
        col("url").cast("string").alias("url"),
        F.coalesce(col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("key", F.concat_ws("-", F.sha2("payload", 256), F.octet_length("payload").cast("string")))
    groups = (
        rows.where(F.octet_length("payload") >= at_least)
        .groupBy("key")
        .agg(
            F.max(F.struct(F.col("order_id").isNotNull().alias("known"), "order_id", "url", "page_id")).alias("first"),
            F.min("order_id").alias("least"),
            F.count("*").alias("n"),
            F.count("order_id").alias("n_known"),
        )
        .where((F.col("least") < F.col("first.order_id")) | ((F.col("n_known") > 0) & (F.col("n_known") < F.col("n"))))
        .select("key", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    spread = written(groups, "warc-groups").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        .join(bounded(spread, 400), ["key", "salt"], "left")
        .withColumn("repeats", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
        .select("page_id", "url", "payload", "key", "repeats", "first_id", "first_url")
    )


def write(pages: DataFrame, root: str | None = None, at_least: int = 0, file_bytes: int = FILE_BYTES, date: str | None = None) -> str:
    """Write one record per page into archives under ``root`` (a new shared folder if not given), which is
    returned. Its table ``manifest`` lists the files that count: name, pages, bytes."""
    spark = pages.sparkSession
    ship_package(spark)
    root = root or scratch_path(spark, "llm-warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    marked = with_first(pages, at_least)
    marked.mapInArrow(_writer(root, date, file_bytes), "file string, records bigint, bytes bigint").write.parquet(f"{root}/manifest")
    return root


# -- reading -----------------------------------------------------------------------


class Inflated:
    """The members of a gzip file one after the other, inflated piece by piece."""

    def __init__(self, read, piece: int = PIECE):
        self._read, self._piece, self._rest = read, piece, b""

    def next_member(self) -> bool:
        self._rest = self._rest or self._read(self._piece)
        self._z = zlib.decompressobj(31)
        return bool(self._rest)

    def more(self) -> bytes:
        """The next bytes of the member; none at its end."""
        while not self._z.eof:
            self._rest = self._rest or self._read(self._piece)
            fed = bool(self._rest)
            out = self._z.decompress(self._rest, self._piece)
            self._rest = self._z.unused_data if self._z.eof else self._z.unconsumed_tail
            if out:
                return out
            if not fed and not self._z.eof:
                raise ValueError("archive ends inside a member")
        return b""


class Framed:
    """Exact reads from the bytes of one member."""

    def __init__(self, inflated: Inflated):
        self._more, self._held = inflated.more, b""

    def until(self, mark: bytes, most: int) -> bytes:
        """Everything up to and with ``mark``."""
        while (at := self._held.find(mark)) < 0:
            more = self._more()
            if not more or len(self._held) > most:
                raise ValueError("record without the end of its header")
            self._held += more
        out, self._held = self._held[: at + len(mark)], self._held[at + len(mark) :]
        return out

    def pieces(self, length: int) -> Iterator[bytes]:
        """Exactly ``length`` bytes."""
        while length:
            piece = self._held or self._more()
            if not piece:
                raise ValueError("record shorter than its Content-Length")
            out, self._held = piece[:length], piece[length:]
            length -= len(out)
            yield out

    def rest(self) -> bytes:
        """What is left of the member, a piece at most beyond what is expected."""
        out = self._held
        while len(out) <= len(END) and (more := self._more()):
            out += more
        return out


_HEADER_BYTES = 1 << 20


def _fields(header: bytes) -> tuple[str, dict[str, str]]:
    """First line, and fields by lower-case name; folded lines are joined."""
    lines = header.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return lines[0], fields


def read_records(read, keep: bool = False) -> Iterator[dict]:
    """Records of an archive, in order: type, fields, payload length and digest, and the payload if it is
    to be kept. ``read(n)`` gives up to n bytes of the file. A record that is not as it says it is raises."""
    inflated = Inflated(read)
    while inflated.next_member():
        member = Framed(inflated)
        first, fields = _fields(member.until(END, _HEADER_BYTES))
        if not first.startswith("WARC/") or "content-length" not in fields:
            raise ValueError(f"not a record: {first[:40]!r}")
        length, kind = int(fields["content-length"]), fields.get("warc-type", "")
        block, payload = hashlib.sha1(), hashlib.sha1()
        http: dict[str, str] = {}
        head, size, held = b"", 0, []
        inside = not fields.get("content-type", "").startswith("application/http")
        for piece in member.pieces(length):
            block.update(piece)
            if not inside:
                head += piece
                at = head.find(END)
                if at < 0:
                    if len(head) > _HEADER_BYTES:
                        raise ValueError("response without the end of its header")
                    continue
                http, piece, head, inside = _fields(head[:at])[1], head[at + len(END) :], b"", True
            payload.update(piece)
            size += len(piece)
            if keep:
                held.append(piece)
        if member.rest() != END:
            raise ValueError("record does not end where its Content-Length says")
        name = fields.get("warc-record-id")
        _verify(fields.get("warc-block-digest"), block, f"block of {name}")
        said = fields.get("warc-payload-digest")
        if kind == "revisit":
            size = int(http.get("content-length", 0))
        else:
            _verify(said, payload, f"payload of {name}")
            if "content-length" in http and int(http["content-length"]) != size:
                raise ValueError(f"payload of {name} has {size} bytes, not {http['content-length']}")
        digest = said.partition(":")[2] if said else base32_sha1(payload)
        yield {"type": kind, "fields": fields, "payload_bytes": size, "payload_digest": digest, "payload": b"".join(held) if keep else None}


def _verify(said: str | None, found, what: str) -> None:
    if said and said.startswith("sha1:") and said[5:] != base32_sha1(found):
        raise ValueError(f"digest of the {what} is {base32_sha1(found)}, not {said[5:]}")


_READ = (
    "page_id string, target_uri string, record_type string, payload_bytes bigint, payload_digest string,"
    " refers_to string, record_id string, payload binary"
)
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
_ROWS_A_BATCH = 1000


def _reader(root: str, keep: bool):
    most = 1 if keep else _ROWS_A_BATCH

    def run(batches):
        fs, folder = _opened(root)
        rows: list[tuple] = []

        def out():
            parts = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
            return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, _KINDS, strict=True)], _READ_NAMES)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for r in read_records(stream.read, keep):
                        if r["type"] not in ("response", "revisit"):
                            continue
                        f = r["fields"]
                        rows.append((f.get("x-page-id"), f.get("warc-target-uri"), r["type"], r["payload_bytes"], r["payload_digest"],
                                     f.get("x-refers-to-page-id"), f.get("warc-record-id"), r["payload"]))
                        if len(rows) >= most:
                            yield out()
                            rows = []
        yield out()

    return run


_READ_NAMES = [f.split()[0] for f in _READ.split(", ")]


def read(spark: SparkSession, root: str, payload: bool = False) -> DataFrame:
    """One row per response or revisit record in the archives under ``root``; payloads only if asked for."""
    ship_package(spark)
    files = spark.read.schema("file string, records bigint, bytes bigint").parquet(f"{root}/manifest").select("file")
    # About a file a task: the names are few bytes, which says nothing about the files.
    dealt = files.repartitionByRange(min(max(1, files.count()), MOST_TASKS), "file")
    return dealt.mapInArrow(_reader(root, payload), _READ)


def round_trip(pages: DataFrame, at_least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages written into archives and what a reader finds there: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    kind = pages.schema["page_id"].dataType
    found = read(pages.sparkSession, write(pages, at_least=at_least, file_bytes=file_bytes))
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               cast(((cast('0x' || hex[5 * (i // 4) + 1:5 * (i // 4) + 5] AS bigint) >> (15 - 5 * (i % 4))) & 31) + 1 AS integer), 1)
                        for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
"""
