"""WARC archives with a two-level capture index.

write_archives() writes one gzip member per record (a warcinfo record heads each file) and returns a manifest. Equal
payloads are stored once: the capture with the smallest page id is the response, the others are revisits that name it.
build_index() sorts the manifest by reversed-host URL key (SURT) into part files of compressed blocks; a part ends with
the directory of its blocks (first key, offset, length), and the top directory holds the first key of each part. There
are at most ``parts`` parts, so only that bounded list is sent to tasks. A lookup searches the top directory, then a
part's directory, by bisection, and reads just the blocks it needs; read_records() then range-reads the records, in
file order, joining neighbouring ranges.

Files are written by tasks to the shared folder under names of their own. The manifest, a table that Spark commits,
says which count, so a task that is lost and run again leaves at most an unnamed file.

Cases: a null payload is an empty one; a null URL has the empty key. A capture without a page id is always a response
and is never referred to. Rows that repeat a page id with one payload are all responses if theirs is the smallest id.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import struct
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store

ROLL_BYTES = 1 << 30
BLOCK_LINES = 1000
JOIN_GAP = 1 << 16
#: Rows of the table of shared payloads up to which it is broadcast (under 10 MB); beyond, the pages are shuffled.
MAX_BROADCAST_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Sort key with the host's labels reversed: com,example,www)/path?query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        parts, host, port = None, "", ""
    if not host:
        return quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
    return f"{','.join(reversed(host.split('.')))}{port})" + quote(rest, safe="!#$%&'()*+,/:;=?@[]~")


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def gzip_member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """Fields of one record: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (None for a revisit)."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    ident = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    digest, full = fields["WARC-Payload-Digest"][5:], fields["WARC-Type"] == "response"
    if full and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the record of page {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": ident(fields.get("WARC-Refers-To")),
        "payload_digest": digest, "payload_bytes": stated, "payload": payload if full else None,
    }


MANIFEST = "key string, page_id long, file string, offset long, length long"
MANIFEST_NAMES = ["key", "page_id", "file", "offset", "length"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], MANIFEST_NAMES)


def write_archives(pages: DataFrame, store: Store, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all captures; the manifest (key, page_id, file, offset, length), committed to the shared folder."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    prints = read.where("page_id is not null").where(F.length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("sha1"))
    shared = prints.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    shared = store.write(shared, "shared-payloads")
    small = shared.count() <= MAX_BROADCAST_ROWS
    joined = read.withColumn("sha1", F.sha1("payload")).join(F.broadcast(shared) if small else shared, "sha1", "left")
    root = store.path("archives")

    def run(batches):
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            rows = []
            for _, page, address, body, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"
                    member = gzip_member(info.encode())
                    out.write(member)
                    at += len(member)
                repeats = first is not None and page is not None and page != first and len(body) >= least_bytes
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                member = gzip_member(record("revisit" if repeats else "response", page, address, body, digest, first))
                out.write(member)
                rows.append((surt(address), page, name, at, len(member)))
                at += len(member)
            yield _rows(rows)
        if out is not None:
            out.close()

    return store.write(joined.select("sha1", "page_id", "url", "payload", "first").mapInArrow(run, MANIFEST), "manifest")


def _order(page_id: int | None) -> int:
    return -(1 << 63) if page_id is None else page_id


def build_index(manifest: DataFrame, store: Store, parts: int = 1024) -> list[tuple[str, int, str]]:
    """Write the index parts; the top directory, one (first key, first page id, file) for each part, sorted."""
    root = store.path("index")
    held = manifest.rdd.getNumPartitions()
    ordered = manifest.repartitionByRange(max(1, min(parts, held)), "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches):
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        name, out, at, directory, lines, top = f"{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def flush():
            nonlocal at, lines
            member = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
            out.write(member)
            directory.append((lines[0][0], _order(lines[0][1] if lines[0][1] != "" else None), at, len(member)))
            at, lines = at + len(member), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, top = fs.open_output_stream(f"{base}/{name}", compression=None), (row[0], _order(row[1]))
                lines.append((row[0], "" if row[1] is None else row[1], *row[2:]))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + struct.pack(">Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([top[0]]), pa.array([top[1]]), pa.array([name])], ["key", "page_id", "file"])

    top = store.write(ordered.mapInArrow(run, "key string, page_id long, file string"), "index-parts")
    return sorted((r.key, r.page_id, r.file) for r in top.collect())  # at most ``parts``


class IndexReader:
    """Bisection from the top directory down to lines; holds the last part's directory and the last block."""

    def __init__(self, root: str, top: list[tuple[str, int, str]]):
        self.fs, self.base = filesystem(root)
        self.top = top
        self.part: tuple[int, list] | None = None
        self.block: tuple[int, int, list] | None = None

    def directory(self, p: int) -> list:
        if not self.part or self.part[0] != p:
            with self.fs.open_input_file(f"{self.base}/{self.top[p][2]}") as f:
                size = f.size()
                length = struct.unpack(">Q", f.read_at(8, size - 8))[0]
                self.part = p, [tuple(x) for x in json.loads(zlib.decompress(f.read_at(length, size - 8 - length)))]
        return self.part[1]

    def lines(self, p: int, b: int) -> list:
        if not self.block or self.block[:2] != (p, b):
            _, _, offset, length = self.directory(p)[b]
            with self.fs.open_input_file(f"{self.base}/{self.top[p][2]}") as f:
                body = zlib.decompress(f.read_at(length, offset)).decode()
            rows = [x.split("\t") for x in body.split("\n")]
            self.block = p, b, [(k, _order(int(i) if i else None), f, int(o), int(n)) for k, i, f, o, n in rows]
        return self.block[2]

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures with this key and page id."""
        want, found = (key, _order(page_id)), []
        # The first line that is not less may follow any number of equal first keys: start one place before them.
        p = max(0, bisect.bisect_left(self.top, (*want, "")) - 1)
        b = max(0, bisect.bisect_left(self.directory(p), (*want, -1, -1)) - 1) if self.top else 0
        while p < len(self.top):
            blocks = self.directory(p)
            while b < len(blocks):
                if blocks[b][:2] > want:
                    return found
                rows = self.lines(p, b)
                i = bisect.bisect_left(rows, (*want, "", -1, -1))
                while i < len(rows) and rows[i][:2] == want:
                    found.append(rows[i][2:])
                    i += 1
                if i < len(rows):
                    return found
                b += 1
            p, b = p + 1, 0
        return found


def locate(asked: DataFrame, store: Store, top: list[tuple[str, int, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(key, page_id, file, offset, length) of the captures that ``asked`` names by URL and page id, by way of the index."""
    root = store.path("index")

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], ["key", "page_id"])

    def run(batches):
        reader = IndexReader(root, top)
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield _rows([(k, i, *hit) for k, i in pairs for hit in (reader.find(k, i) if top else [])])

    wanted = asked.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url")).mapInArrow(keys, "key string, page_id long").distinct()
    # In key order a task reads each block once.
    return wanted.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, MANIFEST)


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def read_records(located: DataFrame, store: Store, payloads: bool = False) -> DataFrame:
    """The records at (file, offset, length), parsed and held against their digests; with ``payload`` (bytes) if asked."""
    root = store.path("archives")
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
    kinds |= {"payload": pa.binary()} if payloads else {}

    def spans(rows):
        """Runs of neighbouring ranges of one file."""
        run, end = [], None
        for row in rows:
            if run and (row[0] != run[0][0] or row[1] - end > JOIN_GAP or row[1] < run[-1][1] or end - run[0][1] > (8 << 20)):
                yield run
                run = []
            run.append(row)
            end = row[1] + row[2]
        if run:
            yield run

    def run(batches):
        fs, base = filesystem(root)
        name, f = None, None
        for batch in batches:
            for near in spans(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                if near[0][0] != name:
                    if f:
                        f.close()
                    name, f = near[0][0], fs.open_input_file(f"{base}/{near[0][0]}")
                low = near[0][1]
                data = io.BytesIO(f.read_at(near[-1][1] + near[-1][2] - low, low)).getbuffer()
                found = [parse(data[o - low : o - low + n]) for _, o, n in near]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in kinds.items()], list(kinds))

    ordered = located.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORD + (", payload binary" if payloads else ""))
