"""Web archives: a writer and a parser of legacy ARC (versions 1 and 2), a converter from ARC to WARC 1.1,
and a reader of WARC.

Archives are gzip files with one member per record, in a shared folder that ``pyarrow.fs`` opens (so any
store it knows). A task writes files under names of its own and returns a manifest; only files of the
manifest are ever read, so what a lost or repeated task left behind is never seen. Files are rolled at
``ROLL_BYTES`` of content or ``ROLL_RECORDS`` records, which bounds what one conversion task holds of its
plan; contents are streamed record by record.

ARC: a version block, then records of a header line (URL, IP, 14-digit date, type, [result code, checksum,
location, offset, file name,] length), so many bytes and a newline. Fields are counted from the left up to the type and from the right
behind it, as a type may hold blanks. The converter follows the declared lengths, never the contents. A line that is no header, and a record
that ends before its length, are set aside (``arc_faults``: file, place, fault); the next header line goes on. It synthesises: WARC-Record-ID as a name-based UUID of digest, date, URL and
place; WARC-Date from the 14 digits; WARC-Type (response, or revisit of the record with the same payload
and the smallest page id); WARC-Payload-Digest, WARC-Block-Digest (SHA-256).

Defined cases: a null html is an empty payload; a null URL becomes ``urn:none``; white space in a URL is
percent-encoded; a null page id is written without the id header, sorts after all ids, and comes back as null;
of records with equal ids and payloads the first in its archive is the response; an empty table writes
no archive; an archive without any record gives none.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checked_broadcast, cut, fresh_path, small_batches

ROLL_BYTES = 64 << 20
ROLL_RECORDS = 20_000
LEVEL = 1
MIN_REVISIT = 100
ID_HEADER = "X-Page-Id"
DATE = "20240101000000"
#: Field names of the two versions' header lines, as the version block states them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def open_file(path: str, mode: str):
    """A stream in whatever store the path names."""
    from pyarrow import fs

    if not urlparse(path).scheme:
        path = f"file://{path}"
    store, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(at.rpartition("/")[0], recursive=True)
        return store.open_output_stream(at, compression=None)
    return store.open_input_file(at)


#: How a gzip member begins; bytes of a line after which it is given away in pieces.
MEMBER, LINE = b"\x1f\x8b\x08", 1 << 20


class Members:
    """Reads a file of gzip members, passing over broken ones; ``read`` and ``readline`` go over their joined contents."""

    def __init__(self, raw, step: int = 1 << 18):
        self.raw, self.step, self.left, self.z = raw, step, b"", zlib.decompressobj(31)
        self.buf, self.at, self.pos, self.broken = b"", 0, 0, 0

    def _more(self) -> bool:
        while True:
            data = self.left or self.raw.read(self.step)
            if not data:
                return False
            self.left = b""
            try:
                out = self.z.decompress(data)
            except zlib.error:  # a broken member: on to where the next begins
                self.broken += 1
                at = data.find(MEMBER, 1)
                self.left, self.z = data[at:] if at > 0 else data[-len(MEMBER) + 1 :] + (self.raw.read(self.step) or b""), zlib.decompressobj(31)
                if at <= 0 and len(self.left) < len(MEMBER):
                    return False
                if at <= 0:
                    at = self.left.find(MEMBER)
                    self.left = self.left[at:] if at >= 0 else self.left
                continue
            if self.z.eof:
                self.left, self.z = self.z.unused_data, zlib.decompressobj(31)
            if out:
                self.buf, self.at = self.buf[self.at :] + out, 0
                return True

    def read(self, n: int) -> bytes:
        parts, have = [], len(self.buf) - self.at
        while have < n:  # whole pieces are set aside, so that a long record is not copied again and again
            parts.append(self.buf[self.at :])
            self.buf, self.at = b"", 0
            n -= have
            if not self._more():
                raise EOFError("a record is shorter than its declared length")
            have = len(self.buf)
        parts.append(self.buf[self.at : self.at + n])
        self.at += n
        out = b"".join(parts)
        self.pos += len(out)
        return out

    def readline(self) -> bytes:
        """b'' at the end."""
        while (end := self.buf.find(b"\n", self.at)) < 0:
            if len(self.buf) - self.at > LINE:  # no header line: given away in pieces
                end = len(self.buf) - 1
                break
            if not self._more():
                end = len(self.buf) - 1
                break
        out = self.buf[self.at : end + 1]
        self.at = end + 1
        self.pos += len(out)
        return out


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roller:
    """Writes members to files of a bounded size and keeps the manifest."""

    def __init__(self, folder: str, head, suffix: str, most_bytes: int, most_records: int):
        self.folder, self.head, self.suffix, self.out, self.done = folder, head, suffix, None, []
        self.most_bytes, self.most_records = most_bytes, most_records

    def put(self, record: bytes) -> None:
        if self.out is None:
            self.path, self.size, self.n = f"{self.folder}/{uuid.uuid4().hex}.{self.suffix}", 0, 0
            self.out = open_file(self.path, "w")
            self.out.write(member(self.head(self.path.rpartition("/")[2])))
        self.out.write(member(record))
        self.size, self.n = self.size + len(record), self.n + 1
        if self.size >= self.most_bytes or self.n >= self.most_records:
            self.close()

    def close(self) -> list[tuple[str, int]]:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.n))
            self.out = None
        return self.done


# -- ARC


def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 tessera\n{ARC_FIELDS[version]}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ") + f"{len(body)}\n"
    return line.encode() + body


def http_block(payload: bytes, page_id) -> bytes:
    own = "" if page_id is None else f"{ID_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_record(version: int, url: str | None, block: bytes, name: str = "-", date: str = DATE) -> bytes:
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:none"
    mid = "" if version == 1 else f"200 - - 0 {name} "
    return f"{url} 0.0.0.0 {date} text/html {mid}{len(block)}\n".encode() + block + b"\n"


def arc_line(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """A header line's fields, None if it is none: a URL, a date of 14 digits and a length must be there."""
    values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    kind = fields.index("Content-type")
    after = len(fields) - kind - 1
    if len(values) < len(fields):
        return None
    left, right = values[:kind], values[len(values) - after :]
    found = dict(zip(fields, [*left, " ".join(values[kind : len(values) - after]), *right], strict=True))
    ok = ":" in found["URL"] and re.fullmatch(r"\d{14}", found["Archive-date"]) and re.fullmatch(r"\d{1,18}", found["Archive-length"])
    return found if ok else None


def parse_arc(f: Members, faults: bool = False) -> Iterator[dict]:
    """Records: the fields of the header line, place (offset of the header line in the contents), block.

    With faults also what is set aside: place, fault. A file without a version block known here is an error.
    """
    first = f.readline()
    while first and not first.strip():
        first = f.readline()
    if not first:
        return
    if not first.startswith(b"filedesc:"):
        raise ValueError("an ARC file begins with a version block")
    block = f.read(int(first.split()[-1]))
    version = int(block.split(b" ", 1)[0])
    fields = block.decode("utf-8", "replace").splitlines()[1].split(" ")
    if fields != ARC_FIELDS.get(version, "").split(" "):
        raise ValueError(f"not a version {version} header: {fields}")
    astray = False
    while True:
        place, line = f.pos, f.readline()
        if not line:
            return
        if not line.strip():
            continue
        found = arc_line(line, fields)
        if found is None:
            if faults and not astray:  # once until the next header line
                yield {"place": place, "fault": "no header line"}
            astray = True
            continue
        astray = False
        try:
            block = f.read(int(found["Archive-length"]))
        except EOFError as e:
            if faults:
                yield {"place": place, "fault": str(e)}
            return
        yield found | {"place": place, "block": block}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def id_of(head: bytes) -> int | None:
    m = re.search(rb"(?im)^" + ID_HEADER.encode() + rb":[ \t]*(-?\d+)\r?$", head)
    return int(m[1]) if m else None


def write_arc(pages: DataFrame, folder: str, version: int = 1) -> DataFrame:
    """Writes pages (page_id, url, html) as ARC files; the manifest: file, records."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Roller(folder, lambda name: arc_head(version, name), "arc.gz", ROLL_BYTES, ROLL_RECORDS)
        for b in batches:
            for page_id, url, html in zip(b.page_id, b.url, b.html, strict=True):
                payload = (html or "").encode()
                out.put(arc_record(version, url, http_block(payload, None if pd.isna(page_id) else page_id)))
        yield pd.DataFrame(out.close(), columns=["file", "records"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return cut(rows.mapInPandas(write, "file string, records long"))


def _per_file(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A partition for each file; the manifest has a row for each 64 MB of archive."""
    n = max(1, manifest.count())
    return manifest.repartition(min(n, 10_000), "file") if n > 1 else manifest


def arc_faults(manifest: DataFrame) -> DataFrame:
    """file, place, fault of what the parser sets aside."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b.file:
                with open_file(file, "r") as raw:
                    rows = [(file, r["place"], r["fault"]) for r in parse_arc(Members(raw), faults=True) if "fault" in r]
                yield pd.DataFrame(rows, columns=["file", "place", "fault"])

    small_batches(manifest.sparkSession)
    return _per_file(manifest.sparkSession, manifest).mapInPandas(scan, "file string, place long, fault string")


def arc_index(manifest: DataFrame) -> DataFrame:
    """file, place, page_id, payload_bytes, payload_digest of each ARC record, and the url, date and id of its WARC record."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b.file:
                with open_file(file, "r") as raw:
                    rows = []
                    for r in parse_arc(Members(raw)):
                        head, payload = split_http(r["block"])
                        digest, url, date = hashlib.sha256(payload).hexdigest(), r["URL"], warc_date(r["Archive-date"])
                        rows.append((file, r["place"], id_of(head), len(payload), digest, url, date, record_id(digest, date, url, file.rpartition("/")[2], r["place"])))
                yield pd.DataFrame(rows, columns=["file", "place", "page_id", "payload_bytes", "payload_digest", "url", "date", "id"]).astype({"page_id": "Int64"})

    return _per_file(manifest.sparkSession, manifest).mapInPandas(scan, "file string, place long, page_id long, payload_bytes long, payload_digest string, url string, date string, id string")


# -- WARC


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_date(digits: str) -> str:
    d = (digits + "00000101000000"[len(digits) :]) if len(digits) < 14 else digits[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", warc_date(DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


def parse_warc(f: Members) -> Iterator[dict]:
    """Records: their header fields in lower case, and block."""
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {f.pos}")
        head = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head | {"block": f.read(int(head["content-length"]))}


def converted(record: dict, file: str, first: dict | None) -> bytes:
    """An ARC record as a WARC record; first: what a revisit refers to (page_id, url, date, id of the first record with that payload)."""
    head, payload = split_http(record["block"])
    digest = hashlib.sha256(payload).hexdigest()
    url, date = record["URL"], warc_date(record["Archive-date"])
    block = head if first else record["block"]
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", record_id(digest, date, url, file, record["place"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if first:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", first["id"]), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"]),
            ("X-Refers-To-Page-Id", str(first["page_id"])), ("X-Payload-Length", str(len(payload))),
        ]
    return warc_record(fields, block)


def revisit_plan(index: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """file, revisits: per ARC file the places of its revisits with what they refer to, as JSON rows.

    Firsts are found with partial minima before the shuffle; a group of copies never meets in one task.
    """
    big = index.where(F.col("payload_bytes") >= min_bytes)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "place", "url", "date", "id")
    firsts = big.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = checked_broadcast(cut(firsts))
    later = big.join(firsts, "payload_digest").where((F.col("first.file") != F.col("file")) | (F.col("first.place") != F.col("place")))
    return later.groupBy("file").agg(F.collect_list(F.struct("place", "first.page_id", "first.url", "first.date", "first.id")).alias("revisits"))


def arc_to_warc(manifest: DataFrame, folder: str, index: DataFrame | None = None, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Converts the manifest's ARC files, each for itself; the new manifest: file, records."""
    index = index if index is not None else cut(arc_index(manifest))
    todo = manifest.select("file").join(revisit_plan(index, min_bytes), "file", "left").select("file", F.to_json("revisits").alias("revisits"))

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = Roller(folder, warc_info, "warc.gz", ROLL_BYTES, ROLL_RECORDS)
            for file, plan in zip(b.file, b.revisits, strict=True):
                again = {r["place"]: {"page_id": None} | r for r in json.loads(plan or "[]")}
                with open_file(file, "r") as raw:
                    for r in parse_arc(Members(raw)):
                        out.put(converted(r, file.rpartition("/")[2], again.get(r["place"])))
            yield pd.DataFrame(out.close(), columns=["file", "records"])

    return cut(_per_file(manifest.sparkSession, cut(todo)).mapInPandas(convert, "file string, records long"))


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, date, record_id, record_type, payload_bytes, payload_digest, refers_to [, payload].

    Payloads of responses are hashed again and held against their header; revisits carry theirs in the header.
    """
    schema = "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            for file in b.file:
                rows, size = [], 0
                with open_file(file, "r") as raw:
                    for r in parse_warc(Members(raw)):
                        if (kind := r["warc-type"]) not in ("response", "revisit"):
                            continue
                        head, payload = split_http(r["block"])
                        digest = r["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{file}: payload and digest of {r['warc-record-id']} differ")
                        refers = r.get("x-refers-to-page-id")
                        n = len(payload) if kind == "response" else int(r["x-payload-length"])
                        row = (id_of(head), r["warc-target-uri"], r["warc-date"], r["warc-record-id"], kind, n, digest, None if refers in (None, "None") else int(refers))
                        rows.append(row + ((payload if kind == "response" else None),) * with_payload)
                        size += len(payload) * with_payload
                        if size > ROLL_BYTES // 8:
                            yield pd.DataFrame(rows, columns=cols).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=cols).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _per_file(manifest.sparkSession, manifest).mapInPandas(read, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, version: int = 1, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages to ARC, ARC to WARC; the WARC manifest."""
    folder = folder or fresh_path(pages.sparkSession, "archives")
    return arc_to_warc(write_arc(pages, f"{folder}/arc", version), f"{folder}/warc", min_bytes=min_bytes)
