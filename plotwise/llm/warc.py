"""WARC archives: write, normalise to one gzip member per record with an offset index, read back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import scratch, stored, text_of

CHUNK = 1 << 20
ROLL_BYTES = 64 << 20  # plain bytes after which a task begins another archive
GZIP = 31  # zlib's window setting for gzip members
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FILES = "file string, records long, bytes long"
INDEX = "file string, offset long, length long, record_id string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _opened(path: str):
    system, place = fs.FileSystem.from_uri(path)
    return system, place


def _new_file(folder: str, ending: str):
    """An output stream and its path; the name is new in every attempt of a task."""
    system, place = _opened(folder)
    system.create_dir(place, recursive=True)
    name = f"{uuid.uuid4().hex}{ending}"
    return system.open_output_stream(f"{place}/{name}", compression=None), f"{folder}/{name}"


def record(page_id, url, payload: bytes, sha1: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone and names the record it repeats."""
    block = HTTP if is_revisit else HTTP + payload
    name = "none" if page_id is None else str(page_id)
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{name}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(folder: str, roll_bytes: int):
    """Rows to archives that are each one gzip stream over the whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(batch.page_id, batch.url, batch.html, batch.refers_to, batch.is_revisit):
                if out is None:
                    out, path = _new_file(folder, ".warc.gz")
                    packer, records, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
                payload = html.encode()
                plain = record(None if pd.isna(page_id) else int(page_id), url, payload, digest(payload), None if pd.isna(refers_to) else int(refers_to), bool(revisit))
                out.write(packer.compress(plain))
                records, size = records + 1, size + len(plain)
                if size >= roll_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"file": [path], "records": [records], "bytes": [size]})
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pd.DataFrame({"file": [path], "records": [records], "bytes": [size]})

    return run


def inflated(stream) -> Iterator[bytes]:
    """The plain bytes of a gzip file of any number of members, a piece at a time."""
    unpack = zlib.decompressobj(GZIP)
    while raw := stream.read(CHUNK):
        while raw:
            piece = unpack.decompress(raw, CHUNK)
            if piece:
                yield piece
            raw = unpack.unconsumed_tail
            if unpack.eof:
                raw = unpack.unused_data
                unpack = zlib.decompressobj(GZIP)
    while not unpack.eof and (piece := unpack.decompress(unpack.unconsumed_tail, CHUNK)):
        yield piece


def plain_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream into WARC records by their Content-Length; memory holds one record."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (head := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("the archive ends inside a record head")
                return
        length = int(headers(bytes(held[:head]))["content-length"])
        end = head + 4 + length + 4
        while len(held) < end:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(held[:end])
        del held[:end]


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in pairs}


def normalise(folder: str):
    """Each archive is inflated once; every record becomes a gzip member of its own.

    Beside each new archive stands a .cdx file of offset, length and record id;
    the same lines are the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.file:
                system, place = _opened(path)
                out, new = _new_file(folder, ".warc.gz")
                rows, offset = [], 0
                with system.open_input_stream(place, compression=None) as source, out:
                    for plain in plain_records(inflated(source)):
                        packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = packer.compress(plain) + packer.flush()
                        out.write(member)
                        rows.append((new, offset, len(member), headers(plain[: plain.find(b"\r\n\r\n")])["warc-record-id"]))
                        offset += len(member)
                system, place = _opened(new)
                with system.open_output_stream(place.removesuffix(".warc.gz") + ".cdx", compression=None) as side:
                    side.write("".join(f"{r[1]} {r[2]} {r[3]}\n" for r in rows).encode())
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "record_id"])

    return run


def _page(urn: str):
    name = urn.strip("<>").removeprefix("urn:page:")
    return None if name == "none" else int(name)


def parsed(plain: bytes) -> tuple:
    head, body = plain.split(b"\r\n\r\n", 1)
    h = headers(head)
    revisit = h["warc-type"] == "revisit"
    payload = None if revisit else body[: int(h["content-length"])][len(HTTP) :]
    stated = h["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and digest(payload) != stated:
        raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
    return (_page(h["warc-record-id"]), h["warc-target-uri"], payload, int(h["x-payload-length"]), stated, h["warc-type"], _page(h["warc-refers-to"]) if revisit else None)


def read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index rows to records: each member is read at its offset and inflated alone."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    for batch in batches:
        rows = []
        for path, part in batch.groupby("file", sort=False):
            system, place = _opened(path)
            with system.open_input_file(place) as source:
                for offset, length in zip(part.offset, part.length):
                    rows.append(parsed(zlib.decompress(source.read_at(int(length), int(offset)), GZIP)))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to and is_revisit of each row.

    Payloads are equal when their SHA-256 and length are; of equal ones the row
    with the smallest page_id is the response. The groups travel as digests.
    """
    html = text_of("html")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("_key"))
    first = rows.groupBy("_key").agg(F.min("page_id").alias("_first"))
    rows = rows.join(first, "_key")
    again = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.select("page_id", "url", "html", F.when(again, F.col("_first")).alias("refers_to"), again.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives of all rows below `folder`, each one gzip stream; returns file, records and bytes.

    NULL html is an empty payload; a NULL url becomes urn:page:ID; white space in
    a url is percent-encoded. A NULL page_id is written as none and is a revisit
    where another row has the payload. The manifest names only files of attempts
    that counted, so a repeated task leaves nothing that is read.
    """
    return stored(with_roles(pages).mapInPandas(write_monolithic(f"{folder}/monolithic", roll_bytes), FILES))


def normalise_archives(files: DataFrame, folder: str) -> DataFrame:
    """Record-wise archives and their index: file, offset, length and record_id of every record."""
    spread = files.repartition(max(1, min(files.count(), 4096)), F.xxhash64("file"))
    return stored(spread.mapInPandas(normalise(f"{folder}/members"), INDEX))


def read_archives(index: DataFrame) -> DataFrame:
    """The records that the index lists; payload is NULL for revisits."""
    return index.mapInPandas(read_members, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back `pages`; an empty table gives an empty result.

    NULL html is an empty payload. Rows that repeat a page_id and its payload are
    each a response, as no smaller page_id holds it; pages of any length stream.
    """
    folder = scratch(pages.sparkSession)
    return read_archives(normalise_archives(write_archives(pages, folder), folder))
