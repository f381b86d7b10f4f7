"""WARC archives: write, normalise a monolithic gzip, and read back by index.

A crawl is first written as whole-file gzip streams, one or more per task. The
normaliser inflates each stream once, front to back, rewrites every record as a gzip
member of its own, and writes a sidecar index of offsets beside it. Readers open an
archive's sidecar and seek to single members by it; what they find must be the records
that the index names, as many as were written. A stream is closed once it has ROLL
bytes, so archives, and the tasks that rewrite and read one each, have a measured size
and grow in number with the crawl. Files are written through the file system of the
shared folder under names that no two task attempts share; a written table of names
says which attempts count, so lost executors and repeated tasks leave no trace in the
result.

Of records with equal payloads of at least LEAST bytes, the one with the largest
page_id is a response, and the others revisit it. Defined cases: null html is an
empty payload; a null url gives an empty target; rows with a null page_id are always
responses; repeated rows each give a record, those of the largest page_id a response;
payloads of any length are archived whole (a long one is held by its task at once);
other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelight.llm.tables import discard, materialise, new_path

#: Bytes from which equal payloads are written once; bytes of a stream after which a task opens the next.
LEAST, ROLL, CHUNK, LEVEL = 1000, 1 << 26, 1 << 20, 1
FILES = "path string, records long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_END = b"\r\n\r\n"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers and leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + _END + body + _END


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(data: bytes) -> dict:
    """Fields of one record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(_END)
    h = _headers(head)
    http, _, payload = rest[: int(h["content-length"])].partition(_END)
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(_headers(http)["content-length"])
    if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {h['warc-record-id']} does not hold the payload that its digest names")
    refers = h.get("warc-refers-to")
    return {"page_id": _page(h["warc-record-id"]), "url": h["warc-target-uri"], "record_type": h["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": None if refers is None else _page(refers)}


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of one whole-file gzip stream, inflated once."""
    inflate, held = zlib.decompressobj(31), bytearray()
    for chunk in chunks:
        while chunk:
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while (gap := held.find(_END, at)) >= 0:
            size = gap + 4 + int(_headers(bytes(held[at:gap]))["content-length"]) + 4
            if size > len(held):
                break
            yield bytes(held[at:size])
            at = size
        del held[:at]
    if held:
        raise ValueError("the stream ends inside a record")


def plan(pages: DataFrame) -> DataFrame:
    """pages with digest, size and refers_to (the response's page_id for revisits).

    Equal payloads are found on digests alone, so a page copied many times moves
    its few columns, never its text, to one place.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    short = rows.select("page_id", "digest", "size").where(F.col("size") >= LEAST)
    keeper = short.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    visits = short.join(keeper, ["digest", "size"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(materialise(visits, "op8-revisits"), ["page_id", "digest"], "left")


def write_streams(rows: DataFrame, folder: str) -> DataFrame:
    """Write planned rows as whole-file gzip streams; path and records of each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path = f"{base}/crawl-{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, n = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                out.write(squeeze.compress(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"])))
                n += 1
                if out.tell() >= ROLL:
                    out.write(squeeze.flush())
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": pa.array([n for _, n in done], pa.int64())}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return materialise(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, FILES), "op8-streams")


def _one_task_each(files: DataFrame) -> DataFrame:
    """Files dealt out so that a task has about one."""
    return files.repartition(max(1, files.count()), "path")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each stream with one gzip member per record, and its index beside it; path and records of each archive.

    The index has a line of JSON per record. A stream is deleted once all are rewritten.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = f"{base}/{source.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{uuid.uuid4().hex}.warc.gz"
                n = at = 0
                with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(path, compression=None) as out, fs.open_output_stream(f"{path}.index") as index:
                    for data in records_of(iter(lambda: stream.read(CHUNK), b"")):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = squeeze.compress(data) + squeeze.flush()
                        out.write(member)
                        index.write((json.dumps({"offset": at, "length": len(member), "record_id": _headers(data[: data.find(_END)])["warc-record-id"]}) + "\n").encode())
                        n, at = n + 1, at + len(member)
                yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if fs.get_file_info(path).type == pafs.FileType.File:  # not yet removed by an earlier attempt
                    fs.delete_file(path)
            yield batch.slice(0, 0)

    archives = materialise(_one_task_each(files).mapInArrow(rewrite, FILES), "op8-archives")
    files.mapInArrow(remove, FILES).write.format("noop").mode("overwrite").save()
    return archives


def index_of(fs: pafs.FileSystem, path: str) -> list[dict]:
    """An archive's sidecar: offset, length and record_id of its records."""
    with fs.open_input_stream(f"{path}.index") as lines:
        return [json.loads(line) for line in lines.read().splitlines()]


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Read the archives' records, each by its own member at the place that the sidecar names."""
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                index = index_of(fs, path)
                if len(index) != n:
                    raise ValueError(f"the index of {path} names {len(index)} records of {n}")
                with fs.open_input_file(path) as file:
                    for k in range(0, n, 1000):
                        rows = []
                        for r in index[k : k + 1000]:
                            rows.append(parse(zlib.decompress(file.read_at(r["length"], r["offset"]), 31)))
                            if _name(rows[-1]["page_id"]) != r["record_id"]:
                                raise ValueError(f"the index of {path} names {r['record_id']} where {_name(rows[-1]['page_id'])} lies")
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))

    return _one_task_each(archives).mapInArrow(load, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, normalise the archives, and read every record back."""
    folder = new_path(pages.sparkSession, "op8-warc")
    streams = write_streams(plan(pages), folder)
    archives = normalise(streams, folder)
    discard(streams)
    return read_records(archives, folder)
