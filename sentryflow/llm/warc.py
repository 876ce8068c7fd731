"""WARC archives: writing, normalising to one gzip member a record, and reading by offset.

``write_archives`` writes each partition as monolithic archives, each a single
gzip stream of records that is closed at ``ARCHIVE_BYTES``.  ``normalise`` inflates such a stream once, in
chunks, rewrites every record as a gzip member of its own, and writes a sidecar
index of (record id, offset, length).  ``read_archives`` opens members by the
index alone.

Payloads of at least ``min_bytes`` that are equal are stored once: the record
with the smallest page_id is a response, the others are revisits that refer to
it and carry its payload's digest and length but not the payload.

Defined cases: a null html is the empty payload; a null page_id is always a
response and is never referred to; rows that repeat both page_id and payload
are responses like the first; a very long html is one record, held in memory alone;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, functions as F

from sentryflow.llm.files import open_dir
from sentryflow.staging import new_path, staged

MIN_BYTES = 100
#: Compressed size at which an archive is closed and the next one begun.
ARCHIVE_BYTES = 1 << 30
_CHUNK = 1 << 20
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; the payload is left out where it refers to another."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    key = f"{page_id}:{hashlib.sha256((url or '').encode('utf-8', 'replace')).hexdigest()}:{digest}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"X-Target-Url: {json.dumps(url)}")
    if refers_to is not None:
        head += [f"X-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("ascii").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(chunks):
    """Byte chunks of an inflated archive to whole records, one at a time."""
    buf = bytearray()
    need, head_end = None, 0
    for chunk in chunks:
        buf += chunk
        while True:
            if need is None:
                at = buf.find(b"\r\n\r\n", max(0, head_end - 3))
                if at < 0:
                    head_end = len(buf)
                    break
                need = at + 4 + int(parse_head(bytes(buf[:at]))["content-length"]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need, head_end = None, 0
    if buf:
        raise ValueError(f"{len(buf)} bytes of an unfinished record")


def inflate(stream):
    """Chunks of a gzip file of one or more members, inflated once from start to end."""
    d = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            if out := d.decompress(data, 4 * _CHUNK):
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data, d = d.unused_data, zlib.decompressobj(31)
    if out := d.flush():
        yield out


def _writer(path: str, archive_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        fs, root = open_dir(path)
        part, made, f = TaskContext.get().partitionId(), 0, None

        def close():
            f.write(z.flush())
            f.close()
            fs.move(temp, name)
            return pa.RecordBatch.from_pylist([{"archive": name, "records": n}])

        for b in batches:
            for page, url, html, digest, size, refers in zip(*(c for c in b.columns)):
                if f is None:
                    name = f"{root}/{part:05d}-{made:04d}.warc.gz"
                    temp, n, z = f"{name}.{uuid.uuid4().hex}", 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    f = fs.open_output_stream(temp, compression=None)
                payload = (html.as_py() or "").encode("utf-8")
                f.write(z.compress(record(page.as_py(), url.as_py(), payload, digest.as_py(), size.as_py(), refers.as_py())))
                n += 1
                if f.tell() >= archive_bytes:
                    yield close()
                    f, made = None, made + 1
        if f is not None:
            yield close()

    return run


def _normaliser(path: str):
    def run(batches):
        fs, root = open_dir(path)
        for b in batches:
            for archive in b.column(0).to_pylist():
                name = f"{root}/{archive.rpartition('/')[2]}"
                own, at, n = uuid.uuid4().hex, 0, 0
                with fs.open_input_stream(archive, compression=None) as src, fs.open_output_stream(f"{name}.{own}", compression=None) as out:
                    with fs.open_output_stream(f"{name}.idx.{own}", compression=None) as side:
                        for rec in split_records(inflate(src)):
                            z = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = z.compress(rec) + z.flush()
                            out.write(member)
                            head = parse_head(rec[: rec.index(b"\r\n\r\n")])
                            side.write(json.dumps([head["warc-record-id"], at, len(member)]).encode() + b"\n")
                            at += len(member)
                            n += 1
                fs.move(f"{name}.{own}", name)
                fs.move(f"{name}.idx.{own}", f"{name}.idx")
                yield pa.RecordBatch.from_pylist([{"archive": name, "records": n, "bytes": at}])

    return run


def read_member(f, offset: int, length: int) -> dict:
    """One record by its place in the archive; the digest of a response is computed from what is read."""
    f.seek(offset)
    rec = zlib.decompress(f.read(length), 31)
    cut = rec.index(b"\r\n\r\n")
    head = parse_head(rec[:cut])
    body = rec[cut + 4 : cut + 4 + int(head["content-length"])]
    number = lambda k: int(head[k]) if k in head else None
    kind = head["warc-type"]
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    size = int(head["x-payload-length"])
    if kind == "response":
        if (hashlib.sha256(body).hexdigest(), len(body)) != (digest, size):
            raise ValueError(f"record {head['warc-record-id']} does not match its digest")
    return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to"), "url": json.loads(head["x-target-url"]) if "x-target-url" in head else None, "body": body}


def _reader(batches):
    for b in batches:
        for archive in b.column(0).to_pylist():
            fs, name = open_dir(archive, create=False)
            rows = []
            with io.BufferedReader(fs.open_input_stream(f"{name}.idx", compression=None), _CHUNK) as side, fs.open_input_file(name) as f:
                for _, offset, length in map(json.loads, side):
                    r = read_member(f, offset, length)
                    r.pop("body")
                    rows.append(r | {"archive": name.rpartition("/")[2], "offset": offset, "length": length})
                    if len(rows) >= 2000:
                        yield _read_batch(rows)
                        rows = []
            yield _read_batch(rows)


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _read_batch(rows):
    return pa.RecordBatch.from_pylist(rows, schema=_READ)


def with_references(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest, size, refers_to."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    # who revisits whom is settled on digests and ids; only rows that repeat a payload are in it
    keys = staged(p.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).select("digest", "page_id"), "payloads")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    revisits = keys.join(first, "digest").where("page_id > first_id").select(F.col("digest").alias("r_digest"), F.col("page_id").alias("r_id"), "first_id").distinct()
    # a page meets its reference by digest and id, so that a payload that many pages share is dealt over all tasks
    joined = p.join(revisits, (F.col("digest") == F.col("r_digest")) & (F.col("page_id") == F.col("r_id")), "left")
    return joined.select("page_id", "url", F.when(F.col("first_id").isNull(), F.col("html")).alias("html"), "digest", "size", F.col("first_id").alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None, *, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Monolithic archives below ``path``; returns their manifest (archive, records)."""
    path = path or new_path(pages.sparkSession, "warc")
    rows = with_references(pages, **columns)
    return staged(rows.mapInArrow(_writer(path, archive_bytes), "archive string, records long"), "warc_manifest")


def one_each(manifest: DataFrame) -> DataFrame:
    """An archive a task: dealt in turn, not by hash."""
    return manifest.select("archive").repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame, path: str | None = None) -> DataFrame:
    """One member a record, with a sidecar index ``*.idx``; the monolithic archives are deleted, with what lost tasks left beside them."""
    path = path or new_path(manifest.sparkSession, "warc_members")
    members = staged(one_each(manifest).mapInArrow(_normaliser(path), "archive string, records long, bytes long"), "member_manifest")
    # only now, when no lost task can need them again
    if (row := manifest.select("archive").first()) is not None:
        fs, name = open_dir(row[0], create=False)
        fs.delete_dir(name.rpartition("/")[0])
        remove_unfinished(path)
    return members


def remove_unfinished(path: str) -> None:
    """Deletes files that a lost task did not move in place."""
    fs, root = open_dir(path, create=False)
    for f in fs.get_file_info(FileSelector(root)):
        if not f.base_name.endswith((".warc.gz", ".idx")):
            fs.delete_file(f.path)


def read_archives(manifest: DataFrame) -> DataFrame:
    return one_each(manifest).mapInArrow(_reader, READ_SCHEMA)
