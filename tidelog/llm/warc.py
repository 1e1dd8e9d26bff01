"""WARC archives: one gzip member for each record, an index of offsets, and coalesced byte-range reads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, new_path, stored

#: A reader joins ranges that lie this near into one read, up to so many bytes at once.
GAP, MOST = 64 << 10, 8 << 20
#: A writer starts another file beyond this size; a reader hands on rows after so many bytes of payload.
FILE_BYTES, HAND_ON = 256 << 20, 8 << 20
INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
#: Fixed values of the format.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f-\U0010ffff]")


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows of 64-bit integers, texts and bytes, nulls and all, without passing floating point."""
    fields = [x.split() for x in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri_lines(name: str, value: str | None) -> list[str]:
    """A URI on one line; one with spaces, control or other than ASCII characters is escaped there and stands exactly in a line of its own."""
    if value is None:
        return []
    shown = _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode("utf-8", "surrogatepass")), value)
    return [f"{name}: {shown}"] + ([f"X-Exact-{name}: {json.dumps(value)}"] if shown != value else [])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, original: str | None = None, place: str = "") -> tuple[bytes, str]:
    """The bytes of one record, compressed, and its payload digest. A response holds an HTTP head and the payload, a revisit the head alone.

    original: the URL of the response that a revisit refers to. place: what tells this record from all others.
    """
    kind, sha = ("response" if refers_to is None else "revisit"), digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{place}:{page_id}:{sha}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", *_uri_lines("WARC-Target-URI", url)]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", *_uri_lines("WARC-Refers-To-Target-URI", original), f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Bytes: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 4, mtime=0), sha


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record; a revisit has no payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} doesn't end after its block")
    http = rest.index(b"\r\n\r\n") + 4
    return fields, rest[http:length]


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for rows in batches:
                index = []
                for row in zip(*rows.columns, strict=True):  # one row at a time: a batch is held once
                    page, url, html, target, original = (x.as_py() for x in row)
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        # A name of its own for each attempt: the index names only files of attempts that ended.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = (html or "").encode()
                    data, sha = record(page, url, payload, target, original, f"{name}:{at}")
                    out.write(data)
                    index.append((page, url, name, at, len(data), len(payload), sha, "response" if target is None else "revisit", target))
                    at += len(data)
                yield _batch(index, INDEX)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, root: str | None = None) -> tuple[str, DataFrame]:
    """Write a record for each row of pages (page_id, url, html); returns the archives' root and the index.

    Of rows with equal payloads (null html: empty) the smallest page_id is the response and the
    others revisit it; rows of its own id, and rows of a payload without any id, are responses too.
    Null url: no target URI. Other columns are ignored. Empty table: no files, an empty index. Equal
    payloads are those of equal SHA-256. The root needs a scheme that pyarrow.fs opens (file, hdfs,
    s3, gs). The index is Parquet in `<root>/index`, with file and offset of each record.

    A first pass reads hashes and ids alone and stores the groups of two rows or more. They are the
    build side of the join (broadcast by the engine where they are small), so pages are not sorted.
    """
    spark = batched(pages.sparkSession)
    root = root or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("_sha"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_least")
    groups = rows.groupBy("_sha").agg(least, F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = stored(groups.select("_sha", F.col("_least.page_id").alias("_first"), F.col("_least.url").alias("_original")), "warc-groups")
    found = rows.join(groups.hint("shuffle_hash"), "_sha", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first")).alias("refers_to"), "_original"
    )
    data = f"{root}/archives"
    found.mapInArrow(_writer(data), INDEX).write.parquet(f"{root}/index")
    return data, spark.read.schema(INDEX).parquet(f"{root}/index")


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = MOST) -> list[tuple[int, int]]:
    """Slices [i, j) of sorted records that one read serves."""
    out, i = [], 0
    for j in range(1, len(offsets) + 1):
        if j == len(offsets) or offsets[j] - offsets[j - 1] - lengths[j - 1] > gap or offsets[j] + lengths[j] - offsets[i] > most:
            out.append((i, j))
            i = j
    return out


def _reader(root: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        name, source, out, held = None, None, [], 0
        for rows in batches:
            files, offsets, lengths = (c.to_pylist() for c in rows.columns)
            cuts = [i for i in range(len(files)) if not i or files[i] != files[i - 1]] + [len(files)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if files[begin] != name:
                    name = files[begin]
                    source = store.open_input_file(f"{base}/{name}")
                for i, j in ranges(offsets[begin:end], lengths[begin:end]):
                    first = offsets[begin + i]
                    whole = source.read_at(offsets[begin + j - 1] + lengths[begin + j - 1] - first, first)
                    for k in range(begin + i, begin + j):
                        fields, payload = parse(gzip.decompress(whole[offsets[k] - first : offsets[k] - first + lengths[k]]))
                        sha, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and digest(payload) != sha:
                            raise ValueError(f"{name} at {offsets[k]}: the payload doesn't match its digest")
                        page, target, exact = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page"), fields.get("X-Exact-WARC-Target-URI")
                        url = json.loads(exact) if exact else fields.get("WARC-Target-URI")
                        shown = payload if payloads and kind == "response" else None
                        out.append((page and int(page), url, kind, target and int(target), int(fields["X-Payload-Bytes"]), sha, shown))
                        held += 200 + len(shown or b"")
                        if held >= HAND_ON:
                            yield _batch(out, RECORD)
                            out, held = [], 0
        yield _batch(out, RECORD)

    return read


def read_records(root: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of index select; a response's digest is verified, a revisit's payload is null."""
    batched(index.sparkSession)
    by = [F.col("file"), F.col("offset")]
    chosen = index.select("file", "offset", "length").repartitionByRange(*by).sortWithinPartitions(*by)
    return chosen.mapInArrow(_reader(root, payloads), RECORD)
