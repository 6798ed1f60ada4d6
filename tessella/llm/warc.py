"""WARC archives with an index that is written first and read by ranges.

:func:`write` stores a record per page, each a gzip member of its own, in one file per task, and
returns the index: page, URL, file, offset, length, payload digest and kind of every record, in a
table that Spark commits.  Files that no committed row names are leftovers of lost tasks and are
never read.  :func:`read` takes any selection of index rows, sorts them by file and offset inside
slabs of a file, coalesces near ranges into one read each, and parses the records.

Of records with equal payloads of ``min_bytes`` or more the smallest page id is a response and the
others revisit it; shorter ones are all responses.  Null payloads count as empty.  Rows with equal
page id and payload are the same capture and have the same kind.  A null page id is never referred
to unless its payload has no other.  An empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import new_folder, stage, whole_text

MIN_BYTES = 100
SLAB = 32 << 20  # bytes of a file that one task may read
GAP, READ = 64 << 10, 8 << 20  # ranges this near are read together, up to so many bytes
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own

# Fixed values of the format.
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"


def kinds(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages with payload, digest, ``record_type`` and ``refers_to``.

    Only digests that occur twice are joined back, so unique pages meet nothing large."""
    payload = whole_text("html")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("payload_digest")
    firsts = shared.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("again", F.lit(True)).drop("n")
    revisit = F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the protocol headers only."""
    from urllib.parse import quote

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers of a record by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record is cut")
    return {**fields, "block": rest[:n]}


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "none") else None


def write(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages and return the committed index."""
    folder = new_folder(pages.sparkSession, "warc")

    def run(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, offset = f"{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{root}/{part}", compression=None) as out:
            for batch in batches:
                index = []
                for page_id, url, payload, digest, kind, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = gzip.compress(record(page_id, url, payload.encode(), digest, kind, to), compresslevel=4, mtime=0)
                    out.write(data)
                    index.append((page_id, url, f"{folder}/{part}", offset, len(data), digest, kind, to))
                    offset += len(data)
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = [c.split()[0] for c in _INDEX.split(", ")]
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=names)

    return stage(kinds(pages, min_bytes).mapInArrow(run, _INDEX), "warc-index")


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, record_type, payload_digest, payload_bytes, refers_to[, payload]) of the records
    that the index rows name.  Digest and size of responses are those of the bytes read."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    slabs = index.select("file", "offset", "length", F.floor(F.col("offset") / SLAB).alias("slab"))
    tasks = max(1, -(-total // (SLAB // 4)))
    ordered = slabs.repartition(tasks, "file", F.floor(F.col("offset") / (SLAB // 4))).sortWithinPartitions("file", "offset").drop("slab")
    schema = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long" + (", payload binary" if payloads else "")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def one(data: bytes) -> tuple:
        r = parse(zlib.decompress(data, 31))
        digest, body = r["warc-payload-digest"].removeprefix("sha256:"), None
        if r["warc-type"] == "response":
            body = r["block"].partition(b"\r\n\r\n")[2]
            if hashlib.sha256(body).hexdigest() != digest:
                raise ValueError("payload digest does not hold")
        return _page(r["warc-record-id"]), r["warc-type"], digest, None if body is None else len(body), _page(r.get("warc-refers-to")), body

    def ranges(rows):
        """(file, start, end, [(offset, length)]) of coalesced reads."""
        now: list | None = None
        for name, offset, length in rows:
            if now and now[0] == name and offset - now[2] <= GAP and offset + length - now[1] <= READ:
                now[2] = max(now[2], offset + length)
                now[3].append((offset, length))
            else:
                if now:
                    yield now
                now = [name, offset, offset + length, [(offset, length)]]
        if now:
            yield now

    def run(batches):
        from pyarrow import fs

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, start, end, parts in ranges(rows):
            store, path = fs.FileSystem.from_uri(name)
            with store.open_input_file(path) as f:
                f.seek(start)
                data = f.read(end - start)
            found = list(zip(*(one(data[a - start : a - start + n]) for a, n in parts), strict=True))
            keep = len(types) if payloads else len(types) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found[:keep], types[:keep], strict=True)], names=names[:keep])

    return ordered.mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the payload size of what they revisit."""
    responses = records.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("size"))
    responses = responses.select(F.col("page_id").alias("to"), F.col("payload_digest").alias("of"), "size")
    same = F.col("refers_to").eqNullSafe(F.col("to")) & (F.col("payload_digest") == F.col("of")) & (F.col("record_type") == "revisit")
    return records.join(responses, same, "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "size")).drop("to", "of", "size")
