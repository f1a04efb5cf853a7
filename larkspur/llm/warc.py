"""WARC archives: writing them, reading them, and assembling transactions.

``write_archives`` writes a request, a response (or revisit) and a metadata record for each page, each a gzip
member of its own, the request and metadata records pointing at the response with WARC-Concurrent-To. Of pages with equal
payloads only that of the largest id carries it; the others are revisits of the identical-payload-digest
profile. Files have names that no other attempt uses, and only those in the manifest count, so lost tasks
leave nothing that is read.

``read_records`` parses the archives record by record; ``assemble`` brings the records of a capture together
through their concurrent-to identifiers and emits one nested row for each; ``resolve`` gives revisits the
payload's size and the page they refer to, found by payload digest.

Edge cases: a null payload is an empty one; a null url leaves out the target URI; control characters in a
url are percent-encoded; a page of null id is smaller than any other, and is a response where all of its group
are null; repeated ids are separate captures; a request or metadata record whose response is
absent makes a capture without response; an empty table makes no archive and no rows; columns other
than id, url and payload aren't looked at. All records of one capture have to fit in a row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._common import BROADCAST_BYTES, HOT_SHARE, materialize, scratch_path, spread_join

#: A task goes on with another archive after so many compressed bytes.
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, offset long, record_id string, type string, concurrent_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes, date: str = DATE) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def members(source, chunk: int = 1 << 20):
    """(offset, bytes) of each gzip member of a file; holds one member and one chunk."""
    unpack, parts, at, start = zlib.decompressobj(31), [], 0, 0
    data = source.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            rest = unpack.unused_data
            at += len(data) - len(rest)
            yield start, b"".join(parts)
            start, unpack, parts = at, zlib.decompressobj(31), []
            data = rest or source.read(chunk)
        else:
            at += len(data)
            data = source.read(chunk)
    if any(parts):
        raise ValueError("the archive ends within a record")


# ---------------------------------------------------------------- writing


def write_archives(pages: DataFrame, page_id="page_id", url="url", payload="html", folder: str | None = None, min_bytes: int = 0, level: int = 6, file_bytes: int = FILE_BYTES) -> str:
    """Write the archives under a folder and return it. Its manifest is folder/manifest."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    groups = p.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keep IS NOT NULL")
    groups = materialize(groups.select(F.col("sha").alias("g_sha"), "keep", "n"), "warc-groups")
    n_groups = groups.count()
    if n_groups * 96 <= BROADCAST_BYTES:
        rows = p.join(F.broadcast(groups.drop("n")), F.col("sha") == F.col("g_sha"), "left")
    else:  # payloads of a digest that many pages have aren't shuffled to one task: their groups, few at any size, are broadcast
        total = p.count()
        hot, rest = (groups.where(c).drop("n") for c in (F.col("n") * HOT_SHARE > total, F.col("n") * HOT_SHARE <= total))
        cold = p.join(F.broadcast(hot), F.col("sha") == F.col("g_sha"), "left_anti")
        rows = p.join(F.broadcast(hot), F.col("sha") == F.col("g_sha")).unionByName(cold.join(rest, F.col("sha") == F.col("g_sha"), "left"))
    # revisits carry no payload
    rows = rows.withColumn("revisit", F.expr("keep IS NOT NULL AND (page_id IS NULL OR page_id < keep)"))
    rows = rows.select("page_id", "url", "sha", "revisit", F.when(~F.col("revisit"), F.col("payload")).alias("payload"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, written, done = None, 0, []
        for b in batches:
            for i in range(0, b.num_rows, 500):
                for pid, uri, sha, revisit, text in zip(*(c.to_pylist() for c in b.slice(i, 500).columns), strict=True):
                    if out is None:
                        name, written = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        done.append(name)
                    ids = [f"urn:uuid:{uuid.uuid4()}" for _ in range(3)]
                    target = [] if uri is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))]
                    label = base64.b32encode(bytes.fromhex(sha)).decode()
                    own = [*target, ("WARC-Payload-Digest", f"sha1:{label}"), ("Content-Type", "application/http; msgtype=response")]
                    body = (text or "").encode("utf-8", "replace")
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    if revisit:
                        main = record("revisit", ids[0], [("WARC-Profile", PROFILE), *own], http + b"\r\n")
                    else:
                        main = record("response", ids[0], own, http + b"Content-Length: %d\r\n\r\n" % len(body) + body)
                    to = ("WARC-Concurrent-To", f"<{ids[0]}>")
                    asked = record("request", ids[1], [*target, to, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nAccept: text/html\r\n\r\n")
                    meta = record("metadata", ids[2], [*target, to, ("Content-Type", "application/warc-fields")], b"page-id: %s\r\n" % (b"" if pid is None else str(pid).encode()))
                    for x in (asked, main, meta):
                        written += out.write(member(x, level)) or 0
                    if out.tell() >= file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    rows.mapInArrow(run, "name string").write.parquet(f"{folder}/manifest")
    return folder


# ---------------------------------------------------------------- reading


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in the folder's manifest: the columns of RECORD.

    payload_digest and payload_bytes are those of the bytes read, for responses; for revisits the digest is
    the one declared, and the size null. ``payloads`` False leaves the payload column null.
    """
    files = spark.read.schema("name string").parquet(f"{folder}/manifest")

    def run(batches):
        import pyarrow as pa

        store, root = _open(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows, size = [], 0
                    for offset, data in members(f):
                        h, block = parse_record(data)
                        kind, fields, body, n = h["warc-type"], {}, None, None
                        label = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            found, n = digest(body), len(body)
                            if label not in (None, found):
                                raise ValueError(f"{name} at {offset}: the payload doesn't have its digest")
                            label = found
                        elif kind == "metadata":
                            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
                        size += len(body or b"")
                        rows.append((name, offset, h["warc-record-id"].strip("<>"), kind, h.get("warc-concurrent-to", "").strip("<>") or None, h.get("warc-target-uri"), h.get("warc-date"), label, n, list(fields.items()), body if payloads else None))
                        if len(rows) >= 2000 or payloads and size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    n = max(1, files.count())
    return files.repartition(n, "name").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """capture_id, response, requests, metadata: a nested row for each capture.

    A capture is named by its response's (or revisit's) record id; requests and metadata records join it by
    their concurrent-to identifier. ``response`` is null where there is none.
    """
    main = F.col("type").isin("response", "revisit")
    r = records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    response = F.struct("record_id", "type", "target_uri", "date", "payload_digest", "payload_bytes", "payload")
    other = F.struct("record_id", "target_uri", "date", "fields")
    plain = F.struct("record_id", "target_uri", "date")
    return r.groupBy("capture_id").agg(
        F.max(F.when(main, response)).alias("response"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", plain))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "metadata", other)), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)).alias("metadata"),
    )


def resolve(captures: DataFrame, page_field: str = "page-id") -> DataFrame:
    """page_id, record_type, payload_digest, payload_bytes, refers_to of each capture that has a response or revisit."""
    c = captures.where("response IS NOT NULL").select(
        F.expr(f"try_cast(element_at(get(metadata, 0).fields, '{page_field}') AS bigint)").alias("page_id"),
        F.col("response.type").alias("record_type"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.payload_bytes").alias("payload_bytes"),
    )
    c = materialize(c, "warc-captures")
    full = c.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("page_id").alias("to"), F.max("payload_bytes").alias("size")).withColumnRenamed("payload_digest", "d")
    revisits = c.where("record_type = 'revisit'")
    # only digests that are revisited
    wanted = revisits.groupBy(F.coalesce("payload_digest", F.lit("")).alias("d")).agg(F.count(F.lit(1)).alias("c")).join(full, "d", "left")
    wanted = materialize(wanted, "warc-wanted")
    found = spread_join(revisits.withColumn("d", F.coalesce("payload_digest", F.lit(""))), wanted, "d", "c", revisits.count()).select("page_id", "record_type", "payload_digest", F.col("size").alias("payload_bytes"), F.col("to").alias("refers_to"))
    return c.where("record_type = 'response'").select("page_id", "record_type", "payload_digest", "payload_bytes", F.lit(None).cast("long").alias("refers_to")).unionByName(found)
