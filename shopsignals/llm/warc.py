"""WARC 1.1 archives: writing pages, and a sequential reader.

Each record is a gzip member of its own. Tasks write archives of their rows to a
shared folder under names no other attempt uses, and return a manifest; only
the manifest of attempts that Spark commits is read on. The reader decompresses
an archive in small pieces, frames records by Content-Length and digests block
and payload as they pass, so memory does not grow with archive or record.

Results in cases of doubt: a null html is an empty payload; among pages with one
payload of at least ``least`` bytes those with the smallest page_id are
responses, the others revisits (null page_ids are larger than all; if all are
null, all are responses); rows that repeat a page_id are records each; a url
that is null or empty writes no WARC-Target-URI, and line ends in it are
escaped; other columns are ignored. A broken member or a length that does not
hold raises; a digest that differs gives ``verified`` false.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignals.llm.tables import read, shared_path, ship, store

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16
MANIFEST_DDL = "path string, records long, bytes long"
RECORD_DDL = ("path string, offset long, record_id string, record_type string, target_uri string, refers_to string, "
              "payload_bytes long, payload_digest string, verified boolean, payload binary")
RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
                    ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _uri(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as executors resolve it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member."""
    block = HTTP if kind == "revisit" else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _writer(folder: str, roll: int, date: str):
    def apply(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        path = out = None
        n = size = 0
        try:
            for b in batches:
                cols = {c: b.column(c) for c in b.schema.names}
                for i in range(b.num_rows):
                    if out is None:
                        path = f"part-{uuid.uuid4().hex}.warc.gz"
                        out, n, size = fs.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                    refers = cols["refers_to"][i].as_py()
                    pid = cols["page_id"][i].as_py()
                    data = record("response" if refers is None else "revisit", "urn:page:" + ("" if pid is None else str(pid)),
                                  cols["url"][i].as_py(), (cols["html"][i].as_py() or "").encode(), cols["digest"][i].as_py(),
                                  None if refers is None else f"urn:page:{refers}", date)
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= roll:
                        out.close()
                        out = None
                        yield _manifest(folder, path, n, size)
            if out is not None:
                out.close()
                out = None
                yield _manifest(folder, path, n, size)
        finally:
            if out is not None:
                out.close()
    return apply


def _manifest(folder: str, path: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [n], "bytes": [size]})


def write_pages(pages: DataFrame, folder: str | None = None, least: int = 100, roll: int = 256 << 20,
                date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives of about ``roll`` bytes
    at most and return their manifest: path, records, bytes."""
    spark = pages.sparkSession
    ship(spark)
    folder = _uri(spark, folder or shared_path(spark, "warc"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                     F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    first = (pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("_digest"))
             .where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
             .groupBy("_digest").agg(F.min(F.col("page_id").cast("long")).alias("_first"), F.count(F.lit(1)).alias("_n"))
             .where("_n > 1"))
    # equal digests of payloads of other lengths do not meet: short ones are not in `first`
    p = p.join(first, p["digest"] == first["_digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return store(p.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
                 .mapInArrow(_writer(folder, roll, date), MANIFEST_DDL), "warc-manifest")


class WarcError(ValueError):
    """An archive that breaks the format."""


class MemberStream:
    """Decompressed bytes of an archive, one gzip member at a time."""

    def __init__(self, stream):
        self.stream, self.rest, self.offset = stream, b"", 0

    def next_member(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(PIECE)
        if not self.rest:
            return False
        self.z, self.data, self.start = zlib.decompressobj(31), b"", self.offset
        return True

    def more(self) -> bool:
        """Decompress some more of this member; False at its end."""
        while not self.z.eof:
            before = len(self.rest)
            try:  # also without input: output over the limit waits inside
                got = self.z.decompress(self.rest, PIECE)
            except zlib.error as e:
                raise WarcError(f"member at {self.start}: {e}") from None
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.offset += before - len(self.rest)
            if got:
                self.data += got
                return True
            if not self.z.eof and not self.rest:
                self.rest = self.stream.read(PIECE)
                if not self.rest:
                    raise WarcError(f"member at {self.start} is cut short")
        return False

    def until(self, mark: bytes) -> bytes:
        while (i := self.data.find(mark)) < 0:
            if not self.more():
                raise WarcError(f"member at {self.start}: no end of headers")
        head, self.data = self.data[:i], self.data[i + len(mark):]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self.more():
                raise WarcError(f"member at {self.start}: shorter than its Content-Length")
            part, self.data = self.data[:n], self.data[n:]
            n -= len(part)
            yield part


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive in order."""
    m = MemberStream(stream)
    while m.next_member():
        lines = m.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"member at {m.start} is no WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block, payload, size, body, edge, kept = hashlib.sha256(), hashlib.sha256(), 0, False, b"", []
        http = head.get("content-type", "").startswith("application/http")
        try:
            length = int(head["content-length"])
        except (KeyError, ValueError):
            raise WarcError(f"member at {m.start}: no Content-Length") from None
        for part in m.take(length):
            block.update(part)
            if http and not body:
                edge += part
                i = edge.find(b"\r\n\r\n")
                if i < 0:
                    continue
                part, body, edge = edge[i + 4:], True, b""
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        while m.more():
            pass
        if m.data != b"\r\n\r\n":
            raise WarcError(f"member at {m.start}: not framed by its Content-Length")
        kind, told = head.get("warc-type"), head.get("warc-payload-digest", "")
        good = head.get("warc-block-digest", "sha256:" + block.hexdigest()) == "sha256:" + block.hexdigest()
        if kind == "revisit":  # its payload is the one it refers to
            size, digest = None, told.removeprefix("sha256:")
        else:
            digest = payload.hexdigest()
            good = good and told in ("", "sha256:" + digest)
        yield {"offset": m.start, "record_id": head.get("warc-record-id", "").strip("<>"), "record_type": kind,
               "target_uri": head.get("warc-target-uri"), "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
               "payload_bytes": size, "payload_digest": digest, "verified": good, "payload": b"".join(kept) if keep_payload else None}


def _reader(keep_payload: bool):
    def apply(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, p = _open(path)
                rows: list[dict] = []
                held = 0
                with fs.open_input_stream(p, compression=None) as stream:
                    for r in read_records(stream, keep_payload):
                        rows.append(r | {"path": path})
                        held += 200 + len(r["payload"] or b"")
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
    return apply


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest`` (path), one task an archive."""
    ship(manifest.sparkSession)
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(_reader(keep_payload), RECORD_DDL)


def page_records(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified per
    page record; a revisit has the length of the payload it refers to."""
    page = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    r = store(read_archives(manifest).drop("payload"), "warc-records")
    target = (r.where("record_type = 'response'").groupBy(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"))
              .agg(F.max("payload_bytes").alias("_bytes")))
    wanted = r.where("record_type = 'revisit'").select(F.col("refers_to").alias("_to")).distinct()
    target = target.join(wanted, target["_id"] == wanted["_to"], "left_semi")
    r = r.join(target, (r["refers_to"] == target["_id"]) & (r["payload_digest"] == target["_digest"]), "left")
    return r.select(page("record_id").alias("page_id"), F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
                    "payload_digest", "record_type", page("refers_to").alias("refers_to"), "verified")


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the given pages and read them back."""
    return page_records(write_pages(read(spark, sf_dir, "pages"))).drop("verified")
