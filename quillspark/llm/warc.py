"""WARC archives: writing, normalising a monolithic gzip, and reading by offset.

A task writes its rows as one gzip stream (a monolithic file, which can only be read from its start).
The normaliser inflates such a stream once, rewrites each record as a gzip member of its own and
writes a sidecar index with each member's offset and length, by which any record can be read alone.
All steps stream: no task holds more than one record and a block of index lines. Files go through ``pyarrow.fs`` to the folder
that all executors share; they appear under their names by a rename when complete, so a task that is
lost or repeated leaves no half file.

Record of a page: type ``response``, an HTTP response with the html in UTF-8 as payload (null: empty);
or ``revisit`` if a payload of at least 100 bytes is also that of a smaller page_id: HTTP headers only,
with the digest and length of the whole payload and a reference to the response. Rows that share the
smallest page_id are all responses. A record's id is made of page_id and digest; rows that repeat both get
a suffix of their own, and a revisit of them names the id without it. Null page_ids come last: they revisit a page with an id, and are
responses if there is none. Null urls give no target. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_small, need, shared_dir, written

SMALL = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PIECE, _ROWS = 1 << 18, 4096


#: Digests of repeated payloads up to which they are broadcast (some 100 bytes each).
BROADCAST_DIGESTS = 500_000


def typed_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, digest, size, refers_to, repeated)``; refers_to is null for a response, html for
    a revisit; repeated: whether other rows have both the page_id and the payload.

    Which payloads are repeated is found on narrow rows. Bodies are joined with those few digests, which
    are broadcast up to a bound that is counted first.
    """
    rows = need(pages, "page_id", "url", "html")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    narrow = written(keyed.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("times"), F.first("size").alias("size")), "payloads")
    large = narrow.where(F.col("size") >= SMALL).groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("times").alias("times"))
    again = written(large.where("times > 1 AND first IS NOT NULL").select(F.col("digest").alias("known"), "first"), "repeated_payloads")
    same = written(narrow.where("times > 1").select(F.col("digest").alias("same"), F.col("page_id").alias("same_id")), "repeated_rows")
    found = keyed.join(broadcast_small(again, BROADCAST_DIGESTS), keyed["digest"] == again["known"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    typed = found.select("page_id", "url", "html", "digest", "size", refers.alias("refers_to"))
    typed = typed.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    if same.isEmpty():
        return typed.withColumn("repeated", F.lit(False))
    marked = typed.join(broadcast_small(same, BROADCAST_DIGESTS), (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("same_id")), "left")
    return marked.select(*typed.columns, F.col("same").isNotNull().alias("repeated"))


def _id(page_id: int | None, digest: str, own: str = "") -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:32]}{own and ':'}{own}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int | None = None, own: str = "") -> bytes:
    """One WARC record, uncompressed. ``size`` is the whole payload's, which a revisit does not hold;
    ``own`` makes the id of a repeated row its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id, digest, own)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%" + f"{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {"": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def _place(base: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(base)


class _Whole:
    """A file that gets its name when it is complete."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.system, self.path, self.part = system, path, f"{path}.{uuid.uuid4().hex}.part"
        self.stream = system.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        return len(data)

    def finish(self) -> None:
        self.stream.close()
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:  # of an attempt that was lost
            self.system.delete_file(self.path)
        self.system.move(self.part, self.path)


class _Inflated:
    """A gzip file of any number of members, read once from its start in bounded pieces."""

    def __init__(self, stream) -> None:
        self.stream, self.engine, self.held, self.rest = stream, zlib.decompressobj(31), b"", b""

    def more(self) -> bytes:
        """Some further inflated bytes; none at the end."""
        while True:
            data = self.rest or self.stream.read(_PIECE)
            if not data:
                return b""
            out = self.engine.decompress(data, _PIECE)
            self.rest = self.engine.unconsumed_tail
            if self.engine.eof:  # what is left belongs to the next member
                self.rest, self.engine = self.engine.unused_data, zlib.decompressobj(31)
            if out:
                return out

    def head(self) -> bytes | None:
        """Bytes up to and with the empty line; nothing at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            data = self.more()
            if not data:
                if self.held:
                    raise ValueError("the archive ends in a record's headers")
                return None
            self.held += data
        out, self.held = self.held[: at + 4], self.held[at + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = self.more()
                if not self.held:
                    raise ValueError("the archive ends in a record's block")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def normalise(system: fs.FileSystem, source: str, target: str, level: int = 6) -> int:
    """Rewrites a gzip archive with a member for each record, and ``target + '.idx'``: one line a
    record with offset, length and headers. Returns the number of records."""
    out, index, offset, n = _Whole(system, target), _Whole(system, target + ".idx"), 0, 0
    with system.open_input_stream(source, compression=None) as stream:
        archive = _Inflated(stream)
        while (head := archive.head()) is not None:
            engine = zlib.compressobj(level, zlib.DEFLATED, 31)
            size = out.write(engine.compress(head))
            for piece in archive.take(int(_headers(head)["content-length"]) + 4):
                size += out.write(engine.compress(piece))
            size += out.write(engine.flush())
            meta = _headers(head)
            index.write((json.dumps([offset, size, meta["warc-type"], meta["warc-record-id"]]) + "\n").encode())
            offset, n = offset + size, n + 1
    out.finish()
    index.finish()
    return n


def write_archives(typed: DataFrame, base: str, level: int = 1) -> DataFrame:
    """Writes one monolithic archive a task into the folder ``base``; ``(archive, records)`` each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = _place(base)
        out, engine, n = None, zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for pdf in batches:
            for page_id, url, html, digest, size, refers, repeated in zip(*(pdf[c].tolist() for c in ("page_id", "url", "html", "digest", "size", "refers_to", "repeated")), strict=True):
                out = out or _Whole(system, f"{folder}/mono-{uuid.uuid4().hex}.warc.gz")
                whole = lambda v: None if pd.isna(v) else int(v)
                payload = b"" if html is None else html.encode("utf-8", "replace")
                out.write(engine.compress(record(whole(page_id), url, payload, digest, whole(refers), None if pd.isna(refers) else size, uuid.uuid4().hex if repeated else "")))
                n += 1
        if out:
            out.write(engine.flush())
            out.finish()
            yield pd.DataFrame({"archive": [out.path.rsplit("/", 1)[1]], "records": [n]})

    # Ids as text: Pandas would turn a nullable long into an inexact float.
    rows = typed.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", "size", F.col("refers_to").cast("string").alias("refers_to"), "repeated")
    return rows.mapInPandas(run, "archive string, records long")


def normalise_archives(archives: DataFrame, base: str, level: int = 6) -> DataFrame:
    """Normalises each of ``archives(archive)`` in ``base`` and removes the monolithic file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = _place(base)
        for pdf in batches:
            for name in pdf["archive"]:
                target = name.replace("mono-", "pages-", 1)
                if system.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:  # else done by a lost task
                    n = normalise(system, f"{folder}/{name}", f"{folder}/{target}", level)
                    system.delete_file(f"{folder}/{name}")
                else:
                    with system.open_input_stream(f"{folder}/{target}.idx", compression=None) as lines:
                        n = sum(1 for _ in _lines(lines))
                yield pd.DataFrame({"archive": [target], "records": [n]})

    return archives.select("archive").mapInPandas(run, "archive string, records long")


def read_record(system: fs.FileSystem, path: str, offset: int, size: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record in the member at ``offset``."""
    with system.open_input_file(path) as archive:
        archive.seek(offset)
        return _parsed(archive.read(size))


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    meta = _headers(head)
    return meta, rest[: int(meta["content-length"])]


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while data := stream.read(_PIECE):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def read_archives(archives: DataFrame, base: str) -> DataFrame:
    """A row for each record of the normalised archives, read by the offsets of their indexes.

    A response's digest and length are computed from its payload; a revisit has those of its headers.
    """

    def page(urn: str) -> int | None:
        name = urn[len("<urn:page:") : -1].split(":")[0]
        return None if name == "none" else int(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = _place(base)

        def shown(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]).astype({"page_id": "Int64", "refers_to": "Int64"})

        for pdf in batches:
            for name in pdf["archive"]:
                rows = []
                with system.open_input_stream(f"{folder}/{name}.idx", compression=None) as index, system.open_input_file(f"{folder}/{name}") as archive:
                    for line in _lines(index):
                        offset, size = json.loads(line)[:2]
                        archive.seek(offset)
                        meta, block = _parsed(archive.read(size))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        fresh = meta["warc-type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if fresh else meta["warc-payload-digest"].removeprefix("sha256:")
                        n = len(payload) if fresh else int(_headers(http)["content-length"])
                        rows.append((page(meta["warc-record-id"]), meta.get("warc-target-uri"), n, digest, meta["warc-type"], None if fresh else page(meta["warc-refers-to"]), name, offset))
                        if len(rows) == _ROWS:
                            yield shown(rows)
                            rows = []
                yield shown(rows)

    return archives.select("archive").mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def archive_pages(spark: SparkSession, pages: DataFrame, base: str | None = None, level: int = 6) -> tuple[DataFrame, str]:
    """Writes and normalises archives of ``pages``; the list of archives and their folder."""
    base = base or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    system, folder = _place(base)
    system.create_dir(folder, recursive=True)
    mono = written(write_archives(typed_pages(pages), base), "mono")
    # One archive a task: the list is short, its files are not.
    files = mono.count()
    return written(normalise_archives(mono.repartition(max(1, files), "archive"), base, level), "archives"), base


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Archives the whole ``pages`` table and reads the archives back."""
    archives, base = archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = read_archives(archives.repartition(max(1, archives.count()), "archive"), base)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM k WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT k.page_id, k.payload_bytes, k.payload_digest,
       CASE WHEN k.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.page_id > f.first_id THEN f.first_id END AS refers_to
FROM k LEFT JOIN f USING (payload_digest)
"""
