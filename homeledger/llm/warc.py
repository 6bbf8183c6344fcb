"""Deterministic sharded WARC writer and reader.

Pages are cut into shards, ranges of page_id, by a rule of the rows alone: equal spans of as many ids as hold
about a shard's bytes on average; a shard of over HOT times as much is cut again by its own ids, as often as
need be, and one of a single id (or of none) by digest. Shards are whole in a task, sorted by page_id, and rolled
into files of about FILE_BYTES compressed bytes; a record is a gzip member of its own. Headers, record ids and
digests are made anew from the payload. Files are named by shard and number, get a temporary name and are
renamed; the manifest, a table, lists the files of successful attempts with their size and SHA-256. So the
files are the same bytes under the same names whatever the number of partitions, executors and attempts.

Of records with equal payloads of at least min_bytes bytes, that with the largest page_id is the response
and the others are revisits, which keep HTTP headers (with the full length) but no payload; smaller ones
are all responses. The digests alone are grouped (with partial maxima), so a payload that a third of the
pages share moves no page twice.

Null html is an empty payload, null url an empty one. Repeated rows of the largest page_id and the same
payload are all responses. A null page_id never is a response that others refer to: such a row revisits
the group's response if there is one, else it is a response. Very long payloads are a record like any other, and
an empty table gives no file. Only page_id, url and html are read; other columns do not travel.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import blocks, prepare, table, work_dir, written

FILE_BYTES = 32 << 20
MIN_BYTES = 0
#: A shard's bytes are a 64th of all, but no fewer or more than these; HOT times as many are too many.
LEAST_SHARD, MOST_SHARD, HOT = 4 << 20, 1 << 30, 4
#: Bytes that a record has besides its payload, about; tasks that read archives back, at most.
RECORD_BYTES, MOST_TASKS = 600, 1 << 14
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "low long, way int, no int, file string, n_records long, n_bytes long, sha256 string"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as z:
        z.write(data)
    return out.getvalue()


def _writer(root: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, no, held, size = (None, None), 0, [], 0
        mark: tuple = (None, None)

        def flush() -> pa.RecordBatch:
            low, way = shard
            data, name = b"".join(held), f"pages-{'none' if low is None else f'{low:+020d}'}-{way:05d}-{no:05d}.warc.gz"
            files.write(root, name, data)
            row = {"low": [low], "way": [way], "no": [no], "file": [name], "n_records": [len(held) - 1], "n_bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()]}
            kinds = {"low": pa.int64(), "way": pa.int32(), "no": pa.int32(), "file": pa.string(), "n_records": pa.int64(), "n_bytes": pa.int64(), "sha256": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(row[c], t) for c, t in kinds.items()], list(kinds))

        info = b"software: homeledger\r\nformat: WARC File Format 1.1\r\n"
        first = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, 'info')}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
        for batch in blocks(batches, "html"):
            for r in batch.to_pylist():
                own = (r["page_id"], r["digest"])
                if (r["low"], r["way"]) != shard:
                    if held:
                        yield flush()
                    shard, held, no, size = (r["low"], r["way"]), [], 0, 0
                if not r["kind"]:
                    mark = own, r["refers_to"]
                    continue
                payload = (r["html"] or "").encode()
                held = held or [first]
                made = _member(record(r["page_id"], r["url"] or "", payload, base32(bytes.fromhex(r["digest"])), mark[1] if mark[0] == own else None))
                held.append(made)
                size += len(made)
                if size >= file_bytes:
                    yield flush()
                    held, no, size = [], no + 1, 0
        if held:
            yield flush()

    return write


def _cuts(own: DataFrame, least: int, most: int) -> list[DataFrame]:
    """The cuts of too large shards (low, a, span, ways), level by level, each a table; at first all rows are one shard."""
    size = F.sum(F.col("n") + RECORD_BYTES)
    target, levels = min(most, max(least, (own.agg(size).first()[0] or 0) // 64)), []
    while True:
        shards = _sharded(own, levels).where("NOT split").groupBy("low").agg(size.alias("b"), F.min("page_id").alias("a"), F.max("page_id").alias("z"))
        wide = "(CAST(z AS decimal(38,0)) - CAST(a AS decimal(38,0)) + 1)"  # ids span up to 2**64
        span = f"CASE WHEN a < z THEN CAST(least(9223372036854775807, ceil({wide} * {target} / b)) AS bigint) END"
        hot = shards.where(f"b > {HOT * target}").selectExpr("low", "a", f"{span} AS span", f"CASE WHEN a < z THEN 1 ELSE CAST(ceil(b / {target}) AS int) END AS ways")
        levels.append(written(hot, "warc-cuts"))
        if levels[-1].isEmpty():
            return levels[:-1]


def _sharded(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows (page_id, digest) with their shard, low and way, and whether it was split by digest."""
    rows = rows.withColumns({"low": F.lit(None).cast("long"), "way": F.lit(0), "split": F.lit(False)})
    for cut in levels:  # a row for HOT shards' bytes at most: some 25,000 for 100 TB
        cut = cut.select(F.col("low").alias("_low"), F.col("a").alias("_a"), "span", "ways")
        rows = rows.join(F.broadcast(cut), F.col("low").eqNullSafe(F.col("_low")) & ~F.col("split"), "left")
        low = "CAST(CAST((CAST(page_id AS decimal(38,0)) - _a) div span AS decimal(38,0)) * span + _a AS bigint)"
        rows = rows.withColumn("low", F.expr(f"CASE WHEN span IS NOT NULL AND page_id IS NOT NULL THEN {low} ELSE low END"))
        rows = rows.withColumn("way", F.expr("CASE WHEN ways > 1 THEN CAST(pmod(crc32(CAST(digest AS binary)), ways) AS int) ELSE way END"))
        rows = rows.withColumn("split", F.coalesce(F.col("ways") > 1, F.col("split"))).drop("_low", "_a", "span", "ways")
    return rows


def write_warc(pages: DataFrame, root: str | None = None, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, least_shard: int = LEAST_SHARD, most_shard: int = MOST_SHARD) -> DataFrame:
    """Writes pages (page_id, url, html); returns the manifest."""
    spark = pages.sparkSession
    prepare(spark)
    root = files.resolved(spark, root or work_dir(spark, "warc"))
    pages = pages.selectExpr("CAST(page_id AS bigint) AS page_id", "url", "html")
    own = written(pages.selectExpr("page_id", "sha1(CAST(coalesce(html, '') AS binary)) AS digest", "octet_length(coalesce(html, '')) AS n"), "warc-digests")
    levels = _cuts(own, least_shard, most_shard)
    long = own.where(f"n >= {int(min_bytes)}").drop("n")
    top = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 AND refers_to IS NOT NULL")
    twins = long.join(top.drop("c"), "digest").where("NOT page_id <=> refers_to").selectExpr("page_id AS twin", "digest", "refers_to").distinct()
    # the marks travel as rows of their own just before their page, so that html is moved once
    marks = twins.selectExpr("twin AS page_id", "digest", "0 AS kind", "CAST(null AS string) AS url", "CAST(null AS string) AS html", "refers_to")
    rows = pages.selectExpr("page_id", "sha1(CAST(coalesce(html, '') AS binary)) AS digest", "1 AS kind", "url", "html", "CAST(null AS bigint) AS refers_to")
    rows = _sharded(rows.unionByName(marks), levels).drop("split").repartition("low", "way").sortWithinPartitions("low", "way", "page_id", "digest", "kind", "url", "html")
    return written(rows.mapInArrow(_writer(root, file_bytes), MANIFEST), "warc-manifest").withColumn("root", F.lit(root))


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members, without copying what is left after each."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, out, step = zlib.decompressobj(31), [], 1 << 14
        while not z.eof:
            out.append(z.decompress(view[at : at + step]))
            at += min(step, len(data) - at) - len(z.unused_data)
            if at >= len(data) and not z.eof:
                raise ValueError("the archive is cut off")
        yield b"".join(out)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _reader(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.string()}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))

        for batch in batches:
            for f in batch.to_pylist():
                data, rows, n = files.read(f["root"], f["file"]), [], 0
                if hashlib.sha256(data).hexdigest() != f["sha256"]:
                    raise ValueError(f"{f['file']}: the archive is damaged")
                for member in _members(data):
                    for h, block in parse_plain(member):
                        if h["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.lower().rpartition(b"content-length: ")[2])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"{f['file']}: a payload is damaged")
                        as_int = lambda k, h=h: int(h[k]) if k in h else None
                        n += 1
                        rows.append({"page_id": as_int("page-id"), "url": h["warc-target-uri"], "payload_bytes": length, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": as_int("refers-to-page-id"), "payload": payload.decode() if payloads and h["warc-type"] == "response" else None})
                        if len(rows) >= 1000:
                            yield batch_of(rows)
                            rows = []
                if n != f["n_records"]:
                    raise ValueError(f"{f['file']}: {n} records, not {f['n_records']}")
                if rows:
                    yield batch_of(rows)

    return read


def parse_plain(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each uncompressed record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        fields = {}
        for x in lines[1:]:
            name, _, value = x.partition(":")
            fields[name.lower()] = value.strip(" ")
        body = end + 4
        stop = body + int(fields["content-length"])
        if not lines[0].startswith("WARC/") or raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield fields, raw[body:stop]
        at = stop + 4


def read_warc(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows (READ) of the archives that a manifest lists; digests and lengths are checked."""
    prepare(manifest.sparkSession)
    tasks = min(MOST_TASKS, max(1, manifest.count()))  # given outright: the manifest's own bytes say nothing of the work
    return manifest.select("root", "file", "n_records", "sha256").repartitionByRange(tasks, "file").mapInArrow(_reader(payloads), READ)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(manifest).drop("url", "payload")
