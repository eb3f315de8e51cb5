"""WARC records in ZIP packages, written and read back without extraction.

Each writing task streams its records, gzipped one by one, into a stored member of a
ZIP package of its own, with an index member of record offsets. A reader finds the
end record at the package's tail, follows it (or its ZIP64 form) to the central
directory, resolves stored members to byte ranges, reads the index, and then
range-reads runs of records. Spark deals packages, then runs of records, to tasks.

Records with equal payloads: that with the least page id is a response, others are
revisits that refer to it.

Defined results: null html is an empty payload; null urls are written as empty; a
null page id loses to any other; rows that repeat a page id and payload are all
responses; packages of no records are read as such; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import gzip
import json
import re
import struct
import urllib.parse
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_grouped, materialise, scratch_path, small_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of compressed records that one range read fetches, and of a package before the next is begun.
RUN_BYTES, PACKAGE_BYTES = 8 << 20, 1 << 30
#: Bytes of records after decompression that are handed on at a time.
YIELD_BYTES = 16 << 20
#: Tasks that read runs, at most; beyond that many runs a task reads several, one after the other.
RUNS = 100_000
_DATE = "2024-01-01T00:00:00Z"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))  # Hadoop's names of the same store


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, before compression. With refers_to, a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=_SAFE)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def parse_record(raw: bytes) -> dict:
    """Fields of one decompressed record; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length"]
    revisit = named["warc-type"] == "revisit"
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload digest differs")
    whole = lambda k: int(named[k]) if k in named else None
    return {
        "page_id": whole("x-page-id"),
        "target_uri": named.get("warc-target-uri", ""),
        "record_type": named["warc-type"],
        "payload_bytes": sizes[0] if revisit else len(payload),
        "payload_digest": digest,
        "refers_to": whole("x-refers-to-page-id"),
        "payload": None if revisit else payload,
    }


class _Package:
    """A package being written to a stream."""

    def __init__(self, uri: str):
        import zipfile

        system, path = _open(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.stream = uri, system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.at, self.lines = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, page_id, url, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.member.write(packed)
        self.lines.append(json.dumps({"url": url or "", "offset": self.at, "length": len(packed), "filename": DATA}))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as out:
            for line in self.lines:
                out.write(line.encode() + b"\n")
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines)


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the packages; returns a written table (uri, records). An attempt's files are listed only if it succeeds."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    ids = materialise(keyed.select("id", "digest", F.octet_length("html").alias("n")), "page-digests")
    groups = ids.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("of"), F.max("n").alias("n"))
    total = ids.count()
    groups = groups.withColumn("first", F.when(F.col("n") >= least_bytes, F.col("first"))).drop("n")
    met = join_grouped(keyed, groups, "digest", "of", total, ["id", "url"])
    met = met.withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")))

    def write(batches):
        from pyspark import TaskContext

        task, made, out = TaskContext.get(), 0, None
        for batch in batches:
            for i, url, html, digest, refers in batch[["id", "url", "html", "digest", "refers_to"]].itertuples(index=False):
                if out is None:
                    out, made = _Package(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{made}.zip"), made + 1
                own = lambda v: None if pd.isna(v) else int(v)
                payload = html.encode("utf-8", "replace")
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                out.add(i, url, record_bytes(own(i), url, payload, name, own(refers)))
                if out.at >= PACKAGE_BYTES:
                    yield pd.DataFrame([out.close()], columns=["uri", "records"])
                    out = None
        if out is not None:
            yield pd.DataFrame([out.close()], columns=["uri", "records"])

    return materialise(met.mapInPandas(write, "uri string, records long"), "packages")


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (start, length) of a package's stored members. read(start, length) gives bytes of it."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, at, out = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, n, m, k = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        local, = struct.unpack("<I", directory[at + 42 : at + 46])
        name, extra = directory[at + 46 : at + 46 + n].decode(), directory[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, has = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64 sizes, of those fields only that overflow
                wide = iter(struct.unpack(f"<{has // 8}Q", extra[4 : 4 + has // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + has :]
        if method == 0:
            head = read(local, 30)
            a, b = struct.unpack("<HH", head[26:30])
            out[name] = (local + 30 + a + b, packed)
        at += 46 + n + m + k
    return out


def record_places(found: dict[str, tuple[int, int]], read) -> list[tuple[int, int]]:
    """(start, length) in the package of each record that its indexes list. found: the package's members.

    An index is a stored member under indexes/ whose lines end in a JSON object (CDXJ), gzipped
    or not; file names in it are members, or stand for members under archive/.
    """
    names = [n for n in found if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", n)]
    if not names:
        raise ValueError("no index of records in the package")
    out = []
    for name in names:
        lines = read(*found[name])
        for line in (gzip.decompress(lines) if name.endswith(".gz") else lines).splitlines():
            if b"{" not in line:
                continue
            at = json.loads(line[line.index(b"{") :])
            start, _ = found.get(at["filename"]) or found["archive/" + at["filename"]]
            out.append((start + int(at["offset"]), int(at["length"])))
    return out


def _reader(uri: str):
    system, path = _open(uri)
    file = system.open_input_file(path)
    return (lambda start, length: file.read_at(length, start)), file.size(), file


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """packages: (uri). One row per record: uri, page_id, target_uri, record_type, payload_bytes, payload_digest, refers_to, payload."""

    def locate(batches):
        for batch in batches:
            for uri in batch["uri"]:
                read, size, file = _reader(uri)
                with file:
                    places = sorted(record_places(members(read, size), read))
                out, begun = [], None
                for start, length in places:
                    if begun is None or start != begun + out[-1][2] or start + length - begun > RUN_BYTES:
                        begun = start
                        out.append([uri, start, 0, []])
                    out[-1][2] = start + length - begun
                    out[-1][3].append(length)
                yield pd.DataFrame(out, columns=["uri", "start", "length", "sizes"])

    def fetch(batches):
        for batch in batches:
            for uri, start, length, sizes in batch.itertuples(index=False):
                read, _, file = _reader(uri)
                with file:
                    data = read(start, length)
                at, held, out = 0, 0, []
                for k, n in enumerate(sizes):
                    record = zlib.decompress(data[at : at + n], 31)
                    at, held = at + n, held + len(record)
                    fields = parse_record(record)
                    out.append({"uri": uri} | (fields if payloads else fields | {"payload": None}))
                    if held >= YIELD_BYTES or k == len(sizes) - 1:
                        made = pd.DataFrame(out, columns=["uri", "page_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
                        made["page_id"], made["refers_to"] = made["page_id"].astype("Int64"), made["refers_to"].astype("Int64")
                        yield made if payloads else made.drop(columns="payload")
                        held, out = 0, []

    # a run's row is a few bytes but stands for RUN_BYTES of reading, so tasks follow the number of runs, not their size
    located = materialise(packages.select("uri").mapInPandas(locate, "uri string, start long, length long, sizes array<long>"), "runs")
    located = located.repartition(max(1, min(located.count(), RUNS)), "uri", "start")
    schema = "uri string, page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return located.mapInPandas(fetch, schema + (", payload binary" if payloads else ""))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = write_packages(pages, scratch_path(spark, "warc"))
    return read_packages(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 by hand: a digest's hexadecimal digits as bits, and these by fives as letters.
ORACLE_SQL = r"""
WITH pages_ AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS body FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(sha1(body), ''), lambda c:
    ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS b FROM pages_),
named AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT + 1, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY body) AS first FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM named
"""
