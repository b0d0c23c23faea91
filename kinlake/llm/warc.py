"""WARC archives: writing, reading, and resolution of revisits.

An archive is a file of gzip members, one for each record (more for records over MEMBER bytes),
written and committed by Spark's own text writer, so any file system and any lost task will do.
That writer ends each row with a separator; since a gzip member of under 16 MiB ends in a zero
byte, the row holds the member without it and the separator is the zero byte. Archives written
elsewhere (*.warc.gz, *.warc) are read too, each file whole by one task.

rewrite() shuffles headers by payload digest: of the records with one payload one becomes the
response and the others revisits of it, revisits of the source included. Payloads stay where
they are read: Bloom filters of the records that lose theirs, of the others that meet that filter,
and of the losers that meet the second one tell nearly all records apart, which are written or
passed over at once. Only payloads of records that meet all three, and of those that must move to
another record, are joined to their header; mostly there are none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.llm.work import Scratch

MEMBER = 8 << 20
RECORDS_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 16
HEADS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
#: What is known of a record without its payload; http is the head of its block, fields its own WARC headers that are kept.
RECORD = "rec string, kind string, page_id long, url string, date string, digest string, bytes long, http binary, refers string, refers_page long, carries boolean"
FILTER_BITS = (12, 26)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{payload_digest}')}>"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(rec: str, page_id: int | None, url: str | None, date: str, http: bytes, payload: bytes | None, payload_digest: str | None, size: int | None, original: tuple | None = None) -> bytes:
    """One record with fresh headers; original (page_id, rec, url, date) makes it a revisit, without payload."""
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {rec}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head += [] if payload_digest is None else [f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if original:
        page, of, uri, when = original
        head += [f"WARC-Profile: {PROFILE}"] + ([] if of is None else [f"WARC-Refers-To: {of}"])
        head += [] if uri is None else [f"WARC-Refers-To-Target-URI: {_safe(uri)}"]
        head += [f"WARC-Refers-To-Date: {when}"]
        head += [] if page is None else [f"X-Refers-To-Page-Id: {page}"]
        head += [] if size is None else [f"X-Payload-Length: {size}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def members(raw: bytes) -> Iterator[bytes]:
    for i in range(0, len(raw), MEMBER):
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
        yield gz.compress(raw[i : i + MEMBER]) + gz.flush()


def _stream(content: bytes) -> Iterator[bytes]:
    """The inflated bytes of all members of an archive, in blocks; an archive that isn't compressed as it is."""
    gz, view = zlib.decompressobj(31), memoryview(content)
    if content[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + _BLOCK]) for i in range(0, len(view), _BLOCK))
        return
    for i in range(0, len(view), _BLOCK):
        rest = bytes(view[i : i + _BLOCK])
        while rest:
            yield gz.decompress(rest)
            rest = b""
            if gz.eof:
                rest, gz = gz.unused_data, zlib.decompressobj(31)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    have = bytearray()
    need, headers = 0, None
    for block in _stream(content):
        have += block
        at = 0
        while True:
            if headers is None:
                end = have.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                lines = have[at:end].decode("utf-8", "replace").split("\r\n")[1:]
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                need, at = int(headers["content-length"]) + 4, end + 4
            if len(have) - at < need:
                break
            yield headers, bytes(have[at : at + need - 4])
            at += need
            headers = None
        del have[:at]
    if headers is not None or have:
        raise ValueError("the archive ends within a record")


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a block with the empty line after it, and the payload; a block without such a head is all payload."""
    end = block.find(b"\r\n\r\n") if block[:5] == b"HTTP/" else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def _head(headers: dict[str, str], block: bytes, checked: bool = False) -> tuple[list, bytes]:
    """A row of RECORD, and the payload (empty for revisits).

    The digest of a response is that of its payload here, and one that doesn't match the stated
    SHA-1 is an error, but for payloads in a transfer encoding, whose stated digest is of
    something else; a stated one that was checked before is taken as it is. Records that are
    neither response nor revisit have none."""
    number = lambda k: int(headers[k]) if headers.get(k, "").lstrip("-").isdigit() else None
    kind, name = headers["warc-type"], headers["warc-record-id"]
    row = [name, kind, number("x-page-id"), headers.get("warc-target-uri"), headers.get("warc-date", DATE)]
    stated = headers.get("warc-payload-digest", "")
    stated = stated[5:].upper() if stated[:5].lower() == "sha1:" and len(stated) == 37 else None
    http, payload = split_block(block)
    if kind == "response":
        plain = b"transfer-encoding" not in http.lower()
        found = stated if checked and stated and plain else digest(payload)
        if stated and found != stated and plain:
            raise ValueError(f"payload of {name} doesn't match its digest")
        return [*row, found, len(payload), http, None, None, True], payload
    if kind == "revisit":
        return [*row, stated, number("x-payload-length"), http, headers.get("warc-refers-to"), number("x-refers-to-page-id"), False], b""
    return [*row, None, None, b"", None, None, False], payload


def verbatim(headers: dict[str, str], block: bytes) -> bytes:
    """A record of a kind that rewriting passes on, with its own headers."""
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items())]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(rows: DataFrame, path: str) -> None:
    """rows: one column of gzip members."""
    rows.select(F.expr("cast(substring(member, 1, length(member) - 1) as string)").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a response record for every row, payload the html in UTF-8.

    A null html is an empty payload; a null url or page_id leaves its header out; repeated rows
    are repeated records; an empty table makes an archive without records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = h or b""
                own = digest(payload)
                out += members(record(record_id(i, u, own), i, u, DATE, http_head(len(payload)), payload, own, len(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    _write(pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("binary")).mapInArrow(run, "member binary"), path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "{part-*,*.warc,*.warc.gz}").load(path).select("content")


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
_NAMES = [f.split()[0] for f in RECORD.split(", ")]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row of RECORD for each record of any kind, read from whole archives; payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0):
                rows = [_head(h, b)[0] for h, b in records(c.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return _archives(spark, path).mapInArrow(run, RECORD)


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """A row of HEADS for each response and revisit; payloads are checked against their digests."""
    found = read_records(spark, path).where("kind in ('response', 'revisit')")
    return found.select("page_id", "url", F.col("kind").alias("record_type"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("refers_page").alias("refers_to"))


def resolve(found: DataFrame, least_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """The responses and revisits of RECORD rows with original (page_id, rec, url, date; null: the record is a response) and carrier, the record that has its payload.

    Records meet by payload digest. A revisit without a digest takes that of the record it refers
    to. Of records with one payload, of at least least_bytes, that with the largest page_id is the
    response; if several rows have that page_id, all of them are; if none has one, it is the
    record with the payload that has the least date, then the least id. A null page_id is below
    all others. A revisit whose payload is in no record of the archives stays what it is: carrier
    is null. The grouped values are combined before the shuffle, and are a table, so that the join
    back is one that adaptive execution splits where one payload has many records.
    """
    scratch = scratch or Scratch(found.sparkSession)
    found = found.where("kind in ('response', 'revisit')")
    bare = found.where("digest is null and refers is not null")
    known = found.where("carries").select(F.col("rec").alias("refers"), F.col("digest").alias("__d")).dropDuplicates(["refers"])
    found = found.where("digest is not null or refers is null").unionByName(bare.join(known, "refers", "left").withColumn("digest", F.col("__d")).drop("__d").select(*found.columns))
    place = F.struct("date", "rec", "page_id", "url")
    least = F.min(F.when(F.col("carries"), place))
    top = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rec", "url", "date")))
    groups = found.where("digest is not null").groupBy("digest").agg(least.alias("least"), top.alias("top"), F.max("bytes").alias("size"), F.count("*").alias("n"))
    groups = scratch.keep(groups.where("n > 1 and least is not null").drop("n"))
    met = found.join(groups, "digest", "left")
    small = F.coalesce("size", F.lit(0)) < least_bytes
    first = F.struct(F.col("least.page_id").alias("page_id"), F.col("least.rec").alias("rec"), F.col("least.url").alias("url"), F.col("least.date").alias("date"))
    chosen = F.coalesce("top", first)
    elected = F.when(F.col("top").isNotNull(), F.col("page_id").eqNullSafe(F.col("top.page_id"))).otherwise(F.col("rec") == F.col("least.rec"))
    stays = F.col("least").isNull() | small | elected
    return met.select(
        "rec", "page_id", "url", "date", "digest", F.coalesce("bytes", "size").alias("bytes"), "http", "refers", "refers_page", "carries",
        F.when(~stays, chosen).alias("original"),
        F.when(F.col("carries"), F.col("rec")).otherwise(F.col("least.rec")).alias("carrier"),
    )


def _places(rec: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    return tuple((rec >> np.uint64(s)) & np.uint64((1 << bits) - 1) for s in (0, 19, 38))


def _hashes(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)


def record_filter(names: DataFrame) -> np.ndarray:
    """A Bloom filter of the record ids in the first column, of 16 bits each and 8 MB at most."""
    bits = min(max((16 * names.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for batch in batches:
            for place in _places(_hashes(batch.column(0).to_pylist()), bits):
                own[place] = True
        packed = np.packbits(own, bitorder="little").view(np.uint64)
        w = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(packed[w].view(np.int64))], ["w", "bits"])

    rows = names.mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most 2 ** 20 rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _met(filter_: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(names), bool)
    for place in _places(_hashes(names), (64 * len(filter_)).bit_length() - 1):
        out &= (filter_[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _meeting(names: DataFrame, filter_) -> DataFrame:
    """Those of the names (a column rec) that meet a broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _met(filter_.value, batch.column(0).to_pylist()) if batch.num_rows else []
            yield batch.filter(pa.array(keep, pa.bool_()))

    return names.select("rec").mapInArrow(run, "rec string")


class Sorter:
    """Tells by its id whether a record with a payload keeps it (True), loses it (False), or can't be told (None)."""

    def __init__(self, filters: list[np.ndarray]):
        self.filters = [(f.tobytes(), (64 * len(f)) - 1) for f in filters]

    def __call__(self, name: str) -> bool | None:
        h = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        for level, (bits, mask) in enumerate(self.filters):
            for shift in (0, 19, 38):
                place = h >> shift & mask
                if not bits[place >> 3] >> (place & 7) & 1:
                    return level % 2 == 0
        return None


def rewrite(spark: SparkSession, source: str, target: str, least_bytes: int = 0, scratch: Scratch | None = None) -> None:
    """Reads the archives of source and writes them to target with revisits resolved and fresh headers.

    Records of other kinds are passed on with their own headers. Record ids must be unique to a
    payload. Rewriting what was rewritten changes nothing but the order of records.
    """
    scratch = scratch or Scratch(spark)
    every = scratch.keep(read_records(spark, source))
    found = scratch.keep(resolve(every, least_bytes, scratch))
    scratch.release(every)
    own, losers = found.where("carries and original is null"), found.where("carries and original is not null")
    filters = [record_filter(losers.select("rec"))]
    unclear = scratch.keep(_meeting(own, spark.sparkContext.broadcast(filters[0])).distinct())
    filters.append(record_filter(unclear))
    filters.append(record_filter(_meeting(losers, spark.sparkContext.broadcast(filters[1]))))
    unclear = _meeting(unclear, spark.sparkContext.broadcast(filters[2]))
    sorter = spark.sparkContext.broadcast(Sorter(filters))
    moved = found.where("not carries and original is null and carrier is not null").select(F.col("carrier").alias("rec"))
    wanted = scratch.keep(unclear.unionByName(moved).distinct())

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of all records that need no join."""
        keeps = sorter.value
        for batch in batches:
            for c in batch.column(0):
                out = []
                for h, b in records(c.as_py()):
                    if h["warc-type"] not in ("response", "revisit"):
                        out += members(verbatim(h, b))
                    elif h["warc-type"] == "response" and keeps(h["warc-record-id"]):
                        (rec, _, page, url, date, own_digest, size, http, *_), payload = _head(h, b, True)
                        out += members(record(rec, page, url, date, http, payload, own_digest, size))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(carrier, body) of the payloads that may be wanted."""
        for batch in batches:
            for c in batch.column(0):
                rows = [(h["warc-record-id"], zlib.compress(split_block(b)[1], 1)) for h, b in records(c.as_py()) if h["warc-type"] == "response" and _met(wanted_.value, [h["warc-record-id"]])[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["carrier", "body"])

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of the revisits, and of the responses whose payload was joined to them."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body = None if r["body"] is None else zlib.decompress(r["body"])
                o = r["original"]
                original = (o["page_id"], o["rec"], o["url"], o["date"]) if o else (r["refers_page"], r["refers"], None, r["date"]) if r["carrier"] is None else None
                out += members(record(r["rec"], r["page_id"], r["url"], r["date"], r["http"], body, r["digest"], r["bytes"], original))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    cols = ["rec", "page_id", "url", "date", "http", "digest", "bytes", "refers", "refers_page", "original", "carrier"]
    texts = _archives(spark, source)
    rows = found.where("original is not null or carrier is null").select(*cols, F.lit(None).cast("binary").alias("body"))
    if not wanted.isEmpty():
        wanted_ = spark.sparkContext.broadcast(record_filter(wanted))
        needed = scratch.keep(texts.mapInArrow(bodies, "carrier string, body binary").join(wanted.withColumnRenamed("rec", "carrier"), "carrier", "left_semi").dropDuplicates(["carrier"]))
        late = own.join(unclear, "rec", "left_semi").unionByName(found.where("not carries and original is null and carrier is not null"))
        rows = rows.unionByName(late.select(*cols).join(needed, "carrier").select(*cols, "body"))
    _write(texts.mapInArrow(at_once, "member binary").unionByName(rows.mapInArrow(headed, "member binary")), target)


def deduplicate(pages: DataFrame, least_bytes: int = 0, scratch: Scratch | None = None) -> tuple[DataFrame, str]:
    """Archives of all pages with revisits resolved: what they hold, read back from them, and their folder.

    Every row of pages, repeated or not, has its record; other columns are left out.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    raw, final = scratch.path(), scratch.path()
    write_pages(pages, raw)
    rewrite(pages.sparkSession, raw, final, least_bytes, scratch)
    return read_heads(pages.sparkSession, final), final
