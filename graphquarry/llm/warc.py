"""WARC: monolithic archives, a gzip normaliser with a sidecar offset index, and reading back.

``write_archives`` writes one record a page as whole-file gzip streams. ``normalise``
inflates each stream once, rewrites every record as a gzip member of its own, and in the
same pass writes an index line (offset, length, id) a record beside the archive.
``read_archives`` goes through whole archives, member by member, where they lie: no archive's
bytes are exchanged; ``checked`` holds what it found against the index. ``read_records`` opens only
the archives in which the index has the wanted pages, and inflates only those members.

Both outputs go through Spark's text writer, hence to any store that Spark knows. Its
line separator after a member is one zero byte: that is the last byte of the member's
length field for records under 16 MiB, and zero padding between members, which gzip
allows, for larger ones.

Defined cases: null html counts as empty; of equal payloads of at least ``least`` bytes
the one with the smallest page_id is a response and the others revisit it, rows that
share that page_id all being responses; rows that repeat a page_id with another html are
records of their own, each compared by its own payload; smaller payloads are all responses, as are rows
without a page_id; urls have
blanks and control characters percent-encoded; repeated rows are written each; an empty
table gives an empty result; other columns are ignored. One archive file must fit in a
task's memory, hence ``archive_bytes``; a single record may be larger and is then alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.plans.storage import exists, materialise, new_path, remove

#: Payload bytes from which equal payloads are written once.
LEAST = 100
#: At most about so many payload bytes go to one archive.
ARCHIVE_BYTES = 32 << 20
FOUND = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, part string, offset bigint, length bigint"
#: Pages, and archives that hold them, up to which ``read_records`` goes by the index.
LOOKUP_PAGES, LOOKUP_ARCHIVES = 100_000, 1000
_INFLATE = 1 << 18
_PART = r"part-(\d+)-"


def classify(pages: DataFrame, dealt: DataFrame, least: int = LEAST) -> DataFrame:
    """``dealt``, the pages with their digests, dealt out by page_id and digest, with refers_to (null for responses); their texts move only once."""
    facts = pages.select("page_id", payload_digest().alias("digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    facts = materialise(facts, "payload_facts")
    groups = facts.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).filter("first_id <> last_id")
    revisits = facts.join(groups, "digest").filter("page_id <> first_id").select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()
    return dealt.join(revisits, ["page_id", "digest"], "left")


def payload_digest() -> Column:
    return F.unhex(F.sha2(F.encode("html", "UTF-8"), 256))


def record_text(html: Column, least: int = LEAST) -> Column:
    """A WARC record, less the line end that the writer adds."""
    digest = F.lower(F.hex("digest"))
    size = F.octet_length(html).cast("string")
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("\r\n"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), " ", "%20"), r"[\x00-\x1f\x7f]", "%0A")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", size), line(""))
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    head = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <urn:page:", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), ">"),
        line("WARC-Target-URI: ", uri),
        line("WARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Payload-Digest: sha256:", digest),
        F.when(revisit, F.concat(line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To: <urn:page:", F.col("refers_to").cast("string"), ">"))).otherwise(""),
        line("Content-Type: application/http;msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        line(""),
    )
    return F.concat(head, block, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record a row of (page_id, url, html), as whole-file gzip streams under ``path``."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    total = slim.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    archives = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // archive_bytes))
    dealt = slim.withColumn("digest", payload_digest()).repartition(archives, "page_id", "digest")
    records = classify(slim, dealt, least).sortWithinPartitions("page_id")
    records.select(record_text(F.col("html"), least).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 0).text(path)


class RecordStream:
    """Records of a gzip stream that arrives in pieces; one inflation of the whole."""

    def __init__(self) -> None:
        self.held, self.inflate = bytearray(), zlib.decompressobj(31)

    def feed(self, data: bytes) -> Iterator[bytes]:
        view = memoryview(data)
        for k in range(0, len(view), _INFLATE):
            part = bytes(view[k : k + _INFLATE])
            while part:
                self.held += self.inflate.decompress(part)
                part = self.inflate.unused_data
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                    part = part.lstrip(b"\0")
                else:
                    break
            yield from self.whole()

    def whole(self) -> Iterator[bytes]:
        start = 0
        while (end := self.held.find(b"\r\n\r\n", start)) >= 0:
            size = int(re.search(rb"\r\nContent-Length: (\d+)", self.held[start:end])[1])
            stop = end + 4 + size + 4
            if len(self.held) < stop:
                break
            yield bytes(self.held[start:stop])
            start = stop
        del self.held[:start]


def member_of(record: bytes) -> tuple[bytes, int]:
    """The record as a gzip member without the byte that the writer adds, and the length it has in the archive."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = deflate.compress(record) + deflate.flush()
    return (member[:-1], len(member)) if member[-1] == 0 else (member, len(member) + 1)


def _id(text: bytes) -> int | None:
    return None if text == b"null" else int(text)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    offset = seq = 0
    for batch in batches:
        for content in batch.column("content"):
            out: list[tuple[str, int, bytes]] = []
            size = 0
            for record in RecordStream().feed(content.as_buffer()):
                member, length = member_of(record)
                page = _id(re.search(rb"WARC-Record-ID: <urn:page:([^>]+)>", record)[1])
                line = json.dumps({"offset": offset, "length": length, "page_id": page})
                out += [("index", seq, line.encode()), ("warc", seq, member)]
                offset, seq, size = offset + length, seq + 1, size + length
                if size > _INFLATE * 16:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)


def _rows(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "seq", "member"])


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrites the archives of ``source`` to ``target``/kind=warc, and their index to ``target``/kind=index.

    An archive and its index have the same part number.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("content").mapInArrow(_rewrite, "kind string, seq bigint, member binary")
    rows = rows.sortWithinPartitions("kind", "seq").select("kind", F.col("member").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 0).partitionBy("kind").text(target)


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an archive's members in turn; zero padding counts to the member before it."""
    at = 0
    while at < len(content):
        start, out, inflate = at, [], zlib.decompressobj(31)
        while not inflate.eof:
            if at >= len(content):
                raise ValueError(f"the member at {start} has no end")
            part = content[at : at + _INFLATE]
            out.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        while at < len(content) and not content[at]:
            at += 1
        yield start, at - start, b"".join(out)


def parsed(record: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (None for revisits) of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    kind, page = headers[b"WARC-Type"].decode(), _id(headers[b"WARC-Record-ID"][10:-1])
    http, _, payload = rest[: int(headers[b"Content-Length"])].partition(b"\r\n\r\n")
    if kind == "response":
        return page, len(payload), hashlib.sha256(payload).hexdigest(), kind, None, payload
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return page, size, headers[b"WARC-Payload-Digest"].partition(b":")[2].decode(), kind, int(headers[b"WARC-Refers-To"][10:-1]), None


def _fields(payloads: bool) -> str:
    return FOUND + ", payload binary" * payloads


def _reader(payloads: bool):
    """Records of archives (part, content[, places]): all, or those at the places."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in _fields(payloads).split(", ")]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places").to_pylist() if "places" in batch.schema.names else [None] * batch.num_rows
            for part, content, wanted in zip(batch.column("part").to_pylist(), batch.column("content"), places, strict=True):
                view, found, size = memoryview(content.as_buffer()), [], 0
                if wanted is None:
                    records = members(view)
                else:
                    records = ((p["offset"], p["length"], next(members(view[p["offset"] : p["offset"] + p["length"]]))[2]) for p in wanted)
                for offset, length, record in records:
                    *facts, payload = parsed(record)
                    found.append((*facts, part, offset, length, payload))
                    size += len(payload or b"") * payloads + 100
                    if size > _INFLATE * 16:
                        yield rows(found)
                        found, size = [], 0
                if found:
                    yield rows(found)

    return run


def _archives(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select(F.regexp_extract("path", _PART, 1).alias("part"), "content")


def read_archives(spark: SparkSession, target: str, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, place and, if asked for, payload (null for revisits) of every record."""
    if not exists(spark, f"{target}/kind=warc"):  # no record was written
        return spark.createDataFrame([], _fields(payloads))
    return _archives(spark, f"{target}/kind=warc").mapInArrow(_reader(payloads), _fields(payloads))


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """part, offset, length and page_id of every record, from the sidecar files."""
    if not exists(spark, f"{target}/kind=index"):
        return spark.createDataFrame([], "part string, offset bigint, length bigint, page_id bigint")
    lines = spark.read.option("lineSep", "\0").text(f"{target}/kind=index")
    place = F.from_json("value", "offset bigint, length bigint, page_id bigint")
    return lines.select(F.regexp_extract(F.input_file_name(), _PART, 1).alias("part"), place.alias("place")).select("part", "place.*")


def checked(found: DataFrame, index: DataFrame) -> DataFrame:
    """The records, held against the index; only places and facts are exchanged.

    A record that the index lacks or has under another page, and an index line without a record, raise an error
    that names the place: nothing goes without a word.
    """
    there = found.withColumn("_record", F.lit(True))
    named = index.select("part", "offset", "length", F.col("page_id").alias("_page"), F.lit(True).alias("_line"))
    both = there.join(named, ["part", "offset", "length"], "full_outer")
    agrees = F.col("_record").isNotNull() & F.col("_line").isNotNull() & F.col("page_id").eqNullSafe(F.col("_page"))
    place = F.concat(F.lit("archive and index differ at "), F.concat_ws(" ", "part", "offset", "length"))
    return both.filter(F.when(agrees, True).otherwise(F.raise_error(place).cast("boolean"))).drop("_page", "_record", "_line")


def read_records(spark: SparkSession, target: str, pages: DataFrame) -> DataFrame:
    """The records, with payloads, of the pages (page_id).

    Up to LOOKUP_PAGES records in LOOKUP_ARCHIVES archives are read by the index; for more, the archives are read whole.
    """
    asked = pages.select(F.col("page_id").cast("long").alias("page_id")).filter("page_id is not null").distinct()
    places = read_index(spark, target).join(asked, "page_id", "left_semi")
    few = places.limit(LOOKUP_PAGES + 1).collect()
    parts = sorted({r["part"] for r in few})
    if len(few) > LOOKUP_PAGES or len(parts) > LOOKUP_ARCHIVES:
        return read_archives(spark, target).join(asked, "page_id", "left_semi").select(*[x.split()[0] for x in _fields(True).split(", ")])
    if not few:
        return spark.createDataFrame([], _fields(True))
    by_part = spark.createDataFrame([(r["part"], r["offset"], r["length"]) for r in few], "part string, offset bigint, length bigint")
    by_part = by_part.groupBy("part").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    archives = _archives(spark, *[f"{target}/kind=warc/part-{p}-*" for p in parts])
    return archives.join(F.broadcast(by_part), "part").mapInArrow(_reader(True), _fields(True))


def round_trip(pages: DataFrame, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, payloads: bool = False) -> DataFrame:
    """Writes, normalises and reads back the pages: all records, without payloads those that the index bears out."""
    spark = pages.sparkSession
    raw, fine = new_path(spark, "warc-raw"), new_path(spark, "warc")
    write_archives(pages, raw, least, archive_bytes)
    normalise(spark, raw, fine)
    remove(spark, raw)
    found = read_archives(spark, fine, payloads)
    found = found if payloads else checked(found, read_index(spark, fine))
    return found.drop("part", "offset", "length")
